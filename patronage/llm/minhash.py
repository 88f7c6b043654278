"""MinHash near-duplicates by an inverted join on signature coordinates.

A signature has ``COORDINATES`` values; two texts of similarity s agree in each with probability s.
Every coordinate and its value is a posting key. Two texts that agree in at least ``least`` keys
must share one among the first ``COORDINATES - least + 1`` of each, whatever common order the keys
have (prefix merging). The order is rarest first, so keys of passages that many texts share are
not posted, and a text whose keys are mostly its own is skipped altogether (skip merging).

Collisions are counted in blocks: each text is in one chunk, under its most widely shared key; chunks
hold a bounded number of texts and meet themselves, then the other chunks they share a key with,
unless all of their texts are linked already. A task sees two chunks, merges the posting lists of
their coordinates, and counts in how many lists each two texts meet. Pairs that meet in at least
``least`` are compared on their full sets, no others. The task returns a spanning forest of the links
instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.texts import (
    _BASE, mix64, pieces, shingle_hashes, text_bytes, word_hashes)
from patronage.operators.components import connected_components
from patronage.session import settle

COORDINATES = 64
CHUNK_TEXTS = 256
CHUNK_SHINGLES = 120_000
_SALTS = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(_BASE))
_MULTIPLY = (_SALTS[:COORDINATES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_SALTS[COORDINATES:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each piece of a column: distinct shingle hashes of its texts, sorted, and their bounds."""
    data, bounds = text_bytes(column)
    for a, b in pieces(bounds):
        words, at = word_hashes(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
        shingles, at = shingle_hashes(words, at, size)
        sets = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            s = np.sort(shingles[i:j])
            sets.append(s[np.diff(s, prepend=~s[:1]) != 0])
        sizes = np.array([len(s) for s in sets], np.int64)
        yield np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])


def _signatures(size: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for shingles, at in shingle_sets(batch.column(1), size):
                n = len(at) - 1
                full = np.flatnonzero(np.diff(at))
                values = np.zeros((n, COORDINATES), np.uint32)
                marks = np.zeros((n, 2), np.uint64)
                if len(full):
                    low = (shingles >> np.uint64(32)).astype(np.uint32)
                    for k in range(COORDINATES):
                        values[full, k] = np.minimum.reduceat(low * _MULTIPLY[k] + _ADD[k], at[full])
                    for k, salt in enumerate(_SALTS[:2]):
                        marks[full, k] = np.add.reduceat(mix64(shingles ^ salt), at[full])
                keys = values.view(np.int32)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * COORDINATES)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(done, n), pa.array(np.diff(at)),
                    pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], schema=schema)
                done += n
    return run


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, mark1, mark2, keys) per row of (id, text): set size, set digest, signature."""
    out = docs.select("id").withColumns({
        "n": F.lit(0).cast("bigint"), "mark1": F.lit(0).cast("bigint"),
        "mark2": F.lit(0).cast("bigint"), "keys": F.lit(None).cast("array<int>")})
    return docs.select("id", "text").mapInArrow(_signatures(size, _arrow(out)), out.schema)


def _sets(size: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for shingles, at in shingle_sets(batch.column(1), size):
                n, raw = len(at) - 1, memoryview(shingles.tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(done, n),
                    pa.array([raw[8 * a:8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
                             pa.binary())], schema=schema)
                done += n
    return run


def _roots(links: np.ndarray, n: int, known: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, on top of what is known to be linked."""
    parent = {int(g): int(g) for g in set(known.tolist())}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for a, b in links.tolist():
        x, y = root(int(known[a])), root(int(known[b]))
        if x != y:
            parent[x] = y
            forest.append((a, b))
    return forest


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``left`` shares with each of ``right``, counted value by value."""
    sets = [*left, *right]
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    fresh = np.diff(values[order], prepend=~values[order][:1]) != 0
    column = np.cumsum(fresh) - 1
    often = np.bincount(column) > 1
    column, owner = column[often[column]], owner[often[column]]
    column = (np.cumsum(np.diff(column, prepend=-1) != 0) - 1)
    common = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, total + step, step))
    for k in range(len(cuts) - 1):
        part = np.zeros((len(sets), step), np.float32)
        part[owner[cuts[k]:cuts[k + 1]], column[cuts[k]:cuts[k + 1]] - k * step] = 1
        common += part[:len(left)] @ part[len(left):].T
    return common.astype(np.int64)


def _similar(left: list[np.ndarray], right: list[np.ndarray], left_posts: list[np.ndarray],
             right_posts: list[np.ndarray], least: int, percent: int) -> np.ndarray:
    """Index pairs (i, j) that collide in ``least`` posting lists and, confirmed on the sets, have
    100 * intersection >= percent * union."""
    collide = _shared(left_posts, right_posts) >= least
    rows, columns = np.flatnonzero(collide.any(1)), np.flatnonzero(collide.any(0))
    if not len(rows):
        return np.empty((0, 2), np.int64)
    some, others = [left[i] for i in rows], [right[j] for j in columns]
    common = _shared(some, others)
    both = (np.array([len(s) for s in some])[:, None] + np.array([len(s) for s in others]))
    linked = (100 * common >= percent * (both - common)) & (common > 0) & collide[np.ix_(rows, columns)]
    i, j = np.nonzero(linked)
    return np.stack([rows[i], columns[j]], 1)


def _posts(keys: list[int]) -> np.ndarray:
    """The posting lists of a signature: coordinate and value as one number."""
    return (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | np.array(
        keys, np.int32).view(np.uint32).astype(np.uint64)


def _block_links(least: int, percent: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                left = batch.column(0)[at].as_py()
                right = batch.column(1)[at].as_py()
                every = left if right is None else left + right
                sets = [np.frombuffer(d["set"], np.uint64) for d in every]
                posts = [_posts(d["keys"]) for d in every]
                n = len(left)
                pairs = _similar(sets[:n], sets if right is None else sets[n:], posts[:n],
                                 posts if right is None else posts[n:], least, percent)
                if right is None:
                    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
                else:
                    pairs = pairs + [0, n]
                names, known = np.unique([d["known"] for d in every], return_inverse=True)
                forest = _roots(pairs, len(every), known)
                if forest:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([every[a]["id"] for a, _ in forest], schema.field(0).type),
                        pa.array([every[b]["id"] for _, b in forest], schema.field(1).type)],
                        schema=schema)
    return run


def _chunked(members: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(chunk, docs): one row per chunk with its texts' ids, sets, signatures and known classes."""
    return (members.join(sets, "id").join(keys, "id").groupBy("chunk")
            .agg(F.collect_list(F.struct("id", "known", "set", "keys")).alias("docs")))


def _links(pairs: DataFrame, chunks: DataFrame, least: int, percent: int, id_type: str) -> DataFrame:
    """Links within the pairs of chunks (a, b); b is null for a chunk with itself."""
    sides = (pairs.join(chunks.select(F.col("chunk").alias("a"), F.col("docs").alias("left")), "a")
             .join(chunks.select(F.col("chunk").alias("b"), F.col("docs").alias("right")), "b",
                   "left").select("left", "right"))
    empty = sides.sparkSession.createDataFrame([], f"u {id_type}, v {id_type}")
    return sides.mapInArrow(_block_links(least, percent, _arrow(empty)), empty.schema)


def _salted(homes: DataFrame) -> DataFrame:
    """Adds to (id, n, known, home, part) the chunk: home, part, and a salt that bounds its size."""
    sizes = homes.groupBy("home", "part").agg(F.greatest(
        F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("salts"))
    return homes.join(sizes, ["home", "part"]).withColumn("chunk", F.concat_ws(
        ":", "home", "part", F.pmod(F.xxhash64("id"), F.col("salts")))).drop("salts")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80, least: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs without white space, A-Z folded; a text's set has its distinct runs of
    ``shingle`` words, or all its words as one if there are fewer. Texts are linked when
    100 * intersection >= percent * union. Sets are compared as 64-bit hashes of shingles.
    ``component_id`` is the smallest id reachable over links, and ``kept`` tells whether it is the
    row's own. ``least`` is the number of the 64 signature values in which candidates must agree;
    the default is 4.5 standard deviations below what the weakest link has on average.

    Null, empty and blank texts have no shingles and no links. Rows that repeat an id count as
    texts of one document and share its fate. A row without an id has no links, no component, and
    is kept. An empty table gives an empty result. Other columns are not looked at.
    """
    level = percent / 100
    if least is None:
        least = int(COORDINATES * level - 4.5 * (COORDINATES * level * (1 - level)) ** 0.5)
    least = max(1, least)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    signed = settle(signatures(texts, shingle))
    linked = signed.filter("n > 0 and id is not null")
    classes = settle(linked.groupBy("mark1", "mark2").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    posted = (classes.select(F.col("rep").alias("id"), "n", F.posexplode("keys").alias("k", "value"))
              .select("id", "n", (F.col("k") * F.lit(1 << 32) + F.col("value")).alias("key")))
    often = posted.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    prefix = (posted.join(often, "key").groupBy("id", "n")
              .agg(F.sort_array(F.collect_list(F.struct("rows", "key"))).alias("keys"))
              .filter(F.size("keys") >= least)
              .select("id", "n", F.explode(F.expr(f"slice(keys, 1, size(keys) - {least - 1})"))
                      .alias("post"))
              .select("id", "n", F.col("post.key").alias("key")))
    prefix = settle(prefix)
    shared = prefix.groupBy("key").agg(F.count("*").alias("shared")).filter("shared > 1")
    posts = settle(prefix.join(shared, "key"))

    sets_schema = posts.select("id").withColumn("set", F.lit(b"").cast("binary"))
    wanted = texts.join(posts.select("id").distinct(), "id", "left_semi")
    sets = settle(wanted.mapInArrow(_sets(shingle, _arrow(sets_schema)), sets_schema.schema))
    signed_sets = (sets, classes.select(F.col("rep").alias("id"), "keys"))

    # First: every chunk with itself, and the chunks of one home with its first.
    homes = posts.groupBy("id", "n").agg(F.max(F.struct("shared", "key")).alias("home")).select(
        "id", "n", F.col("id").alias("known"), F.col("home.key").alias("home"),
        F.lit(0).alias("part"))
    alone = settle(_salted(homes))
    names = alone.select("chunk", "home").distinct()
    of_home = names.groupBy("home").agg(F.min("chunk").alias("b"), F.count("*").alias("chunks"))
    itself = F.lit(None).cast("string").alias("b")
    star = names.join(of_home.filter("chunks > 1"), "home").filter("chunk <> b")
    pairs = names.select(F.col("chunk").alias("a"), itself).unionByName(
        star.select(F.col("chunk").alias("a"), "b"))
    links = settle(_links(pairs, settle(_chunked(alone, *signed_sets)), least, percent, id_type))

    # Then: chunks that share a key, unless all their texts under that key are linked already.
    # Where a home has several chunks, its largest class gets chunks of its own, which need no
    # comparison among themselves.
    linked_now = connected_components(links).select(F.col("node").alias("id"), "root")
    known = settle(alone.drop("known", "part", "chunk").join(linked_now, "id", "left")
                   .select("id", "n", "home", F.coalesce("root", "id").alias("known")))
    largest = (known.groupBy("home", "known").agg(F.count("*").alias("rows")).groupBy("home")
               .agg(F.max(F.struct("rows", "known")).alias("top")))
    # A plain join of written tables, so that a home with most of the rows can be split.
    tops = settle(largest.join(of_home, "home"))
    parts = settle(known.join(tops, "home").select(
        "id", "n", "known", "home", F.when(F.col("chunks") > 1, F.when(
            F.col("known") == F.col("top.known"), 2).otherwise(1)).otherwise(0).alias("part")))
    again = settle(_salted(parts))
    under = settle(posts.select("id", "key").join(again.select("id", "known", "chunk", "part"), "id")
                   .groupBy("key", "chunk", "part")
                   .agg(F.min("known").alias("low"), F.max("known").alias("high")))
    left = under.select("key", F.col("chunk").alias("a"), F.col("low").alias("low_a"),
                        F.col("high").alias("high_a"))
    right = under.select("key", F.col("chunk").alias("b"), F.col("low").alias("low_b"),
                         F.col("high").alias("high_b"))
    across = (left.join(right, "key").filter("a < b")
              .filter("least(low_a, low_b) <> greatest(high_a, high_b)").select("a", "b").distinct())
    mixed = under.filter("part = 1 and low <> high").select(F.col("chunk").alias("a"), itself) \
        .distinct()
    more = settle(_links(across.unionByName(mixed), settle(_chunked(again, *signed_sets)), least, percent, id_type))

    final = connected_components(links.unionByName(more))
    lowest = final.join(final.groupBy("root").agg(F.min("node").alias("component")), "root") \
        .select(F.col("node").alias("rep"), "component")
    of_class = classes.select("mark1", "mark2", "rep").join(lowest, "rep", "left").select(
        "mark1", "mark2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "mark1", "mark2").join(of_class, ["mark1", "mark2"], "left")
    component = F.when(F.col("id").isNotNull(),
                       F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
