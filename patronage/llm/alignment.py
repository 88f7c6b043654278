"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

Tokens of both are sorted by where they start; where a start reaches the largest end so far, both
have a token border, and a group of tokens ends. Inside a group each token meets those of the other
side that it overlaps. Of these pairs the links are those that also end together.

Alignments are written as a table of chunks of about ``CHUNK_LINKS`` links, in which a document
stays whole: ``ids``, ``n_*`` and the checksum of the groups per document; ``a`` and ``b`` the token
ids of all of them, as little-endian unsigned integers of ``width`` bytes; ``a_last`` and ``b_last``
one bit a token, set where the token is the last of its side in its group; ``pairs`` (a << 32 | b,
ascending) and ``times`` the linked pairs of the chunk and how often each occurs; ``places`` the place
of each link's pair among them, in 4 bytes. Ids, bits and places are zstandard frames. Pairs are
counted over the corpus from the chunks' own counts, so a pair that occurs everywhere is one row a
chunk, and the counts return to a chunk as one list as long as ``pairs``; tokens are not moved for it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from patronage.llm.texts import pieces, ragged, text_bytes
from patronage.llm.tokens import _Encoder
from patronage.session import settle

CHUNK_LINKS = 1 << 18
LOW = (1 << 32) - 1

_vocabularies: dict[tuple[str, str], "_Vocabularies"] = {}


class _PlainEncoder(_Encoder):
    """Ids of texts in which the strings of added tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for.

    Visible signs of Latin-1 stand for themselves, the other bytes, in order, for U+0100 and on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Bytes:
    """The bytes of every id of a vocabulary, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[ids], self.length[ids])]


class _Vocabularies:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = _PlainEncoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs, names = _byte_of_sign(), {i: t for t, i in self.a.tokenizer.get_vocab().items()}
        self.a_bytes = _Bytes([bytes(signs[c] for c in names[i]) if all(c in signs for c in names[i])
                               else names[i].encode() for i in range(max(names) + 1)])
        pieces_ = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = _Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i)
                               else p.replace("▁", " ").encode() for i, p in pieces_])
        largest = max(len(self.a_bytes.length), len(self.b_bytes.length))
        self.width = 2 if largest <= 1 << 16 else 4
        self.names = _names(largest)


def _vocabulary(a_path: str, b_path: str) -> _Vocabularies:
    if (a_path, b_path) not in _vocabularies:
        _vocabularies[a_path, b_path] = _Vocabularies(a_path, b_path)
    return _vocabularies[a_path, b_path]


def _flat(parts: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(itertools.chain.from_iterable(parts), np.int64, int(counts.sum())), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive stretches of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _faithful(ids: np.ndarray, counts: np.ndarray, table: _Bytes, data: np.ndarray,
              sizes: np.ndarray) -> np.ndarray:
    """Which texts, of ``sizes`` bytes of ``data`` each, their tokens' bytes give back."""
    good = _sums(table.length[ids], counts) == sizes
    got = table.joined(ids[np.repeat(good, counts)])
    differs = got != data[np.repeat(good, sizes)]
    good[good] = _sums(differs.astype(np.int64), sizes[good]) == 0
    return good


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """The group of every a and every b token, numbered from 0 in the order of the bytes."""
    start = np.concatenate([a_start, b_start])
    end = np.concatenate([a_end, b_end])
    side = np.repeat(np.arange(2), [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    new = np.zeros(len(order), np.int64)
    new[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return group[:len(a_start)], group[len(a_start):]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b), as places, of tokens that share a byte; each side's tokens are in order."""
    first = np.searchsorted(b_end, a_start, "right")
    met = np.searchsorted(b_start, a_end, "left") - first
    return np.repeat(np.arange(len(a_start)), met), ragged(first, met)


def _names(largest: int) -> list[str]:
    """What is written for a token: its id and the sign after it, by side and place in its group."""
    ids = [str(i) for i in range(largest)]
    return [i + sign for sign in ",|;" for i in ids]


def _written(names: list[str], a: np.ndarray, a_last: np.ndarray, b: np.ndarray, b_last: np.ndarray,
             n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
    """Every text's groups as ``a1,a2|b1;a3|b2,b3``."""
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group))])  # a tokens up to a group
    b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group))])
    code, third = np.empty(len(a) + len(b), np.int64), len(names) // 3
    code[np.arange(len(a)) + b_before[a_group]] = a + third * a_last
    code[np.arange(len(b)) + a_before[b_group + 1]] = b + 2 * third * b_last
    cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    shown = list(map(names.__getitem__, code.tolist()))
    return ["".join(shown[x:y])[:-1] for x, y in zip(cuts, cuts[1:])]


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def _aligned(vocabulary: _Vocabularies, data: np.ndarray, bounds: np.ndarray) -> dict:
    """Tokens, groups and links of the texts of one piece, flat, with counts per text."""
    n = len(bounds) - 1
    texts = [data[x:y].tobytes().decode() for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
    spaced, spaced_bounds = np.insert(data, bounds[:-1], 32), bounds + np.arange(n + 1)
    sizes = np.diff(spaced_bounds)
    a, n_a = _flat(vocabulary.a.encode(spaced, spaced_bounds))
    b, n_b = _flat(vocabulary.b.encode(texts, num_threads=1))
    good = ((sizes > 1) & _faithful(a, n_a, vocabulary.a_bytes, spaced, sizes)
            & _faithful(b, n_b, vocabulary.b_bytes, spaced, sizes))
    a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    a_end, b_end = np.cumsum(vocabulary.a_bytes.length[a]), np.cumsum(vocabulary.b_bytes.length[b])
    a_start, b_start = a_end - vocabulary.a_bytes.length[a], b_end - vocabulary.b_bytes.length[b]
    a_group, b_group = coalesce(a_start, a_end, b_start, b_end)
    left, right = overlaps(a_start, a_end, b_start, b_end)
    together = a_end[left] == b_end[right]
    left, right = left[together], right[together]
    a_last, b_last = (np.diff(g, append=g[-1:] + 1) != 0 for g in (a_group, b_group))
    text_of = np.repeat(np.arange(n), n_a)
    shown = _written(vocabulary.names, a, a_last, b, b_last, n_a, n_b)
    return {"digests": np.array([_digest(t) for t in shown], object), "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text_of[a_last], minlength=n),
            "n_links": np.bincount(text_of[left], minlength=n), "a": a, "b": b, "a_last": a_last,
            "b_last": b_last, "pairs": a[left] << 32 | b[right]}


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _spread(frame: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(frame.as_py()), kind)


def _chunk(number: int, width: int, ids: list, parts: list[dict]) -> dict:
    joined = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    pairs, places, times = np.unique(joined["pairs"], return_inverse=True, return_counts=True)
    return ({"chunk": number, "width": width, "ids": ids}
            | {k: joined[k].tolist() for k in _COUNTS}
            | {k: _squeezed(joined[k].astype(f"<u{width}")) for k in ("a", "b")}
            | {k: _squeezed(np.packbits(joined[k])) for k in ("a_last", "b_last")}
            | {"pairs": pairs.tolist(), "times": times.tolist(), "digests": joined["digests"].tolist(),
               "places": _squeezed(places.astype("<u4"))})


def _writer(schema: pa.Schema, a_path: str, b_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(a_path, b_path)
        number, held = TaskContext.get().partitionId() << 33, 0
        ids: list = []
        parts: list[dict] = []
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            keys = batch.column(0).to_pylist()
            for x, y in pieces(bounds):
                part = _aligned(vocabulary, data[bounds[x]:bounds[y]], bounds[x:y + 1] - bounds[x])
                parts.append(part)
                ids += keys[x:y]
                held += len(part["pairs"])
                if held >= CHUNK_LINKS:
                    yield pa.RecordBatch.from_pylist(
                        [_chunk(number, vocabulary.width, ids, parts)], schema=schema)
                    number, held, ids, parts = number + 1, 0, [], []
        if parts:
            yield pa.RecordBatch.from_pylist(
                [_chunk(number, vocabulary.width, ids, parts)], schema=schema)
    return run


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def write_alignments(docs: DataFrame, path: str, a_path: str, b_path: str, *,
                     id_col: str = "doc_id", text_col: str = "text") -> None:
    """Align the tokens of every whole text and write them in chunks.

    ``a_path`` names a byte-level vocabulary of the tokenizers library, which gets a space and the
    text; ``b_path`` a sentencepiece model, which puts a space before the text itself. No special
    tokens are added, and their strings are ordinary text.

    Null and empty texts, and texts that either side's tokens do not give back byte by byte, have no
    tokens. Rows that repeat an id, or have none, are rows of their own. Other columns are not read.
    An empty table writes an empty one.
    """
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shape = (f"chunk bigint, width int, ids array<{kept.schema['id'].dataType.simpleString()}>, "
             + ", ".join(f"{k} array<bigint>" for k in _COUNTS)
             + ", a binary, b binary, a_last binary, b_last binary, pairs array<bigint>, "
             "times array<bigint>, digests array<string>, places binary")
    kept.mapInArrow(_writer(_arrow(docs.sparkSession, shape), a_path, b_path), shape) \
        .write.parquet(path)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): how often ids are linked in the whole corpus.

    ``pair`` is a << 32 | b; ``best`` says that no other a id is linked with this b id more often.
    The table of the highest count per b id has at most one row per id of a vocabulary, so it may be
    sent to all tasks.
    """
    each = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = settle(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")))
    of_b = F.col("pair").bitwiseAND(F.lit(LOW))
    highest = counts.groupBy(of_b.alias("_b")).agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(highest), of_b == F.col("_b")).select(
        "pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _texts(row: dict) -> list[str]:
    kind = f"<u{row['width'].as_py()}"
    a, b = (_spread(row[k], kind).astype(np.int64) for k in ("a", "b"))
    a_last, b_last = (np.unpackbits(_spread(row[k + "_last"], "u1"), count=len(ids)).astype(bool)
                      for k, ids in (("a", a), ("b", b)))
    n_a, n_b = (row[k].values.to_numpy() for k in ("n_a", "n_b"))
    largest = int(max(a.max(initial=0), b.max(initial=0))) + 1
    return _written(_names(largest), a, a_last, b, b_last, n_a, n_b)


def _scorer(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {k: batch.column(i)[at] for i, k in enumerate(batch.schema.names)}
                place = _spread(row["places"], "<u4")
                n = row["n"].values.to_numpy()[place] if len(place) else np.empty(0, np.int64)
                best = np.array(row["best"].values.to_pylist(), np.int64)[place]
                n_links = row["n_links"].values.to_numpy()
                groups = pa.array(_texts(row), pa.string()) if "a" in row else row["digests"].values
                yield pa.RecordBatch.from_arrays(
                    [row["ids"].values, *(row[k].values for k in _COUNTS),
                     pa.array(_sums(best, n_links)), pa.array(_sums(n, n_links)), groups], schema=schema)
    return run


def read_alignments(spark: SparkSession, path: str, *, groups: str = "text",
                    id_col: str = "doc_id") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every written document.

    ``n_best`` counts the links whose pair is the most frequent one of its b id, ``count_sum`` adds
    up the frequencies of the links' pairs. ``groups`` is ``a1,a2|b1;a3|b2,b3``, or that text's
    checksum with ``groups="sha256"``; without tokens it is empty.
    """
    if groups not in ("text", "sha256"):
        raise ValueError(f"groups must be 'text' or 'sha256', got {groups!r}")
    chunks = spark.read.parquet(path)
    counts = pair_counts(chunks)
    returned = (chunks.select("chunk", F.explode("pairs").alias("pair")).join(counts, "pair")
                .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best")))
                                      .alias("c"))
                .select("chunk", F.col("c.n").alias("n"), F.col("c.best").alias("best")))
    none = F.array()
    tokens = ["width", "a", "b", "a_last", "b_last"] if groups == "text" else ["digests"]
    rows = chunks.select("chunk", "ids", *_COUNTS, "places", *tokens) \
        .join(returned, "chunk", "left").drop("chunk").withColumns({
            "n": F.coalesce("n", none.cast("array<bigint>")),
            "best": F.coalesce("best", none.cast("array<boolean>"))})
    id_type = chunks.schema["ids"].dataType.elementType.simpleString()
    shape = (f"`{id_col}` {id_type}, " + ", ".join(f"{k} bigint" for k in _COUNTS)
             + ", n_best bigint, count_sum bigint, groups string")
    return rows.mapInArrow(_scorer(_arrow(spark, shape)), shape)
