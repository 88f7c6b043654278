"""Nearest neighbours by cosine: probed lists, scanned dimension by dimension with early abandonment.

Vectors are scaled to length one and turned by a random rotation, which spreads what tells two
vectors apart over all dimensions. They are dealt to lists by the nearest of up to ``MOST_LISTS``
centres, and some lists, or parts of large ones, make up a bucket. The task that holds a bucket keeps
blocks of ``BLOCK_ROWS`` vectors, stored by column: ``COLUMNS`` dimensions of all its vectors, then
the next ones. A query reads the lists nearest to it. Within a block it adds up squared distances
one column block at a time; after d of D dimensions, the share seen so far estimates the whole
distance, and a hypothesis test abandons every vector whose estimate lies beyond the k-th best
distance by more than ``DOUBT`` / sqrt(d) of it. What is left has its cosine taken in double
precision from the vectors as they came.

The first list gives each query its k-th best distance, the others are scanned against that, but for
lists that lie wholly beyond it. How many lists a query reads is found when the index is fitted: so
many that of the true neighbours within the fitted sample the share ``recall`` stands in them.

Every vector is indexed; only the fit is from a sample, of about ``SAMPLE`` vectors, which the driver
holds; their products with the centres and with each other it takes in pieces of ``HELD``. A list of
any size is many parts in several buckets, so a list with a third of all vectors costs more tasks,
not a longer one. A query goes once to each bucket in which it reads, with the names of its lists.
Only vectors as they came are written and shuffled. To the driver and to all tasks go the rotation,
the centres and the sizes of the lists.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import FloatType

from patronage.session import settle

SAMPLE = 40_000
MOST_LISTS = 2_048
BLOCK_ROWS = 2_048
PACK_ROWS = 1_024
# Vectors, as they came, that a task holds at once.
BUCKET_BYTES = 64 << 20
COLUMNS = 16
DOUBT = 2.1
RECALL = 0.99
SEED = 11
# Distances held at once while a block is scanned.
CELLS = 1 << 19
# Vectors left in a block are picked out when they are fewer than one in so many.
SPARSE = 20
# Products of sampled rows with centres, or with each other, that are held at once.
HELD = 1 << 21


@dataclass
class Index:
    """What is needed to place a vector: the turn, the centres, and how many lists to read."""

    dims: int
    kind: str
    rotation: np.ndarray
    centres: np.ndarray
    probes: int


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the usable vectors of an Arrow list column: finite, not zero, of ``dims``."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        values[flat.is_null().to_numpy(zero_copy_only=False)] = np.nan
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    place = np.flatnonzero(size == dims)
    rows = values[start[place][:, None] + np.arange(dims)]
    good = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return place[good], rows[good]


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that squares neither overflow nor vanish."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, each from its own two rows alone, so that equal rows tie."""
    left, right = _scaled(left), _scaled(right)
    dot, a, b = (np.einsum("ij,ij->i", x, y) for x, y in ((left, right), (left, left), (right, right)))
    return dot / (np.sqrt(a) * np.sqrt(b))


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _sampler(schema: pa.Schema, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(0), dims)[1]).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([unit.tobytes()], pa.binary())], schema=schema)
    return run


def _pieces(rows: np.ndarray, across: int) -> Iterator[slice]:
    """The rows in pieces whose products with ``across`` others are few enough to be held."""
    step = max(1, HELD // max(across, 1))
    return (slice(i, i + step) for i in range(0, len(rows), step))


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    # All have length one, so the nearest centre is the one with the largest product.
    return np.concatenate([np.empty(0, np.int64), *(
        (rows[some] @ centres.T).argmax(1) for some in _pieces(rows, len(centres)))])


def _centres(rows: np.ndarray, lists: int, turns: int = 12) -> np.ndarray:
    """Spherical k-means; a centre that loses all its rows goes to a row far from its own."""
    pick = np.random.default_rng(SEED)
    centres = rows[pick.choice(len(rows), lists, replace=False)]
    at, near = np.empty(len(rows), np.int64), np.empty(len(rows), rows.dtype)
    for _ in range(turns):
        for some in _pieces(rows, lists):
            products = rows[some] @ centres.T
            at[some], near[some] = products.argmax(1), products.max(1)
        sums = np.zeros((lists, rows.shape[1]), np.float64)
        np.add.at(sums, at, rows)
        empty = np.flatnonzero(np.bincount(at, minlength=lists) == 0)
        sums[empty] = rows[np.argsort(near, kind="stable")[:len(empty)]]
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres).astype(np.float32)
    return centres


def _probes(rows: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """So many lists that the share ``recall`` of the sample's own neighbours stands in them."""
    if len(rows) < 2:
        return 1
    pick = np.random.default_rng(SEED + 1)
    asked = pick.choice(len(rows), min(len(rows), 400), replace=False)
    k = min(k, len(rows) - 1)
    at, ranks = _nearest_centre(rows, centres), []
    for some in _pieces(asked, max(len(rows), k * len(centres))):
        mine = asked[some]
        products = rows[mine] @ rows.T
        products[np.arange(len(mine)), mine] = -np.inf
        near = np.argpartition(-products, k - 1, axis=1)[:, :k]
        to_centres = rows[mine] @ centres.T
        own = np.take_along_axis(to_centres, at[near], 1)
        ranks.append((to_centres[:, None, :] > own[:, :, None]).sum(2).ravel())
    rank = np.sort(np.concatenate(ranks))
    return int(rank[min(len(rank) - 1, math.ceil(recall * len(rank)) - 1)]) + 1


def fit(vectors: DataFrame, vector_col: str = "embedding", *, k: int = 5, sample: int = SAMPLE,
        recall: float = RECALL) -> Index | None:
    """An index of the vectors' most frequent length (of two such, the greater); None without any."""
    spark, column = vectors.sparkSession, F.col(f"`{vector_col}`")
    sizes = (vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("dims"))
             .agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first())
    if sizes is None:
        return None
    dims, n = sizes["dims"], sizes["n"]
    some = vectors.select(column.alias("v"))
    if n > sample:
        some = some.filter(F.rand(SEED) < sample / n)
    shape = "unit binary"
    taken = some.mapInArrow(_sampler(_arrow(spark, shape), dims), shape).collect()
    rows = np.concatenate([np.empty((0, dims), "<f4"), *(
        np.frombuffer(r["unit"], "<f4").reshape(-1, dims) for r in taken)])
    del taken
    if not len(rows):
        return None
    rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))[0].astype(np.float32)
    rows = rows @ rotation
    lists = max(1, min(MOST_LISTS, len(rows) // 8, math.isqrt(n)))
    centres = _centres(rows, lists)
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    return Index(dims, "<f4" if single else "<f8", rotation, centres, _probes(rows, centres, k, recall))


def _placer(schema: pa.Schema, index: Index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            place, rows = _matrix(batch.column(1), index.dims)
            yield pa.RecordBatch.from_arrays([
                pa.array(at + place), batch.column(0).take(pa.array(place)),
                batch.column(2).take(pa.array(place)),
                pa.array(_nearest_centre(_turned(rows, index), index.centres), pa.int32()),
                pa.array([r.tobytes() for r in rows.astype(index.kind)], pa.binary())], schema=schema)
            at += batch.num_rows
    return run


def _turned(rows: np.ndarray, index: Index) -> np.ndarray:
    return _unit(rows.astype(np.float64)).astype(np.float32) @ index.rotation


def _rows(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


class _Deal:
    """Which buckets hold a list: lists are cut into parts of about ``BLOCK_ROWS``, a bucket is some parts."""

    def __init__(self, sizes: np.ndarray, index: Index, least: int):
        self.sizes, self.parts = sizes, np.maximum(1, -(-sizes // BLOCK_ROWS))
        self.first = np.cumsum(self.parts) - self.parts
        most = -(-int(sizes.sum()) * index.dims * np.dtype(index.kind).itemsize // BUCKET_BYTES)
        self.buckets = int(min(self.parts.sum(), max(least, most)))
        self.bucket_parts = -(-int(self.parts.sum()) // self.buckets)


def _packer(schema: pa.Schema, index: Index, deal: _Deal, k: int, nearest: bool) -> Callable:
    """For each bucket in which a query of a batch reads, one row with the lists that it reads there.

    A query reads the nearest list alone, or the others: ``probes`` lists in all, and more until
    they hold k vectors besides itself. A list is left out if whatever is nearer to its centre than
    to that of the nearest list is farther from the query than the k-th best so far.
    """
    sizes = deal.sizes

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        turned = _turned(_rows(batch.column(2), index.kind, index.dims), index)
        products = turned @ index.centres.T
        order = np.argsort(-products, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        read = (np.arange(order.shape[1]) < index.probes) | (held - sizes[order] < k + 1)
        first = np.argmax(sizes[order] > 0, axis=1)[:, None] == np.arange(order.shape[1])
        read &= (first if nearest else ~first) & (sizes[order] > 0)
        if not nearest:
            # Equal centres have no border between them; no list is left out for that.
            own = index.centres[order[:, 0]]
            apart = np.sqrt(np.maximum(2 - 2 * (own @ index.centres.T), 0))
            border = np.maximum(products.max(1, keepdims=True) - products, 0) / np.maximum(apart, 1e-3)
            far = batch.column(3).to_numpy(zero_copy_only=False)
            reach = np.sqrt(np.maximum(far, 0) * (1 + 1e-4) + 1e-5)[:, None]
            read &= np.take_along_axis(border <= reach + 1e-4, order, 1)
        query, rank = np.nonzero(read)
        lists = order[query, rank]
        low = deal.first[lists] // deal.bucket_parts
        times = (deal.first[lists] + deal.parts[lists] - 1) // deal.bucket_parts - low + 1
        query, lists = np.repeat(query, times), np.repeat(lists, times)
        bucket = np.repeat(low, times) + np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
        by = np.lexsort((lists, query, bucket))
        query, lists, bucket = query[by], lists[by], bucket[by]
        heads = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
        ends = np.append(heads, len(query)) * 2
        some = pa.array(query[heads])
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[heads], pa.int32()), pa.array(np.ones(len(heads), bool)),
            pa.nulls(len(heads), pa.int32()), batch.column(0).take(some), batch.column(1).take(some),
            batch.column(2).take(some), batch.column(3).take(some),
            pa.Array.from_buffers(pa.binary(), len(heads), [
                None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(lists.astype("<u2"))])],
            schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                yield pack(batch.slice(at, PACK_ROWS))
    return run


def scan(columns: list[np.ndarray], queries: np.ndarray, far: np.ndarray, k: int,
         own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the vectors of a block that no test has abandoned.

    ``columns`` holds dimensions by rows, ``far`` each query's k-th best squared distance so far,
    infinite if it has none, ``own`` the row that is the query itself, or -1. A query without a
    distance takes the k-th best among the block's first rows, all of whose dimensions are added up.
    """
    dims, n = sum(len(c) for c in columns), columns[0].shape[1]
    starts = np.cumsum([0, *(len(c) for c in columns)])

    def whole(asked: np.ndarray, rows: slice) -> np.ndarray:
        part = np.concatenate([c[:, rows] for c in columns])
        return (asked * asked).sum(1)[:, None] + (part * part).sum(0) - 2 * asked @ part

    far = far.copy()
    fresh, head = np.flatnonzero(~np.isfinite(far)), min(n, max(128, 4 * k))
    if len(fresh):
        seen = whole(queries[fresh], slice(0, head))
        mine = own[fresh]
        inside = np.flatnonzero((mine >= 0) & (mine < head))
        seen[inside, mine[inside]] = np.inf
        if head > k:
            far[fresh] = np.partition(seen, k - 1, axis=1)[:, k - 1]

    def near(sums: np.ndarray, d: int, limit: np.ndarray) -> np.ndarray:
        allowed = limit * (1 + DOUBT / math.sqrt(d)) ** 2 if d < dims else limit
        return sums <= ((allowed * (1 + 1e-4) + 1e-5) * (d / dims)).astype(np.float32)

    def apart2(part: np.ndarray, block: np.ndarray) -> np.ndarray:
        one = np.ones(1, np.float32)
        left = np.concatenate([-2 * part, (part * part).sum(1)[:, None], one.repeat(len(part))[:, None]], 1)
        return left @ np.concatenate([block, one.repeat(block.shape[1])[None], (block * block).sum(0)[None]])

    found_q, found_r = [], []
    chunk = max(1, CELLS // max(n, 1))
    for a in range(0, len(queries), chunk):
        asked, limit = queries[a:a + chunk], far[a:a + chunk]
        sums = apart2(asked[:, :starts[1]], columns[0])
        keep = near(sums, int(starts[1]), limit[:, None])
        mine = own[a:a + chunk]
        has = np.flatnonzero(mine >= 0)
        keep[has, mine[has]] = False
        q = r = None
        for block, low in zip(columns[1:], starts[1:]):
            d = int(low + len(block))
            # While many are left, one product for all costs less than picking out those.
            if q is None and np.count_nonzero(keep) * SPARSE > keep.size:
                sums += apart2(asked[:, low:d], block)
                keep &= near(sums, d, limit[:, None])
                continue
            if q is None:
                q, r = np.nonzero(keep)
                sums = sums[q, r]
            apart = block[:, r].T - asked[q, low:d]
            sums = sums + np.einsum("ij,ij->i", apart, apart)
            left = near(sums, d, limit[q])
            q, r, sums = q[left], r[left], sums[left]
        if q is None:
            q, r = np.nonzero(keep)
        found_q.append(q + a)
        found_r.append(r)
    return np.concatenate(found_q), np.concatenate(found_r)


class _Bucket:
    """The vectors of a bucket, with blocks of their turned forms stored by column."""

    def __init__(self, held: list[pa.RecordBatch], index: Index):
        lists = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in held])
        self.rows = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in held])
        self.ids = pa.concat_arrays([b.column(4) for b in held])
        self.raw = np.concatenate([_rows(b.column(5), index.kind, index.dims) for b in held])
        self.blocks = []
        heads = np.flatnonzero(np.diff(lists, prepend=-1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(lists)]):
            for i in range(a, b, BLOCK_ROWS):
                some = slice(i, min(i + BLOCK_ROWS, b))
                by_column = np.ascontiguousarray(_turned(self.raw[some], index).T)
                order = np.argsort(self.rows[some])
                self.blocks.append((int(lists[a]), some, self.rows[some][order], order, [
                    by_column[j:j + COLUMNS] for j in range(0, index.dims, COLUMNS)]))

    def best(self, asked: pa.RecordBatch, index: Index, k: int) -> tuple[np.ndarray, ...]:
        """(query, vector, score) of the k best for each query, in that order."""
        raw = _rows(asked.column(5), index.kind, index.dims)
        turned = _turned(raw, index)
        query_rows = asked.column(3).to_numpy(zero_copy_only=False)
        far = asked.column(6).to_numpy(zero_copy_only=False)
        reads = np.zeros((len(raw), len(index.centres)), bool)
        for i, lists in enumerate(asked.column(7).to_pylist()):
            reads[i, np.frombuffer(lists, "<u2")] = True
        found_q, found_r, found_s = [], [], []
        for one, some, sorted_rows, order, columns in self.blocks:
            mine = np.flatnonzero(reads[:, one])
            if not len(mine):
                continue
            place = np.minimum(np.searchsorted(sorted_rows, query_rows[mine]), len(order) - 1)
            own = np.where(sorted_rows[place] == query_rows[mine], order[place], -1)
            q, r = scan(columns, turned[mine], far[mine], k, own)
            q, r = mine[q], r + some.start
            score = np.empty(len(q))
            for a in range(0, len(q), CELLS // 4):
                b = a + CELLS // 4
                score[a:b] = cosines(raw[q[a:b]].astype(np.float64), self.raw[r[a:b]].astype(np.float64))
            best = self._first(q, r, score, k)
            found_q.append(q[best])
            found_r.append(r[best])
            found_s.append(score[best])
        if not found_q:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, r, score = (np.concatenate(x) for x in (found_q, found_r, found_s))
        best = self._first(q, r, score, k)
        return q[best], r[best], score[best]

    def _first(self, q: np.ndarray, r: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        ids = self.ids.take(pa.array(r))
        by_id = pc.rank(ids, "ascending", tiebreaker="dense").to_numpy() if len(ids) else r
        best = np.lexsort((self.rows[r], by_id, -score, q))
        rank = np.arange(len(q)) - np.searchsorted(q[best], q[best])
        return best[rank < k]


def _scanner(schema: pa.Schema, index: Index, k: int) -> Callable:
    """Rows (bucket, asks, list, row, id, raw, far, lists) in that order to what each query finds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, bucket = None, [], None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero((np.diff(key, prepend=-1) != 0) | np.diff(asks, prepend=~asks[:1]))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows]):
                if key[a] != at:
                    at, held, bucket = key[a], [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if bucket is None and not held:
                    continue
                if bucket is None:
                    bucket, held = _Bucket(held, index), []
                for i in range(a, b, PACK_ROWS):
                    asked = batch.slice(i, min(PACK_ROWS, b - i))
                    q, r, score = bucket.best(asked, index, k)
                    yield pa.RecordBatch.from_arrays([
                        asked.column(3).take(pa.array(q)), asked.column(4).take(pa.array(q)),
                        pa.array(bucket.rows[r]), bucket.ids.take(pa.array(r)), pa.array(score)],
                        schema=schema)
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", index: Index | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest other rows, nearest first.

    ``is_query`` picks the rows that ask, all rows are candidates. Ties go to the smaller id. Rows
    without an id, and vectors that are null, zero, or hold a null or a number that is not finite,
    take no part; nor do vectors of another length than the most frequent one (of two, the greater).
    Rows that repeat an id are rows of their own, and each may find the others. Other columns are not
    read. Without usable vectors the result is empty.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    index = index or fit(vectors, vector_col, k=k)
    if index is None:
        return spark.createDataFrame(
            [], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    kept = vectors.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    shape = f"row bigint, id {id_type}, asks boolean, list int, raw binary"
    placed = settle(kept.mapInArrow(_placer(_arrow(spark, shape), index), shape))
    sizes = np.zeros(len(index.centres), np.int64)
    for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    deal = _Deal(sizes, index, 2 * spark.sparkContext.defaultParallelism)
    # One row per list; the number of lists is bounded.
    split = F.broadcast(spark.createDataFrame(
        [(i, int(a), int(n)) for i, (a, n) in enumerate(zip(deal.first, deal.parts))],
        "list int, first int, parts int"))
    bucket = F.floor((F.col("first") + F.pmod(F.xxhash64("row"), "parts")) / deal.bucket_parts)
    shape = (f"bucket int, asks boolean, list int, row bigint, id {id_type}, raw binary, far double, "
             "lists binary")
    living = placed.join(split, "list").select(
        bucket.cast("int").alias("bucket"), F.lit(False).alias("asks"), "list", "row", "id", "raw",
        F.lit(None).cast("double").alias("far"), F.lit(None).cast("binary").alias("lists"))
    pack_schema, found_shape = _arrow(spark, shape), (
        f"query_row bigint, query_id {id_type}, row bigint, vec_id {id_type}, score double")
    found_schema = _arrow(spark, found_shape)

    def search(asked: DataFrame, first: bool) -> DataFrame:
        packs = asked.mapInArrow(_packer(pack_schema, index, deal, k, first), shape)
        # A task holds the vectors of a bucket; the queries that read there pass by in batches.
        return (living.unionByName(packs).repartitionById(deal.buckets, F.col("bucket"))
                .sortWithinPartitions("bucket", "asks", "list")
                .mapInArrow(_scanner(found_schema, index, k), found_shape))

    asked = placed.filter("asks").select("row", "id", "raw")
    none = F.lit(float("inf"))
    first = settle(_best(search(asked.withColumn("far", none), True), k).drop("rank"))
    # Of unit vectors the squared distance is 2 - 2 cos.
    reached = first.groupBy(F.col("query_row").alias("row")).agg(
        F.when(F.count("*") >= k, 2 - 2 * F.min("score")).otherwise(none).alias("far"))
    later = search(asked.join(reached, "row", "left").withColumn("far", F.coalesce("far", none)), False)
    return _best(first.unionByName(later), k).select("query_id", "rank", "vec_id", "score")
