"""Exact density clustering of points with many features: dealt to places, compared there as blocks.

Beyond a few features most cells of a grid hold one point, and a point has more near cells than can
be written out. So no pair of points and no pair of cells ever becomes a row:

* a bounded sample is halved along its widest features into places of about ``PLACE_ROWS`` points. A
  task holds one place, halved further into blocks with boxes, and compares blocks by products of
  matrices; what rounding leaves open is decided by the exact sum of squares;
* a point with ``min_samples`` neighbours in its own place is core. Only a point without them goes to
  the other places whose boxes it reaches. One that stays short of them has few neighbours, so those
  are kept with it and later decide its cluster as a border point;
* the core points of a place fall into components: a component grows over points not yet reached, so
  most comparisons are saved once it holds most of the place;
* up to ``SENT`` points of every component go to the places they reach and are joined with what they
  meet. Components that then still have points unsent and are not in the largest cluster send all of
  them. Two core points of different clusters can only be near if one of them has been sent.

Places that hold many equal points cannot be halved; they are dealt at random to several tasks, which
is as right as any other deal. To the driver go the sample, and the boxes and counts of the places.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.ordering import with_running
from patronage.operators.components import connected_components
from patronage.session import settle, ship_package

# Points that a task holds, and how many of them are compared at once.
PLACE_ROWS = 65_536
BLOCK_ROWS = 1_024
# Fewer points are not worth another place.
LEAST_ROWS = 2_048
MOST_PLACES = 4_096
# Points from which the places are found, in all and for each place.
SAMPLE = 4_000
SAMPLE_EACH = 32
# Core points by which a component first makes itself known to other places.
SENT = 64
# Components with more than one in so many of all core points are joined by a broadcast.
HOT_PARTS = 20_000


def _halve(x: np.ndarray, some: np.ndarray) -> tuple[int, float] | None:
    """The widest feature of these points and a value that parts them; None if all are equal."""
    low, high = x[some].min(0), x[some].max(0)
    with np.errstate(all="ignore"):
        wide = np.where(high > low, np.nan_to_num(x[some].std(0), nan=np.inf), -1.0)
    at = int(wide.argmax())
    if not high[at] > low[at]:
        return None
    values = x[some, at]
    middle = float(np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2])
    return at, middle if middle < high[at] else float(values[values < high[at]].max())


class Cuts:
    """A tree of halvings: points of ``x`` in at most ``most`` leaves, or in leaves of ``rows``."""

    def __init__(self, x: np.ndarray, most: int | None = None, rows: int | None = None):
        self.tree: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
        self.parts: list[np.ndarray] = []
        todo, done = deque([(0, np.arange(len(x)))]), []
        while todo:
            node, some = todo.popleft()
            # Taken breadth first, so that the places are of about one size.
            full = len(some) > rows if rows else len(todo) + len(done) + 1 < most
            cut = _halve(x, some) if full and len(some) > 1 else None
            if cut is None:
                done.append((node, some))
                continue
            at, value = cut
            left = x[some, at] <= value
            n = len(self.tree)
            self.tree[node] = (at, value, n, n + 1)
            self.tree += [(-1, 0.0, 0, 0), (-1, 0.0, 0, 0)]
            todo += [(n, some[left]), (n + 1, some[~left])]
        for leaf, (node, some) in enumerate(done):
            self.tree[node] = (-1, float(leaf), 0, 0)
            self.parts.append(some)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, value, left, right = (np.array(c) for c in zip(*self.tree))
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(at[node] >= 0)
            if not len(inner):
                return value[node].astype(np.int64)
            here = node[inner]
            node[inner] = np.where(x[inner, at[here]] <= value[here], left[here], right[here])


def near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``a`` are within ``eps`` of which of ``b``, as the plain sum of squares has it."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), bool)
    with np.errstate(all="ignore"):
        middle = b[0]
        p, q = a - middle, b - middle
        p2, q2 = (p * p).sum(1), (q * q).sum(1)
        apart = p2[:, None] + q2 - 2 * (p @ q.T)
        doubt = (1e-12 * (p2 + q2.max() + eps * eps))[:, None]
        out = apart <= eps * eps - doubt
        # Whatever is no number is in doubt, too.
        maybe = ~(apart > eps * eps + doubt)
        if np.count_nonzero(maybe) > np.count_nonzero(out):
            i, j = np.nonzero(maybe & ~out)
            exact = np.zeros(len(i))
            for f in range(a.shape[1]):
                exact += (a[i, f] - b[j, f]) ** 2
            out[i, j] = exact <= eps * eps
    return out


def _reach(x: np.ndarray, low: np.ndarray, high: np.ndarray, eps: float) -> np.ndarray:
    """Which points may be within ``eps`` of something in which box."""
    gap2 = np.zeros((len(x), len(low)))
    with np.errstate(all="ignore"):
        for f in range(x.shape[1]):
            gap = np.maximum(np.maximum(low[:, f] - x[:, f, None], x[:, f, None] - high[:, f]), 0.0)
            gap2 += gap * gap
    return ~(gap2 > eps * eps * (1 + 1e-9))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _vectors(x: np.ndarray) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))


class Place:
    """The points of a place in blocks with boxes."""

    def __init__(self, x: np.ndarray, eps: float):
        self.x, self.eps = x, eps
        self.blocks = Cuts(x, rows=BLOCK_ROWS).parts
        # Equal points stay together however many they are.
        self.blocks = [b[i:i + BLOCK_ROWS] for b in self.blocks for i in range(0, len(b), BLOCK_ROWS)]
        self.low = np.array([x[b].min(0) for b in self.blocks])
        self.high = np.array([x[b].max(0) for b in self.blocks])

    def around(self, q: np.ndarray, keyless: np.ndarray, found: np.ndarray,
               enough: int) -> tuple[np.ndarray, ...]:
        """Neighbours found with those before, how many of them share the cell, and pairs (q, place).

        A point is left alone once it has ``enough`` of them; pairs are given of the others. A point
        without a key counts the points of its own cell only, whose diagonal is just below eps.
        """
        side = self.eps / math.sqrt(q.shape[1]) * (1.0 - 1e-9)
        found, same = found.copy(), np.zeros(len(q), np.int64)
        pairs_q, pairs_x = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(q), BLOCK_ROWS):
            some = np.arange(at, min(at + BLOCK_ROWS, len(q)))
            reach = _reach(q[some], self.low, self.high, self.eps)
            for b, block in enumerate(self.blocks):
                asks = some[reach[:, b] & (found[some] < enough)]
                if not len(asks):
                    continue
                i, j = np.nonzero(near(q[asks], self.x[block], self.eps))
                i, j = asks[i], block[j]
                with np.errstate(all="ignore"):
                    own = (np.floor(q[i] / side) == np.floor(self.x[j] / side)).all(1)
                keep = own | ~keyless[i]
                i, j, own = i[keep], j[keep], own[keep]
                found += np.bincount(i, minlength=len(q))
                same += np.bincount(i[own], minlength=len(q))
                short = found[i] < enough
                pairs_q.append(i[short])
                pairs_x.append(j[short])
        i, j = np.concatenate(pairs_q), np.concatenate(pairs_x)
        short = found[i] < enough
        return found, same, i[short], j[short]

    def judge(self, keyless: np.ndarray, enough: int) -> tuple[np.ndarray, ...]:
        """``around`` for the points of the place themselves, each with its own block first."""
        found = np.zeros(len(self.x), np.int64)
        for block in self.blocks:
            here = near(self.x[block], self.x[block], self.eps)
            found[block] = np.where(keyless[block], 0, here.sum(1))
        # Points without enough in their own block are asked again from the start, with all blocks.
        open_ = np.flatnonzero(found < enough)
        again, same, i, j = self.around(self.x[open_], keyless[open_], np.zeros(len(open_), np.int64), enough)
        found[open_] = again
        shared = np.zeros(len(self.x), np.int64)
        shared[open_] = same
        return found, shared, open_[i], j

    def components(self) -> np.ndarray:
        """For each point a point of its component; the same for all of them."""
        x, label = self.x, np.full(len(self.x), -1)
        free, low, high = list(self.blocks), self.low, self.high
        left = len(x)
        for seed in np.concatenate([np.empty(0, np.int64), *self.blocks]).tolist():
            if label[seed] >= 0:
                continue
            label[seed] = seed
            edge = deque([np.array([seed])])
            while edge:
                some = edge.popleft()
                # The first steps are small: each saves comparing all those that it reaches.
                if len(some) > 128:
                    edge.append(some[128:])
                    some = some[:128]
                if len(free) > 1 and left <= 2 * BLOCK_ROWS:
                    free = [np.concatenate(free)]
                    free = [free[0][label[free[0]] < 0]]
                    low, high = low.min(0)[None], high.max(0)[None]
                reach = _reach(x[some], low, high, self.eps)
                for b in np.flatnonzero(reach.any(0)).tolist():
                    rest = free[b]
                    if not len(rest):
                        continue
                    asks = some[reach[:, b]]
                    hit = near(x[asks], x[rest], self.eps).any(0)
                    new = rest[hit]
                    new = new[label[new] < 0]
                    label[new] = seed
                    free[b] = rest[~hit]
                    left -= len(new)
                    if len(new):
                        edge.append(new)
        return label


def _by_place(run: Callable, d: int, eps: float) -> Callable:
    """Rows sorted by (place, asks): those that live there are gathered, then ``run`` sees the others.

    ``run`` gets the place, its gathered rows, and a batch of asking rows, or None after the last of
    them.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, place, rows = None, [], None, None

        def ready():
            nonlocal held, place, rows
            if place is None and held:
                rows = pa.Table.from_batches(held).combine_chunks()
                rows = rows.to_batches(max_chunksize=rows.num_rows)[0]
                place, held = Place(_matrix(rows.column("x"), d), eps), []
            return place

        for batch in batches:
            key, asks = _numbers(batch.column("place")), _numbers(batch.column("asks"))
            heads = np.flatnonzero((np.diff(key, prepend=-1) != 0) | np.diff(asks, prepend=~asks[:1]))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows]):
                if key[a] != at:
                    if ready() is not None:
                        yield from run(place, rows, None)
                    at, held, place, rows = key[a], [], None, None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                elif ready() is not None:
                    yield from run(place, rows, batch.slice(a, b - a))
        if ready() is not None:
            yield from run(place, rows, None)
    return each


def _lists(i: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values as a list for each of ``n`` rows."""
    by = np.argsort(i, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[by], pa.int64()))


def _judge(enough: int) -> Callable:
    def run(place: Place, rows: pa.RecordBatch, asked: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        keyless = _numbers(rows.column("_id").is_null())
        found, same, i, j = place.judge(keyless, enough)
        names = (int(rows.column("place")[0].as_py()) << 33) + np.arange(len(found))
        yield pa.RecordBatch.from_arrays([
            rows.column("place"), pa.array(names), rows.column("_id"), rows.column("x"), pa.array(found),
            pa.array(same), _lists(i, names[j], len(found))],
            names=["place", "row", "_id", "x", "found", "same", "arms"])
    return run


def _judge_others(enough: int, d: int) -> Callable:
    def run(place: Place, rows: pa.RecordBatch, asked: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if asked is None:
            return
        before = _numbers(asked.column("found"))
        found, same, i, j = place.around(
            _matrix(asked.column("x"), d), _numbers(asked.column("_id").is_null()), before, enough)
        arms = _lists(i, _numbers(rows.column("row"))[j], len(found))
        yield pa.RecordBatch.from_arrays([asked.column("row"), pa.array(found - before), pa.array(same), arms],
                                         names=["row", "found", "same", "arms"])
    return run


def _grow(most: int) -> Callable:
    """Each point with its component, and which of them are sent first."""
    def run(place: Place, rows: pa.RecordBatch, asked: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        label = place.components()
        # In the order of the blocks, so that those sent are spread over the component.
        order = np.concatenate(place.blocks)
        order = order[np.argsort(label[order], kind="stable")]
        start = np.searchsorted(label[order], label[order])
        size = np.bincount(label, minlength=len(label))[label[order]]
        rank = np.arange(len(order)) - start
        sent = np.empty(len(label), bool)
        sent[order] = (size <= most) | (rank * most // size != (rank - 1) * most // size)
        names = _numbers(rows.column("row"))
        yield pa.RecordBatch.from_arrays([
            rows.column("place"), rows.column("row"), rows.column("_id"), rows.column("x"),
            pa.array(names[label]), pa.array(sent)], names=["place", "row", "_id", "x", "part", "sent"])
    return run


def _meet(d: int, eps: float) -> Callable:
    known: dict = {}

    def run(place: Place, rows: pa.RecordBatch, asked: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if asked is None:
            return
        if known.get("place") is not place:
            part = _numbers(rows.column("part"))
            blocks = [b[np.argsort(part[b], kind="stable")] for b in place.blocks]
            heads = [np.flatnonzero(np.append(True, np.diff(part[b]) != 0)) for b in blocks]
            known.update(place=place, part=part, blocks=blocks, heads=heads)
        part, x, mine = known["part"], _matrix(asked.column("x"), d), _numbers(asked.column("part"))
        for at in range(0, len(x), BLOCK_ROWS):
            reach = _reach(x[at:at + BLOCK_ROWS], place.low, place.high, eps)
            found = [np.empty((0, 2), np.int64)]
            for b, (block, heads) in enumerate(zip(known["blocks"], known["heads"])):
                some = at + np.flatnonzero(reach[:, b])
                if len(some):
                    i, j = np.nonzero(np.logical_or.reduceat(near(x[some], place.x[block], eps), heads, axis=1))
                    found.append(np.unique(np.stack([mine[some[i]], part[block[heads[j]]]], 1), axis=0))
            found = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["u", "v"])
    return run


def _sender(low: np.ndarray, high: np.ndarray, d: int, eps: float) -> Callable:
    """A copy of each row for each other place that it reaches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                reach = _reach(_matrix(some.column("x"), d), low, high, eps)
                reach[np.arange(len(reach)), _numbers(some.column("place"))] = False
                i, place = np.nonzero(reach)
                out = some.take(pa.array(i))
                columns = {n: out.column(n) for n in out.schema.names}
                columns |= {"place": pa.array(place, pa.int32()), "asks": pa.array(np.ones(len(i), bool))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


class Places:
    """Points (_id, x0, x1, ...) dealt to places."""

    def __init__(self, points: DataFrame, d: int, eps: float):
        self.d, self.eps, self.id_type = d, eps, points.schema["_id"].dataType.simpleString()
        spark = points.sparkSession
        ship_package(spark)
        points = settle(points.select("_id", F.array(*[f"x{j}" for j in range(d)]).alias("x")))
        n = points.count()
        wanted = max(-(-n // PLACE_ROWS), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
        wanted = max(1, min(wanted, MOST_PLACES))
        taken = points.orderBy(F.xxhash64("_id", "x"), "x").limit(
            max(SAMPLE, SAMPLE_EACH * wanted)).select("x").collect()
        cuts = Cuts(np.array([r["x"] for r in taken]).reshape(-1, d), most=wanted)

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = cuts.leaf(_matrix(batch.column(1), d))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf, pa.int32()), batch.column(0), batch.column(1)], names=["leaf", "_id", "x"])

        shape = f"leaf int, _id {self.id_type}, x array<double>"
        found = points.mapInArrow(leaves, shape)
        x = [F.get("x", F.lit(j)) for j in range(d)]
        facts = {r["leaf"]: r for r in found.groupBy("leaf").agg(
            F.count("*").alias("n"), F.array(*[F.min(c) for c in x]).alias("low"),
            F.array(*[F.max(c) for c in x]).alias("high")).collect()}
        # A leaf with too many points is several places.
        first, parts, self.low, self.high = {}, {}, [], []
        for leaf, r in sorted(facts.items()):
            first[leaf], parts[leaf] = len(self.low), -(-r["n"] // (2 * PLACE_ROWS))
            self.low += [r["low"]] * parts[leaf]
            self.high += [r["high"]] * parts[leaf]
        self.low, self.high = (np.array(v, float).reshape(-1, d) for v in (self.low, self.high))
        self.n = max(1, len(self.low))
        firsts, many = (np.array([v.get(i, 0) for i in range(len(cuts.parts))]) for v in (first, parts))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = 0
            for batch in batches:
                leaf = cuts.leaf(_matrix(batch.column(1), d))
                turn = (at + np.arange(len(leaf))) % np.maximum(many[leaf], 1)
                at += len(leaf)
                yield pa.RecordBatch.from_arrays([
                    pa.array(firsts[leaf] + turn, pa.int32()), pa.array(np.zeros(len(leaf), bool)),
                    batch.column(0), batch.column(1)], names=["place", "asks", "_id", "x"])

        self.points = points.mapInArrow(deal, f"place int, asks boolean, _id {self.id_type}, x array<double>")

    def run(self, rows: DataFrame, step: Callable, shape: str) -> DataFrame:
        """``step`` on the rows (place, asks, x, ...) of each place."""
        return (rows.repartitionById(self.n, F.col("place")).sortWithinPartitions("place", "asks")
                .mapInArrow(_by_place(step, self.d, self.eps), shape))

    def sent(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("asks", F.lit(True))
        return rows.mapInArrow(_sender(self.low, self.high, self.d, self.eps), rows.schema)

    def judged(self, enough: int) -> tuple[DataFrame, DataFrame]:
        """Core points (place, row, _id, x), and the others (row, _id, arms) with their neighbours."""
        point = f"place int, row bigint, _id {self.id_type}, x array<double>"
        state = settle(self.run(self.points, _judge(enough),
                                f"{point}, found bigint, same bigint, arms array<bigint>"))
        short = F.col("found") < enough
        living = state.select("place", F.lit(False).alias("asks"), "row", "_id", "x", "found")
        elsewhere = self.run(living.unionByName(self.sent(living.filter(short))),
                             _judge_others(enough, self.d),
                             "row bigint, found bigint, same bigint, arms array<bigint>")
        more = elsewhere.filter(F.col("found") > 0).groupBy("row").agg(
            F.sum("found").alias("_found"), F.sum("same").alias("_same"),
            F.flatten(F.collect_list("arms")).alias("_arms"))
        asked = settle(state.filter(short).join(more, "row", "left").select(
            "place", "row", "_id", "x", (F.col("found") + F.coalesce("_found", F.lit(0))).alias("found"),
            (F.col("same") + F.coalesce("_same", F.lit(0))).alias("same"),
            F.concat("arms", F.coalesce("_arms", F.array().cast("array<bigint>"))).alias("arms")))
        # Rows that repeat a key count together what lies outside their cells.
        outside = asked.groupBy("_id").agg(F.sum(F.col("found") - F.col("same")).alias("_outside"))
        told = asked.join(outside, "_id", "left").withColumn("is_core", (F.col("found") >= enough) | (
            F.col("same") + F.coalesce("_outside", F.lit(0)) >= enough)).drop("_outside")
        told = settle(told)
        columns = ["place", "row", "_id", "x"]
        core = state.filter(~short).select(*columns).unionByName(told.filter("is_core").select(*columns))
        return core, told.filter("not is_core").select("row", "_id", "arms")

    def components(self, core: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Core points (row, _id, part), and parts (part, n, first, root) with what is one cluster."""
        grown = settle(self.run(
            core.withColumn("asks", F.lit(False)), _grow(SENT),
            f"place int, row bigint, _id {self.id_type}, x array<double>, part bigint, sent boolean"))
        parts = settle(grown.groupBy("part").agg(F.count("*").alias("n"), F.min("_id").alias("first")))
        living = grown.select("place", F.lit(False).alias("asks"), "part", "x")

        def rooted(edges: DataFrame) -> DataFrame:
            found = connected_components(edges).withColumnRenamed("node", "part")
            return settle(parts.join(found, "part", "left").withColumn("root", F.coalesce("root", "part")))

        def met(asking: DataFrame) -> DataFrame:
            return settle(self.run(living.unionByName(self.sent(asking.select(living.columns))),
                                   _meet(self.d, self.eps), "u bigint, v bigint").distinct())

        placed = grown.select("row", "_id", "part")
        grown = grown.withColumn("asks", F.lit(False))
        if self.n == 1:
            return placed, parts.withColumn("root", F.col("part"))
        edges = met(grown.filter("sent"))
        out = rooted(edges)
        largest = out.groupBy("root").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "root").first()
        if largest is None:
            return placed, out
        # Smaller parts have sent all their points.
        rest = out.filter((F.col("n") > SENT) & (F.col("root") != largest["root"])).select("part")
        if not rest.isEmpty():
            out = rooted(edges.unionByName(met(self.with_part(grown.filter("not sent"), parts, rest))))
        return placed, out

    def with_part(self, rows: DataFrame, parts: DataFrame, facts: DataFrame) -> DataFrame:
        """Attach ``facts`` of parts to rows without shuffling the rows of large parts."""
        total = parts.agg(F.sum("n")).first()[0] or 0
        # By counting there are at most HOT_PARTS of them, so they may be broadcast.
        hot = parts.filter(F.col("n") > max(4_096, total // HOT_PARTS)).select("part", F.lit(True).alias("_hot"))
        marked = rows.join(F.broadcast(hot), "part", "left")
        large = F.broadcast(facts.join(F.broadcast(hot.select("part")), "part", "left_semi"))
        return (marked.filter("_hot").drop("_hot").join(large, "part")
                .unionByName(marked.filter("_hot is null").drop("_hot").join(facts, "part")))


def clustered(points: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    """(_id, cluster, is_core) of points (_id, x0, x1, ...), one row for each; cluster -1 marks noise.

    Clusters are numbered from 0 by their smallest core key; a border point joins the lowest-numbered
    cluster that reaches it.
    """
    places = Places(points, d, eps)
    core, others = places.judged(min_samples)
    placed, parts = places.components(core)
    firsts = parts.groupBy("root").agg(F.min("first").alias("first")).filter(F.col("first").isNotNull())
    numbers = with_running(firsts, [F.col("first")], {}, "number")
    labelled = settle(parts.join(numbers.select("root", "number"), "root").select("part", "number"))
    core_rows = settle(places.with_part(placed, parts, labelled).select(
        "row", "_id", F.col("number").alias("cluster")))
    arms = others.select("_id", F.explode("arms").alias("row"))
    border = arms.join(core_rows.select("row", "cluster"), "row").groupBy("_id").agg(
        F.min("cluster").alias("cluster"))
    other_rows = others.select("_id").join(border, "_id", "left").select(
        "_id", F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"), F.lit(False).alias("is_core"))
    return core_rows.select("_id", "cluster", F.lit(True).alias("is_core")).unionByName(other_rows)
