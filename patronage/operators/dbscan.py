"""Density clustering and anomaly detection, exact and without all-pairs work.

Points fall into grid cells whose diagonal is just below ``eps``, so all points of a cell are
neighbours of each other. From that:

* a cell with at least ``min_samples`` points consists of core points only, with no distance
  computed; every other cell has fewer than ``min_samples`` points;
* the core points of a cell share a cluster, so clusters are the connected components of a graph
  of *cells*, whose degree is bounded by the dimension and not by the data;
* bounding boxes settle most questions between two cells (surely within reach, surely not);
  only the rest looks at points. A scarce cell's few points meet a crowded cell in salted chunks,
  and two crowded cells are split into ever smaller boxes until they are decided.

So a cell holding a third of all rows costs work linear in its rows, spread over many tasks.

Which cells can be near each other is found in one of two ways with the same result. With few
features the neighbours of a cell are enumerated on the grid. Their number grows with a power of the
features, so beyond ``GRID_FEATURES`` points are compared place by place instead (``places.py``). With
``pivots``, cells are treated as balls in a metric space: each belongs to
the nearest of some pivots, is copied to the pivots that a ball within reach could belong to, and
meets there only balls whose distance to that pivot is about its own. A task compares the balls that
live at such a place with the copies sent there as blocks of numbers: the distances of the middles
rule out most pairs, the boxes the rest. Only pairs that are left become rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.ordering import with_running
from patronage.operators.components import connected_components
from patronage.operators.places import clustered
from patronage.operators.prepare import safe_numeric, standard_scale
from patronage.session import settle, ship_package

# At most this many cells can be "hot"; their table is the only one broadcast.
MAX_HOT_CELLS = 20_000
# Rows of a crowded cell that one task compares with a neighbour's points.
CHUNK_ROWS = 4_096
# Two cells with at most this many point pairs are compared directly, larger ones are split.
DIRECT_PAIRS = 10_000
# The neighbours of a cell are enumerated on the grid up to this many features.
GRID_FEATURES = 5
# Pivots of the metric partitions, chosen among this many cells.
LEAST_PIVOTS = 6
MOST_PIVOTS = 96
PIVOT_SAMPLE = 4_000
# Pairs of balls that are compared at once in a task.
MET_PAIRS = 1 << 20
# Splitting is exact at any depth; past this depth points are nearly identical.
MAX_SPLITS = 24


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _distance2(d: int, p: str, q: str) -> Column:
    return _sum([(F.col(f"{p}x{j}") - F.col(f"{q}x{j}")) * (F.col(f"{p}x{j}") - F.col(f"{q}x{j}"))
                 for j in range(d)])


def _box_gap2(d: int, lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared distance between two boxes; a lower bound for their points, bit for bit."""
    gaps = [F.greatest(lo_a(j) - hi_b(j), lo_b(j) - hi_a(j), F.lit(0.0)) for j in range(d)]
    return _sum([g * g for g in gaps])


def _box_reach2(d: int, lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared distance of the farthest corners; an upper bound for their points."""
    spans = [F.greatest(hi_a(j) - lo_b(j), hi_b(j) - lo_a(j)) for j in range(d)]
    return _sum([s * s for s in spans])


def _named(prefix: str):
    return lambda j: F.col(f"{prefix}{j}")


def _boxes(d: int) -> list[Column]:
    return [e for j in range(d)
            for e in (F.min(f"x{j}").alias(f"lo{j}"), F.max(f"x{j}").alias(f"hi{j}"))]


def _close(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (radius, lows, highs) whose boxes are, up to rounding, within ``eps``."""
    d = (a.shape[1] - 1) // 2
    lo_a, hi_a, lo_b, hi_b = a[:, 1:d + 1], a[:, d + 1:], b[:, 1:d + 1], b[:, d + 1:]
    # Distances of the middles, seen from the middle of the block so that little is cancelled.
    p, q = (lo_a + hi_a) / 2, (lo_b + hi_b) / 2
    p, q = p - p.mean(0), q - p.mean(0)
    p2, q2 = (p * p).sum(1), (q * q).sum(1)
    far = (a[:, :1] + b[:, 0] + eps) * (1 + 1e-9)
    bound = far * far + 1e-12 * (p2[:, None] + q2)
    # Whatever is no number is left to the boxes.
    i, j = np.nonzero(~(p2[:, None] + q2 - 2 * (p @ q.T) > bound))
    gap = np.maximum(np.maximum(lo_a[i] - hi_b[j], lo_b[j] - hi_a[i]), 0.0)
    keep = ~((gap * gap).sum(1) > eps * eps * (1 + 1e-9))
    return i[keep], j[keep]


def _meeting(d: int, eps: float) -> Callable:
    """Rows (part, ring, salt, copy, home, cell, radius, lows, highs) in that order to pairs of cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, balls = None, None, np.empty((0, 2 * d + 1))
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            copy = batch.column(3).to_numpy(zero_copy_only=False)
            home = batch.column(4).to_numpy(zero_copy_only=False)
            facts = np.stack([batch.column(i).to_numpy(zero_copy_only=False)
                              for i in range(6, 7 + 2 * d)], 1)
            heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(key) else []
            for first, last in zip(heads, np.append(heads[1:], len(key))):
                if place is None or (key[first] != place).any():
                    place, names, balls = key[first], None, balls[:0]
                middle = first + int(np.count_nonzero(~copy[first:last]))
                if middle > first:
                    more = batch.column(5).slice(first, middle - first)
                    names = more if names is None else pa.concat_arrays([names, more])
                    balls = np.concatenate([balls, facts[first:middle]])
                if not len(balls):
                    continue
                step = max(1, MET_PAIRS // len(balls))
                for at in range(middle, last, step):
                    to = min(at + step, last)
                    i, j = _close(balls, facts[at:to], eps)
                    a, b = names.take(pa.array(i)), batch.column(5).take(pa.array(j + at))
                    # Two balls of one home meet twice; the pair is kept once.
                    once = pc.or_(pa.array(home[j + at] > place[0]), pc.less(a, b))
                    yield pa.RecordBatch.from_arrays(
                        [a.filter(once), b.filter(once)], names=["a_cell", "b_cell"])
    return run


class _Grid:
    """The points of one run with their cells and the tables derived from them."""

    def __init__(self, points: DataFrame, d: int, eps: float, min_samples: int):
        self.d, self.eps2, self.min_samples = d, eps * eps, min_samples
        # Slightly below eps / sqrt(d): rounding can never put two points of a cell out of reach.
        self.side = eps / math.sqrt(d) * (1.0 - 1e-9)
        self.eps = eps
        indexes = [F.floor(F.col(f"x{j}") / F.lit(self.side)).cast("bigint").alias(f"c{j}")
                   for j in range(d)]
        celled = points.select("_id", *[f"x{j}" for j in range(d)], *indexes).withColumn(
            "cell", F.concat_ws(",", *[f"c{j}" for j in range(d)]))
        self.cells = settle(celled.groupBy("cell", *[f"c{j}" for j in range(d)]).agg(
            F.count("*").alias("n"), *_boxes(d)))
        # A cell above rows / MAX_HOT_CELLS is hot; by counting there are fewer than
        # MAX_HOT_CELLS of them, so this table may be broadcast. No other cell can skew a join.
        rows = self.cells.agg(F.sum("n")).first()[0] or 0
        self.hot_above = max(CHUNK_ROWS, rows // MAX_HOT_CELLS, min_samples)
        self.points = settle(self.with_cell(
            celled.drop(*[f"c{j}" for j in range(d)]), self.cells.select("cell", "n"))
            .withColumn("salt", F.pmod(F.xxhash64("_id"), self._chunks(F.col("n")))))

    def _chunks(self, n: Column) -> Column:
        return F.greatest(F.ceil(n / F.lit(CHUNK_ROWS)), F.lit(1)).cast("bigint")

    def with_cell(self, points: DataFrame, per_cell: DataFrame, how: str = "inner") -> DataFrame:
        """Attach one row per cell to every point without shuffling the hot cells' points."""
        hot = self.cells.filter(F.col("n") > self.hot_above).select(
            "cell", F.lit(True).alias("_hot"))
        marked = points.join(F.broadcast(hot), "cell", "left")
        hot_rows = marked.filter("_hot").drop("_hot").join(
            F.broadcast(per_cell.join(F.broadcast(hot.select("cell")), "cell", "left_semi")),
            "cell", how)
        cold_rows = marked.filter("_hot is null").drop("_hot").join(per_cell, "cell", how)
        return hot_rows.unionByName(cold_rows)

    def near_cells(self) -> DataFrame:
        """Unordered pairs (a, b) of different cells whose boxes are within eps."""
        d, reach = self.d, int(math.floor(1 + self.eps / self.side))
        first = min(d, 3)
        lead = [f"c{j}" for j in range(first)]
        limit = F.lit(self.eps2)

        def gap2(offset: Column) -> Column:
            g = F.greatest(F.abs(offset) - 1, F.lit(0)).cast("double") * F.lit(self.side)
            return g * g

        # The grid gap is only a coarse filter; allow for the rounding of cell borders.
        loose = limit * F.lit(1.0 + 1e-6)
        steps = F.sequence(F.lit(-reach), F.lit(reach))
        probes = self.cells.select(*lead).distinct()
        probes = probes.withColumn("_gap", F.lit(0.0)).withColumn("_ahead", F.lit(0))
        for j in range(first):
            probes = (probes.withColumn("_o", F.explode(steps))
                      .withColumn("_gap", F.col("_gap") + gap2(F.col("_o")))
                      .filter(F.col("_gap") <= loose)
                      .withColumn("_ahead", F.when(F.col("_ahead") != 0, F.col("_ahead"))
                                  .otherwise(F.signum("_o").cast("int")))
                      .filter(F.col("_ahead") >= 0)
                      .withColumn(f"b{j}", F.col(f"c{j}") + F.col("_o")))
        pairs = probes.drop("_o").join(
            self.cells.select(*[F.col(c).alias(f"b{j}") for j, c in enumerate(lead)]).distinct(),
            [f"b{j}" for j in range(first)])
        # Further dimensions are added one at a time, so only prefixes that exist are followed.
        for j in range(first, d):
            known = self.cells.select(*[f"c{i}" for i in range(j + 1)]).distinct()
            pairs = (pairs.join(known, [f"c{i}" for i in range(j)])
                     .withColumn("_o", F.explode(steps))
                     .withColumn("_gap", F.col("_gap") + gap2(F.col("_o")))
                     .filter(F.col("_gap") <= loose)
                     .withColumn("_ahead", F.when(F.col("_ahead") != 0, F.col("_ahead"))
                                 .otherwise(F.signum("_o").cast("int")))
                     .filter(F.col("_ahead") >= 0)
                     .withColumn(f"b{j}", F.col(f"c{j}") + F.col("_o")).drop("_o")
                     .join(known.select(*[F.col(f"c{i}").alias(f"b{i}") for i in range(j + 1)]),
                           [f"b{i}" for i in range(j + 1)]))
        pairs = pairs.filter(F.col("_ahead") > 0)

        def side(p: str, c: str) -> DataFrame:
            return self.cells.select(
                F.col("cell").alias(p), *[F.col(f"c{j}").alias(f"{c}{j}") for j in range(d)],
                F.col("n").alias(f"{p}_n"),
                *[F.col(f"{s}{j}").alias(f"{p}_{s}{j}") for j in range(d) for s in ("lo", "hi")])

        boxed = (pairs.join(side("a", "c"), [f"c{j}" for j in range(d)])
                 .join(side("b", "b"), [f"b{j}" for j in range(d)]))
        gap = _box_gap2(d, _named("a_lo"), _named("a_hi"), _named("b_lo"), _named("b_hi"))
        sides = [f"{p}_{s}{j}" for p in "ab" for j in range(d) for s in ("lo", "hi")]
        return settle(boxed.filter(gap <= limit).select("a", "b", "a_n", "b_n", *sides))

    def _sides(self, p: str) -> list[str]:
        return [f"{p}_{s}{j}" for j in range(self.d) for s in ("lo", "hi")]

    def _boxed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose boxes are within eps, with counts and boxes."""
        def side(p: str) -> DataFrame:
            return self.cells.select(F.col("cell").alias(p), F.col("n").alias(f"{p}_n"), *[
                F.col(f"{s}{j}").alias(f"{p}_{s}{j}") for j in range(self.d) for s in ("lo", "hi")])

        boxed = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        return settle(boxed.filter(self._gap2() <= F.lit(self.eps2)).select(
            "a", "b", "a_n", "b_n", *self._sides("a"), *self._sides("b")))

    def _gap2(self) -> Column:
        return _box_gap2(self.d, _named("a_lo"), _named("a_hi"), _named("b_lo"), _named("b_hi"))

    def balls(self) -> DataFrame:
        """Each cell as a ball (middle, radius) with its distances to all pivots and the nearest one.

        The pivots lie far from each other: each is the cell of a bounded sample that is farthest
        from those before it. The sample and the pivots are all that the driver sees.
        """
        d = self.d
        middle = F.array(*[(F.col(f"lo{j}") + F.col(f"hi{j}")) / 2 for j in range(d)])
        radius = F.sqrt(_sum([(F.col(f"hi{j}") - F.col(f"lo{j}")) * (F.col(f"hi{j}") - F.col(f"lo{j}"))
                              for j in range(d)])) / 2
        cells = self.cells.withColumns({"middle": middle, "radius": radius})
        seen = np.array([r["middle"] for r in cells.orderBy(F.xxhash64("cell"), "cell").limit(
            PIVOT_SAMPLE).select("middle").collect()])
        chosen = [0]
        left = np.sqrt(((seen - seen[0]) ** 2).sum(1)) if len(seen) else np.empty(0)
        wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(len(seen))))
        while len(chosen) < wanted and len(left) and left.max() > 0:
            chosen.append(int(left.argmax()))
            left = np.minimum(left, np.sqrt(((seen - seen[chosen[-1]]) ** 2).sum(1)))
        pivots = F.array(*[F.array(*[F.lit(float(x)) for x in seen[i]]) for i in chosen]) \
            if len(seen) else F.array(middle)
        away = F.transform(pivots, lambda p: F.sqrt(F.aggregate(
            F.zip_with(p, "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)))
        out = settle(cells.drop(*[f"c{j}" for j in range(d)]).withColumn("away", away))
        return out.withColumn("home", (F.array_position("away", F.array_min("away")) - 1).cast("int"))

    def met_balls(self) -> DataFrame:
        """Unordered pairs (a, b) of cells that meet in a partition and whose boxes may be within eps.

        If two middles are within w of each other, their distances to a pivot differ by w at most,
        and neither is farther from the other's pivot than from its own by more than 2 w. So a ball
        copied to every pivot within that margin meets all balls that live there and are within
        reach. It is copied only to pivots before its own, which finds each pair once. Balls that
        meet are compared block by block, by one product of matrices, and what that leaves by boxes.
        """
        balls = self.balls()
        widest = balls.agg(F.max("radius")).first()[0] or 0.0
        reach = (self.eps + 2 * widest) * (1 + 1e-9)
        own_reach = (F.lit(self.eps + widest) + F.col("radius")) * F.lit(1 + 1e-9)
        facts = ["cell", "radius", *[f"{s}{j}" for s in ("lo", "hi") for j in range(self.d)]]

        def ring(x: Column) -> Column:
            return F.floor(x / F.lit(reach)).cast("bigint")

        living = balls.select(*facts, F.col("home").alias("part"), "home",
                              ring(F.get("away", F.col("home"))).alias("ring"))
        # Partitions with many balls are cut into chunks, each of which meets all copies. There are
        # fewer than MAX_HOT_CELLS of them.
        rows = living.groupBy("part", "ring").agg(F.count("*").alias("here"))
        total = living.count()
        hot = rows.filter(F.col("here") > max(CHUNK_ROWS, total // MAX_HOT_CELLS)).select(
            "part", "ring", self._chunks(F.col("here")).alias("chunks"))

        def chunked(df: DataFrame, salt) -> DataFrame:
            n = F.coalesce("chunks", F.lit(1).cast("bigint"))
            return df.join(F.broadcast(hot), ["part", "ring"], "left").withColumn(
                "salt", salt(n)).drop("chunks")

        living = chunked(living, lambda n: F.pmod(F.xxhash64("cell"), n))
        margin = 2 * own_reach
        copies = balls.select(*facts, "home", F.posexplode(F.slice(
            "away", 1, F.col("home") + 1)).alias("part", "far"), F.get("away", F.col("home")).alias("_own"))
        copies = copies.filter(F.col("far") - F.col("_own") <= margin).withColumn(
            "ring", F.explode(F.sequence(ring(F.greatest(F.col("far") - own_reach, F.lit(0.0))),
                                         ring(F.col("far") + own_reach))))
        copies = chunked(copies, lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
        place = ["part", "ring", "salt", "copy"]
        both = living.withColumn("copy", F.lit(False)).select(*place, "home", *facts).unionByName(
            copies.withColumn("copy", F.lit(True)).select(*place, "home", *facts))
        spark = both.sparkSession
        ship_package(spark)
        # A task holds the balls that live at one place; the copies sent there pass by in batches.
        return (both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *place[:3])
                .sortWithinPartitions(*place)
                .mapInArrow(_meeting(self.d, self.eps), "a_cell string, b_cell string"))

    def near_balls(self) -> DataFrame:
        """What ``near_cells`` gives, found by pivots."""
        return self._boxed(self.met_balls().select(
            F.col("a_cell").alias("a"), F.col("b_cell").alias("b")))

    def _toward(self, pairs: DataFrame) -> DataFrame:
        """Both directions of the pairs as (cell, target, target count, target box)."""
        def end(src: str, dst: str) -> Column:
            return F.struct(F.col(src).alias("cell"), F.col(dst).alias("target"),
                            F.col(f"{dst}_n").alias("t_n"),
                            *[F.col(f"{dst}_{s}{j}").alias(f"t_{s}{j}")
                              for j in range(self.d) for s in ("lo", "hi")])
        return pairs.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("e.*")

    def hits(self, asking: DataFrame, toward: DataFrame, candidates: DataFrame) -> DataFrame:
        """(_id, target, hits): how many candidates of each target cell are within eps.

        ``asking`` holds points of scarce cells only, so fewer than ``min_samples`` per cell.
        Boxes decide whole cells; the rest meets the target's chunks by (cell, salt).
        """
        d, limit = self.d, F.lit(self.eps2)
        x = lambda j: F.col(f"x{j}")
        faced = asking.select("_id", "cell", *[f"x{j}" for j in range(d)]).join(toward, "cell")
        gap = _box_gap2(d, x, x, _named("t_lo"), _named("t_hi"))
        span = _box_reach2(d, x, x, _named("t_lo"), _named("t_hi"))
        faced = faced.withColumn("_gap", gap).withColumn("_span", span).filter(
            F.col("_gap") <= limit)
        whole = faced.filter(F.col("_span") <= limit).select(
            "_id", "target", F.col("t_n").alias("hits"))
        chunked = faced.filter(F.col("_span") > limit).select(
            F.col("_id").alias("p_id"), "target", *[F.col(f"x{j}").alias(f"p_x{j}") for j in range(d)],
            F.explode(F.sequence(F.lit(0).cast("bigint"), self._chunks(F.col("t_all")) - 1)).alias("salt"))
        met = (chunked.join(candidates.select(F.col("cell").alias("target"), "salt",
                                              *[f"x{j}" for j in range(d)]), ["target", "salt"])
               .filter(_distance2(d, "p_", "") <= limit)
               .groupBy(F.col("p_id").alias("_id"), "target").agg(F.count("*").alias("hits")))
        return whole.unionByName(met)

    def flag_core(self, near: DataFrame) -> DataFrame:
        """All points with ``is_core``; a point counts itself."""
        crowded = F.col("n") >= self.min_samples
        scarce = self.points.filter(~crowded)
        # For plain cells the salted rows and the counted rows are the same.
        found = self.hits(scarce, self._toward(near).withColumn("t_all", F.col("t_n")), self.points)
        degree = found.groupBy("_id").agg(F.sum("hits").alias("_around"))
        judged = scarce.join(degree, "_id", "left").withColumn(
            "is_core", F.col("n") + F.coalesce("_around", F.lit(0)) >= self.min_samples).drop(
            "_around")
        return settle(self.points.filter(crowded).withColumn("is_core", F.lit(True))
                      .unionByName(judged))


def _split_key(grid: _Grid, level: int) -> Column:
    """Which sub-box of its cell a point is in after ``level`` splits of up to 3 dimensions."""
    d = grid.d
    bits = [0] * d
    for step in range(level):
        for j in range(3 * step, 3 * step + min(d, 3)):
            bits[j % d] += 1
    return F.concat_ws(",", *[
        F.floor(F.col(f"x{j}") / F.lit(grid.side / 2.0 ** bits[j])).cast("string")
        for j in range(d)])


def _cell_edges(grid: _Grid, near: DataFrame, core: DataFrame, core_cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of cells with core points within eps of each other."""
    d, limit = grid.d, F.lit(grid.eps2)
    gap = _box_gap2(d, _named("a_lo"), _named("a_hi"), _named("b_lo"), _named("b_hi"))
    span = _box_reach2(d, _named("a_lo"), _named("a_hi"), _named("b_lo"), _named("b_hi"))
    boxes = core_cells.select("cell", "n_core",
                              *[f"{s}{j}" for j in range(d) for s in ("lo", "hi")])

    def side(p: str) -> DataFrame:
        return boxes.select(F.col("cell").alias(p), F.col("n_core").alias(f"{p}_n"),
                            *[F.col(f"{s}{j}").alias(f"{p}_{s}{j}")
                              for j in range(d) for s in ("lo", "hi")])

    pairs = (near.select("a", "b").join(side("a"), "a").join(side("b"), "b")
             .withColumn("node_a", F.lit("")).withColumn("node_b", F.lit(""))
             .withColumn("_gap", gap).withColumn("_span", span).filter(F.col("_gap") <= limit))
    pairs = settle(pairs)
    edges = pairs.filter(F.col("_span") <= limit).select("a", "b")
    open_pairs = pairs.filter(F.col("_span") > limit)
    # Boxes too full to be compared directly are taken out before the join; above the hot limit
    # there are fewer than MAX_HOT_CELLS of them.
    full = F.col("n") > max(grid.hot_above, DIRECT_PAIRS)
    crowded = core_cells.filter(full).select("cell", F.lit("").alias("node"))
    for level in range(MAX_SPLITS + 1):
        size = F.col("a_n") * F.col("b_n")
        direct = size <= DIRECT_PAIRS if level < MAX_SPLITS else F.lit(True)
        key = F.lit("") if level == 0 else _split_key(grid, level)
        keyed = core.select("cell", key.alias("node"), *[f"x{j}" for j in range(d)])
        if crowded is not None:
            keyed = keyed.join(F.broadcast(crowded), ["cell", "node"], "left_anti")
        left, right = (keyed.select(
            F.col("cell").alias(c), F.col("node").alias(f"node_{c}"),
            *[F.col(f"x{j}").alias(f"{p}x{j}") for j in range(d)])
            for c, p in (("a", "p_"), ("b", "q_")))
        met = (open_pairs.filter(direct).select("a", "b", "node_a", "node_b")
               .join(left, ["a", "node_a"]).join(right, ["b", "node_b"])
               .filter(_distance2(d, "p_", "q_") <= limit).select("a", "b").distinct())
        edges = edges.unionByName(met)
        big = open_pairs.filter(~direct)
        if level == MAX_SPLITS or big.isEmpty():
            break
        parts = settle(core.groupBy(
            "cell", key.alias("parent"), _split_key(grid, level + 1).alias("node"))
            .agg(F.count("*").alias("n"), *_boxes(d)))
        # At the last depth everything left is compared, however full.
        crowded = (parts.filter(full).select("cell", "node") if level + 1 < MAX_SPLITS else None)

        def children(p: str) -> DataFrame:
            return parts.select(F.col("cell").alias(p), F.col("parent").alias(f"node_{p}"),
                                F.col("node").alias(f"child_{p}"), F.col("n").alias(f"{p}_n"),
                                *[F.col(f"{s}{j}").alias(f"{p}_{s}{j}")
                                  for j in range(d) for s in ("lo", "hi")])

        finer = settle(
            big.select("a", "b", "node_a", "node_b")
            .join(children("a"), ["a", "node_a"]).join(children("b"), ["b", "node_b"])
            .drop("node_a", "node_b").withColumnsRenamed(
                {"child_a": "node_a", "child_b": "node_b"})
            .withColumn("_gap", gap).withColumn("_span", span).filter(F.col("_gap") <= limit))
        sure = finer.filter(F.col("_span") <= limit).select("a", "b").distinct()
        edges = edges.unionByName(sure)
        open_pairs = settle(finer.filter(F.col("_span") > limit).join(sure, ["a", "b"], "left_anti"))
    return edges.distinct()


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float = 0.5,
           min_samples: int = 5, scale: bool = True, pivots: bool | None = None) -> DataFrame:
    """Key, features, ``cluster`` and ``is_core``; cluster -1 marks noise.

    Features are standardised first unless ``scale`` is off. Near cells are found by ``pivots`` or on
    the grid if stated; else on the grid up to ``GRID_FEATURES`` features, and beyond them points are
    compared place by place (``places.py``), where no pair becomes a row. Clusters are numbered from 0 by
    their smallest core key; a border point joins the lowest-numbered cluster that reaches it.
    """
    features = list(features)
    d = len(features)
    data = safe_numeric(df.select(key, *features), key).select(key, *features)
    scaled = standard_scale(data, features) if scale else data
    points = scaled.select(F.col(key).alias("_id"), *[
        F.col(f"`{c}`").alias(f"x{j}") for j, c in enumerate(features)])
    if pivots is None and d > GRID_FEATURES:
        found = clustered(points, d, eps, min_samples)
    else:
        found = _by_cells(_Grid(points, d, eps, min_samples), bool(pivots))
    return data.join(found.withColumnRenamed("_id", key), key).select(key, *features, "cluster", "is_core")


def _by_cells(grid: _Grid, pivots: bool) -> DataFrame:
    """(_id, cluster, is_core) of the points, from pairs of near cells."""
    d = grid.d
    near = grid.near_balls() if pivots else grid.near_cells()
    flagged = grid.flag_core(near)
    core = flagged.filter("is_core")
    core_cells = settle(core.groupBy("cell").agg(
        F.count("*").alias("n_core"), F.max("n").alias("n"), F.min("_id").alias("rep"), *_boxes(d)))

    # Components over cells, then a number per component in the order of its smallest core key.
    edges = _cell_edges(grid, near, core, core_cells)
    reps = core_cells.select("cell", "rep")
    rooted = connected_components(
        edges.join(reps.select(F.col("cell").alias("a"), F.col("rep").alias("u")), "a")
        .join(reps.select(F.col("cell").alias("b"), F.col("rep").alias("v")), "b").select("u", "v"))
    placed = settle(reps.join(rooted.withColumnRenamed("node", "rep"), "rep", "left").select(
        "cell", "rep", F.coalesce("root", "rep").alias("root")))
    numbers = with_running(placed.groupBy("root").agg(F.min("rep").alias("first")),
                           [F.col("first")], {}, "number")
    labelled = settle(placed.join(numbers.select("root", F.col("number")), "root")
                      .select("cell", "number"))

    # Core points take their cell's number. Border points are in scarce cells: they take the
    # lowest number among their own cell and the cells that hold a core point within eps.
    core_rows = grid.with_cell(core.select("_id", "cell"), labelled).select(
        "_id", F.col("number").alias("cluster"), F.lit(True).alias("is_core"))
    others = flagged.filter("not is_core")
    target = core_cells.select(
        F.col("cell").alias("target"), F.col("n_core").alias("t_n"), F.col("n").alias("t_all"),
        *[F.col(f"{s}{j}").alias(f"t_{s}{j}") for j in range(d) for s in ("lo", "hi")])
    around = near.select(F.explode(F.array(
        F.struct(F.col("a").alias("cell"), F.col("b").alias("target")),
        F.struct(F.col("b").alias("cell"), F.col("a").alias("target")))).alias("e")).select("e.*")
    reached = grid.hits(others, around.join(target, "target"), core).select("_id", "target")
    own = others.select("_id", F.col("cell").alias("target"))
    border = (reached.unionByName(own)
              .join(labelled.withColumnRenamed("cell", "target"), "target")
              .groupBy("_id").agg(F.min("number").alias("cluster")))
    other_rows = others.select("_id").join(border, "_id", "left").select(
        "_id", F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"),
        F.lit(False).alias("is_core"))
    return core_rows.unionByName(other_rows)
