"""Second-order boosted trees for a 0/1 label, grown level by level or leaf by leaf.

Features are cut into bins at quantiles once. A tree grows from histograms: one aggregate sums the
first and second derivatives of the loss by (node, feature, bin), running sums along the bins give the
gain of every cut, and the best cut of each node is the only thing that reaches the driver. Partial
sums are formed before the shuffle, so what is shuffled is bounded by nodes x features x bins per
task, whatever the number of rows. Leaf values are -G / (H + l2).

Level by level, every node of a level is split in one pass; leaf by leaf, the leaf with the largest
gain is split next, which gives deeper and fewer leaves.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import settle

# Trees grown between two written states of the training rows.
TREES_KEPT_OPEN = 5


@dataclass
class Node:
    """A leaf with a value, or a cut: rows with ``feature`` <= ``cut`` (or missing) go left."""

    value: float
    feature: int = -1
    bin: int = -1
    cut: float = math.nan
    gain: float = 0.0
    left: int = -1
    right: int = -1


Tree = list[Node]


def _walk(tree: Tree, leaf, left_if, at: int = 0) -> Column:
    """The tree as nested conditions; ``leaf`` gives a leaf's column, ``left_if`` a node's condition."""
    node = tree[at]
    if node.left < 0:
        return leaf(at, node)
    return F.when(left_if(node), _walk(tree, leaf, left_if, node.left)).otherwise(
        _walk(tree, leaf, left_if, node.right))


@dataclass
class Booster:
    """A fitted ensemble. It scores as an MLlib model does: ``transform`` adds ``prediction`` and
    ``probability``."""

    features: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    @property
    def stages(self) -> list[Booster]:
        return [self]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name that MLlib models use
        """Share of each feature in the gain of all cuts."""
        total = [0.0] * len(self.features)
        for node in (n for t in self.trees for n in t if n.left >= 0):
            total[node.feature] += node.gain
        whole = sum(total) or 1.0
        return DenseVector([t / whole for t in total])

    def margin(self) -> Column:
        """Log-odds from the features' own values."""
        def goes_left(node: Node) -> Column:
            x = F.col(f"`{self.features[node.feature]}`").cast("double")
            return F.coalesce(x <= F.lit(node.cut), F.lit(True))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + F.lit(self.rate) * _walk(tree, lambda _, n: F.lit(n.value), goes_left)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin")))
        return (df.withColumn("_margin", self.margin())
                .withColumns({"prediction": (F.col("_margin") > 0).cast("double"),
                              "probability": array_to_vector(F.array(1 - p, p))}).drop("_margin"))


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Cuts between ``bins`` bins of about equal size per feature; repeated values share a cut."""
    marks = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), marks, 10_000).alias(f"q{i}")
                   for i, c in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in row]


def binned(df: DataFrame, edges: Mapping[str, Sequence[float]], keep: Sequence[Column | str]) -> DataFrame:
    """``keep`` and ``bins``: for each feature how many of its cuts lie below the value, 0 if missing."""
    def place(name: str, cuts: Sequence[float]) -> Column:
        x = F.col(f"`{name}`").cast("double")
        if not cuts:
            return F.lit(0)
        return F.when(x.isNull(), 0).otherwise(F.size(F.filter(
            F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < x)))

    return df.select(*keep, F.array(*[place(n, c).cast("int") for n, c in edges.items()]).alias("bins"))


def histograms(rows: DataFrame) -> DataFrame:
    """(node, feature, bin, g, h, n) from rows (node, bins, g, h)."""
    return (rows.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
            .groupBy("node", "feature", "bin")
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")))


def split_gains(cells: DataFrame, l2: float = 1.0, least_weight: float = 1.0,
                least_rows: int = 1) -> DataFrame:
    """(node, feature, bin, gain, g_left, h_left, g_right, h_right) of every allowed cut.

    Rows up to and including the bin go left. Both sides need ``least_weight`` of second derivatives
    and ``least_rows`` rows. A group has as many rows as the feature has bins.
    """
    along = Window.partitionBy("node", "feature").orderBy("bin")
    whole = Window.partitionBy("node", "feature")
    sides = cells.select(
        "node", "feature", "bin", F.sum("g").over(along).alias("g_left"),
        F.sum("h").over(along).alias("h_left"), F.sum("n").over(along).alias("_n"),
        F.sum("g").over(whole).alias("_g"), F.sum("h").over(whole).alias("_h"),
        F.sum("n").over(whole).alias("_all"))
    sides = sides.withColumns({"g_right": F.col("_g") - F.col("g_left"),
                               "h_right": F.col("_h") - F.col("h_left")})

    def score(g: str, h: str) -> Column:
        return F.try_divide(F.col(g) * F.col(g), F.col(h) + F.lit(l2))

    gain = (score("g_left", "h_left") + score("g_right", "h_right") - score("_g", "_h")) / 2
    return sides.filter(
        (F.col("h_left") >= least_weight) & (F.col("h_right") >= least_weight)
        & (F.col("_n") >= least_rows) & (F.col("_all") - F.col("_n") >= least_rows)) \
        .select("node", "feature", "bin", gain.alias("gain"), "g_left", "h_left", "g_right", "h_right")


def _best_cuts(rows: DataFrame, l2: float, least_weight: float, least_rows: int) -> dict[int, dict]:
    """The best cut of each node; of equal ones the first feature and bin."""
    fields = ["gain", "feature", "bin", "g_left", "h_left", "g_right", "h_right"]
    # Bounded by nodes x features x bins, so one task may hold all cells and nothing moves again.
    cells = histograms(rows).repartition(1)
    best = split_gains(cells, l2, least_weight, least_rows).groupBy("node").agg(
        F.max_by(F.struct(*fields), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("b"))
    return {r["node"]: r["b"].asDict() for r in best.collect() if r["b"]["gain"] is not None}


def fit(train: DataFrame, features: Sequence[str], label: str = "churn", *, rounds: int = 100,
        rate: float = 0.1, max_depth: int = 6, leaves: int | None = None, bins: int = 64,
        l2: float = 1.0, least_weight: float = 1.0, least_rows: int = 1,
        least_gain: float = 0.0) -> Booster:
    """An ensemble of ``rounds`` trees.

    Without ``leaves``, trees grow level by level to ``max_depth``; with it, leaf by leaf to that
    many. Missing features go left. Rows without a label are left out. A table with one class, or
    without rows, gives an ensemble without cuts.
    """
    features = list(features)
    known = train.filter(F.col(label).isNotNull())
    counts = known.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("s")).first()
    n, ones = counts["n"], counts["s"] or 0.0
    edges = quantile_edges(known, features, bins) if n else [[] for _ in features]
    share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
    model = Booster(features, edges, math.log(share / (1 - share)), rate)
    if not n or ones in (0, n):
        return model
    state = settle(binned(known, dict(zip(features, edges)), [
        F.col(label).cast("double").alias("y"), F.lit(model.base).alias("margin")]))

    def goes_left(node: Node) -> Column:
        return F.get("bins", F.lit(node.feature)) <= F.lit(node.bin)

    def leaf_of(tree: Tree) -> Column:
        return _walk(tree, lambda at, _: F.lit(at), goes_left)

    limits = (l2, least_weight, least_rows)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    for turn in range(rounds):
        slopes = state.withColumn("_p", p).select(
            "bins", (F.col("_p") - F.col("y")).alias("g"), (F.col("_p") * (1 - F.col("_p"))).alias("h"))
        tree = (_by_leaf if leaves else _by_level)(
            slopes, leaf_of, edges, limits, least_gain, leaves or max_depth)
        if len(tree) == 1 and tree[0].value == 0.0:
            break
        model.trees.append(tree)
        step = F.lit(rate) * _walk(tree, lambda _, node: F.lit(node.value), goes_left)
        state = state.withColumn("margin", F.col("margin") + step)
        if turn % TREES_KEPT_OPEN == TREES_KEPT_OPEN - 1:
            state = settle(state)
    return model


def _split(tree: Tree, at: int, cut: dict, edges: list[list[float]], l2: float) -> None:
    node = tree[at]
    node.feature, node.bin, node.gain = cut["feature"], cut["bin"], cut["gain"]
    node.cut = edges[node.feature][node.bin]
    node.left, node.right = len(tree), len(tree) + 1
    for side in ("left", "right"):
        tree.append(Node(-cut[f"g_{side}"] / (cut[f"h_{side}"] + l2)))


def _by_level(slopes, leaf_of, edges, limits, least_gain, depth) -> Tree:
    tree, level = [Node(0.0)], [0]
    for _ in range(depth):
        rows = slopes.withColumn("node", leaf_of(tree)).filter(F.col("node").isin(level))
        cuts = {k: c for k, c in _best_cuts(rows, *limits).items() if c["gain"] > least_gain}
        level = []
        for at in sorted(cuts):
            _split(tree, at, cuts[at], edges, limits[0])
            level += [tree[at].left, tree[at].right]
        if not level:
            break
    return tree


def _by_leaf(slopes, leaf_of, edges, limits, least_gain, leaves) -> Tree:
    tree, open_, fresh = [Node(0.0)], {}, [0]
    while (len(tree) + 1) // 2 < leaves:
        rows = slopes.withColumn("node", leaf_of(tree)).filter(F.col("node").isin(fresh))
        open_ |= _best_cuts(rows, *limits)
        at = max(open_, key=lambda k: (open_[k]["gain"], -k), default=None)
        if at is None or open_[at]["gain"] <= least_gain:
            break
        _split(tree, at, open_.pop(at), edges, limits[0])
        fresh = [tree[at].left, tree[at].right]
    return tree
