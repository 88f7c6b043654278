"""Connected components as rounds of keyed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.session import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); roots are arbitrary nodes.

    Each round lets every node point to the node with the smallest priority within two steps,
    replaces both ends of every edge by what they point to, and drops loops and duplicates.
    Priorities are fresh hashes per round, so the graph shrinks by a constant factor on average
    whatever its shape; long chains need logarithmically many rounds. Minima are aggregated
    before the shuffle, so a hub node is no hot spot. Every round is written out.
    """
    current = settle(edges.select("u", "v").filter("u <> v").distinct())
    rounds: list[DataFrame] = []
    while not current.isEmpty():
        seed = F.lit(len(rounds))

        def priority(c: str):
            return F.struct(F.xxhash64(F.col(c), seed).alias("h"), F.col(c).alias("id"))

        ends = current.select(F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.col("v").alias("other")),
            F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e")).select("e.*")
        one_step = ends.groupBy("node").agg(F.min(priority("other")).alias("p")).select(
            "node", F.least(F.col("p"), priority("node")).alias("p"))
        two_steps = (ends.join(one_step.withColumnsRenamed({"node": "other"}), "other")
                     .groupBy("node").agg(F.min("p").alias("q")))
        points = settle(one_step.join(two_steps, "node").select(
            "node", F.least("p", "q")["id"].alias("parent")))
        rounds.append(points)
        current = settle(
            current.join(points.select(F.col("node").alias("u"), F.col("parent").alias("pu")), "u")
            .join(points.select(F.col("node").alias("v"), F.col("parent").alias("pv")), "v")
            .filter("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("root")).limit(0)
    out = rounds[-1].select("node", F.col("parent").alias("root"))
    for points in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("parent"), F.col("root").alias("_root"))
        out = points.join(later, "parent", "left").select(
            "node", F.coalesce("_root", "parent").alias("root"))
    return out
