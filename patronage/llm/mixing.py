"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents stand in key order, a
distributed running total of their sizes says where each one begins, and the source's budget cuts
that order. A budget above the size of its source takes whole passes (epochs) first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.ordering import with_running
from patronage.session import settle

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without white space; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(id_col: str, seed: int) -> Column:
    """60 bits of a hash of the id that any engine can compute."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] | Mapping[str, float],
                   share: float, max_epochs: int) -> DataFrame:
    """One row per source with its target, from (source, source_size).

    Targets are proportional to the weights and add up to ``share`` of all sizes. None exceeds
    ``max_epochs`` times its source; the excess goes to the others by weight. With the sources
    ordered by limit per unit of weight, those at their limit come first, so that one running sum
    finds the level of the rest. Windows here see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    if isinstance(weights, Mapping):
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(w)))
                              for k, w in weights.items()], F.lit(0.0))
    else:
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        weight = F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("room"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    base = by_name.rowsBetween(Window.unboundedPreceding, -1)
    # A source without weight takes nothing.
    limited = (sizes.withColumn("weight", weight)
               .withColumn("most", F.when(F.col("weight") > 0, F.col("source_size") * max_epochs)
                           .otherwise(F.lit(0)))
               .withColumn("room", F.when(F.col("weight") > 0, F.col("most") / F.col("weight"))
                           .otherwise(F.lit(0.0)))
               .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
               .withColumn("source_base", F.coalesce(F.sum("source_size").over(base), F.lit(0))))
    level = (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0))) \
        / F.sum("weight").over(onward)
    levelled = limited.withColumn("level", F.when(F.sum("weight").over(onward) > 0, level)) \
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("room"), F.col("level")))
                    .over(everything))
    target = F.when(F.col("level").isNull() | (F.col("room") < F.col("level")),
                    F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return levelled.select("source", "source_size", "source_base", target.alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source",
        size: Column | None = None, weights: Sequence[float] | Mapping[str, float] = (5, 2, 1),
        share: float = 1.0, max_epochs: int = 3, seed: int = 17, cut: str = "word") -> DataFrame:
    """What a mix takes of every document: (doc_id, size, source_size, target, taken, source, key).

    ``weights`` names sources, or is repeated over the sources in code point order, null last.
    ``cut="word"`` meets each budget to the word: the document across it counts with the words
    that fit. ``cut="document"`` takes that document whole when at least half of it fits. ``taken``
    counts words, repeats included, and is at most ``max_epochs`` times the size.

    A null or empty text has size 0 and takes 0; a null source is a source of its own; a null id
    is an id like any other. Rows that repeat an id are documents of their own next to each
    other in the order. An empty table gives an empty result. Other columns are not looked at.
    """
    size = word_count(F.col("text")) if size is None else size
    keyed = settle(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        size.cast("bigint").alias("size"), random_key(id_col, seed).alias("key")))
    targets = source_targets(
        keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    order = [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("doc_id").asc(),
             F.col("size").asc()]
    ordered = with_running(keyed, order, {"upto": F.col("size")})
    named = targets.withColumnRenamed("source", "of_source")
    budget = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))) \
        .otherwise(F.lit(0)).cast("bigint")
    rest = budget - F.col("passes") * F.col("source_size")
    begin = F.col("upto") - F.col("size") - F.col("source_base")
    if cut == "word":
        part = F.greatest(F.lit(0), F.least(rest - begin, F.col("size")))
    elif cut == "document":
        part = F.when(2 * begin + F.col("size") <= 2 * rest, F.col("size")).otherwise(F.lit(0))
    else:
        raise ValueError(f"cut is word or document, not {cut!r}")
    return (ordered.join(named, F.col("source").eqNullSafe(F.col("of_source")))
            .withColumn("passes", passes)
            .select("doc_id", "size", "source_size", "target",
                    (F.col("passes") * F.col("size") + part).cast("bigint").alias("taken"),
                    "source", "key", "passes", (part > 0).alias("in_part")))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source",
                    text_col: str = "text", seed: int = 17, **options) -> DataFrame:
    """The documents of the mix, whole, one row per repeat, with the columns of ``docs``.

    Each source's order is cut at one place, so that the texts need no shuffle: a table with one
    row per source says how often its documents come, and up to which key they come once more.
    A document without words is taken in no pass. Rows that repeat an id are taken alike.
    """
    size = word_count(F.col(text_col))
    taken = mix(docs, id_col=id_col, source_col=source_col, size=size, seed=seed, cut="document",
                **options)
    cuts = settle(taken.groupBy("source").agg(
        F.max("passes").alias("passes"),
        F.max(F.when(F.col("in_part"), F.struct("key", "doc_id"))).alias("last")))
    here = F.struct(random_key(id_col, seed).alias("key"),
                    F.col(id_col).alias("doc_id"))
    named = cuts.select(F.col("source").alias("_mix_source"), F.col("passes").alias("_mix_passes"),
                        F.col("last").alias("_mix_last"))
    times = F.col("_mix_passes") + F.coalesce((here <= F.col("_mix_last")).cast("int"), F.lit(0))
    joined = docs.join(named, F.col(source_col).cast("string").eqNullSafe(F.col("_mix_source")))
    repeated = joined.filter(size > 0).withColumn(
        "_mix_times", F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns],
                           F.explode("_mix_times").alias("_mix_time")).drop("_mix_time")
