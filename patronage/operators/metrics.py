"""Classification quality from the label × prediction counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.numeric import guarded_ratio


def confusion_matrix(df: DataFrame, label: str = "churn",
                     prediction: str = "churn_prediction") -> DataFrame:
    """(label, prediction, n); the only step that touches the rows."""
    return (df.groupBy(F.col(label).cast("int").alias("label"),
                       F.col(prediction).cast("int").alias("prediction"))
            .agg(F.count("*").alias("n")))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _or_zero(F.try_divide(F.lit(2.0) * p * r, p + r))


def metrics_binary(matrix: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and f1 of the class 1; 0 where undefined."""
    hit = F.col("label") == F.col("prediction")
    return (matrix.agg(
        F.sum("n").alias("_n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("_hit"),
        F.sum(F.when(hit & (F.col("label") == 1), F.col("n")).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col("prediction") == 1, F.col("n")).otherwise(0)).alias("_pp"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("_ap"))
        .select(_or_zero(guarded_ratio(F.col("_hit"), F.col("_n"))).alias("accuracy"),
                _or_zero(guarded_ratio(F.col("_tp"), F.col("_pp"))).alias("precision"),
                _or_zero(guarded_ratio(F.col("_tp"), F.col("_ap"))).alias("recall"))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall"))))


def metrics_weighted(matrix: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and f1 averaged over classes by their support."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp"))))
    per_class = (matrix.select(sides.alias("s")).select("s.*").groupBy("cls")
                 .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
                 .withColumn("p", _or_zero(guarded_ratio(F.col("tp"), F.col("predicted"))))
                 .withColumn("r", _or_zero(guarded_ratio(F.col("tp"), F.col("support"))))
                 .withColumn("f", _f1(F.col("p"), F.col("r"))))

    def mean(c: str) -> Column:
        return guarded_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    return per_class.agg(guarded_ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
                         mean("p").alias("precision"), mean("r").alias("recall"),
                         mean("f").alias("f1"))


def metrics_table(matrices: dict[str, DataFrame]) -> DataFrame:
    """One row of weighted metrics per model."""
    rows = [metrics_weighted(m).select(F.lit(name).alias("model"), "*")
            for name, m in matrices.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
