"""Tables laid out by key, so that joins and aggregates on the key need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame

from patronage.session import fresh_path


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as the table ``name``, cut into ``buckets`` by a hash of ``key``; read it back.

    Tables with the same number of buckets and the same key type meet bucket by bucket. Choose the
    number so that a bucket fits a task; a key with a very large share of all rows makes its bucket
    as large, so such tables are better left to a shuffled join, which can split it. The rows of a
    bucket are first brought together, so that a table has one file per bucket.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return spark.table(name)
