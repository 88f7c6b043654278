"""Session helpers: a local session for tests, and durable materialisation."""

from __future__ import annotations

import functools
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(app_name: str = "patronage", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, bring your own."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable_root(spark: SparkSession) -> str:
    """Folder for materialised intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used only where
    that is unset and the session is local, because executors on other machines could not
    read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        _local_roots[app] = tempfile.mkdtemp(prefix="patronage-")
    return _local_roots[app]


def _application_folder(spark: SparkSession) -> str:
    return f"{durable_root(spark)}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder among those that all executors share."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_settled(spark: SparkSession) -> None:
    """Remove what this application has settled; call it when its results are no longer read."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the durable folder and continue from the written table.

    Used where a result feeds several later passes (iterations, statistics plus rows) or
    where rows must not move on a recompute. The written table survives executor loss, cuts
    the lineage, and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = f"{_application_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smaller_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of 2,000 rows unless the session asks for another number.

    A batch stands in the JVM's buffers and in the Python worker at the same time, so that whole
    texts in batches of the default 10,000 rows take a large part of a small executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "2000")


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once per application.

    It is packed into the durable folder, from where Spark hands it out. Tasks that run Python import their functions from it, wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(
        f"{durable_root(spark)}/{package.name}-{app}.zip")
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    stream.write(packed.getvalue())
    stream.close()
    context.addPyFile(path.toString())
    _shipped.add(app)


def shipped(query: Callable) -> Callable:
    """A query, taking the session first, whose tasks find this package and take small batches."""
    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship_package(spark)
        smaller_batches(spark)
        return query(spark, *args)
    return run
