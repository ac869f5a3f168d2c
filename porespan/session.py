"""Session helpers: a configured session, the shared scratch folder, and tables that cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
BATCHES, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def spark_session(app: str = "porespan", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow; on a cluster use the session that is there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PORESPAN_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; any other master is an error, because
    executors there don't see each other's files.
    """
    root = spark.conf.get(CHECKPOINT, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT} to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="spark-porespan-")
    return _own[key]


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that are made here pass rows to Python in batches of ``ARROW_BYTES``: both sides hold some of them at a time, and keep what they once took."""
    before = spark.conf.get(BATCHES, None)
    spark.conf.set(BATCHES, ARROW_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCHES) if before is None else spark.conf.set(BATCHES, before)


def limit_batches(spark: SparkSession) -> None:
    """Sets batches of ``ARROW_BYTES`` for the rest of the session: for plans that are returned and only run later, as stages of a pipeline are."""
    spark.conf.set(BATCHES, ARROW_BYTES)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that ``materialize`` returned, once all that was read from them is written."""
    for df in tables:
        if path := _paths.pop(df, None):
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nobody holds any more: it does so when the driver collects garbage, which a long job may not do for long."""
    spark._jvm.java.lang.System.gc()
