"""Session settings, lineage cutting and scratch space."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str = "local[*]", shuffle_partitions: int | None = None, app: str = "kinweave", **extra: str
) -> SparkSession:
    """A session with the settings every job here relies on.

    On a cluster pass the cluster's master; ``shuffle_partitions`` stays unset there so that
    the submitted configuration (or AQE's coalescing) decides.
    """
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return adopt(spark)


def adopt(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to any session and ship this package to its Python workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_kinweave_shipped", None) is None:
        root = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='kinweave-zip-')}/kinweave", "zip", root, "kinweave"
        )
        context.addPyFile(archive)
        context._kinweave_shipped = archive
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a local master may go without one; it gets a temporary
    folder, as driver and tasks are one process there."""
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root:
        return root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kinweave-", dir="/tmp")
    context.setCheckpointDir(root)
    return context.getCheckpointDir() or root


# For large tables that are written once and read once or twice: texts, hashes and ids take about half the room.
SMALL = "zstd"


def cut_lineage(df: DataFrame, *more: DataFrame, codec: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: the plan's history ends there, the rows
    survive the loss of any executor, and Spark knows the size of what it reads. More of the same
    columns is added one after the other."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path, compression=codec)
    for other in more:
        other.write.mode("append").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` wrote and nothing reads any more; tables from elsewhere stay."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("cut-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_cleared(spark: SparkSession):
    """Spark deletes the shuffle files of each query that ends within; else they stay until the driver's garbage goes."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that the optimizer knows to have none; a list of no rows would be read by Python tasks."""
    from pyspark.sql import functions as F

    fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
    return spark.range(0).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint only after counting: at most ``max_rows`` rows, otherwise ``df`` unchanged and
    Spark joins it by shuffle. For inputs that are cheap to count, such as tenant settings; every task
    counts its own rows, and only the counts meet."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= max_rows else df


def task_count(spark: SparkSession) -> int:
    """How many tasks a shuffle is cut into; AQE does not merge partitions of an explicit number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_if_small(df: DataFrame) -> DataFrame:
    """Deal a table of few partitions out to all tasks before costly per-row work: one small file would be
    one task. A large table is read in many partitions and is left where it is, so nothing large moves."""
    tasks = task_count(df.sparkSession)
    # Asking an adaptive plan for its partitions would run its shuffles, here and once more in the job itself;
    # what is shuffled anyway gets its number of tasks by size.
    if " hashpartitioning(" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name for a table a job writes, below the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
