"""Session construction and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Keyed state of streaming operators lives on disk and in checkpoints, not on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

INITIAL_PARTITIONS = "2000"


def build_session(master: str | None = None, app: str = "webloom", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on.

    On a cluster leave `master` unset and let spark-submit decide, and name a shared folder in spark.checkpoint.dir.
    Shuffles start with INITIAL_PARTITIONS, which adaptive execution merges where a partition would be small; pass
    spark__sql__shuffle__partitions for inputs that need more or far fewer.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.shuffle.partitions", INITIAL_PARTITIONS)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where driver and tasks share a machine.

    On a cluster without that setting intermediate tables would land on each executor's own disk, so this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.gettempdir()


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; intermediate tables go there."""
    return f"{shared_dir(spark).rstrip('/')}/webloom-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when all results have been read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_written(*frames: DataFrame) -> None:
    """Delete the folders of frames that `written` returned; nothing may read them afterwards."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if not folder.toUri().getPath().startswith(scratch_path(spark)):
                raise ValueError(f"{folder} is not an intermediate table")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession) -> str:
    """The scratch folder without its scheme."""
    return spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark)).toUri().getPath()


def in_folders(df: DataFrame, *columns: str) -> DataFrame:
    """`df` dealt out by `columns` for a write partitioned by these: few files per folder, large folders in several tasks.

    Adaptive execution splits and merges the partitions by their size. Ranges would need a sample of the rows first, for
    which everything since the last exchange runs twice.
    """
    return df.hint("rebalance", *[F.col(c) for c in columns])


def write_scratch(df: DataFrame, name: str, *partition_by: str) -> str:
    """Write `df` to a new path in the scratch folder and return the path."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage on storage that outlives executors, and gives the optimizer the real size of the result: a join
    side written this way is broadcast only if its files are below spark.sql.autoBroadcastJoinThreshold.
    """
    path = write_scratch(df, name, *partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
