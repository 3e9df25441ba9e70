"""Merge-on-read tables of Parquet files.

A write adds the folder `version=<n>`, and a retried write replaces just that folder, so that writing the same micro
batch twice changes nothing. Micro batches are numbered per run (a streaming query and its checkpoint); a table notes
at which version each run began, so a new run goes on after all versions that are there. One run at a time writes.
Reading keeps the latest row per key. `compact` folds the versions into one, bucketing nothing and locking nothing: it
writes a new table next to the old one, at a version after which any run goes on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = "_runs"  # folder of the notes; readers skip names with an underscore


def write_version(rows: DataFrame, path: str, version: int, *partition_by: str) -> None:
    """Write one batch of rows as version `version`; idempotent."""
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path.rstrip('/')}/version={version}")


def current_run(spark: SparkSession) -> str:
    """The streaming query that runs this micro batch, as its checkpoint names it; `batch` outside of streams."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def version_of(spark: SparkSession, path: str, batch_id: int) -> int:
    """The version under which the current run writes its batch `batch_id` to the table.

    The first batch of a run that a table sees fixes the run's place behind all versions the table has; later and
    repeated batches count from there.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    note_folder = spark._jvm.org.apache.hadoop.fs.Path(folder, RUNS)
    run = current_run(spark)
    if system.exists(note_folder):
        for entry in system.listStatus(note_folder):
            named = re.fullmatch(r"(.+)@(-?\d+)", entry.getPath().getName())
            if named and named[1] == run:
                return int(named[2]) + batch_id
    present = [-1]
    if system.exists(folder):
        names = (entry.getPath().getName() for entry in system.listStatus(folder))
        present += [int(n.removeprefix("version=")) for n in names if re.fullmatch(r"version=-?\d+", n)]
    offset = max(present) + 1 - batch_id
    system.create(spark._jvm.org.apache.hadoop.fs.Path(note_folder, f"{run}@{offset}"), False).close()
    return offset + batch_id


def write_batch(rows: DataFrame, path: str, batch_id: int, *partition_by: str) -> int:
    """Write the current run's batch and return its version; idempotent."""
    version = version_of(rows.sparkSession, path, batch_id)
    write_version(rows, path, version, *partition_by)
    return version


def read_latest(spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...]) -> DataFrame:
    """Latest row per key over all versions; `schema` is that of the rows, without `version`.

    Keys are unique within a version. The winners are found on the key columns alone and select the rows.
    """
    rows = read_versions(spark, path, schema)
    winners = rows.groupBy(*keys).agg(F.max("version").alias("version"))
    return rows.join(winners, [*keys, "version"], "left_semi")


def read_versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
    return spark.read.schema(full).option("basePath", path).parquet(path)


def compact(
    spark: SparkSession, path: str, target: str, schema: T.StructType, keys: tuple[str, ...], *partition_by: str
) -> None:
    """Write the latest rows of `path` as version 0 of the new table `target`."""
    write_version(read_latest(spark, path, schema, keys).drop("version"), target, 0, *partition_by)
