"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


SMALL_BYTES = 256 << 20


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(table_path(folder, name))


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work at least one partition per core, where the table is small.

    A small table comes in one or two splits and would leave most cores idle. One of more than SMALL_BYTES, as the
    planner knows it, has splits of its own and is returned unchanged, without a shuffle.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
