"""Files that tasks write themselves, on whatever file system Spark uses for a path."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

# Schemes of Hadoop's file systems and what pyarrow calls the same store.
STORES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would use for it; plain paths belong to the default file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def filesystem(path: str) -> tuple[Any, str]:
    """(file system, path on it) for an address with a scheme; one without is refused, since it could be any store's."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{path} does not say on which file system it is")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{STORES.get(scheme, scheme)}:{rest}")
