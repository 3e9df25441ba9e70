"""Keyed tables that are updated by small batches: hash buckets, sorted by key, in levels that are folded now and then.

A batch is one version: rows with unique keys, in the folders of the buckets that it touches, sorted by key, with a Bloom
filter of each text key in every file. Level 0 has the batches; when FAN versions of a level are there, `append` folds
them into one of the next level first, so a stream keeps FAN versions per level at most and rewrites a row once per
level. The base that a table is created with has a level of its own and is folded by `fold_all` only.

A list of the versions that count is published after each change; what no list names is deleted one change later, so
that readers of the list before can finish. One run at a time writes. A repeated batch replaces its own version.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.session import written
from webloom.sources.versioned import current_run

FAN = 8
BASE = 99  # level of the rows that a table is created with
LEVEL, VERSION, BUCKET = "store_level", "store_version", "store_bucket"  # names of folders, and columns while reading


class Store(NamedTuple):
    """A table: where it is, its columns, the columns that name a row, and its number of buckets.

    A bucket should be a few hundred megabytes: take as many as the table will have of these. With `grows_only` rows are
    never replaced: keys of a batch are new to the table, so all versions together are the table.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int
    grows_only: bool = False


Live = list[tuple[int, int]]  # (level, version), oldest version first


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, system = _folder(spark, path)
    return [entry.getPath().getName() for entry in system.listStatus(folder)] if system.exists(folder) else []


def _lists(spark: SparkSession, store: Store) -> list[int]:
    """Numbers of the published lists, oldest first."""
    return sorted(int(n) for n in _names(spark, f"{store.path}/_live") if n.isdigit())


def live(spark: SparkSession, store: Store) -> Live:
    """The versions that make up the table."""
    known = _lists(spark, store)
    if not known:
        return []
    file, system = _folder(spark, f"{store.path}/_live/{known[-1]}")
    stream = system.open(file)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return [tuple(map(int, line.split())) for line in text.splitlines()]


def _publish(spark: SparkSession, store: Store, versions: Live) -> None:
    """A list is written under another name first, so that it appears as a whole."""
    known = _lists(spark, store)
    before, number = set(live(spark, store)), known[-1] + 1 if known else 0
    draft, system = _folder(spark, f"{store.path}/_live/draft")
    stream = system.create(draft, True)
    stream.writeBytes("".join(f"{level} {version}\n" for level, version in sorted(versions, key=lambda v: v[1])))
    stream.close()
    if not system.rename(draft, _folder(spark, f"{store.path}/_live/{number}")[0]):
        raise OSError(f"cannot publish list {number} of {store.path}")
    for old in known[:-1]:
        system.delete(_folder(spark, f"{store.path}/_live/{old}")[0], False)
    for level in _names(spark, f"{store.path}/rows"):
        for version in _names(spark, f"{store.path}/rows/{level}"):
            found = (int(level.partition("=")[2]), int(version.partition("=")[2]))
            if found not in before and found not in versions:
                system.delete(_folder(spark, f"{store.path}/rows/{level}/{version}")[0], True)


def bucket_of(store: Store) -> Column:
    return F.pmod(F.xxhash64(*store.keys), F.lit(store.buckets)).cast("int")


def _write(rows: DataFrame, store: Store, level: int, version: int) -> None:
    """One task per bucket that has rows; a bucket of one version is a file."""
    placed = rows.select(*store.schema.fieldNames(), bucket_of(store).alias(BUCKET))
    placed = placed.repartition(BUCKET).sortWithinPartitions(BUCKET, *store.keys)
    writer = placed.write.mode("overwrite").partitionBy(BUCKET)
    for key in store.keys:
        if isinstance(store.schema[key].dataType, T.StringType):
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(f"{store.path}/rows/{LEVEL}={level}/{VERSION}={version}")


def create(spark: SparkSession, store: Store, rows: DataFrame | None = None) -> None:
    """A new table, with `rows` (unique keys) as its base."""
    if rows is not None:
        _write(rows, store, BASE, -1)
    _publish(spark, store, [(BASE, -1)] if rows is not None else [])


def versions(spark: SparkSession, store: Store, which: Live) -> DataFrame:
    """The rows of some versions, with the numbers of level, version and bucket."""
    numbers = [T.StructField(LEVEL, T.IntegerType()), T.StructField(VERSION, T.LongType()), T.StructField(BUCKET, T.IntegerType())]
    schema = T.StructType([*store.schema.fields, *numbers])
    # A version without rows has no bucket, and no folder of one.
    folders = [f"{store.path}/rows/{LEVEL}={level}/{VERSION}={version}" for level, version in which]
    folders = [f for f in folders if any(n.startswith(f"{BUCKET}=") for n in _names(spark, f))]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{store.path}/rows").parquet(*folders)


def _latest(rows: DataFrame, store: Store) -> DataFrame:
    """The newest version of each key; decided on the keys alone."""
    newest = rows.groupBy(BUCKET, *store.keys).agg(F.max(VERSION).alias(VERSION))
    return rows.join(newest, [BUCKET, *store.keys, VERSION], "left_semi")


def read(spark: SparkSession, store: Store) -> DataFrame:
    """The table. Its largest version is scanned and not regrouped: rows with newer ones drop out by an anti-join."""
    which = live(spark, store)
    columns = store.schema.fieldNames()
    if store.grows_only or len(which) < 2:
        return versions(spark, store, which).select(*columns)
    base, newer = which[:1], versions(spark, store, which[1:])
    changed = newer.select(BUCKET, *store.keys).distinct()
    kept = versions(spark, store, base).join(changed, [BUCKET, *store.keys], "left_anti")
    newer = newer if len(which) == 2 else _latest(newer, store)
    return newer.select(*columns).unionByName(kept.select(*columns))


def _touched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the buckets that `wanted`, which has a column of bucket numbers, falls into; at most all numbers of buckets."""
    found = [row[0] for row in wanted.select(BUCKET).distinct().collect()]
    return rows.filter(F.col(BUCKET).isin(found))


def lookup(spark: SparkSession, store: Store, wanted: DataFrame, which: Live | None = None) -> DataFrame:
    """The rows with the keys in `wanted`; only buckets that these fall into are read."""
    asked = written(wanted.select(*store.keys).distinct().withColumn(BUCKET, bucket_of(store)), "wanted-keys")
    rows = _touched(versions(spark, store, live(spark, store) if which is None else which), asked)
    found = rows.join(asked, [BUCKET, *store.keys], "left_semi")
    return (found if store.grows_only else _latest(found, store)).select(*store.schema.fieldNames())


def get(spark: SparkSession, store: Store, *key) -> DataFrame:
    """The row with one key: one bucket is read, and of its files those whose Bloom filter knows the key."""
    literals = [F.lit(value).cast(store.schema[name].dataType) for name, value in zip(store.keys, key, strict=True)]
    number = spark.range(1).select(F.pmod(F.xxhash64(*literals), F.lit(store.buckets)).cast("int")).first()[0]
    rows = versions(spark, store, live(spark, store)).filter(F.col(BUCKET) == number)
    for name, literal in zip(store.keys, literals):
        rows = rows.filter(F.col(name) == literal)
    return rows.orderBy(F.desc(VERSION)).limit(1).select(*store.schema.fieldNames())


def version_of(spark: SparkSession, store: Store, batch_id: int) -> int:
    """The version of the current run's batch: the first batch of a run that a table sees goes behind all it has."""
    run = current_run(spark)
    for name in _names(spark, f"{store.path}/_runs"):
        known, _, offset = name.rpartition("@")
        if known == run:
            return int(offset) + batch_id
    offset = max([-1, *(version for _, version in live(spark, store))]) + 1 - batch_id
    folder, system = _folder(spark, f"{store.path}/_runs/{run}@{offset}")
    system.create(folder, False).close()
    return offset + batch_id


def earlier(spark: SparkSession, store: Store, batch_id: int) -> Live:
    """The versions before the current run's batch, whether the batch is repeated or not."""
    own = version_of(spark, store, batch_id)
    return [v for v in live(spark, store) if v[1] < own]


def append(rows: DataFrame, store: Store, batch_id: int) -> int:
    """Write a batch (unique keys) as a version, after folding levels that are full; returns the version."""
    spark = rows.sparkSession
    own = version_of(spark, store, batch_id)
    before = earlier(spark, store, batch_id)
    for level in sorted({level for level, _ in before} - {BASE}):
        full = [v for v in before if v[0] == level]
        if len(full) >= FAN:
            before = _folded(spark, store, before, full, level + 1)
    _write(rows, store, 0, own)
    if (0, own) not in (now := live(spark, store)):
        _publish(spark, store, [*now, (0, own)])
    return own


def _folded(spark: SparkSession, store: Store, before: Live, full: Live, level: int) -> Live:
    """Merge some versions into one of `level`, which takes the number of the newest."""
    rows = versions(spark, store, full)
    merged = (level, max(version for _, version in full))
    _write(rows if store.grows_only else _latest(rows, store), store, *merged)
    after = [*(v for v in before if v not in full), merged]
    _publish(spark, store, [*(v for v in live(spark, store) if v not in before), *after])
    return sorted(after, key=lambda v: v[1])


def fold_all(spark: SparkSession, store: Store) -> None:
    """Merge everything into one base."""
    which = live(spark, store)
    if len(which) > 1:
        _folded(spark, store, which, which, BASE)
