"""Keyed tables with levels: against a dictionary, over many batches, repeated ones included."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import types as T

from webloom.session import fresh_path
from webloom.sources import leveled
from webloom.streaming import frontier

SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("n", T.LongType()), T.StructField("version", T.StringType())]
)


def store(spark, buckets: int = 4) -> leveled.Store:
    return leveled.Store(fresh_path(spark, "store"), SCHEMA, ("name", "n"), buckets)


def frame(spark, rows: dict) -> object:
    return spark.createDataFrame([(name, n, text) for (name, n), text in rows.items()], SCHEMA)


def table(df) -> dict:
    rows = df.collect()
    found = {(r["name"], r["n"]): r["version"] for r in rows}
    assert len(found) == len(rows)
    return found


def test_against_a_dictionary(spark, monkeypatch):
    monkeypatch.setattr(leveled, "FAN", 3)
    r, kept = random.Random(1), store(spark)
    want = {(f"k{i}", i % 3): "base" for i in range(30)}
    leveled.create(spark, kept, frame(spark, want))
    for batch in range(8):
        changes = {(f"k{r.randrange(45)}", r.randrange(3)): f"b{batch}" for _ in range(r.choice([0, 1, 6]))}
        leveled.append(frame(spark, changes), kept, batch)
        if batch == 5:  # the same batch again, as after a failure
            leveled.append(frame(spark, changes), kept, batch)
        want |= changes
    assert table(leveled.read(spark, kept)) == want
    asked = spark.createDataFrame([(f"k{i}", i % 3) for i in range(0, 60, 7)], "name string, n long")
    keys = {(x["name"], x["n"]) for x in asked.collect()}
    assert table(leveled.lookup(spark, kept, asked)) == {k: v for k, v in want.items() if k in keys}
    key = next(iter(want))
    assert table(leveled.get(spark, kept, *key)) == {key: want[key]}
    assert leveled.get(spark, kept, "nobody", 0).count() == 0
    assert len(leveled.live(spark, kept)) <= 1 + 2 * 3
    leveled.fold_all(spark, kept)
    assert len(leveled.live(spark, kept)) == 1 and table(leveled.read(spark, kept)) == want
    # A new run goes on behind what is there.
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "another")
    try:
        leveled.append(frame(spark, {key: "later"}), kept, 0)
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert table(leveled.read(spark, kept)) == want | {key: "later"}


def test_empty(spark):
    kept = store(spark)
    leveled.create(spark, kept)
    assert table(leveled.read(spark, kept)) == {}
    leveled.append(frame(spark, {}), kept, 0)
    assert table(leveled.read(spark, kept)) == {} and leveled.get(spark, kept, "a", 1).count() == 0
    assert leveled.lookup(spark, kept, frame(spark, {("a", 1): "x"})).count() == 0


def test_only_touched_buckets_are_read(spark):
    kept = store(spark, 32)
    leveled.create(spark, kept, frame(spark, {(f"k{i}", 0): "x" for i in range(500)}))
    found = leveled.lookup(spark, kept, frame(spark, {("k7", 0): "y", ("k9", 0): "y"}))
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    named = [re.findall(r"store_bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", line) for line in plan.splitlines() if "PartitionFilters" in line]
    buckets = {b for found in named for many, one in found for b in (many or one).split(",")}
    assert 1 <= len(buckets) <= 2
    (one,) = leveled.get(spark, kept, "k7", 0).collect()
    assert one["version"] == "x"


def files_of(path: str) -> int:
    return sum(name.endswith(".parquet") for _, _, names in os.walk(path.removeprefix("file:")) for name in names)


@pytest.mark.parametrize("batches", [50])
def test_many_micro_batches_keep_few_files(spark, batches):
    """A stream of 50 micro batches: the visited set stays a few versions of a few files, and no URL passes twice."""
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("ts", T.LongType())])
    visited = frontier.visited_store(fresh_path(spark, "visited"), 2)
    leveled.create(spark, visited)
    source, sink = fresh_path(spark, "in"), fresh_path(spark, "out")
    for i in range(batches):
        rows = [(f"http://e.com/{i * 3 + j}", i) for j in range(4)]  # the last one comes again in the next batch
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = frontier.read_frontier(spark, source, schema, max_files=1)
    frontier.start_visited_filter(stream, visited, sink, fresh_path(spark, "state")).awaitTermination()
    passed = [r.link for r in spark.read.parquet(sink).collect()]
    assert len(passed) == len(set(passed)) == batches * 3 + 1
    assert leveled.read(spark, visited).count() == len(passed)
    # At most FAN versions of two levels and what the list before still names, two buckets each.
    assert files_of(visited.path) <= 2 * (2 * leveled.FAN + leveled.FAN)
