"""The pipeline on small tables: every stage's decision takes effect and clean documents stay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import BASE, ITEM, SCHEMA, junk, near, prose

ROWS = [
    (1, BASE),
    (2, BASE),
    (3, near(BASE, 40, 4)),
    (4, prose(60, 50) + " " + near(ITEM, 9, 51)),
    (5, prose(40, 52) + " password = abcdefgh12 " + prose(30, 53)),
    (6, junk(54)),
    (7, prose(90, 55)),
    (7, prose(90, 55)),
    (None, prose(70, 56)),
    (None, prose(70, 56)),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    learned = [(1000 + i, junk(i) if i % 2 else prose(90, 2000 + i)) for i in range(240)]
    rows = [(i, t, "xx", "s", len(t), "7", 3, "f", "r", "s") for i, t in [*ROWS, *learned]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1 - i % 2, 0) for i, _ in learned]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
        seen[name] = sorted(r["doc_id"] for r in docs.filter("doc_id < 1000").collect())
    assert seen["quality"] == [1, 2, 3, 4, 5, 7, 7]
    assert seen["near_duplicates"] == [1, 4, 5, 7]
    assert seen["decontamination"] == seen["secret_scan"] == [1, 5, 7]
    (masked,) = docs.filter("doc_id = 5").collect()
    assert "[SECRET]" in masked["text"] and "abcdefgh12" not in masked["text"]
    assert masked["n_chars"] == len(masked["text"])
    assert docs.filter(F.col("doc_id").isNull()).count() == 1
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_rows_without_an_id_of_their_own(spark, folder):
    rows = [(1, prose(90, 60)), (1, prose(90, 61)), (1, prose(90, 61)), (2, BASE), (2, prose(90, 62)), (3, BASE),
            (None, prose(60, 63) + " " + ITEM), (None, BASE), (None, prose(90, 66)), (None, prose(90, 66)), (4, prose(60, 64) + " " + ITEM), (4, prose(90, 65))]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t), "7", 3, "f", "r", "s") for i, t in rows], SCHEMA)
    once = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert sorted(r["text"] for r in once.collect()) == sorted({t for _, t in rows})
    assert once.filter(F.col("text") == BASE).first()["doc_id"] == 2
    clean = corpus_pipeline.decontamination(spark, docs, folder)
    assert sorted(r["text"] for r in clean.collect()) == sorted(t for _, t in rows if not t.endswith(ITEM))


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")] + ["pipeline"]
    assert len(names) == 14
