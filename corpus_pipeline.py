"""Corpus cleaning: stages that each write a table which the next one reads.

Low-quality documents go, one document of each group of near duplicates stays, documents that overlap with benchmark
items go, secrets are masked, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe_automaton, decontaminate, quality_cnn, secrets, superminhash
from webloom.llm.batches import documents
from webloom.llm.queries import GOOD_SCORE, quality_model, tokenizer_file
from webloom.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; null and empty texts have a score like others, repeated rows stay."""
    return quality_cnn.keep_good(docs, quality_model(spark, sf_dir), GOOD_SCORE)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a number of their own, written, so that it stays theirs; and the name of its column, which is new."""
    key = "row"
    while key in docs.columns:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id, rows without an id last; of equal ones any.

    Every row is a document of its own, with or without an id, also if it shares its id with others. Rows without words
    are in no group and stay, repeated ones too. Null columns, and columns of any name, pass as they are.
    """
    rows, key = numbered(docs, "pipeline-numbered")
    groups = written(superminhash.near_duplicates(rows, key).select(key, "component_id"), "pipeline-groups")
    ids = rows.select(key, F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"))
    first = groups.join(ids, key).groupBy("component_id").agg(F.min(F.struct("without", "id", key)).alias("first"))
    return rows.join(first.select(F.col(f"first.{key}").alias(key)), key, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item, decided row by row, with or without an id."""
    rows, key = numbered(docs, "pipeline-numbered")
    found = decontaminate.leaks(rows, documents(spark, sf_dir, "benchmark"), key)
    return rows.join(found.select(key).distinct(), key, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; null texts stay null, repeated rows stay."""
    found = secrets.scan(docs, out_col="spans__")
    clean = found.withColumn("text", secrets.masked(F.col("text"), F.col("spans__")))
    length = F.when(F.size("spans__") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document; null texts count as empty, repeated rows stay."""
    return bpe_automaton.encode_decode(docs, tokenizer_file())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

# The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every stage but the last is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
