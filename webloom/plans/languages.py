"""Queries and checks for language profiles, identification and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import language
from webloom.plans import sql
from webloom.plans.derived import profiles, sites, stored
from webloom.session import fresh_path
from webloom.sources.profiles import read_profiles, write_profiles
from webloom.sources.tables import read_table, spread


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents").select("doc_id", "text", "lang"))


def language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return language.profiles(_documents(spark, folder), "text", "lang")


def language_profile_files(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles after they were written as files and read back."""
    path = fresh_path(spark, "profile_files")
    write_profiles(profiles(spark, folder), path)
    return read_profiles(spark, path)


def language_profile_totals(spark: SparkSession, folder: str) -> DataFrame:
    return language.profile_totals(profiles(spark, folder))


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, lang, word, tf of the documents; the profiles are learned from them, and detection reads them twice."""
    counted = language.word_counts(_documents(spark, folder), "text", "doc_id", "lang")
    return stored(spark, folder, "document_words", lambda: counted)


def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    words = document_words(spark, folder)
    ids = read_table(spark, folder, "documents").select("doc_id")
    return language.detect(ids, profiles(spark, folder, words), "doc_id", "text", words)


def detect_scores(spark: SparkSession, folder: str) -> DataFrame:
    words = document_words(spark, folder)
    ids = read_table(spark, folder, "documents").select("doc_id")
    found = language.scores(ids, profiles(spark, folder, words), "doc_id", "text", words)
    return found.select("doc_id", "lang", F.round("score", 6).alias("score"), "n_grams")


def accepted_sites(spark: SparkSession, folder: str) -> DataFrame:
    return language.accepted(sites(spark, folder)).select("language", "id", "link", "title")


def route_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Number of documents each store receives per language."""
    to_store = language.routed(sites(spark, folder)).select("language", F.explode("stores").alias("store"))
    return to_store.groupBy("language", "store").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "language_profiles": language_profiles,
    "language_profile_files": language_profile_files,
    "language_profile_totals": language_profile_totals,
    "detect_language": detect_language,
    "detect_scores": detect_scores,
    "accepted_sites": accepted_sites,
    "route_by_language": route_by_language,
}

_DETECTED = sql.detection("detected", "documents", "doc_id")

ORACLES = {
    "language_profiles": sql.with_ctes(sql.PROFILES, select="SELECT lang, n, gram, cnt::BIGINT AS cnt FROM profiles"),
    "language_profile_files": sql.with_ctes(
        sql.PROFILES, select="SELECT lang, n, gram, cnt::BIGINT AS cnt FROM profiles"
    ),
    "language_profile_totals": sql.with_ctes(
        sql.PROFILES,
        select="""
SELECT lang, t.n, total::BIGINT AS total, vocabulary FROM profile_totals t JOIN profile_sizes s ON s.n = t.n""",
    ),
    "detect_language": sql.with_ctes(sql.PROFILES, _DETECTED, select="SELECT doc_id, language FROM detected"),
    "detect_scores": sql.with_ctes(
        sql.PROFILES,
        _DETECTED,
        select="""
SELECT doc_id, lang, round(score / n_grams, 6) AS score, n_grams::BIGINT AS n_grams FROM detected_scores""",
    ),
    "accepted_sites": sql.with_ctes(
        *sql.TO_SITES, select=f"SELECT language, id, link, title FROM sites WHERE language IN {sql.ACCEPTED}"
    ),
    "route_by_language": sql.with_ctes(
        *sql.TO_SITES,
        select=f"""
SELECT language, store, count(*) AS n FROM (
  SELECT language, 'documents' AS store FROM sites WHERE language IN {sql.ACCEPTED}
  UNION ALL SELECT language, 'links' FROM sites WHERE language = 'en') GROUP BY ALL""",
    ),
}
