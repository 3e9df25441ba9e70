"""Stored tables are built when a query needs them, and from rows that are computed once."""

from pyspark.sql import functions as F

from webloom.operators import language
from webloom.plans import derived, searching
from webloom.session import fresh_path

TEXT = "the quick red fox runs and the lazy dog sleeps near the old river "


def folder_of(spark, n=6):
    """Tables `pages` and `documents` of a few rows."""
    folder = fresh_path(spark, "tables")
    html = "<html><head><title>Red fox {0}</title></head><body><p>{1} {0}</p><a href='/p/{0}'>x</a></body></html>"
    pages = [(i, f"http://a{i % 2}.example.com/en/{i}", html.format(i, TEXT * 3)) for i in range(n)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    documents = [(1, TEXT * 5, "en"), (2, "el zorro rojo corre y el perro duerme cerca del rio " * 5, "es")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return folder


def built(folder):
    return {key[3] for key in derived._stored if key[1] == folder}


def test_a_query_builds_the_tables_it_reads(spark):
    folder = folder_of(spark)
    typed = spark.createDataFrame([(1, "red f", "en")], searching.query_table(spark, []).schema)
    index = derived.search_index(spark, folder)
    assert searching.search.autocomplete(typed, index.sites, index.titles, completed=index.completions).count() == 6
    assert not built(folder) & {"postings", "terms", "deletions", "block_bounds"}
    for query, needless in (('"red fox"', {"deletions", "block_bounds"}), ("fox", {"deletions"}), ("fix~1", set())):
        asked = searching.query_table(spark, [(1, query, "en")])
        assert searching.search.search(asked, derived.search_index(spark, folder)).count() == 6
        assert not built(folder) & needless
    assert {"deletions", "block_bounds"} <= built(folder)


def test_folders_are_dealt_out_without_a_sample(spark):
    """Ranges run everything since the last exchange twice, the first time for a sample."""
    folder = folder_of(spark)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    table = spark.range(100, numPartitions=4).select(F.lit("en").alias("language"), F.col("id").cast("string").alias("term"))
    table = table.withColumn("term", counted("term")).withColumn("bucket", F.lit(1))
    path = derived.write_scratch(derived._by_bucket(table, "term"), "dealt", "language", "bucket")
    assert seen.value == 100
    assert [r.term for r in spark.read.parquet(path).select("term").collect()] == sorted(map(str, range(100)))
    sites = derived.sites(spark, folder)
    assert sites.count() == 6 and derived.documents.shelves_of(sites) == 8


def test_detection_reads_counted_words(spark):
    """The texts themselves are not cut into words again."""
    profile = language.profiles(spark.createDataFrame([("aaaa", "xx"), ("bbbb", "yy")], "text string, lang string"), "text", "lang")
    texts = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "")], "k int, text string")
    words = language.word_counts(texts, "text", "k").cache()
    plain = {r.k: r.language for r in language.detect(texts, profile, "k", "text").collect()}
    assert plain == {1: "xx", 2: "yy", 3: "error"}
    silent = texts.withColumn("text", F.lit(""))
    assert {r.k: r.language for r in language.detect(silent, profile, "k", "text", words).collect()} == plain


def test_ids_stay_in_dictionaries(spark, monkeypatch):
    """The stored rows per document cost no more when there are more documents than a dictionary of ids holds."""
    monkeypatch.setattr(derived, "DOCUMENTS_PER_SLICE", 5)
    folder = folder_of(spark, 12)
    index = derived.search_index(spark, folder)
    for table in (index.postings, index.titles):
        assert {r.slice for r in table.select("slice").distinct().collect()} == {0, 1, 2}
        per_file = table.groupBy(F.input_file_name()).agg(F.countDistinct("slice").alias("n"))
        assert {r.n for r in per_file.collect()} == {1}
    asked = searching.query_table(spark, [(1, '"red fox"', "en"), (2, "fox", "en")])
    assert searching.search.search(asked, index).count() == 24


def test_politeness_asks_the_state_once():
    """A domain's earlier admission is read by one call, and its timer is deleted by its time."""
    from unittest.mock import MagicMock

    import pandas as pd

    from webloom.streaming.frontier import PolitenessState, expiry_millis

    state, handle = PolitenessState(10, expire=True), MagicMock()
    state.init(handle)
    state.last.get.return_value = (5_000_000,)
    rows = pd.DataFrame({"arrival_id": [1], "domain": ["a"], "url": ["u"], "us": [20_000_000]})
    assert [*state.handleInputRows(("a",), iter([rows]), None)][0]["admitted"].tolist() == [True]
    handle.listTimers.assert_not_called()
    state.last.exists.assert_not_called()
    handle.deleteTimer.assert_called_once_with(expiry_millis(5_000_000, 10_000_000))
    handle.registerTimer.assert_called_once_with(expiry_millis(20_000_000, 10_000_000))
