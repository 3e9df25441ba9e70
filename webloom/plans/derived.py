"""Tables derived from the input tables and stored once per application, as a deployment stores them.

`stored` writes to the shared folder and reads back, so later queries start from Parquet with real statistics.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators import documents, extract, language, links, search
from webloom.session import in_folders, write_scratch, written
from webloom.sources.tables import read_table, spread

DOCUMENTS_PER_SLICE = 8000
DOCUMENTS_PER_PART = 3000  # over the lengths of documents, a block of the search index has a tenth of it or so

_stored: dict[tuple[str, str, int, str], tuple[str, T.StructType]] = {}


def input_state(spark: SparkSession, folder: str) -> int:
    """A number that changes with the files of a folder of tables: their names, sizes and times."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return hash(tuple(sorted(found)))


def stored(
    spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], *partition_by: str
) -> DataFrame:
    """The table `name` of the input `folder`: built and written at first use, read until the input changes."""
    key = (spark.sparkContext.applicationId, folder, input_state(spark, folder), name)
    if key not in _stored:
        table = build()
        _stored[key] = write_scratch(table, name, *partition_by), table.schema
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "pages"))


def profiles(spark: SparkSession, folder: str, counted: DataFrame | None = None) -> DataFrame:
    """Language profiles learned from the labelled documents; from their words, if these are `counted` already."""
    return stored(
        spark,
        folder,
        "profiles",
        lambda: language.profiles(spread(read_table(spark, folder, "documents")), "text", "lang", counted),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Everything extracted from the pages, in one pass over their HTML."""
    return stored(spark, folder, "records", lambda: extract.crawl_records(pages(spark, folder)))


def page_languages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, language of every page."""

    def build() -> DataFrame:
        texts = spread(records(spark, folder).select("page_id", "text"))
        words = written(language.word_counts(texts, "text", "page_id"), "page_words")
        return language.detect(texts, profiles(spark, folder), "page_id", "text", words)

    return stored(spark, folder, "page_languages", build)


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, link, dst, anchor_text, pos of the pages in an accepted language; other pages contribute no links."""
    kept = language.accepted(page_languages(spark, folder)).select("page_id")
    return extract.anchors_long(records(spark, folder).join(kept, "page_id", "left_semi"))


def build_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Latest document per link with its language, for the accepted and the refused languages alike."""
    found = spread(records(spark, folder).drop("anchors"))
    return documents.identified(found, page_languages(spark, folder)).withColumnRenamed("page_id", "version")


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """The document table on its shelves; there is a document per record at most."""

    def build() -> DataFrame:
        return documents.shelved(build_sites(spark, folder), records(spark, folder).count())

    return stored(spark, folder, "sites", build, "language", documents.SHELF)


def link_table(spark: SparkSession, folder: str) -> DataFrame:
    """The links of the pages in the linked language, ordered by source: a lookup skips what holds other sources."""

    def build() -> DataFrame:
        spoken = page_languages(spark, folder).filter(F.col("language") == language.LINKED_LANGUAGE).select("page_id")
        linked = extract.anchors_long(records(spark, folder).join(spoken, "page_id", "left_semi"))
        table = links.links_from_anchors(linked)
        return table.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")

    return stored(spark, folder, "links", build)


def indexed_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the accepted languages: what is searched."""
    return language.accepted(sites(spark, folder))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """Partitioned by language and bucket of the term, sorted by term: a lookup reads the buckets of its terms."""

    def build() -> DataFrame:
        found = indexed_sites(spark, folder)
        index = search.postings(spread(found), max(16, found.count() // DOCUMENTS_PER_PART))
        return _by_bucket(in_slices(index, found.count()), "slice", "term", "field", "block", "id")

    return stored(spark, folder, "postings", build, "language", "bucket", "slice")


def in_slices(table: DataFrame, expected: int) -> DataFrame:
    """`table(id, ...)` with `slice`, a folder below its bucket's for every DOCUMENTS_PER_SLICE of `expected` documents.

    An id is 64 letters long and comes once per word. Files keep each of them once, in a dictionary, while that fits into
    the one megabyte which Parquet allows; else they would grow by the length of an id per row.
    """
    return table.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(-(-expected // DOCUMENTS_PER_SLICE) or 1)).cast("int"))


def _by_bucket(table: DataFrame, *order: str) -> DataFrame:
    """Sorted within language and bucket, for a table that is stored in folders of these, and of slices if it has them."""
    folders = ("language", "bucket", *[c for c in table.columns if c == "slice"])
    return in_folders(table, *folders).sortWithinPartitions("language", "bucket", *order)


class StoredIndex:
    """The tables of `search.Index`, each built and stored when a query first asks for it: a search without fuzzy words
    has no use for the deletions, completion none for the postings."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return stored(self.spark, self.folder, name, build)

    def _kept(self, name: str, build: Callable[[], DataFrame], *order: str) -> DataFrame:
        return stored(self.spark, self.folder, name, lambda: _by_bucket(build(), *order), "language", "bucket")

    @cached_property
    def sites(self) -> DataFrame:
        return indexed_sites(self.spark, self.folder)

    @cached_property
    def postings(self) -> DataFrame:
        return postings(self.spark, self.folder)

    @cached_property
    def terms(self) -> DataFrame:
        return self._stored("terms", lambda: search.dictionary(self.postings))

    @cached_property
    def stats(self) -> DataFrame:
        return self._stored("field_stats", lambda: search.field_stats(self.sites))

    @cached_property
    def titles(self) -> DataFrame:
        def build() -> DataFrame:
            grams = in_slices(search.title_grams(self.sites), self.sites.count())
            return _by_bucket(grams, "slice", "head", "size", "gram", "id")

        return stored(self.spark, self.folder, "title_grams", build, "language", "bucket", "slice")

    @cached_property
    def deletions(self) -> DataFrame:
        return self._kept("deletions", lambda: search.deletion_index(self.terms), "key", "term")

    @cached_property
    def completions(self) -> DataFrame:
        return self._kept("completions", lambda: search.completions(self.titles), "prefix", "at")

    @cached_property
    def blocks(self) -> DataFrame:
        return self._kept("block_bounds", lambda: search.block_bounds(self.postings, self.stats), "term", "field", "block")

    @cached_property
    def hosts(self) -> DataFrame:
        return self._kept("hosts", lambda: search.host_index(self.sites), "domain", "id")


def search_index(spark: SparkSession, folder: str) -> StoredIndex:
    """The stored tables a search reads; none is built before it is read."""
    return StoredIndex(spark, folder)


def whole_index(spark: SparkSession, folder: str) -> search.Index:
    """All tables of the index, built."""
    index = search_index(spark, folder)
    return search.Index(*(getattr(index, name) for name in search.Index._fields))
