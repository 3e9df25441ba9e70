"""Micro-batched writes of extracted pages into the document and link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from webloom.functions import urls
from webloom.operators import extract, frontier, language, links
from webloom.session import remove_written, written
from webloom.sources.tables import spread
from webloom.sources.versioned import read_versions, version_of, write_batch
from webloom.streaming.frontier import VISITED_SCHEMA, _triggered

SITE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "link", "domain", "title", "text", "keywords", "metadata")]
    + [T.StructField("language", T.StringType())]
)
LINK_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("src", "dst", "anchor_text")])


def store_pages(
    profile: DataFrame, sites_path: str, links_path: str, visited_path: str | None = None, frontier_path: str | None = None
):
    """foreachBatch function: pages to documents of accepted languages and to links of the linked language.

    Every batch is a version of what is written: a later fetch of a page replaces the document and merges into
    its links when the tables are read, and a repeated batch replaces its own output.

    With `visited_path` the URLs of the batch are marked as visited: those requested (column `requested`, if the rows
    have it) and those answered. With `frontier_path` too, the targets of accepted pages that nobody visited go back to
    the frontier as `url`; read it with recursiveFileLookup.
    """

    def run(pages: DataFrame, batch_id: int) -> None:
        found = written(extract.crawl_records(spread(pages)), "batch_records")
        words = written(language.word_counts(found, "text", "page_id"), "batch_words")
        spoken = written(language.detect(found, profile, "page_id", "text", words), "batch_languages")
        accepted = language.accepted(spoken)
        winners = (
            accepted.join(found.select("page_id", "id"), "page_id")
            .groupBy("language", "id")
            .agg(F.max("page_id").alias("page_id"))
            .select("page_id", "language")
        )
        documents = found.join(winners, "page_id").select(*SITE_SCHEMA.fieldNames())
        write_batch(documents, sites_path, batch_id, "language")
        linked = accepted.filter(F.col("language") == language.LINKED_LANGUAGE).select("page_id")
        anchors = extract.anchors_long(found.join(linked, "page_id", "left_semi"))
        write_batch(links.links_from_anchors(anchors).drop("version"), links_path, batch_id)
        if visited_path:
            keys = fetched_keys(pages, found)
            write_batch(keys, visited_path, batch_id)
        if visited_path and frontier_path:
            own = version_of(pages.sparkSession, visited_path, batch_id)
            known = read_versions(pages.sparkSession, visited_path, VISITED_SCHEMA).filter(f"version <= {own}")
            targets = extract.anchors_long(found.join(accepted.select("page_id"), "page_id", "left_semi"))
            new = frontier.new_links(targets, known.select("url_key"))
            write_batch(new.select("url"), frontier_path, batch_id)
        remove_written(found, words, spoken)

    return run


def fetched_keys(pages: DataFrame, found: DataFrame) -> DataFrame:
    """url_key of every URL that was fetched: as answered, and as requested where that is known."""
    keys = found.select(urls.url_key(F.col("link")).alias("url_key"))
    if "requested" in pages.columns:
        asked = urls.canonical_url(urls.with_default_scheme(F.col("requested")))
        keys = keys.unionByName(pages.select(urls.url_key(asked).alias("url_key")))
    return keys.filter("url_key IS NOT NULL").distinct()


def start_store(
    pages: DataFrame,
    profile: DataFrame,
    sites_path: str,
    links_path: str,
    checkpoint: str,
    once: bool = True,
    visited_path: str | None = None,
    frontier_path: str | None = None,
) -> StreamingQuery:
    run = store_pages(profile, sites_path, links_path, visited_path, frontier_path)
    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _triggered(writer, once).start()
