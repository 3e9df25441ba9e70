"""The document table `sites`, keyed by (language, id).

A stored table is put on shelves: parts of a language by the hash of `id`, ordered by `id`. The metadata of column `id`
say how many there are (those of a partition column are lost in reading), so a lookup knows which shelf to read whatever
the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.session import in_folders

SITE_KEY = ("language", "id")
SHELF = "shelf"  # folder below the language's, and column while reading
DOCUMENTS_PER_SHELF = 100_000
LEAST_SHELVES = 8


def shelved(sites: DataFrame, expected: int) -> DataFrame:
    """`sites` for a write partitioned by (language, shelf), with as many shelves as `expected` documents need.

    A shelf that is larger than others is split; inside files documents are ordered, so that the statistics of row
    groups leave out most of a shelf too.
    """
    shelves = max(LEAST_SHELVES, expected // DOCUMENTS_PER_SHELF)
    placed = sites.withColumn(SHELF, _shelf(F.col("id"), shelves)).withMetadata("id", {"shelves": shelves})
    return in_folders(placed, "language", SHELF).sortWithinPartitions("language", SHELF, "id")


def _shelf(key: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shelves)).cast("int")


def shelves_of(sites: DataFrame) -> int:
    """How many shelves a language has; 0 for a table without."""
    return sites.schema["id"].metadata.get("shelves", 0) if SHELF in sites.columns else 0


def on_shelves(keys: DataFrame, sites: DataFrame) -> tuple[DataFrame, list[str]]:
    """`keys(language, id, ...)` with what names their place in `sites`, and the columns to join on.

    The filter holds for every id; it makes the shelves of the keys worth pruning by while the query runs.
    """
    shelves = shelves_of(sites)
    if not shelves:
        return keys, list(SITE_KEY)
    return keys.withColumn(SHELF, _shelf(F.col("id"), shelves)).filter(F.col(SHELF) >= 0), ["language", SHELF, "id"]


def with_documents(keys: DataFrame, sites: DataFrame) -> DataFrame:
    """`keys(language, id, ...)` with the columns of their documents; keys without one are left out. Give keys that were
    written before: while they are few, only their shelves are read."""
    placed, columns = on_shelves(keys, sites)
    return placed.join(sites, columns).drop(SHELF)


def latest_documents(rows: DataFrame, recency: str = "version") -> DataFrame:
    """The most recent document per key, for stored rows whose recency is unique per key.

    The winners are found on the narrow columns alone, by a hash aggregate, and select the documents afterwards: the
    text is moved once and never sorted.
    """
    winners = rows.groupBy(*SITE_KEY).agg(F.max(recency).alias(recency))
    return rows.join(winners, [*SITE_KEY, recency], "left_semi")


def sites_upsert(stored: DataFrame, arrived: DataFrame, recency: str = "version") -> DataFrame:
    """A document that arrives again replaces the stored one as a whole."""
    return latest_documents(stored.unionByName(arrived), recency)


def identified(found: DataFrame, spoken: DataFrame) -> DataFrame:
    """Stored page documents `found(page_id, id, ...)` with their language, the latest page per (language, id).

    `spoken(page_id, language)` is what `language.detect` says of the pages. The winner is decided on narrow columns; the
    documents meet the result in one join.
    """
    winners = (
        found.select("page_id", "id")
        .join(spoken, "page_id")
        .groupBy(*SITE_KEY)
        .agg(F.max("page_id").alias("page_id"))
        .select("page_id", "language")
    )
    return found.join(winners, "page_id")


def site_lookup(sites: DataFrame, language: str, link: str) -> DataFrame:
    """Link and title of one document; of a stored table one shelf of one language is read, and there the row groups whose
    ids surround the wanted one."""
    wanted = urls.site_id(F.lit(link))
    found = sites.filter((F.col("language") == language) & (F.col("id") == wanted))
    shelves = shelves_of(sites)
    return (found.filter(F.col(SHELF) == _shelf(wanted, shelves)) if shelves else found).select("link", "title")


def sites_lookup(sites: DataFrame, probes: DataFrame) -> DataFrame:
    """Link and title for each of `probes(language, link)`; links without a document give no row."""
    keys = probes.select("language", urls.site_id(F.col("link")).alias("id")).distinct()
    placed, columns = on_shelves(keys, sites)
    return sites.join(placed, columns, "left_semi").select("language", "link", "title")


def sites_delete(sites: DataFrame, keys: DataFrame) -> DataFrame:
    return sites.join(keys.select(*SITE_KEY), list(SITE_KEY), "left_anti")
