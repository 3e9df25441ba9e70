"""The link table `links(src, dst, anchor_text, version)`, unique per (src, dst), and aggregates over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import extract

LINK_KEY = ("src", "dst")


def latest(rows: DataFrame, keys: tuple[str, ...], *recency: str) -> DataFrame:
    """The most recent row per key.

    An aggregate instead of a ranking window: map-side combine keeps one row per key and task, so a key that was
    written very often does not gather in one task.
    """
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*recency)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*rows.columns)


def link_cells(pages: DataFrame) -> DataFrame:
    """One row per page and target, both ends without protocol, targets without leading www."""
    return _as_cells(extract.page_anchors(pages))


def _as_cells(anchors: DataFrame) -> DataFrame:
    return anchors.select(
        urls.site_key(F.col("link")).alias("src"),
        urls.anchor_key(F.col("dst")).alias("dst"),
        "anchor_text",
        F.col("page_id").alias("version"),
        "pos",
    )


def links_from_pages(pages: DataFrame) -> DataFrame:
    """The link table of a set of pages; of cells with the same ends the last one (page, then place) wins."""
    return latest(link_cells(pages), LINK_KEY, "version", "pos").drop("pos")


def links_from_anchors(anchors: DataFrame) -> DataFrame:
    """As `links_from_pages`, from the long anchor table."""
    return latest(_as_cells(anchors), LINK_KEY, "version", "pos").drop("pos")


def links_scan(links: DataFrame) -> DataFrame:
    return links.select("dst")


def links_explode(sites: DataFrame) -> DataFrame:
    """Cells of page records `sites(link, anchors)`, whose anchors are a map from target to text."""
    # Outer, because the filter inferred for a plain explode would compute the anchors of every page twice.
    cells = sites.select("link", F.explode_outer("anchors").alias("dst", "anchor_text"))
    return cells.filter(F.col("dst").isNotNull())


def link_lookup(links: DataFrame, key: str) -> DataFrame:
    """All cells of one source."""
    return links.filter(F.col("src") == key)


def lookup_all(links: DataFrame, probes: DataFrame) -> DataFrame:
    """All cells of the sources in `probes(src)`."""
    return links.join(probes.select("src").distinct(), "src", "left_semi")


def link_contains(probes: DataFrame, links: DataFrame) -> DataFrame:
    """`probes(src)` with `present`: whether at least one cell is stored under that source."""
    known = links.select("src").distinct().withColumn("present", F.lit(True))
    return probes.join(known, "src", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def links_upsert(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Cell-level merge: a cell that arrives again is replaced, all other stored cells stay."""
    return latest(stored.unionByName(arrived), LINK_KEY, "version")


def links_delete(links: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove every cell of the sources in `keys(src)`."""
    return links.join(keys.select("src"), "src", "left_anti")


def ref_counts(links: DataFrame) -> DataFrame:
    """Number of sources that refer to each target."""
    return links.groupBy("dst").agg(F.count(F.lit(1)).alias("num_of_refs")).select(
        F.col("dst").alias("id"), "num_of_refs"
    )


def ref_counts_multi(links: DataFrame) -> DataFrame:
    return ref_counts(links).filter("num_of_refs > 1").select(
        "id", "num_of_refs", F.concat_ws(":", "id", F.col("num_of_refs").cast("string")).alias("label")
    )


def link_totals(links: DataFrame) -> DataFrame:
    """Number of sources and of cells, both from the counts per source: one pre-aggregated shuffle."""
    per_source = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return per_source.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells"))


def sites_with_refs(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with the number of references to them; 0 for a document nobody refers to."""
    keyed = counts.select(F.col("id").alias("ref_id"), "num_of_refs")
    return (
        sites.join(keyed, urls.site_key(F.col("link")) == F.col("ref_id"), "left")
        .drop("ref_id")
        .withColumn("num_of_refs", F.coalesce("num_of_refs", F.lit(0).cast("long")))
    )
