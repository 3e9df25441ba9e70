"""Pages to page records and links. Everything is row-local: no shuffle between a page and its record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html, urls
from webloom.functions.arrays import sorted_runs
from webloom.functions.rows import explode_as

NO_TEXT = "empty"  # fixed value: text of an anchor without text


def with_link(pages: DataFrame) -> DataFrame:
    """Add `link`, the canonical URL of the page; NULL for a page whose URL is refused."""
    return pages.withColumn("link", urls.canonical_url(urls.with_default_scheme(F.trim("url"))))


def cleaned(pages: DataFrame) -> DataFrame:
    """Admissible pages with `link` and `clean`, the HTML without comments, scripts and styles."""
    return with_link(pages).filter(F.col("link").isNotNull()).withColumn("clean", html.clean_html(F.col("html")))


def extract_rejects(pages: DataFrame) -> DataFrame:
    """Pages and anchors that extraction refuses or accepts, counted by reason, in one pass over the pages."""
    linked = with_link(pages).withColumn(
        "clean", F.when(F.col("link").isNotNull(), html.clean_html(F.col("html")))
    )
    scheme = F.lower(F.regexp_extract(urls.with_default_scheme(F.trim("url")), r"^(\w+)://", 1))
    page_reason = (
        F.when(F.col("link").isNotNull(), F.lit("page_accepted"))
        .when(~scheme.isin(*urls.HTTP_SCHEMES), F.lit("page_bad_protocol"))
        .otherwise(F.lit("page_malformed_url"))
    )
    anchor_reasons = F.transform(
        "targets",
        lambda a: F.when(a["dst"].isNotNull(), F.lit("anchor_accepted"))
        .when(urls.is_http(a["resolved"]), F.lit("anchor_malformed_url"))
        .otherwise(F.lit("anchor_bad_protocol")),
    )
    reasons = F.concat(F.array(page_reason), F.coalesce(anchor_reasons, F.array().cast("array<string>")))
    listed = explode_as(_with_targets(linked).select(reasons.alias("reasons")), "reasons", "reason")
    return listed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _with_targets(cleaned_pages: DataFrame) -> DataFrame:
    """Add targets array<struct(dst, pos, text, resolved)>; dst is NULL where the target is refused.

    The three steps are separate projections, so that each is computed once per page.
    """
    found = cleaned_pages.withColumn(
        "base", F.coalesce(urls.resolve_link(F.col("link"), html.base_href(F.col("clean"))), F.col("link"))
    ).withColumn("targets", html.raw_anchors(F.col("clean")))
    resolved = found.withColumn(
        "targets",
        F.transform(
            "targets",
            lambda a: F.struct(
                a["pos"].alias("pos"),
                F.when(a["text"] == "", F.lit(NO_TEXT)).otherwise(a["text"]).alias("text"),
                urls.resolve_link(F.col("base"), a["href"]).alias("resolved"),
            ),
        ),
    )
    return resolved.withColumn(
        "targets",
        F.transform(
            "targets",
            lambda a: F.struct(
                F.when(urls.is_http(a["resolved"]), urls.canonical_url(a["resolved"])).alias("dst"),
                a["pos"].alias("pos"),
                a["text"].alias("text"),
                a["resolved"].alias("resolved"),
            ),
        ),
    ).drop("base")


def resolved_links(pages: DataFrame) -> DataFrame:
    """One row per anchor: page_id, link, pos, href as resolved, text."""
    found = _with_targets(cleaned(pages)).select("page_id", "link", "targets")
    return explode_as(found, "targets", "a").select("page_id", "link", "a.pos", "a.resolved", "a.text", "a.dst")


def with_anchors(cleaned_pages: DataFrame, default_self: bool = True) -> DataFrame:
    """Add anchors array<struct(dst, text, pos)>: targets grouped per page, texts joined in document order.

    With `default_self` a page without usable anchors gets one entry, its own link.
    """
    grouped = _with_targets(cleaned_pages).withColumn(
        "anchors",
        sorted_runs(
            F.transform(
                F.filter("targets", lambda t: t["dst"].isNotNull()),
                lambda t: F.struct(t["dst"].alias("dst"), t["pos"].alias("pos"), t["text"].alias("text")),
            ),
            "dst",
            lambda dst, run: F.struct(
                dst.alias("dst"),
                F.array_join(F.transform(run, lambda t: t["text"]), ", ").alias("text"),
                F.get(run, F.lit(0))["pos"].alias("pos"),
            ),
        ),
    )
    if default_self:
        own = F.array(F.struct(F.col("link").alias("dst"), F.lit(NO_TEXT).alias("text"), F.lit(0).alias("pos")))
        grouped = grouped.withColumn("anchors", F.when(F.size("anchors") > 0, F.col("anchors")).otherwise(own))
    return grouped.drop("targets")


def anchors_long(entries: DataFrame) -> DataFrame:
    """Long form of `entries(page_id, link, anchors)`: page_id, link, dst, anchor_text, pos of the first such anchor."""
    return explode_as(entries.select("page_id", "link", "anchors"), "anchors", "a").select(
        "page_id", "link", F.col("a.dst").alias("dst"), F.col("a.text").alias("anchor_text"), "a.pos"
    )


def page_anchors(pages: DataFrame, default_self: bool = True) -> DataFrame:
    """Long anchor table of pages."""
    return anchors_long(with_anchors(cleaned(pages), default_self))


def with_fields(cleaned_pages: DataFrame) -> DataFrame:
    """Add title, text, keywords and metadata."""
    parsed = cleaned_pages.withColumn("metas", html.metas(F.col("clean")))
    return (
        parsed.withColumn("title", html.title(F.col("clean")))
        .withColumn("text", html.visible_text(F.col("clean")))
        .withColumn("keywords", html.keywords(F.col("clean"), F.col("metas")))
        .withColumn("metadata", html.metadata(F.col("metas")))
        .drop("metas")
    )


SITE_COLUMNS = ("page_id", "id", "link", "domain", "title", "text", "keywords", "metadata")


def _as_sites(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("id", urls.site_id(F.col("link"))).withColumn("domain", urls.host_of(F.col("link")))


def sites(pages: DataFrame) -> DataFrame:
    """The document part of a page record: id, link, domain (host), title, text, keywords, metadata."""
    return _as_sites(with_fields(cleaned(pages))).select(*SITE_COLUMNS)


def crawl_records(pages: DataFrame) -> DataFrame:
    """Documents and anchors in one pass over the HTML, to be stored; what follows reads columns of it."""
    return _as_sites(with_anchors(with_fields(cleaned(pages)))).select(*SITE_COLUMNS, "anchors")


def site_records(pages: DataFrame) -> DataFrame:
    """The complete record of a page, with its HTML and the anchor map."""
    return with_anchors(with_fields(cleaned(pages))).select(
        "page_id",
        "link",
        "title",
        "keywords",
        "text",
        "metadata",
        "html",
        F.map_from_entries(F.transform("anchors", lambda a: F.struct(a["dst"], a["text"]))).alias("anchors"),
    )
