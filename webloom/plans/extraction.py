"""Queries and checks for page extraction and URL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html, urls
from webloom.operators import extract
from webloom.plans import sql
from webloom.plans.derived import pages
from webloom.sources.tables import read_table


def _fields(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return extract.sites(pages(spark, folder)).select("page_id", *columns)


def page_record(spark: SparkSession, folder: str) -> DataFrame:
    records = extract.site_records(pages(spark, folder))
    return records.select(
        "page_id",
        "link",
        "title",
        "keywords",
        "text",
        "metadata",
        F.length("html").cast("long").alias("html_chars"),
        F.size("anchors").cast("long").alias("n_anchors"),
        F.array_join(F.array_sort(F.map_keys("anchors")), " ").alias("targets"),
    )


def page_title(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = extract.cleaned(read_table(spark, folder, "pages"))
    return cleaned.select("page_id", html.title(F.col("clean")).alias("title"))


def canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    linked = extract.with_link(read_table(spark, folder, "pages"))
    return linked.select("page_id", "url", "link")


def canonical_query(spark: SparkSession, folder: str) -> DataFrame:
    parts = urls.url_parts(urls.with_default_scheme(F.col("url")))
    return read_table(spark, folder, "pages").select(
        "page_id", "url", urls.canonical_query(parts["query"]).alias("query")
    )


def url_domain(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select("page_id", urls.domain_of(F.col("url")).alias("domain"))


def url_host(spark: SparkSession, folder: str) -> DataFrame:
    linked = extract.with_link(read_table(spark, folder, "pages"))
    return linked.select("page_id", urls.host_of(F.col("link")).alias("host"))


def site_key(spark: SparkSession, folder: str) -> DataFrame:
    linked = extract.with_link(read_table(spark, folder, "pages"))
    return linked.select("page_id", urls.site_key(F.col("link")).alias("site_key"))


def url_keys(spark: SparkSession, folder: str) -> DataFrame:
    linked = extract.with_link(read_table(spark, folder, "pages"))
    return linked.select(
        "page_id", urls.site_id(F.col("link")).alias("site_id"), urls.url_key(F.col("link")).alias("url_key")
    )


def resolve_links(spark: SparkSession, folder: str) -> DataFrame:
    return extract.resolved_links(pages(spark, folder)).select("page_id", "pos", "resolved", "text")


def filter_http_links(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.resolved_links(pages(spark, folder)).filter(F.col("dst").isNotNull())
    return found.select("page_id", "pos", "dst", urls.host_of(F.col("dst")).alias("host"))


def page_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return extract.page_anchors(pages(spark, folder), default_self=False).select(
        "page_id", "link", "dst", "anchor_text"
    )


def page_anchors_default(spark: SparkSession, folder: str) -> DataFrame:
    return extract.page_anchors(pages(spark, folder)).select("page_id", "link", "dst", "anchor_text")


def sites_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract.sites(pages(spark, folder))


def extract_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract_rejects(pages(spark, folder))


QUERIES = {
    "sites_extract": sites_extract,
    "page_record": page_record,
    "page_title": page_title,
    "page_text": lambda spark, folder: _fields(spark, folder, "text"),
    "page_keywords": lambda spark, folder: _fields(spark, folder, "keywords"),
    "page_metadata": lambda spark, folder: _fields(spark, folder, "metadata"),
    "page_anchors": page_anchors,
    "page_anchors_default": page_anchors_default,
    "resolve_links": resolve_links,
    "filter_http_links": filter_http_links,
    "extract_rejects": extract_rejects,
    "canonical_urls": canonical_urls,
    "canonical_query": canonical_query,
    "url_domain": url_domain,
    "url_host": url_host,
    "site_key": site_key,
    "url_keys": url_keys,
}


def _on_pages(select: str) -> str:
    return sql.with_ctes(*sql.TO_PAGE_SITES, select=select)


def _on_links(select: str) -> str:
    joined = f"pages p LEFT JOIN canonical c ON c.url = {sql.default_scheme('p.url')}"
    return sql.with_ctes(sql.PAGE_URLS, sql.CANONICAL, select=f"SELECT {select} FROM {joined}")


ORACLES = {
    "sites_extract": _on_pages("SELECT page_id, id, link, domain, title, text, keywords, metadata FROM page_sites"),
    "page_record": sql.with_ctes(
        *sql.TO_ANCHORS,
        sql.PAGE_SITES,
        select="""
SELECT s.page_id, s.link, title, keywords, text, metadata, length(html) AS html_chars, a.n_anchors, a.targets
FROM page_sites s JOIN pages p ON p.page_id = s.page_id
JOIN (SELECT page_id, count(*) AS n_anchors, string_agg(dst, ' ' ORDER BY dst) AS targets
      FROM page_anchors GROUP BY page_id) a ON a.page_id = s.page_id""",
    ),
    "page_title": _on_pages("SELECT page_id, title FROM page_sites"),
    "page_text": _on_pages("SELECT page_id, text FROM page_sites"),
    "page_keywords": _on_pages("SELECT page_id, keywords FROM page_sites"),
    "page_metadata": _on_pages("SELECT page_id, metadata FROM page_sites"),
    "page_anchors": sql.with_ctes(
        *sql.TO_RESOLVED,
        select="""
SELECT page_id, link, dst, string_agg(text, ', ' ORDER BY pos) AS anchor_text
FROM targets WHERE dst IS NOT NULL GROUP BY page_id, link, dst""",
    ),
    "page_anchors_default": sql.with_ctes(
        *sql.TO_ANCHORS, select="SELECT page_id, link, dst, anchor_text FROM page_anchors"
    ),
    "resolve_links": sql.with_ctes(*sql.TO_RESOLVED, select="SELECT page_id, pos, resolved, text FROM resolved"),
    "filter_http_links": sql.with_ctes(
        *sql.TO_RESOLVED,
        select=f"SELECT page_id, pos, dst, {sql.host('dst')} AS host FROM targets WHERE dst IS NOT NULL",
    ),
    "extract_rejects": sql.with_ctes(
        *sql.TO_RESOLVED,
        select=rf"""
SELECT CASE WHEN c.link IS NOT NULL THEN 'page_accepted'
            WHEN NOT regexp_matches(u, '(?i)^https?://') THEN 'page_bad_protocol'
            ELSE 'page_malformed_url' END AS reason, count(*) AS n
FROM (SELECT {sql.default_scheme('url')} AS u FROM pages) p LEFT JOIN canonical c ON c.url = p.u GROUP BY 1
UNION ALL
SELECT CASE WHEN dst IS NOT NULL THEN 'anchor_accepted'
            WHEN regexp_matches(resolved, '(?i)^https?://') THEN 'anchor_malformed_url'
            ELSE 'anchor_bad_protocol' END AS reason, count(*) AS n FROM targets GROUP BY 1""",
    ),
    "canonical_urls": _on_links("page_id, p.url, c.link"),
    "canonical_query": sql.with_ctes(
        sql.PAGE_URLS,
        sql.CANONICAL,
        select=f"""
SELECT page_id, p.url, coalesce(q.query, '') AS query
FROM pages p LEFT JOIN url_queries q ON q.url = {sql.default_scheme('p.url')}""",
    ),
    "url_domain": f"SELECT page_id, {sql.domain_of_host(sql.host('url'))} AS domain FROM pages",
    "url_host": _on_links(f"page_id, {sql.host('c.link')} AS host"),
    "site_key": _on_links(f"page_id, {sql.site_key('c.link')} AS site_key"),
    "url_keys": _on_links(f"page_id, sha256({sql.site_key('c.link')}) AS site_id, md5(c.link) AS url_key"),
}
