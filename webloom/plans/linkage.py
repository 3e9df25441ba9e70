"""Queries and checks for the link table and the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators import documents, extract, links
from webloom.plans import sql
from webloom.plans.derived import link_table, pages, sites
from webloom.session import fresh_path, written
from webloom.sources import leveled
from webloom.sources.tables import read_table

STORE_BUCKETS = 16  # of the stores that the queries here make; a deployment takes as many as its table needs


def _secure() -> Column:
    return F.col("url").startswith("https")


def links_scan(spark: SparkSession, folder: str) -> DataFrame:
    return links.links_scan(link_table(spark, folder))


def links_explode(spark: SparkSession, folder: str) -> DataFrame:
    return links.links_explode(extract.site_records(pages(spark, folder)))


def links_no_protocol(spark: SparkSession, folder: str) -> DataFrame:
    return links.links_from_pages(pages(spark, folder))


def link_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the alphabetically first source; the key is a scalar subquery, so the filter is pushed to the scan."""
    table = link_table(spark, folder)
    first = table.agg(F.min("src")).scalar()
    return table.filter(F.col("src") == first).select("src", "dst", "anchor_text")


def link_contains(spark: SparkSession, folder: str) -> DataFrame:
    """Is there a stored row for each page, and for each link target?"""
    table = link_table(spark, folder)
    probes = table.select(F.col("dst").alias("src")).unionByName(table.select("src")).distinct()
    return links.link_contains(probes, table)


def _store_schema(*names: str) -> T.StructType:
    fields = [T.StructField(name, T.StringType()) for name in names]
    return T.StructType([*fields, T.StructField("version", T.LongType())])


LINK_STORE_SCHEMA = _store_schema("src", "dst", "anchor_text")
SITE_STORE_SCHEMA = _store_schema("language", "id", "link", "title")


def links_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Pages fetched over http are stored first, those over https arrive later; versions follow that order."""
    crawled = pages(spark, folder)
    old = links.links_from_pages(crawled.filter(~_secure())).withColumn("version", F.lit(1).cast("long"))
    new = links.links_from_pages(crawled.filter(_secure())).withColumn("version", F.lit(2).cast("long"))
    store = leveled.Store(fresh_path(spark, "link-store"), LINK_STORE_SCHEMA, links.LINK_KEY, STORE_BUCKETS)
    leveled.create(spark, store, old)
    leveled.append(new, store, 0)
    return leveled.read(spark, store)


def links_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Remove the cells of every source on a blog host."""
    table = link_table(spark, folder)
    gone = table.filter(F.col("src").startswith("blog.")).select("src").distinct()
    return links.links_delete(table, gone)


def ref_counts(spark: SparkSession, folder: str) -> DataFrame:
    return links.ref_counts(link_table(spark, folder))


def ref_counts_multi(spark: SparkSession, folder: str) -> DataFrame:
    return links.ref_counts_multi(link_table(spark, folder))


def top_ref_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 most referenced targets."""
    counts = links.ref_counts(link_table(spark, folder))
    return counts.orderBy(F.desc("num_of_refs"), "id").limit(20)


def link_totals(spark: SparkSession, folder: str) -> DataFrame:
    return links.link_totals(link_table(spark, folder))


def sites_with_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Reference counts of the links that pages of one host carry to each other, and to pages, by key."""
    counted = links.ref_counts(link_table(spark, folder))
    return links.sites_with_refs(sites(spark, folder).select("id", "link", "title"), counted)


def _versions(spark: SparkSession, folder: str, secure: bool) -> DataFrame:
    kept = pages(spark, folder).filter(_secure() if secure else ~_secure())
    return extract.sites(kept).select(
        F.regexp_extract("link", r"^\w+://[^/]+/(\w+)", 1).alias("language"),
        "id",
        "link",
        "title",
        F.col("page_id").alias("version"),
    )


def sites_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A document replaces the stored one if its page comes later."""
    store = leveled.Store(fresh_path(spark, "site-store"), SITE_STORE_SCHEMA, documents.SITE_KEY, STORE_BUCKETS)
    leveled.create(spark, store, links.latest(_versions(spark, folder, False), documents.SITE_KEY, "version"))
    arrived = written(documents.latest_documents(_versions(spark, folder, True)), "arrived-sites")
    stored = leveled.lookup(spark, store, arrived).select(*documents.SITE_KEY, F.col("version").alias("known"))
    newer = arrived.join(stored, list(documents.SITE_KEY), "left").filter("known IS NULL OR version > known")
    leveled.append(newer.drop("known"), store, 0)
    return leveled.read(spark, store)


def site_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for the probes (section of the URL as language, link) of every page: the ids decide."""
    probes = extract.with_link(read_table(spark, folder, "pages")).select(
        F.regexp_extract("link", r"^\w+://[^/]+/(\w+)", 1).alias("language"), "link"
    )
    return documents.sites_lookup(sites(spark, folder), probes)


def sites_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Remove the documents of spam hosts."""
    table = sites(spark, folder).select("language", "id", "link", "title")
    return documents.sites_delete(table, table.filter(F.col("link").rlike("://(spam|cheap)")))


QUERIES = {
    "links_scan": links_scan,
    "links_explode": links_explode,
    "links_no_protocol": links_no_protocol,
    "link_lookup": link_lookup,
    "link_contains": link_contains,
    "links_upsert": links_upsert,
    "links_delete": links_delete,
    "ref_counts": ref_counts,
    "ref_counts_multi": ref_counts_multi,
    "top_ref_counts": top_ref_counts,
    "link_totals": link_totals,
    "sites_with_refs": sites_with_refs,
    "sites_upsert": sites_upsert,
    "site_lookup": site_lookup,
    "sites_delete": sites_delete,
}


def _on_links(select: str) -> str:
    return sql.with_ctes(*sql.TO_LINKS, select=select)


def _on_sites(*ctes: str, select: str) -> str:
    return sql.with_ctes(*sql.TO_SITES, *ctes, select=select)


_SECTION = r"regexp_extract(link, '^\w+://[^/]+/(\w+)', 1)"
_COUNTS = "SELECT dst AS id, count(DISTINCT src) AS num_of_refs FROM links GROUP BY dst"

ORACLES = {
    "links_scan": _on_links("SELECT dst FROM links"),
    "links_explode": sql.with_ctes(*sql.TO_ANCHORS, select="SELECT link, dst, anchor_text FROM page_anchors"),
    "links_no_protocol": sql.with_ctes(
        *sql.TO_ANCHORS, sql.LINKS, select="SELECT src, dst, anchor_text, version FROM links"
    ),
    "link_lookup": _on_links("SELECT src, dst, anchor_text FROM links WHERE src = (SELECT min(src) FROM links)"),
    "link_contains": _on_links("""
SELECT src, src IN (SELECT src FROM links) AS present
FROM (SELECT dst AS src FROM links UNION SELECT src FROM links)"""),
    "links_upsert": sql.with_ctes(
        *sql.TO_ANCHORS,
        select=f"""
SELECT src, dst, anchor_text, version FROM (
  SELECT {sql.site_key('a.link')} AS src, {sql.anchor_key('dst')} AS dst, anchor_text,
         CASE WHEN starts_with(p.url, 'https') THEN 2 ELSE 1 END AS version,
         row_number() OVER (PARTITION BY {sql.site_key('a.link')}, {sql.anchor_key('dst')}
                            ORDER BY starts_with(p.url, 'https') DESC, a.page_id DESC, pos DESC) AS rn
  FROM page_anchors a JOIN pages p ON p.page_id = a.page_id) WHERE rn = 1""",
    ),
    "links_delete": _on_links(
        "SELECT src, dst, anchor_text, version FROM links WHERE NOT starts_with(src, 'blog.')"
    ),
    "ref_counts": _on_links(_COUNTS),
    "ref_counts_multi": _on_links(
        f"SELECT id, num_of_refs, id || ':' || num_of_refs AS label FROM ({_COUNTS}) WHERE num_of_refs > 1"
    ),
    "top_ref_counts": _on_links(f"{_COUNTS} ORDER BY num_of_refs DESC, id LIMIT 20"),
    "link_totals": _on_links('SELECT count(DISTINCT src) AS "rows", count(*) AS cells FROM links'),
    "sites_with_refs": _on_sites(
        *sql.TO_LINKS,
        select=f"""
SELECT s.id, link, title, coalesce(num_of_refs, 0) AS num_of_refs
FROM sites s LEFT JOIN ({_COUNTS}) c ON c.id = {sql.site_key('link')}""",
    ),
    "sites_upsert": sql.with_ctes(
        *sql.TO_PAGE_SITES,
        select=f"""
SELECT language, id, link, title, version FROM (
  SELECT {_SECTION} AS language, id, link, title, page_id AS version, row_number() OVER (
    PARTITION BY {_SECTION}, id ORDER BY page_id DESC) AS rn FROM page_sites) WHERE rn = 1""",
    ),
    "site_lookup": _on_sites(
        select=f"""
SELECT DISTINCT s.language, s.link, s.title
FROM sites s JOIN (SELECT {_SECTION} AS language, sha256({sql.site_key('link')}) AS id
                   FROM page_links) q ON q.language = s.language AND q.id = s.id"""
    ),
    "sites_delete": _on_sites(
        select="SELECT language, id, link, title FROM sites WHERE NOT regexp_matches(link, '://(spam|cheap)')"
    ),
}
