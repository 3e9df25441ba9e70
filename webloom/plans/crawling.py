"""Queries and checks for the batch frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import extract, frontier, language, politeness
from webloom.plans import sql
from webloom.plans.derived import anchors, sites, stored
from webloom.session import fresh_path, written
from webloom.sources import leveled
from webloom.sources.tables import read_table
from webloom.streaming.frontier import visited_store

PERIOD = 7200  # seconds; the events of one user are hours apart
HOT_PERIOD = 600  # an event type comes every few minutes
CRAWL_STEP = 7  # seconds between two pages of the crawl order
ROUNDS = 4
VISITED_BUCKETS = 16  # of the visited set that a query here makes; a deployment takes as many as its table needs


def page_visits(spark: SparkSession, folder: str) -> DataFrame:
    """url_key of every page over https: the part of the web that was fetched before."""
    linked = extract.with_link(read_table(spark, folder, "pages")).filter("link LIKE 'https:%'")
    return linked.select(urls.url_key(F.col("link")).alias("url_key")).distinct()


def found_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The frontier: page URLs and link targets with the page number as arrival time."""
    own = read_table(spark, folder, "pages").select("url", F.col("page_id").alias("ts"))
    targets = anchors(spark, folder).select(F.col("dst").alias("url"), F.col("page_id").alias("ts"))
    return own.unionByName(targets)


def frontier_unvisited(spark: SparkSession, folder: str) -> DataFrame:
    rows = frontier.keyed(found_urls(spark, folder))
    return frontier.unvisited(rows, page_visits(spark, folder)).select("link", "url_key", "domain", "ts")


def new_links(spark: SparkSession, folder: str) -> DataFrame:
    return frontier.new_links(anchors(spark, folder), page_visits(spark, folder))


def frontier_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs and link targets, and their hosts' last label alone, which has no domain."""
    urls_found = found_urls(spark, folder).select("url")
    bare = urls_found.select(F.regexp_extract("url", r"^\w+://[^/?#]*?(\w+)(?:[/?#]|$)", 1).alias("url"))
    return frontier.frontier_rejects(urls_found.unionByName(bare))


def visited_update(spark: SparkSession, folder: str) -> DataFrame:
    """All pages are requested over http and answer under their own URL; the visited set is a store with levels."""
    fetched = read_table(spark, folder, "pages").select(
        F.regexp_replace("url", "^https:", "http:").alias("url"), F.col("url").alias("final_url")
    )
    store = visited_store(fresh_path(spark, "visited"), VISITED_BUCKETS)
    leveled.create(spark, store, page_visits(spark, folder))
    keys = written(frontier.fetched_keys(fetched), "fetched-keys")
    leveled.append(keys.join(leveled.lookup(spark, store, keys), "url_key", "left_anti"), store, 0)
    return leveled.read(spark, store)


def _arrivals(spark: SparkSession, folder: str, domain: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("arrival_id"),
        F.col(domain).cast("string").alias("domain"),
        F.col("props").alias("url"),
        "ts",
    )


def politeness_admit(spark: SparkSession, folder: str) -> DataFrame:
    return politeness.admit(_arrivals(spark, folder, "user_id"), PERIOD).select("arrival_id", "domain", "admitted")


def politeness_admit_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a handful of domains, each spread over many blocks."""
    hot = politeness.admit(_arrivals(spark, folder, "event_type"), HOT_PERIOD)
    return hot.select("arrival_id", "domain", "admitted")


def politeness_redirects(spark: SparkSession, folder: str) -> DataFrame:
    """Every third event of a user is answered by a neighbour, one of the ten with the same first digits."""
    events = _arrivals(spark, folder, "user_id").withColumn("user", F.col("domain").cast("long"))
    neighbour = F.col("user") - F.col("user") % 10 + (F.col("user") + F.col("arrival_id")) % 10
    answered = F.when(F.col("arrival_id") % 3 == 0, neighbour).otherwise(F.col("user")).cast("string")
    checked = politeness.admit_redirected(events.withColumn("answered", answered), PERIOD)
    return checked.select("arrival_id", "domain", "admitted")


def politeness_schedule(spark: SparkSession, folder: str) -> DataFrame:
    slots = politeness.schedule(_arrivals(spark, folder, "user_id"), PERIOD)
    return slots.select("arrival_id", "domain", F.unix_micros("slot").alias("slot_us"))


def politeness_schedule_hot(spark: SparkSession, folder: str) -> DataFrame:
    slots = politeness.schedule(_arrivals(spark, folder, "event_type"), HOT_PERIOD)
    return slots.select("arrival_id", "domain", F.unix_micros("slot").alias("slot_us"))


def crawl_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome counts of one pass over the crawl order: pages arrive every few seconds, known ones are skipped."""
    arrived = frontier.keyed(
        read_table(spark, folder, "pages").select(
            "url",
            F.col("page_id").alias("arrival_id"),
            F.timestamp_seconds(F.col("page_id") * CRAWL_STEP).alias("ts"),
        )
    )
    refused = arrived.filter("domain IS NULL").select(F.lit("no_domain").alias("outcome"), F.lit(1).alias("n"))
    known = page_visits(spark, folder).withColumn("known", F.lit(True))
    keys = written(
        frontier.with_copies(arrived.filter("domain IS NOT NULL")).join(known, "url_key", "left"), "frontier_keys"
    )
    # Of an unknown URL the first copy is tried and the others are skipped; of a known one all are.
    skipped = keys.select(
        F.lit("visited_skip").alias("outcome"), (F.col("copies") - F.when(F.col("known"), 0).otherwise(1)).alias("n")
    )
    tried = politeness.admit(keys.filter("known IS NULL")).select(
        F.when(F.col("admitted"), F.lit("fetched")).otherwise(F.lit("domain_skip")).alias("outcome"),
        F.lit(1).alias("n"),
    )
    checked = refused.unionByName(skipped).unionByName(tried)
    accepted = F.col("language").isin(*language.ACCEPTED_LANGUAGES)
    stored_links = sites(spark, folder).filter(accepted).select("link").distinct()
    kept_anchors = anchors(spark, folder).join(stored_links, "link", "left_semi")
    return frontier.outcomes(checked, sites(spark, folder), kept_anchors, page_visits(spark, folder), accepted)


def trade_links(spark: SparkSession, folder: str) -> DataFrame:
    """links(src, dst) from the star schema: customer to part to supplier to nation to region."""
    node = lambda kind, column: F.concat(F.lit(f"{kind}/"), F.col(column).cast("string"))
    items = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    bought = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = [
        bought.select(node("customer", "o_custkey").alias("src"), node("part", "l_partkey").alias("dst")),
        items.select(node("part", "l_partkey").alias("src"), node("supplier", "l_suppkey").alias("dst")),
        read_table(spark, folder, "supplier").select(
            node("supplier", "s_suppkey").alias("src"), node("nation", "s_nationkey").alias("dst")
        ),
        read_table(spark, folder, "nation").select(
            node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst")
        ),
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def frontier_expand(spark: SparkSession, folder: str) -> DataFrame:
    """From the customers in debt, four rounds."""
    seeds = read_table(spark, folder, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("url")
    )
    links = stored(
        spark,
        folder,
        "trade_links",
        lambda: trade_links(spark, folder).repartitionByRange("src").sortWithinPartitions("src"),
    )
    return frontier.expand(seeds, links, ROUNDS)


QUERIES = {
    "frontier_unvisited": frontier_unvisited,
    "new_links": new_links,
    "frontier_rejects": frontier_rejects,
    "visited_update": visited_update,
    "politeness_admit": politeness_admit,
    "politeness_admit_hot": politeness_admit_hot,
    "politeness_redirects": politeness_redirects,
    "politeness_schedule": politeness_schedule,
    "politeness_schedule_hot": politeness_schedule_hot,
    "crawl_outcomes": crawl_outcomes,
    "frontier_expand": frontier_expand,
}

# ---- checks --------------------------------------------------------------------------------------------------------

_VISITED = "visited AS (SELECT DISTINCT md5(link) AS url_key FROM page_links WHERE link LIKE 'https:%')"
_FOUND = """
found AS (
  SELECT link, page_id AS ts FROM page_links UNION ALL SELECT dst, page_id FROM page_anchors
)"""


def admission(source: str, period: int, select: str) -> tuple[str, str]:
    """CTEs and select: admitted arrivals of `source(arrival_id, domain, url, ts)` by following next-admission links."""
    ctes = f"""
numbered AS (
  SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY domain ORDER BY ts, url, arrival_id) AS n FROM {source}
),
jumps AS (
  SELECT domain, n, min(n) OVER (PARTITION BY domain ORDER BY us
                                 RANGE BETWEEN {period * 1_000_000} FOLLOWING AND UNBOUNDED FOLLOWING) AS next_n
  FROM numbered
),
admitted AS (
  SELECT domain, 1::BIGINT AS n FROM (SELECT DISTINCT domain FROM numbered)
  UNION ALL
  SELECT j.domain, j.next_n FROM admitted d JOIN jumps j ON j.domain = d.domain AND j.n = d.n WHERE j.next_n IS NOT NULL
)"""
    return ctes, select


def _arrival_cte(domain: str) -> str:
    return f"""
arrivals AS (SELECT event_id AS arrival_id, {domain}::VARCHAR AS domain, props AS url, ts FROM events)"""


def _admit(domain: str, period: int) -> str:
    ctes, select = admission(
        "arrivals",
        period,
        "SELECT arrival_id, r.domain, a.n IS NOT NULL AS admitted "
        "FROM numbered r LEFT JOIN admitted a ON a.domain = r.domain AND a.n = r.n",
    )
    return sql.with_ctes(_arrival_cte(domain), ctes, select=select)


def _schedule(domain: str, period: int) -> str:
    us = period * 1_000_000
    return sql.with_ctes(
        _arrival_cte(domain),
        """
numbered AS (
  SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY domain ORDER BY ts, url, arrival_id) AS n FROM arrivals
)""",
        select=f"""
SELECT arrival_id, domain, (max(us - {us} * n) OVER (PARTITION BY domain ORDER BY n) + {us} * n)::BIGINT AS slot_us
FROM numbered""",
    )


_OUTCOME_CTES, _ = admission("open_arrivals", politeness.PERIOD_SECONDS, "")
_NODES = """
trade_links AS (
  SELECT 'customer/' || o_custkey AS src, 'part/' || l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION SELECT 'part/' || l_partkey, 'supplier/' || l_suppkey FROM lineitem
  UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier
  UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation
),
reach AS (
  SELECT 'customer/' || c_custkey AS url, 0 AS round FROM customer WHERE c_acctbal < 0
  UNION
  SELECT dst, round + 1 FROM reach JOIN trade_links ON src = url WHERE round < 4
)"""

ORACLES = {
    "frontier_unvisited": sql.with_ctes(
        *sql.TO_ACCEPTED_ANCHORS,
        _VISITED,
        _FOUND,
        select=f"""
SELECT link, md5(link) AS url_key, {sql.domain_of_host(sql.host('link'))} AS domain, min(ts) AS ts
FROM found WHERE md5(link) NOT IN (SELECT url_key FROM visited) GROUP BY link""",
    ),
    "new_links": sql.with_ctes(
        *sql.TO_ACCEPTED_ANCHORS,
        _VISITED,
        select="""
SELECT DISTINCT dst AS url, md5(dst) AS url_key FROM page_anchors WHERE md5(dst) NOT IN (SELECT url_key FROM visited)""",
    ),
    "frontier_rejects": sql.with_ctes(
        *sql.TO_ACCEPTED_ANCHORS,
        _FOUND,
        rf"""
addresses AS (
  SELECT link AS url FROM found
  UNION ALL SELECT regexp_extract(link, '^\w+://[^/?#]*?(\w+)(?:[/?#]|$)', 1) FROM found
),
hosts AS (
  SELECT regexp_extract(lower(CASE WHEN regexp_matches(url, '^\w+://.+') THEN url ELSE 'http://' || url END),
                        '^\w+://([^/?#:]*)', 1) AS host FROM addresses
)""",
        select=f"""
SELECT CASE WHEN host = '' THEN 'malformed_url' WHEN {sql.domain_of_host('host')} IS NULL THEN 'no_domain' ELSE 'kept' END
       AS reason, count(*) AS n
FROM hosts GROUP BY 1""",
    ),
    "visited_update": sql.with_ctes(
        *sql.TO_PAGE_LINKS, select="""
SELECT md5(link) AS url_key FROM page_links UNION SELECT md5(regexp_replace(link, '^https:', 'http:')) FROM page_links"""
    ),
    "politeness_admit": _admit("user_id", PERIOD),
    "politeness_admit_hot": _admit("event_type", HOT_PERIOD),
    # One event after the other, ten neighbours at a time; `held` has the last hold of each of the ten.
    "politeness_redirects": f"""
WITH RECURSIVE numbered AS (
  SELECT event_id AS arrival_id, user_id, user_id // 10 AS ten, user_id % 10 AS own,
         CASE WHEN event_id % 3 = 0 THEN (user_id + event_id) % 10 ELSE user_id % 10 END AS other, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id // 10 ORDER BY ts, props, event_id) AS n
  FROM events
),
walk AS (
  SELECT ten, 0::BIGINT AS n, -1::BIGINT AS arrival_id, false AS admitted,
         list_transform(range(0, 10), lambda i: -{PERIOD * 10**6}::BIGINT * 1000000) AS held
  FROM (SELECT DISTINCT ten FROM numbered)
  UNION ALL
  SELECT ten, n, arrival_id, ok,
         CASE WHEN ok THEN list_transform(held, lambda h, i: CASE WHEN i - 1 = own OR i - 1 = other THEN us ELSE h END)
              ELSE held END
  FROM (SELECT w.ten, e.n, e.arrival_id, e.own, e.other, e.us, w.held, e.us >= w.held[e.own + 1] + {PERIOD * 10**6} AS ok
        FROM walk w JOIN numbered e ON e.ten = w.ten AND e.n = w.n + 1)
)
SELECT arrival_id, user_id::VARCHAR AS domain, w.admitted
FROM walk w JOIN numbered USING (arrival_id) WHERE w.n > 0""",
    "politeness_schedule": _schedule("user_id", PERIOD),
    "politeness_schedule_hot": _schedule("event_type", HOT_PERIOD),
    "crawl_outcomes": sql.with_ctes(
        *sql.TO_SITES,
        *sql.TO_ACCEPTED_ANCHORS,
        _VISITED,
        f"""
arrived AS (
  SELECT page_id AS arrival_id, url, {sql.domain_of_host(sql.host('link'))} AS domain,
         make_timestamp(page_id * {CRAWL_STEP} * 1000000) AS ts,
         md5(link) IN (SELECT url_key FROM visited)
           OR row_number() OVER (PARTITION BY link ORDER BY page_id) > 1 AS skipped
  FROM page_links
),
open_arrivals AS (SELECT * FROM arrived WHERE NOT skipped)""",
        _OUTCOME_CTES,
        select=f"""
SELECT 'visited_skip' AS outcome, count(*) AS n FROM arrived WHERE skipped
UNION ALL
SELECT CASE WHEN a.n IS NULL THEN 'domain_skip' ELSE 'fetched' END, count(*)
FROM numbered r LEFT JOIN admitted a ON a.domain = r.domain AND a.n = r.n GROUP BY 1
UNION ALL
SELECT CASE WHEN language IN {sql.ACCEPTED} THEN 'page_stored' ELSE 'language_skip' END, count(*) FROM sites GROUP BY 1
UNION ALL
SELECT CASE WHEN md5(dst) IN (SELECT url_key FROM visited) THEN 'anchor_seen' ELSE 'anchor_sent' END, count(*)
FROM page_anchors WHERE link IN (SELECT link FROM sites WHERE language IN {sql.ACCEPTED}) GROUP BY 1""",
    ),
    "frontier_expand": sql.with_ctes(_NODES, select="SELECT url, min(round) AS round FROM reach GROUP BY url"),
}
