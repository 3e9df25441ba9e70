"""Frontier dataflow in batch: visited filter, new links, rejects, expansion and outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.session import written


def keyed(frontier: DataFrame) -> DataFrame:
    """Add link (canonical), url_key and domain to `frontier(url, ...)`; NULL where the URL is refused."""
    linked = frontier.withColumn("link", urls.canonical_url(urls.with_default_scheme(F.trim("url"))))
    return linked.withColumn("url_key", urls.url_key(F.col("link"))).withColumn("domain", urls.domain_of(F.col("link")))


def reject_reason(link: Column, domain: Column) -> Column:
    return (
        F.when(link.isNull(), F.lit("malformed_url")).when(domain.isNull(), F.lit("no_domain")).otherwise(F.lit("kept"))
    )


def frontier_rejects(frontier: DataFrame) -> DataFrame:
    """reason, n: URLs dropped because no domain can be told, and those kept."""
    reason = reject_reason(F.col("link"), F.col("domain")).alias("reason")
    return keyed(frontier).select(reason).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Earliest row (ts, url) per url_key with the number of its `copies`, combined before the exchange."""
    rest = [c for c in rows.columns if c != "url_key"]
    first = F.min_by(F.struct(*rest), F.struct("ts", "url")).alias("first")
    grouped = rows.groupBy("url_key").agg(first, F.count(F.lit(1)).alias("copies"))
    return grouped.select("url_key", "first.*", "copies").select(*rows.columns, "copies")


def first_per_key(rows: DataFrame) -> DataFrame:
    return with_copies(rows).drop("copies")


def unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Admissible rows of `keyed` frontier whose key is not in `visited(url_key)`, each key once."""
    kept = frontier.filter(F.col("domain").isNotNull())
    return first_per_key(kept).join(visited.select("url_key"), "url_key", "left_anti")


def new_links(anchors: DataFrame, visited: DataFrame) -> DataFrame:
    """url, url_key of anchor targets `anchors(dst)` that were not visited yet, each once."""
    targets = anchors.select(F.col("dst").alias("url")).distinct().withColumn("url_key", urls.url_key(F.col("url")))
    return targets.join(visited.select("url_key"), "url_key", "left_anti").select("url", "url_key")


def fetched_keys(fetched: DataFrame) -> DataFrame:
    """url_key of the requested and the final URL of `fetched(url, final_url)`, each once."""
    both = fetched.select(
        F.explode(
            F.array(
                urls.canonical_url(urls.with_default_scheme(F.trim("url"))),
                urls.canonical_url(urls.with_default_scheme(F.trim("final_url"))),
            )
        ).alias("link")
    )
    return both.filter(F.col("link").isNotNull()).select(urls.url_key(F.col("link")).alias("url_key")).distinct()


def mark_visited(visited: DataFrame, fetched: DataFrame) -> DataFrame:
    """Visited keys after fetching: those of `fetched(url, final_url)` are added, each key once."""
    return visited.select("url_key").unionByName(fetched_keys(fetched)).distinct()


def expand(seeds: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """url, round: everything reachable from `seeds(url)` in at most `rounds` steps over `links(src, dst)`.

    Each round is written to the shared folder. That cuts the lineage, survives the loss of executors, and tells the
    planner how large the frontier is: it is broadcast while small and shuffled on the link source otherwise.
    """
    frontier = written(seeds.select("url").distinct().withColumn("round", F.lit(0)), "round")
    visited = frontier
    for number in range(1, rounds + 1):
        reached = (
            links.join(frontier.select(F.col("url").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("url"))
            .distinct()
        )
        fresh = reached.join(visited.select("url"), "url", "left_anti")
        frontier = written(fresh.withColumn("round", F.lit(number)), "round")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def outcomes(
    checked: DataFrame, sites: DataFrame, anchors: DataFrame, visited: DataFrame, accepted: Column
) -> DataFrame:
    """outcome, n: what became of frontier rows, pages and anchors.

    `checked(outcome, n)` are counted frontier rows, `sites(language)` parsed pages, `anchors(dst)` the targets found
    on accepted pages.
    """
    pages = sites.select(F.when(accepted, F.lit("page_stored")).otherwise(F.lit("language_skip")).alias("outcome"))
    known = visited.select("url_key").distinct().withColumn("known", F.lit(True))
    # Counted per target first, so that a target found on very many pages is one row in the join.
    targets = anchors.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    sent = targets.select(urls.url_key(F.col("dst")).alias("url_key"), "n").join(known, "url_key", "left")
    anchor = F.when(F.col("known"), F.lit("anchor_seen")).otherwise(F.lit("anchor_sent"))
    one = F.lit(1).cast("long").alias("n")
    tagged = (
        checked.select("outcome", "n")
        .unionByName(pages.select("outcome", one))
        .unionByName(sent.select(anchor.alias("outcome"), "n"))
    )
    return tagged.groupBy("outcome").agg(F.sum("n").alias("n"))
