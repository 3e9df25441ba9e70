"""The checks of a crawl over a stream of frontier rows, and what became of each row, counted as the batches run.

Every number is an observation of a job that runs anyway (`DataFrame.observe`): nothing is read again to be counted.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from webloom.operators import frontier as batch
from webloom.operators import language
from webloom.operators.politeness import PERIOD_SECONDS, admit, micros
from webloom.session import remove_written, written
from webloom.sources import leveled
from webloom.sources.versioned import write_batch
from webloom.streaming.frontier import LAST_SCHEMA, _triggered, mark_keys, seen_before

OUTCOME_SCHEMA = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("n", T.LongType())])


class Crawl(NamedTuple):
    """Where a crawl keeps its tables: visited keys and last admissions (stores), outcomes (a folder of versions)."""

    visited: leveled.Store
    held: leveled.Store
    outcomes: str


def held_store(path: str, buckets: int) -> leveled.Store:
    """The last admission of each domain, in microseconds."""
    return leveled.Store(path, LAST_SCHEMA, ("domain",), buckets)


def _counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items())), seen


def counted_crawl(crawl: Crawl, web: DataFrame, profile: DataFrame, period_seconds: int = PERIOD_SECONDS):
    """foreachBatch function over frontier rows (arrival_id, url, ts): check, fetch from `web`, tell the language, count.

    `web(link, page_id, text)` answers for the network; a link that it does not have is a failed fetch. A URL is marked
    as visited when it passes the visited filter, a domain is held when a row is admitted. Counts of a batch (`polled`,
    `malformed_url`, `no_domain`, `visited_skip`, `domain_skip`, `fetched`, `fetch_failed`, `page_stored`,
    `language_skip`) are a version of the outcome table, so that a repeated batch replaces its own.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        keyed, arrived = _counted(
            batch.keyed(rows), "arrived", polled=F.lit(True), malformed_url=F.col("link").isNull(),
            no_domain=F.col("link").isNotNull() & F.col("domain").isNull(), kept=F.col("domain").isNotNull(),
        )
        keyed = written(keyed, "crawl-keyed")
        first = written(batch.first_per_key(keyed.filter("domain IS NOT NULL")), "crawl-first")
        fresh, passed = _counted(
            first.join(seen_before(first, crawl.visited, batch_id), "url_key", "left_anti"), "passed", fresh=F.lit(True)
        )
        fresh = written(fresh, "crawl-fresh")
        since = leveled.lookup(spark, crawl.held, fresh, leveled.earlier(spark, crawl.held, batch_id))
        checked = admit(fresh.select("arrival_id", "domain", "url", "ts"), period_seconds, earlier=written(since, "crawl-since"))
        checked, tried = _counted(checked, "tried", admitted=F.col("admitted"), domain_skip=~F.col("admitted"))
        checked = written(checked, "crawl-checked")
        admitted = checked.filter("admitted")
        asked = fresh.select("arrival_id", "link").join(admitted.select("arrival_id"), "arrival_id", "left_semi")
        answered = asked.join(web, "link", "left").select("arrival_id", "page_id", "text")
        answered, fetches = _counted(answered, "fetches", failed=F.col("page_id").isNull(), pages=F.col("page_id").isNotNull())
        answered = written(answered, "crawl-answered")
        pages = answered.filter("page_id IS NOT NULL").select("page_id", "text")
        stored = F.col("language").isin(*language.ACCEPTED_LANGUAGES)
        words = written(language.word_counts(pages, "text", "page_id"), "crawl-words")
        detected = language.detect(pages, profile, "page_id", "text", words)
        spoken, told = _counted(detected, "told", stored=stored, skipped=~stored)
        spoken.write.format("noop").mode("overwrite").save()
        a, f = arrived.get, fetches.get
        counts = {
            **{name: a[name] for name in ("polled", "malformed_url", "no_domain")},
            "visited_skip": a["kept"] - passed.get["fresh"],
            "domain_skip": tried.get["domain_skip"], "fetched": f["pages"], "fetch_failed": f["failed"],
            "page_stored": told.get["stored"], "language_skip": told.get["skipped"],
        }
        write_batch(spark.createDataFrame(sorted(counts.items()), OUTCOME_SCHEMA), crawl.outcomes, batch_id)
        leveled.append(admitted.groupBy("domain").agg(F.max(micros(checked)).alias("since")), crawl.held, batch_id)
        mark_keys(fresh.select("url_key"), crawl.visited, batch_id)
        remove_written(keyed, first, fresh, checked, answered, words)

    return run


def start_counted_crawl(
    rows: DataFrame,
    crawl: Crawl,
    web: DataFrame,
    profile: DataFrame,
    checkpoint: str,
    period_seconds: int = PERIOD_SECONDS,
    once: bool = True,
) -> StreamingQuery:
    """The counted crawl over a stream of `rows(arrival_id, url, ts)`; both stores must have been created."""
    run = counted_crawl(crawl, web, profile, period_seconds)
    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _triggered(writer, once).start()


def outcomes(spark: SparkSession, crawl: Crawl) -> DataFrame:
    """outcome, n over all batches."""
    rows = spark.read.schema(OUTCOME_SCHEMA).parquet(crawl.outcomes)
    return rows.groupBy("outcome").agg(F.sum("n").alias("n"))
