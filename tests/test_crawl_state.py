"""Redirected admission against a plain walk, expiring state, and counted outcomes over several micro batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators import language, politeness
from webloom.session import STATE_STORE, fresh_path
from webloom.sources import leveled
from webloom.streaming import crawl, frontier

ARRIVALS = T.StructType(
    [T.StructField(n, T.StringType() if n in ("domain", "url", "answered") else T.LongType()) for n in ("arrival_id", "domain", "url", "at", "answered")]
)
START = dt.datetime(2024, 1, 1)


def walk(rows: list[tuple], period: int) -> dict[int, bool]:
    held: dict[str, int] = {}
    out = {}
    for number, domain, _, at, answered in sorted(rows, key=lambda r: (r[3], r[2], r[0])):
        out[number] = at - held.get(domain, -(10**9)) >= period
        if out[number]:
            held[domain] = at
            if answered:
                held[answered] = at
    return out


@pytest.mark.parametrize("seed, domains, count", [(1, 4, 3), (2, 1, 2)])
def test_redirected_admission(spark, seed, domains, count):
    r = random.Random(seed)
    rows = [
        (i, f"d{r.randrange(domains)}", r.choice("ab"), r.randrange(150), r.choice([None, "d0", "d1", "d2", "elsewhere"]))
        for i in range(120)
    ]
    df = spark.createDataFrame([*rows, (999, None, "a", 5, "d0")], ARRIVALS).withColumn("ts", F.timestamp_seconds("at"))
    got = politeness.admit_redirected(df, 7, count).collect()
    assert {r["arrival_id"]: r["admitted"] for r in got} == walk(rows, 7)


def test_redirects_of_nothing(spark):
    df = spark.createDataFrame([], ARRIVALS).withColumn("ts", F.timestamp_seconds("at"))
    assert politeness.admit_redirected(df, 7).count() == 0


def test_rounds_decide_only_what_changed(spark, monkeypatch):
    """A chain of redirects, each deciding about the next: a round decides the one domain that is next, and no others."""
    monkeypatch.setattr(politeness, "FAN_IN", 2)  # the rounds of the chain are folded on the way
    chain = [(i, f"d{i}", "u", 5 * i, f"d{i + 1}") for i in range(7)]
    rest = [(100 + i, f"e{i % 20}", "u", 3 * i, None) for i in range(200)]
    df = spark.createDataFrame([*chain, *rest], ARRIVALS).withColumn("ts", F.timestamp_seconds("at"))
    admit, sizes = politeness.admit, []

    def counted(arrivals, *args):
        sizes.append(arrivals.count())
        return admit(arrivals, *args)

    monkeypatch.setattr(politeness, "admit", counted)
    got = politeness.admit_redirected(df, 7, 2).collect()
    assert {r["arrival_id"]: r["admitted"] for r in got} == walk([*chain, *rest], 7)
    assert sizes[0] == len(chain) + len(rest) and sizes[1] == 6 and len(sizes) > 4 and max(sizes[2:]) < 6


def test_state_expires(spark):
    """Four micro batches in order of time: decisions are those of a walk, and only domains of the last period have state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    r = random.Random(3)
    queue, sink, checkpoint = (fresh_path(spark, n) for n in ("queue", "admitted", "state"))
    rows, schema = [], "arrival_id long, domain string, url string, ts timestamp"
    for part in range(4):
        some = [(100 * part + i, f"d{r.randrange(3) + 2 * part}", "u", part * 100 + r.randrange(100)) for i in range(40)]
        rows += [(*row, None) for row in some]
        frame = spark.createDataFrame([(*row[:3], START + dt.timedelta(seconds=row[3])) for row in some], schema)
        frame.write.mode("append").parquet(queue)
        stream = frontier.read_frontier(spark, queue, frame.schema)
        frontier.write_frontier(frontier.politeness_stream(stream, 20, 5), sink, checkpoint).awaitTermination()
    got = {r["arrival_id"]: r["admitted"] for r in spark.read.parquet(sink).collect()}
    want = walk(rows, 20)
    assert got == want
    last = {}
    for number, domain, _, at, _ in rows:
        if want[number]:
            last[domain] = max(at, last.get(domain, 0))
    watermark = max(row[3] for row in rows) - 5
    left = {r["domain"] for r in frontier.open_domains(spark, checkpoint).collect()}
    assert left == {d for d, at in last.items() if at + 20 >= watermark} and len(left) < len(last)


def test_counted_crawl(spark):
    """Three micro batches, the last one run twice; every row is counted under what became of it."""
    train = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")], "lang string, text string")
    profile = language.profiles(train, "text", "lang").cache()
    web = spark.createDataFrame(
        [("http://a.com/1", 1, "the cat"), ("http://b.com/1", 2, "die katze"), ("http://a.com/3", 3, "the dog")],
        "link string, page_id long, text string",
    )
    tables = crawl.Crawl(
        frontier.visited_store(fresh_path(spark, "visited"), 2), crawl.held_store(fresh_path(spark, "held"), 2),
        fresh_path(spark, "outcomes"),
    )
    leveled.create(spark, tables.visited)
    leveled.create(spark, tables.held)
    run = crawl.counted_crawl(tables, web, profile, 30)
    batches = [
        [(1, "http://www.a.com/1/", 0), (2, "http://a.com/1", 1), (3, "http://b.com/1", 2), (4, "http://localhost/x", 2)],
        [(5, "http://a.com/2", 10), (6, "http://x.com:y/", 11), (7, "http://b.com/1", 40)],
        [(8, "http://a.com/3", 50), (9, "http://c.com/9", 51)],
    ]
    for number, rows in [*enumerate(batches), (2, batches[2])]:
        df = spark.createDataFrame(rows, "arrival_id long, url string, at long").withColumn("ts", F.timestamp_seconds("at"))
        run(df.drop("at"), number)
    assert {r["outcome"]: r["n"] for r in crawl.outcomes(spark, tables).collect()} == {
        "polled": 9, "malformed_url": 1, "no_domain": 1, "visited_skip": 2, "domain_skip": 1, "fetched": 3,
        "fetch_failed": 1, "page_stored": 2, "language_skip": 1,
    }
