import random

from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import frontier


def test_unvisited_and_rejects(spark):
    rows = [
        ("http://e.com/a", 3),
        ("http://www.e.com/a/", 1),
        ("e.com/b", 2),
        ("http://localhost/x", 2),
        ("http://e.com/?a=%zz", 2),
        ("http://seen.org", 5),
    ]
    keyed = frontier.keyed(spark.createDataFrame(rows, "url string, ts int"))
    visited = spark.createDataFrame([("http://seen.org",)], "u string").select(urls.url_key(F.col("u")).alias("url_key"))
    got = frontier.unvisited(keyed, visited).select("link", "ts", "domain").collect()
    assert sorted(got) == [("http://e.com/a", 1, "e.com"), ("http://e.com/b", 2, "e.com")]
    reasons = {r.reason: r.n for r in frontier.frontier_rejects(spark.createDataFrame(rows, "url string, ts int")).collect()}
    assert reasons == {"kept": 4, "no_domain": 1, "malformed_url": 1}


def test_mark_visited(spark):
    fetched = spark.createDataFrame([("http://e.com/r", "http://h.org/")], "url string, final_url string")
    before = frontier.mark_visited(spark.createDataFrame([], "url_key string"), fetched)
    assert before.count() == 2
    assert frontier.mark_visited(before, fetched).count() == 2


def test_expand_matches_search(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)]
    edges += [("hub", f"n{i}") for i in range(0, 60, 5)] + [("n1", "hub")]
    reach, layer = {"n1": 0, "n2": 0}, {"n1", "n2"}
    for number in range(1, 5):
        layer = {d for s, d in edges if s in layer} - set(reach)
        reach.update(dict.fromkeys(layer, number))
    got = frontier.expand(
        spark.createDataFrame([("n1",), ("n2",), ("n1",)], "url string"),
        spark.createDataFrame(edges, "src string, dst string"),
        4,
    )
    assert {r.url: r.round for r in got.collect()} == reach


def test_copies_and_outcomes(spark):
    rows = [("k", "u", 1)] * 200 + [("m", "v", 2), ("k", "t", 1)]
    found = frontier.with_copies(spark.createDataFrame(rows, "url_key string, url string, ts int"))
    assert sorted(found.collect()) == [("k", "t", 1, 201), ("m", "v", 2, 1)]
    counted = frontier.outcomes(
        found.select(F.lit("visited_skip").alias("outcome"), (F.col("copies") - 1).alias("n")),
        spark.createDataFrame([("en",), ("de",)], "language string"),
        spark.createDataFrame([("http://e.com",)] * 5 + [("http://h.org",)], "dst string"),
        spark.createDataFrame([("http://e.com",)], "u string").select(urls.url_key(F.col("u")).alias("url_key")),
        F.col("language") == "en",
    )
    assert {r.outcome: r.n for r in counted.collect()} == {
        "visited_skip": 200,
        "page_stored": 1,
        "language_skip": 1,
        "anchor_seen": 5,
        "anchor_sent": 1,
    }
