import datetime as dt
import os

from webloom.operators import language
from webloom.operators.links import LINK_KEY
from webloom.plans import streams
from webloom.session import STATE_STORE, fresh_path, scratch_dir
from webloom.sources.versioned import compact, read_latest
from webloom.streaming import frontier, sinks
from pyspark.sql import types as T

EPOCH = dt.datetime(2024, 1, 1)
ARRIVAL = T.StructType(
    [
        T.StructField("arrival_id", T.LongType()),
        T.StructField("domain", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)


def arrivals(spark, rows):
    data = [(i, d, f"u{i:03}", EPOCH + dt.timedelta(seconds=s)) for i, d, s in rows]
    return spark.createDataFrame(data, ARRIVAL)


def test_visited_filter_over_batches(spark):
    source, sink, visited, state = (fresh_path(spark, n) for n in ("in", "out", "visited", "state"))
    schema = T.StructType.fromDDL("url string, ts long")
    frontier.create_visited(spark, visited)
    runs = []

    def arrive(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = frontier.read_frontier(spark, source, schema)
        query = frontier.start_visited_filter(stream, visited, sink, state)
        query.awaitTermination()
        runs.append(query.id)
        return sorted(r.link for r in spark.read.parquet(sink).collect())

    assert arrive(("http://e.com/a", 1), ("http://e.com/a/", 2), ("http://nodomain", 1)) == ["http://e.com/a"]
    assert arrive(("http://www.e.com/a", 3), ("e.com/b", 4)) == ["http://e.com/a", "http://e.com/b"]
    # A batch that runs twice keeps its own rows, and counts the same outcomes.
    again = spark.createDataFrame([("http://www.e.com/a", 3), ("e.com/b", 4), ("http://nodomain", 5)], schema)
    counts = fresh_path(spark, "counts")
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", runs[0])
    for _ in range(2):
        frontier.visited_filter(visited, sink, counts)(again, 1)
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    found = {r.outcome: r.n for r in spark.read.parquet(counts).collect()}
    assert found == {"no_domain": 1, "unvisited": 1, "visited_skip": 1}
    assert sorted(r.link for r in spark.read.parquet(sink).collect()) == ["http://e.com/a", "http://e.com/b"]


def test_politeness_state_survives_batches(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    first = [(0, "d", 0), (1, "d", 10), (2, "e", 5)]
    second = [(3, "d", 29), (4, "d", 30), (5, "d", 59), (6, "e", 34), (7, "e", 35), (8, "f", 1)]
    want = {0: True, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True, 8: True}
    source, sink, table, state = (fresh_path(spark, n) for n in ("in", "out", "last", "state"))
    keyed_sink, keyed_state = fresh_path(spark, "out"), fresh_path(spark, "state")
    frontier.create_state(spark, table)
    for rows in (first, second):
        arrivals(spark, rows).write.mode("append").parquet(source)
        stream = frontier.read_frontier(spark, source, ARRIVAL)
        frontier.start_politeness(stream, table, sink, state, 30).awaitTermination()
        admitted = frontier.politeness_stream(frontier.read_frontier(spark, source, ARRIVAL), 30)
        frontier.write_frontier(admitted, keyed_sink, keyed_state).awaitTermination()
    assert {r.arrival_id: r.admitted for r in spark.read.parquet(sink).collect()} == want
    assert {r.arrival_id: r.admitted for r in spark.read.parquet(keyed_sink).collect()} == want


def test_refused_rows_come_back(spark):
    queue, sink, table, state = (fresh_path(spark, n) for n in ("queue", "out", "last", "state"))
    frontier.create_state(spark, table)
    arrivals(spark, [(0, "d", 0), (1, "d", 1), (2, "d", 2), (3, "e", 2)]).write.parquet(f"{queue}/start")
    for _ in range(4):
        rows = frontier.read_frontier(spark, queue, ARRIVAL, recursiveFileLookup="true")
        frontier.start_politeness(rows, table, sink, state, 30, requeue_path=queue).awaitTermination()
    admitted = spark.read.parquet(sink).filter("admitted").collect()
    assert {r.arrival_id: r.ts.second + 60 * r.ts.minute for r in admitted} == {0: 0, 3: 2, 1: 31, 2: 62}


def test_page_store(spark):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")], "lang string, text string")
    profile = language.profiles(train, "text", "lang").cache()
    schema = T.StructType.fromDDL("page_id long, url string, html string")
    source, sites, links, state = (fresh_path(spark, n) for n in ("in", "sites", "links", "state"))

    def fetch(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = frontier.read_frontier(spark, source, schema)
        sinks.start_store(stream, profile, sites, links, state).awaitTermination()

    fetch((1, "http://e.com/a", "<title>The cat</title><a href=/x>the dog</a><a href=/y>and</a>"), (2, "http://e.com/d", "der hund <a href=/z>die</a>"))
    fetch((3, "http://www.e.com/a", "<title>The dog</title><a href=/x>and the</a>"))
    found = read_latest(spark, sites, sinks.SITE_SCHEMA, ("language", "id")).collect()
    assert [(r.language, r.link, r.title) for r in found] == [("en", "http://e.com/a", "The dog")]
    cells = read_latest(spark, links, sinks.LINK_SCHEMA, LINK_KEY).collect()
    assert {(r.src, r.dst): r.anchor_text for r in cells} == {
        ("e.com/a", "e.com/x"): "and the",
        ("e.com/a", "e.com/y"): "and",
    }


def test_new_checkpoint_goes_on(spark):
    """A table outlives the checkpoint of the stream that wrote it, also when it was compacted in between."""
    schema = T.StructType.fromDDL("url string, ts long")
    visited, folded, sink = (fresh_path(spark, n) for n in ("visited", "folded", "out"))
    frontier.create_visited(spark, visited)

    def run(table, *urls):
        source, state = fresh_path(spark, "in"), fresh_path(spark, "state")
        for url in urls:  # a micro batch per file
            spark.createDataFrame([(url, 1)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = frontier.read_frontier(spark, source, schema, max_files=1)
        frontier.start_visited_filter(stream, table, sink, state).awaitTermination()
        return sorted(r.link for r in spark.read.parquet(sink).collect())

    first = ["http://e.com/a", "http://e.com/b", "http://e.com/c"]
    assert run(visited, *first) == first
    compact(spark, visited, folded, frontier.VISITED_SCHEMA, ("url_key",))
    assert run(folded, "http://e.com/a", "http://e.com/d") == [*first, "http://e.com/d"]
    assert run(folded, "http://e.com/d", "http://e.com/b", "http://e.com/e") == [*first, "http://e.com/d", "http://e.com/e"]
    assert read_latest(spark, folded, frontier.VISITED_SCHEMA, ("url_key",)).count() == 5


def test_folder_and_file_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://e.com/{i}", "<p>x") for i in range(20)], "page_id long, url string, html string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "pages.parquet"))
    (tmp_path / "file").mkdir()
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("part-*")
    part.rename(tmp_path / "file" / "pages.parquet")
    for name in ("folder", "file"):
        out = streams._stream(spark, str(tmp_path / name), "pages")
        sink = fresh_path(spark, "out")
        frontier.write_frontier(out, sink, fresh_path(spark, "state")).awaitTermination()
        assert spark.read.parquet(sink).count() == 20


def test_batches_leave_no_scratch(spark):
    schema = T.StructType.fromDDL("url string, ts long")
    visited, sink = fresh_path(spark, "visited"), fresh_path(spark, "out")
    frontier.create_visited(spark, visited)
    run = frontier.visited_filter(visited, sink)
    for i in range(10):
        run(spark.createDataFrame([(f"http://e.com/{i}", i)], schema), i)
    left = os.listdir(scratch_dir(spark).removeprefix("file:"))
    assert not [n for n in left if n.startswith(("keyed-", "arrived-", "fresh-"))]


def test_store_marks_and_feeds_back(spark):
    """A fetched page and the address it was asked under are marked; a URL that failed passes the filter again."""
    train = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")], "lang string, text string")
    profile = language.profiles(train, "text", "lang").cache()
    visited, queue, sites, links, sink = (fresh_path(spark, n) for n in ("visited", "queue", "sites", "links", "out"))
    frontier.create_visited(spark, visited)
    asked = spark.createDataFrame([("http://e.com/old", 1), ("http://f.com/gone", 1)], "url string, ts long")
    keep = frontier.visited_filter(visited, sink, mark=False)
    keep(asked, 0)
    pages = spark.createDataFrame(
        [
            (1, "http://e.com/new", "<p>the cat</p><a href=/new>the dog</a><a href=/old>and</a><a href=/x>cat</a>", "http://e.com/old"),
            (2, "http://d.com/", "der hund <a href=/z>die</a>", "http://d.com/"),
        ],
        "page_id long, url string, html string, requested string",
    )
    sinks.store_pages(profile, sites, links, visited, queue)(pages, 0)
    assert [r.url for r in spark.read.parquet(queue).collect()] == ["http://e.com/x"]
    keep(asked, 1)
    again = spark.read.parquet(sink).filter("version = 1").collect()
    assert [r.link for r in again] == ["http://f.com/gone"]
