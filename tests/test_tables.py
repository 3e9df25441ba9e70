from webloom.functions import urls
from webloom.operators import documents, graph, links
from webloom.session import fresh_path, written
from webloom.sources.versioned import compact, read_latest, write_version
from webloom.streaming.sinks import LINK_SCHEMA
from pyspark.sql import functions as F

CELLS = "src string, dst string, anchor_text string, version int"


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), CELLS)


def test_upsert_merges_cells(spark):
    old = cells(spark, ("a", "x", "1", 1), ("a", "y", "2", 1))
    new = cells(spark, ("a", "x", "3", 2), ("b", "x", "4", 2))
    assert sorted(links.links_upsert(old, new).collect()) == [
        ("a", "x", "3", 2),
        ("a", "y", "2", 1),
        ("b", "x", "4", 2),
    ]


def test_delete_and_contains(spark):
    table = cells(spark, ("a", "x", "1", 1), ("a", "y", "2", 1), ("b", "x", "3", 1))
    left = links.links_delete(table, spark.createDataFrame([("a",)], "src string"))
    assert left.collect() == [("b", "x", "3", 1)]
    probes = spark.createDataFrame([("a",), ("b",), ("x",)], "src string")
    assert {r.src: r.present for r in links.link_contains(probes, left).collect()} == {"a": False, "b": True, "x": False}
    assert links.link_lookup(table, "a").count() == 2
    assert links.lookup_all(table, probes).count() == 3


def test_counts_with_one_hot_target(spark):
    rows = [(f"s{i}", "hot", "", 1) for i in range(500)] + [(f"s{i}", f"t{i}", "", 1) for i in range(100)]
    table = cells(spark, *rows)
    counts = {r.id: r.num_of_refs for r in links.ref_counts(table).collect()}
    assert counts["hot"] == 500 and sum(counts.values()) == len(rows)
    assert [(r.id, r.label) for r in links.ref_counts_multi(table).collect()] == [("hot", "hot:500")]
    assert links.link_totals(table).first() == (500, 600)


def test_counts_reach_documents(spark):
    sites = spark.createDataFrame([("http://e.com/a",), ("https://e.com/b",)], "link string")
    table = cells(spark, ("s", "e.com/a", "", 1), ("t", "e.com/a", "", 1), ("s", "other", "", 1))
    got = links.sites_with_refs(sites, links.ref_counts(table)).collect()
    assert {r.link: r.num_of_refs for r in got} == {"http://e.com/a": 2, "https://e.com/b": 0}


def test_documents_are_replaced_as_a_whole(spark):
    schema = "language string, id string, link string, title string, version int"
    make = lambda link, title, v: spark.range(1).select(
        F.lit("en").alias("language"),
        urls.site_id(F.lit(link)).alias("id"),
        F.lit(link).alias("link"),
        F.lit(title).cast("string").alias("title"),
        F.lit(v).alias("version"),
    )
    table = documents.sites_upsert(make("http://e.com", "old", 1), make("https://e.com", None, 2))
    assert [(r.link, r.title) for r in table.collect()] == [("https://e.com", None)]
    assert documents.site_lookup(table, "en", "http://e.com").collect() == [("https://e.com", None)]
    assert documents.site_lookup(table, "fa", "http://e.com").count() == 0
    assert documents.sites_delete(table, table.select("language", "id")).count() == 0
    assert spark.createDataFrame([], schema).unionByName(table).count() == 1


def test_documents_on_shelves(spark, monkeypatch):
    """Lookups find what they find without shelves, and read the shelves of their keys only."""
    monkeypatch.setattr(documents, "DOCUMENTS_PER_SHELF", 20)
    link = F.format_string("http://h%d.com/a", "id")
    plain = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "fa").otherwise("en").alias("language"), urls.site_id(link).alias("id"),
        link.alias("link"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit(1).alias("version"),
    )
    table = written(documents.shelved(plain, plain.count()), "shelved", "language", documents.SHELF)
    assert documents.shelves_of(table) == 20 and documents.shelves_of(plain) == 0
    assert table.drop(documents.SHELF).exceptAll(plain.select(*table.drop(documents.SHELF).columns)).isEmpty()
    found = documents.site_lookup(table, "en", "https://h7.com/a")
    assert found.collect() == documents.site_lookup(plain, "en", "https://h7.com/a").collect() == [("http://h7.com/a", "t7")]
    assert files_read(found) == 1
    assert documents.site_lookup(table, "fa", "http://h7.com/a").isEmpty()
    probes = spark.createDataFrame(
        [("en", "http://h7.com/a"), ("en", "http://h7.com/a"), ("fa", "h9.com/a"), ("fa", "h7.com/a"), (None, "h9.com/a"), ("en", None)],
        "language string, link string",
    )
    want = [("en", "http://h7.com/a", "t7"), ("fa", "http://h9.com/a", "t9")]
    for stored in (table, plain):
        assert sorted(documents.sites_lookup(stored, probes).collect()) == want
    keys = probes.select("language", urls.site_id(F.col("link")).alias("id"), F.lit(5).alias("n"))
    keys = written(keys, "keys")
    for stored in (table, plain):
        got = documents.with_documents(keys, stored)
        assert sorted(r.title for r in got.collect()) == ["t7", "t7", "t9"]
        assert set(got.columns) == {"language", "id", "n", "link", "title", "version"}
    assert files_read(documents.with_documents(keys, table)) <= 4
    empty = written(documents.shelved(plain.limit(0), 0), "shelved", "language", documents.SHELF)
    assert documents.with_documents(keys, empty).isEmpty() and documents.site_lookup(empty, "en", "h7.com/a").isEmpty()


def files_read(df) -> int:
    """Files that a plan's scan read; of several scans the one of most files."""
    df = df.select("*")  # a plan that ran before counts no files when it runs again
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_versioned_table(spark):
    path, small = fresh_path(spark, "t"), fresh_path(spark, "t")
    rows = lambda *r: spark.createDataFrame(list(r), LINK_SCHEMA)
    write_version(rows(("a", "x", "1"), ("a", "y", "2")), path, 0)
    for _ in range(2):  # a repeated write changes nothing
        write_version(rows(("a", "x", "3")), path, 1)
    want = [("a", "x", "3"), ("a", "y", "2")]
    assert sorted(read_latest(spark, path, LINK_SCHEMA, links.LINK_KEY).drop("version").collect()) == want
    compact(spark, path, small, LINK_SCHEMA, links.LINK_KEY)
    assert sorted(read_latest(spark, small, LINK_SCHEMA, links.LINK_KEY).drop("version").collect()) == want


ADJACENCY = [
    ("a", "o", "b", 9),
    ("a", "o", "a", 2),
    ("b", "i", "a", 3),
    ("b", "i", "c", 4),
    ("b", "o", "d", 1),
    ("e", "o", "b", 7),
]


def adjacency(spark, rows=ADJACENCY):
    return spark.createDataFrame(rows, "domain string, direction string, neighbour string, weight int")


def test_edges_clamp_direction_first_wins(spark):
    edges = graph.graph_edges(graph.numbered(adjacency(spark))).collect()
    assert sorted(edges) == [("a", "b", 5, "to"), ("b", "d", 1, "to"), ("c", "b", 4, "to"), ("e", "b", 5, "to")]
    listed = graph.multi_lookup(
        adjacency(spark), spark.createDataFrame([("b", 1), ("a", 2), ("zz", 3)], "domain string, pos int")
    )
    assert ("a", "b", 3, "to") in graph.graph_edges(listed).collect()
    assert listed.filter("domain = 'zz'").select("neighbour").collect() == [(None,)]


def test_vertices(spark):
    found = {r.id: r.color for r in graph.graph_vertices(graph.numbered(adjacency(spark))).collect()}
    row, other = graph.ROW_COLOR, graph.NEIGHBOUR_COLOR
    # b is first seen as a neighbour of a.
    assert found == {"a": row, "b": other, "c": other, "d": other, "e": row}
    ego = graph.graph_vertices(graph.ego_rows(adjacency(spark), "b")).collect()
    assert {r.id: r.color for r in ego} == {"a": other, "b": row, "c": other, "d": other}
    assert graph.graph_vertices(graph.ego_rows(adjacency(spark), "nobody")).count() == 0


def test_induced_subgraph(spark):
    edges = spark.createDataFrame(
        [("a", "b", 3), ("c", "b", 2), ("b", "a", 4), ("x", "x", 99), ("a", "c", 1)], "src string, dst string, weight int"
    )
    top = graph.top_domains(edges, 2)
    assert sorted((r.pos, r.domain, r.in_links) for r in top.collect()) == [(1, "b", 5), (2, "a", 4)]
    adj = graph.adjacency(edges)
    assert sorted(graph.graph_edges(graph.restrict(adj, top)).select("from", "to", "width").collect()) == [
        ("a", "b", 3),
        ("b", "a", 4),
    ]
    assert {r.id for r in graph.top_graph_vertices(adj, top).collect()} == {"a", "b"}


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from webloom import session

    def fake(master, folder):
        conf = SimpleNamespace(get=lambda key, other: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert session.shared_dir(fake("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert session.shared_dir(fake("local[4]", None))
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master, None))
