import pytest
from pyspark.sql import functions as F

from webloom.operators import search

SITES = [
    # id, domain, title, text, keywords
    ("1", "a.com", "Red fox", "The quick red fox. It runs! A red red dog", "fox "),
    ("2", "b.com", "Blue fox", "The blue fox sleeps", " "),
    ("3", "a.com", "Dogs", "Red dogs and a quick cat", "dogs red "),
    ("4", "c.com", "Élan", "a a a b", " "),
    ("5", "c.com", "RED FOX", "other words", " "),
]


@pytest.fixture(scope="module")
def index(spark):
    sites = spark.createDataFrame(SITES, "id string, domain string, title string, text string, keywords string")
    sites = sites.withColumn("language", F.lit("en")).withColumn("link", F.concat(F.lit("http://x/"), "id")).cache()
    postings = search.postings(sites).cache()
    terms, stats = search.dictionary(postings).cache(), search.field_stats(sites).cache()
    return search.Index(sites, postings, terms, stats, search.title_grams(sites).cache())


def run(spark, index, *queries):
    asked = spark.createDataFrame([(i, q, "en") for i, q in enumerate(queries)], "query_id int, query string, lang string")
    hits = search.search(asked, index).collect()
    return [{r.id for r in hits if r.query_id == i} for i in range(len(queries))], asked, hits


def test_parse(spark):
    rows = [
        (1, "red domain:a.com fox -Cat domain:b.com"),
        (2, "-"),
        (3, ""),
        (4, "domain: - x-y"),
        (5, "-domain:x"),
    ]
    df = spark.createDataFrame([(i, q, "en") for i, q in rows], "query_id int, query string, lang string")
    got = {r.query_id: (r.text, r.domain, r.exclude) for r in search.parse_queries(df).collect()}
    assert got == {
        1: ("red fox", "b.com", ["cat"]),
        2: ("-", None, []),
        3: ("", None, []),
        4: ("domain: - x-y", None, []),
        5: ("", None, ["domain:x"]),
    }


def test_clauses(spark):
    df = spark.createDataFrame([(1, 'a +b | "c d" e* fg~ hi~1 x-y "p q"~3 ( )', "en")], "query_id int, query string, lang string")
    got = search.clauses(search.parse_queries(df)).orderBy("clause").collect()
    assert [(r.op, r.kind, r.terms, r.distance) for r in got] == [
        ("or", "terms", ["a"], None),
        ("and", "terms", ["b"], None),
        ("or", "phrase", ["c", "d"], None),
        ("or", "prefix", ["e"], None),
        ("or", "fuzzy", ["fg"], 2),
        ("or", "fuzzy", ["hi"], 1),
        ("or", "terms", ["x", "y"], None),
        ("or", "phrase", ["p", "q"], 3),
    ]


def test_kinds_and_operators(spark, index):
    found, _, _ = run(
        spark,
        index,
        "fox",
        "fox +quick",
        "blue +sleeps dogs",
        '"red dog"',
        '"quick cat" fox',
        "do*",
        "fix~1",
        "slleps~",
        "red domain:a.com",
        "red -quick",
        "nothing",
        "-",
        '"a a"',
        "FOX domain:c.com",
        "red +nothing",
    )
    assert found == [
        {"1", "2", "5"},
        {"1"},
        {"2", "3"},
        {"1"},
        {"1", "2", "3", "5"},
        {"1", "3"},
        {"1", "2", "5"},
        {"2"},
        {"1", "3"},
        {"5"},
        set(),
        set(),
        {"4"},
        {"5"},
        set(),
    ]


def test_top_hits_are_limited(spark):
    hits = spark.range(500).select(
        F.lit(1).alias("query_id"), F.lit("en").alias("language"), F.col("id").cast("string"), (F.col("id") % 7).cast("double").alias("score")
    )
    top = search.top_hits(hits).orderBy("rank_no").collect()
    assert [r.rank_no for r in top] == list(range(1, 21)) and {r.score for r in top} == {6.0}
    assert [r.id for r in top] == sorted(str(i) for i in range(500) if i % 7 == 6)[:20]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_fuzzy_terms_are_complete(spark):
    words = ["fox", "fix", "ox", "foxes", "xof", "f", "box", "boxer", "фокс", "foxtrot"]
    index = spark.createDataFrame([("en", w) for w in words], "language string, term string")
    for distance in (1, 2):
        wanted = spark.createDataFrame(
            [(i, "en", 0, distance, w) for i, w in enumerate(words)],
            "query_id int, language string, clause int, distance int, wanted string",
        )
        got = {(r.query_id, r.term) for r in search.fuzzy_terms(wanted, index).collect()}
        assert got == {(i, v) for i, w in enumerate(words) for v in words if edits(w, v) <= distance}


def test_highlight_and_summary(spark, index):
    _, asked, _ = run(spark, index, "red ru*", "zzz")
    marked = search.with_fragments(search.search(asked, index), asked, index.sites)
    got = {r.id: r.fragments for r in marked.collect()}
    assert got["1"] == ["The quick <b>red</b> fox.", "It <b>runs</b>!", "A <b>red</b> <b>red</b> dog"]
    shaped = {r.link[-1]: r for r in search.shape_hits(marked).collect()}
    assert shaped["1"].text == "...The quick <b>red</b> fox....It <b>runs</b>!...A <b>red</b> <b>red</b> dog"
    assert shaped["5"].text == "other words" and shaped["5"].rank == 1.0 and shaped["5"].tags is None
    assert search.hits_json(search.shape_hits(marked)).filter("json like '%\"full-text\":%'").count() == len(got)
    assert sorted(search.counts(asked, marked).collect()) == [(0, len(got)), (1, 0)]


def test_summary_lengths(spark):
    frags = ["x" * 300, "y" * 300, "z" * 300]
    rows = [(1, "t", frags), (2, "s" * 501, []), (3, "s" * 500, [])]
    df = spark.createDataFrame(rows, "i int, text string, f array<string>")
    got = {r.i: r.s for r in df.select("i", search.summary(F.col("text"), F.col("f")).alias("s")).collect()}
    assert got == {1: "..." + frags[0] + "..." + frags[1], 2: "s" * 500 + "...", 3: "s" * 500}


def test_optional_document_fields(spark):
    df = spark.createDataFrame(
        [(1, 1, "t", "l", "x", [], 2.5, "a,b")],
        "query_id int, rank_no int, title string, link string, text string, fragments array<string>, page_rank double, tags string",
    )
    row = search.shape_hits(df).first()
    assert (row.rank, row.tags) == (2.5, ["a", "b"])


def test_autocomplete(spark, index):
    rows = [(1, "re", "EN"), (2, "red fo", "en"), (3, "-x", "en"), (4, "", "en"), (5, "fox", "xx")]
    asked = spark.createDataFrame(rows, "query_id int, query string, lang string")
    got = search.autocomplete(asked, index.sites, index.titles).collect()
    assert {(r.query_id, r.rank_no, r.suggestion) for r in got} >= {(1, 1, "red fox"), (2, 1, "red fox")}
    assert {r.query_id for r in got} == {1, 2}
    many = spark.range(40).select(
        F.lit("en").alias("language"), F.col("id").cast("string"), F.concat(F.lit("Word "), F.col("id").cast("string")).alias("title")
    )
    ask = spark.createDataFrame([(1, "wo", "en")], "query_id int, query string, lang string")
    assert search.autocomplete(ask, many, search.title_grams(many)).count() == search.SUGGESTIONS


def test_long_distances_and_cut_prefixes(spark, index):
    df = spark.createDataFrame([(1, "a~12 b~0 c~01 foo-bar*", "en")], "query_id int, query string, lang string")
    got = search.clauses(search.parse_queries(df)).orderBy("clause").collect()
    assert [(r.kind, r.terms, r.distance) for r in got] == [
        ("fuzzy", ["a"], 2),
        ("fuzzy", ["b"], 0),
        ("fuzzy", ["c"], 1),
        ("prefix", ["foo", "bar"], None),
    ]
    found, _, _ = run(spark, index, "red-fo*", "blue-qu*", "quick-ca*", "fo*")
    assert found == [{"1", "5"}, set(), {"3"}, {"1", "2", "5"}]


def test_many_terms(spark, index):
    """More terms than any list a filter would carry."""
    found, _, _ = run(spark, index, " ".join(f"w{i}" for i in range(300)) + " sleeps")
    assert found == [{"2"}]
