"""Groups and phrases against a plain evaluator, on random documents and queries."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from webloom.operators import search

WORDS = "abcde"


def documents(seed: int) -> dict[str, list[str]]:
    r = random.Random(seed)
    return {str(i): [r.choice(WORDS) for _ in range(r.randint(0, 14))] for i in range(40)}


@pytest.fixture(scope="module")
def found(spark):
    """A function from queries to the ids found for each."""
    docs = documents(1)
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    sites = spark.createDataFrame(rows, "id string, text string").select(
        "id", F.lit("en").alias("language"), F.lit("x.com").alias("domain"), F.lit("").alias("title"), "text",
        F.lit("").alias("keywords"),
    )
    postings = search.postings(sites).cache()
    index = search.Index(
        sites, postings, search.dictionary(postings).cache(), search.field_stats(sites).cache(), search.title_grams(sites)
    )

    def run(queries: list[str]) -> list[set[str]]:
        asked = spark.createDataFrame([(i, q, "en") for i, q in enumerate(queries)], "query_id int, query string, lang string")
        parsed = search.parse_queries(asked)
        split = search.clauses(parsed).cache()
        hits = search.combine(search.matches(split, index), split).collect()
        return [{r.id for r in hits if r.query_id == i} for i in range(len(queries))]

    return run


def holds(words: list[str], query: str) -> bool:
    """Recursive evaluation from left to right; parentheses without counterpart are dropped first."""
    pieces = re.findall(r"[+|]|[()]|[a-z]+", query)
    depth, kept = [], []
    for piece in pieces:
        if piece == ")" and not depth:
            continue
        if piece == "(":
            depth.append(len(kept))
        elif piece == ")":
            depth.pop()
        kept.append(piece)
    kept = [p for i, p in enumerate(kept) if i not in depth]

    def group(at: int) -> tuple[bool | None, int]:
        value, op = None, ""
        while at < len(kept) and kept[at] != ")":
            piece = kept[at]
            at += 1
            if piece in "+|":
                op = piece
                continue
            if piece == "(":
                part, at = group(at)
                at += 1
                if part is None:
                    continue
            else:
                part = piece in words
            value = part if value is None else (value and part) if op == "+" else (value or part)
            op = ""
        return value, at

    return bool(group(0)[0])


def random_query(r: random.Random) -> str:
    return " ".join(r.choice(["a", "b", "c", "d", "e", "(", ")", "+", "|", "("]) for _ in range(r.randint(1, 12)))


def test_groups(found):
    r = random.Random(2)
    queries = [random_query(r) for _ in range(120)]
    queries += ["a +(b | (c + d))", "((a", "a))) + b", "( ) + a", "a + ( ) b", "((a + b)) | ((c) + (d | e))", "+ +a | + b", ")("]
    docs = documents(1)
    for query, got in zip(queries, found(queries)):
        assert got == {i for i, words in docs.items() if holds(words, query)}, query


def near(words: list[str], phrase: list[str], slop: int) -> bool:
    """Whether distinct places of the phrase's words, less their place in the phrase, lie within the distance."""
    places = [[i for i, w in enumerate(words) if w == p] for p in phrase]

    def pick(n: int, taken: tuple[int, ...]) -> bool:
        if n == len(phrase):
            starts = [p - i for i, p in enumerate(taken)]
            return max(starts) - min(starts) <= slop and all(
                a < b for i, a in enumerate(taken) for j, b in enumerate(taken) if i < j and phrase[i] == phrase[j]
            )
        return any(pick(n + 1, (*taken, p)) for p in places[n] if p not in taken)

    return pick(0, ())


def test_phrases(found):
    phrases = [list(p) for n in (1, 2, 3) for p in permutations("abc", n)] + [["a", "a"], ["a", "b", "a"], ["d", "d", "d"], ["z", "a"]]
    asked = [(p, slop) for p in phrases for slop in (0, 1, 2, 4)]
    docs = documents(1)
    queries = [f'"{" ".join(p)}"' + (f"~{slop}" if slop else "") for p, slop in asked]
    for (phrase, slop), got in zip(asked, found(queries)):
        assert got == {i for i, words in docs.items() if near(words, phrase, slop)}, (phrase, slop)


def test_places_of_a_phrase(spark):
    """Overlapping matches count once, from the left; a start may lie before the text."""
    rows = [
        (1, [([0, 1], [2, 3, 4, 5])], 2, None, [2, 4]),
        (2, [([0], [0, 7]), ([1], [3, 8])], 2, 0, [7]),
        (3, [([0], [0, 7]), ([1], [3, 8])], 2, 2, [0, 7]),
        (4, [([0], [3]), ([1], [0])], 2, 4, [-1]),
    ]
    schema = "i int, words array<struct<offsets:array<int>,positions:array<int>>>, size int, slop int, want array<int>"
    df = spark.createDataFrame(rows, schema)
    got = df.select("i", "want", search.phrase_starts(F.col("words"), F.col("size"), F.col("slop")).alias("got")).collect()
    assert {r.i: r.got for r in got} == {r.i: r.want for r in got}


def test_group_structure(spark):
    df = spark.createDataFrame([(1, 'a +(b |("c d"~3 e)) ) !!', "en")], "query_id int, query string, lang string")
    got = search.clauses(search.parse_queries(df)).orderBy("clause").collect()
    assert [(r.op, r.terms, r.distance, r.opens, r.closes) for r in got] == [
        ("or", ["a"], None, [], 0),
        ("or", ["b"], None, ["and"], 0),
        ("or", ["c", "d"], 3, ["or"], 0),
        ("or", ["e"], None, [], 2),
    ]


def test_blocks_that_cannot_matter_are_skipped(spark):
    """The best hits are those of a full evaluation, ties and excluded words included, from fewer postings."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [
        (str(i), r.choice(["en", "es"]), " ".join(r.choices(words, [1 / (k + 1) for k in range(30)], k=r.choice([3, 9, 40, 200, 500]))))
        for i in range(1500)
    ]
    sites = spark.createDataFrame(rows, "id string, language string, text string").select(
        "id", "language", F.lit("x.com").alias("domain"), F.substring_index("text", " ", 2).alias("title"), "text",
        F.lit("").alias("keywords"),
    )
    postings = search.postings(sites, 20).cache()
    stats = search.field_stats(sites).cache()
    full = search.Index(sites, postings, search.dictionary(postings).cache(), stats, search.title_grams(sites))
    index = full._replace(blocks=search.block_bounds(postings, stats).cache())
    queries = ["w0 w1", "w7", "w29 w28", "w3 w3 w4-w5", "w2 -w1", "w6 +w1", "nothing", "w0 (w1 | w9)", '"w0 w0"', "w1 domain:x.com"]
    asked = spark.createDataFrame([(i, q, "en") for i, q in enumerate(queries)], "query_id int, query string, lang string")
    got, want = ({tuple(x) for x in search.search(asked, i).collect()} for i in (index, full))
    assert got == want and len({x[0] for x in got}) == 9
    parsed = search.parse_queries(asked)
    split = search.clauses(parsed)
    plain = search.plain_queries(parsed, split)
    assert sorted(x[0] for x in plain.collect()) == [0, 1, 2, 3, 4, 6]
    kept = search.reachable_blocks(split.join(plain, "query_id", "left_semi"), parsed, index)
    rows_scored = {x["query_id"]: x["n"] for x in kept.groupBy("query_id").agg(F.sum("n").alias("n")).collect()}
    held = {(x["term"]): x["n"] for x in postings.filter("language = 'en'").groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert rows_scored[0] < 0.75 * (held["w0"] + held["w1"]) and rows_scored[1] < held["w7"]
