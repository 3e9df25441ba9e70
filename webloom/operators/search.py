"""Ranked full-text search and title autocomplete over tables of queries.

Index: `postings(language, field, term, id, tf, len, positions)`, one row per document, field and term. Queries are
parsed into clauses; every clause kind yields `(query_id, language, clause, id, score)`, and one evaluation combines
them. All steps are joins and partial aggregates, so any number of queries runs in one plan. Phrases are decided on
positions; no document text is read to find hits.

Sizes: nothing is broadcast by hint. What the queries ask for (clauses, weights, candidates, hits) is written to the
shared folder before it meets the index or the documents; the planner then knows its real size, broadcasts it while
it is below the threshold, so that neither index nor documents are shuffled, and shuffles on the term otherwise.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.rows import explode_as
from webloom.functions.text import TOKEN, term_positions, tokens
from webloom.operators import documents
from webloom.session import written

# Fixed values.
FIELD_BOOSTS = {"title": 3.0, "text": 1.0, "keywords": 2.0}
RESULT_SIZE = 20
SUMMARY_LENGTH = 500
MAX_FRAGMENTS = 5
PRE_TAG, POST_TAG = "<b>", "</b>"
SUGGESTION_HITS = 20
SUGGESTIONS = 6
K1, B = 1.2, 0.75

# The query grammar.
DOMAIN_TOKEN = r"^domain:(\S+)"
EXCLUDE_TOKEN = r"^-(\S+)"
MAX_DISTANCE = 2
BUCKETS = 16  # parts of the postings of a language
CLAUSE = r'[+|]?\s*(?:"[^"]*"(?:~\d*)?|[^\s"+|()]+|[()])'
FIRST_POSTINGS = 100  # per wanted hit, postings in a query's best blocks that are scored before others are left out
HEAD = 3  # letters under which titles are stored
COMPLETED = 8  # inputs of one word with up to so many letters are answered from a table
MOST_SLOP = 1_000_000  # larger distances after a phrase count as this one


def boost(field: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(0.0))
    for name, value in FIELD_BOOSTS.items():
        chain = chain.when(field == name, F.lit(value))
    return chain


class Index(NamedTuple):
    """The stored tables a search reads."""

    sites: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    titles: DataFrame
    deletions: DataFrame | None = None  # of the terms; made from the dictionary for each search if it is not stored
    completions: DataFrame | None = None  # of short inputs; from the titles if it is not stored
    blocks: DataFrame | None = None  # bounds of the postings' blocks; without them all postings of a term are scored
    hosts: DataFrame | None = None  # which documents a host has; from the documents if it is not stored


# ---- index ---------------------------------------------------------------------------------------------------------


def postings(sites: DataFrame, parts: int = 16) -> DataFrame:
    """language, field, term, id, tf, len (number of tokens in that field of that document), positions, bucket of the term,
    block of the document.

    Only phrases read the positions; Parquet keeps them in a column of their own. Documents of about the same length share
    blocks, `parts` for each length: what a word is worth differs most by length, so blocks differ in their best score.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in FIELD_BOOSTS])
    rows = sites.select("language", "id", fields.alias("fields"))
    size = F.aggregate("fields", F.lit(1), lambda n, f: n + F.size(f["tokens"]))
    block = F.floor(2 * F.log2(size)).cast("int") * 65536 + F.pmod(F.hash("id"), F.lit(parts))
    per_field = explode_as(rows.withColumn("block", block), "fields", "f").select(
        "language", "id", "block", "f.field", F.size("f.tokens").alias("len"),
        term_positions(F.col("f.tokens")).alias("terms"),
    )
    found = explode_as(per_field, "terms", "t").select(
        "language", "field", "t.term", "id", "t.tf", "len", "t.positions", "block"
    )
    return found.withColumn("bucket", bucket_of(F.col("term")))


def block_bounds(index: DataFrame, stats: DataFrame) -> DataFrame:
    """language, bucket, term, field, block, top, n: the largest share of its idf and boost that a word scores in a block,
    and the postings there."""
    rated = index.join(stats.select("language", "field", "avg_len"), ["language", "field"])
    return rated.groupBy("language", "bucket", "term", "field", "block").agg(
        F.max(_saturated()).alias("top"), F.count(F.lit(1)).alias("n")
    )


def field_stats(sites: DataFrame) -> DataFrame:
    """language, field, n_docs, avg_len over the documents where the field is not empty; a few rows per language."""
    fields = F.array(
        *[F.struct(F.lit(f).alias("field"), F.size(tokens(F.col(f))).alias("len")) for f in FIELD_BOOSTS]
    )
    lengths = explode_as(sites.select("language", fields.alias("fields")), "fields", "f").select("language", "f.*")
    return (
        lengths.filter("len > 0")
        .groupBy("language", "field")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    )


def dictionary(index: DataFrame) -> DataFrame:
    """language, field, term, df: number of documents per term."""
    return index.groupBy("language", "field", "term").agg(F.count(F.lit(1)).alias("df"))


def title_grams(sites: DataFrame) -> DataFrame:
    """language, id, size, gram, head, bucket: the 1- to 3-word sequences of every title under their first letters.

    A sequence has a row for each of its heads of 1 to HEAD letters, so that a prefix of any length finds its sequences
    by equality; `bucket` is that of the head.
    """
    words = sites.select("language", "id", _shingles(tokens(F.col("title"))).alias("s"))
    grams = explode_as(words, "s", "g").select("language", "id", F.col("g.size").alias("size"), F.col("g.gram").alias("gram"))
    heads = F.array_distinct(F.array(*(F.substring("gram", 1, n) for n in range(1, HEAD + 1))))
    return explode_as(grams.withColumn("heads", heads), "heads", "head").withColumn("bucket", bucket_of(F.col("head")))


def completions(titles: DataFrame, hits: int = SUGGESTION_HITS) -> DataFrame:
    """language, prefix, at, id, bucket: for every prefix of a title's word of up to COMPLETED letters the best `hits`
    titles. All of them score one point for such an input, so these are the ones with the smallest ids.

    A prefix that very many titles have is cut to `hits` rows by each task before the exchange.
    """
    words = titles.filter("size = 1").filter(F.length("head") == F.least(F.lit(HEAD), F.length("gram")))
    cut = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(COMPLETED), F.length("gram"))), lambda n: F.substring("gram", F.lit(1), n)
    )
    each = explode_as(words.select("language", "id", cut.alias("cut")), "cut", "prefix").distinct()
    order = Window.partitionBy("language", "prefix").orderBy("id")
    best = each.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= hits)
    return best.select("language", "prefix", "at", "id", bucket_of(F.col("prefix")).alias("bucket"))


def deletion_index(terms: DataFrame) -> DataFrame:
    """language, depth, key, term, bucket: what is left of every vocabulary term after `depth` deletions."""
    vocabulary = terms.select("language", "term").distinct()
    found = explode_as(vocabulary.withColumn("left", _deletions(F.col("term"))), "left", "d")
    return found.select("language", "d.depth", "d.key", "term", bucket_of(F.col("d.key")).alias("bucket"))


def host_index(sites: DataFrame) -> DataFrame:
    """language, bucket, domain, id: the documents of each host, for queries that name one."""
    return sites.select("language", bucket_of(F.col("domain")).alias("bucket"), "domain", "id")


def bucket_of(term: Column) -> Column:
    """The part of the postings that holds a term."""
    return F.pmod(F.hash(term), F.lit(BUCKETS))


def _postings_of(wanted: DataFrame, index: Index, *keys: str) -> DataFrame:
    """The postings of the terms in `wanted`, which was written before, joined on language, term and `keys`.

    Stored postings are partitioned by language and bucket. The comparison tells the planner that the few wanted terms
    are worth a look before the scan: it reads the partitions they name only, however many terms there are.
    """
    asked = wanted.withColumn("bucket", bucket_of(F.col("term"))).filter("bucket >= 0")
    return index.postings.join(asked, ["language", "bucket", "term", *keys])


# ---- queries -------------------------------------------------------------------------------------------------------


def parse_queries(queries: DataFrame) -> DataFrame:
    """query_id, language, text, domain, exclude from `queries(query_id, query, lang)`.

    The last domain wins; excluded words are lower-cased, as the analyser lower-cases documents.
    """
    parts = queries.select("query_id", F.col("lang").alias("language"), F.split("query", " ").alias("tokens"))
    return parts.select(
        "query_id",
        "language",
        F.trim(
            F.array_join(F.filter("tokens", lambda t: ~t.rlike(DOMAIN_TOKEN) & ~t.rlike(EXCLUDE_TOKEN)), " ")
        ).alias("text"),
        F.regexp_extract(
            F.try_element_at(F.filter("tokens", lambda t: t.rlike(DOMAIN_TOKEN)), F.lit(-1)), DOMAIN_TOKEN, 1
        ).alias("domain"),
        F.transform(
            F.filter("tokens", lambda t: t.rlike(EXCLUDE_TOKEN) & ~t.rlike(DOMAIN_TOKEN)),
            lambda t: F.lower(F.regexp_extract(t, EXCLUDE_TOKEN, 1)),
        ).alias("exclude"),
    )


def _analysed(raw: Column) -> Column:
    """struct(op, kind, terms, distance) of one piece of a query text. op is empty where none is written."""
    body = F.trim(F.regexp_replace(raw, r"^[+|]\s*", ""))
    fuzzy, sloppy = r'^[^"~]+~(\d*)$', r'^"[^"]*"~(\d+)$'
    kind = (
        F.when(body.isin("(", ")"), F.when(body == "(", F.lit("open")).otherwise(F.lit("close")))
        .when(body.startswith('"'), F.lit("phrase"))
        .when(body.rlike(r"^[^*]+\*$"), F.lit("prefix"))
        .when(body.rlike(fuzzy), F.lit("fuzzy"))
        .otherwise(F.lit("terms"))
    )
    number = F.ltrim(F.regexp_extract(body, fuzzy, 1), F.lit("0"))
    few = (F.regexp_extract(body, fuzzy, 1) != "") & (F.length(number) <= 1)  # more digits are more than MAX_DISTANCE
    own = F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0))
    slop = F.ltrim(F.regexp_extract(body, sloppy, 1), F.lit("0"))
    wide = F.when(F.length(slop) > 6, F.lit(MOST_SLOP)).otherwise(F.coalesce(F.nullif(slop, F.lit("")).cast("int"), F.lit(0)))
    distance = F.when(few, F.least(own, F.lit(MAX_DISTANCE))).otherwise(F.lit(MAX_DISTANCE))
    op = F.when(raw.startswith("+"), F.lit("and")).when(raw.startswith("|"), F.lit("or")).otherwise(F.lit(""))
    return F.struct(
        op.alias("op"),
        kind.alias("kind"),
        tokens(F.regexp_replace(body, r"~\d*$", "")).alias("terms"),
        F.when(kind == "fuzzy", distance).when((kind == "phrase") & body.rlike(sloppy), wide).alias("distance"),
    )


def _matched(pieces: Column) -> Column:
    """Pieces without closing parentheses that nothing opened; opening ones that nothing closes become kind `none`."""

    def renamed(piece: Column, kind: Column) -> Column:
        return F.struct(piece["op"].alias("op"), kind.alias("kind"), piece["terms"].alias("terms"), piece["distance"].alias("distance"))

    def settle(items: Column, inner: str, outer: str) -> Column:
        """Turn each `outer` into `none` that has no `inner` before it of its own."""

        def step(state: Column, piece: Column) -> Column:
            lost = (piece["kind"] == outer) & (state["depth"] == 0)
            depth = state["depth"] + F.when(piece["kind"] == inner, 1).when((piece["kind"] == outer) & ~lost, -1).otherwise(0)
            kept = renamed(piece, F.when(lost, F.lit("none")).otherwise(piece["kind"]))
            return F.struct(depth.alias("depth"), F.concat(state["out"], F.array(kept)).alias("out"))

        start = F.struct(F.lit(0).alias("depth"), F.filter(items, lambda x: F.lit(False)).alias("out"))
        return F.aggregate(items, start, step)["out"]

    return F.reverse(settle(F.reverse(settle(pieces, "open", "close")), "close", "open"))


_CLAUSE_TYPE = "array<struct<op:string,kind:string,terms:array<string>,distance:int,opens:array<string>,closes:int>>"


def _grouped(pieces: Column) -> Column:
    """Clauses in order, each with the operators of the groups that open before it and the number that close after it.

    An operator waits for the next clause or group; of several the last one counts. A group without clauses is as if it
    was not there.
    """

    def step(state: Column, piece: Column) -> Column:
        op = F.when(piece["op"] != "", piece["op"]).otherwise(state["op"])
        is_open, is_close = piece["kind"] == "open", piece["kind"] == "close"
        is_none = piece["kind"] == "none"
        empty = is_close & (F.size(state["opens"]) > 0)
        ends = is_close & (F.size(state["opens"]) == 0)
        size = F.size(state["out"])
        clause = F.struct(
            op.alias("op"), piece["kind"].alias("kind"), piece["terms"].alias("terms"),
            piece["distance"].alias("distance"), state["opens"].alias("opens"), F.lit(0).alias("closes"),
        )
        closed = F.transform(state["out"], lambda c, i: c.withField("closes", c["closes"] + F.when(i + 1 == size, 1).otherwise(0)))
        none = F.array().cast("array<string>")
        opens = (
            F.when(is_open, F.concat(state["opens"], F.array(op)))
            .when(empty, F.slice(state["opens"], 1, F.size(state["opens"]) - 1))
            .when(ends | is_none, state["opens"])
            .otherwise(none)
        )
        waiting = (
            F.when(is_none, op).when(empty, F.element_at(state["opens"], -1)).otherwise(F.lit(""))
        )
        out = (
            F.when(is_open | empty | is_none, state["out"])
            .when(ends, closed)
            .otherwise(F.concat(state["out"], F.array(clause)).cast(_CLAUSE_TYPE))
        )
        return F.struct(waiting.alias("op"), opens.alias("opens"), out.alias("out"))

    start = F.struct(
        F.lit("").alias("op"), F.array().cast("array<string>").alias("opens"), F.array().cast(_CLAUSE_TYPE).alias("out")
    )
    return F.aggregate(pieces, start, step)["out"]


def clauses(parsed: DataFrame) -> DataFrame:
    """query_id, language, clause, op, kind, terms, distance, opens, closes: one row per clause of the query text.

    kind is `terms` (any of the terms), `phrase`, `prefix` or `fuzzy`. op says how the clause is combined with what
    stands to its left in its group: `and` after a plus sign, `or` otherwise. `opens` has the operators of the groups
    that open right before the clause, outermost first, `closes` says how many close right after it. Parentheses that
    have no counterpart, and groups without a clause, are ignored. The distance of a phrase is how far its words may
    be out of place together, null or 0 for an exact phrase.
    """
    found = F.transform(F.regexp_extract_all("text", F.lit(CLAUSE), F.lit(0)), _analysed)
    pieces = F.filter(found, lambda p: (F.size(p["terms"]) > 0) | p["kind"].isin("open", "close"))
    split = parsed.select("query_id", "language", pieces.alias("pieces"))
    split = split.withColumn("pieces", _matched(F.col("pieces"))).withColumn("pieces", _grouped(F.col("pieces")))
    each = split.select("query_id", "language", F.posexplode("pieces").alias("clause", "c"))
    either = F.when(F.col("c.op") == "", F.lit("or")).otherwise(F.col("c.op"))
    opens = F.transform("c.opens", lambda o: F.when(o == "", F.lit("or")).otherwise(o))
    return each.select(
        "query_id", "language", "clause", either.alias("op"), "c.kind", "c.terms", "c.distance",
        opens.alias("opens"), "c.closes",
    )


# ---- matching ------------------------------------------------------------------------------------------------------


_IDF = "ln(1 + (n_docs - df + 0.5D) / (df + 0.5D))"


def _saturated() -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def _relevance(idf: Column) -> Column:
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    return boost(F.col("field")) * idf * F.col("tf") * (K1 + 1) / norm


def _weights(wanted: DataFrame, index: Index) -> DataFrame:
    """query_id, language, clause, field, term, avg_len, idf for `wanted(query_id, language, clause, term)`, written."""
    return written(
        wanted.join(index.terms, ["language", "term"])
        .join(index.stats, ["language", "field"])
        .select("query_id", "language", "clause", "field", "term", "avg_len", F.expr(_IDF).alias("idf")),
        "weights",
    )


def _bm25(wanted: DataFrame, index: Index) -> DataFrame:
    """query_id, language, clause, id, score for `wanted(query_id, language, clause, term)`.

    The weights are joined to the query terms first, from the dictionary; the postings are read once.
    """
    weights = _weights(wanted, index)
    return (
        _postings_of(weights, index, "field")
        .select("query_id", "language", "clause", "id", _relevance(F.col("idf")).alias("score"))
    )


def term_matches(parsed_clauses: DataFrame, index: Index) -> DataFrame:
    """Matches of `terms` clauses."""
    wanted = parsed_clauses.filter("kind = 'terms'").select(
        "query_id", "language", "clause", F.explode(F.array_distinct("terms")).alias("term")
    )
    return _bm25(wanted, index)


def fuzzy_matches(parsed_clauses: DataFrame, index: Index) -> DataFrame:
    """Matches of `fuzzy` clauses: as terms, for every vocabulary term within the distance."""
    wanted = parsed_clauses.filter("kind = 'fuzzy'").select(
        "query_id", "language", "clause", "distance", F.explode("terms").alias("wanted")
    )
    stored = deletion_index(index.terms) if index.deletions is None else index.deletions
    return _bm25(near_terms(wanted, stored), index)


def _deletions(term: Column) -> Column:
    """array<struct(depth, key)>: the strings left after deleting up to MAX_DISTANCE letters of `term`, with the least
    number of deletions that gives them."""

    def shorter(words: Column) -> Column:
        return F.flatten(
            F.transform(
                words,
                lambda w: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
                    lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
                ),
            )
        )

    def numbered(words: Column, depth: int) -> Column:
        # The number of deletions is the number of letters that are missing.
        kept = F.filter(words, lambda w: F.length(w) == F.length(term) - depth)
        return F.transform(kept, lambda w: F.struct(F.lit(depth).alias("depth"), w.alias("key")))

    level = F.array(term)
    out = [numbered(level, 0)]
    for depth in range(1, MAX_DISTANCE + 1):
        level = F.array_distinct(shorter(level))
        out.append(numbered(level, depth))
    return F.concat(*out)


def near_terms(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """query_id, language, clause, term: vocabulary terms within `distance` of `wanted`, from a `deletion_index`.

    Two terms within edit distance k share a string that is left after at most k deletions in each, so candidates come
    from an equi-join on such strings, no deeper than the distance asked for, and the distance is computed for candidates
    only. The stored index is read by bucket.
    """
    asked = explode_as(wanted.withColumn("left", _deletions(F.col("wanted"))), "left", "d").filter("d.depth <= distance")
    asked = asked.select("query_id", "language", "clause", "distance", "wanted", "d.key", bucket_of(F.col("d.key")).alias("bucket"))
    asked = written(asked, "wanted-keys").filter("bucket >= 0")
    return (
        stored.join(asked, ["language", "bucket", "key"])
        .filter((F.col("depth") <= F.col("distance")) & (F.levenshtein("term", "wanted") <= F.col("distance")))
        .select("query_id", "language", "clause", "term")
        .distinct()
    )


def fuzzy_terms(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """As `near_terms`, for a vocabulary `terms(language, term)` without a stored index."""
    return near_terms(wanted, deletion_index(terms))


def with_prefixes(terms: DataFrame, term: str, prefixes: DataFrame) -> DataFrame:
    """One row per term and prefix length that occurs in `prefixes(prefix)`, with `prefix`.

    Turns "starts with" into an equi-join. The lengths come as one array, no longer than the longest prefix.
    """
    lengths = prefixes.agg(F.array_sort(F.collect_set(F.length("prefix")))).scalar()
    cut = F.transform(
        F.filter(F.col("lengths"), lambda n: n <= F.length(term)), lambda n: F.substring(term, F.lit(1), n)
    )
    return explode_as(terms.withColumn("lengths", lengths).withColumn("cut", cut).drop("lengths"), "cut", "prefix")


def prefix_matches(parsed_clauses: DataFrame, index: Index) -> DataFrame:
    """Matches of `prefix` clauses: the field boost for every field with a term that starts with the prefix.

    Of a clause that the analyser cuts into several terms, the last is the prefix and a field must hold the others as
    they are. The vocabulary is searched first, then the index is joined with the terms found.
    """
    asked = parsed_clauses.filter("kind = 'prefix'").select("query_id", "language", "clause", "terms")
    wanted = asked.select("query_id", "language", "clause", F.element_at("terms", -1).alias("prefix"))
    others = asked.withColumn("term", F.array_distinct(F.slice("terms", F.lit(1), F.size("terms") - 1)))
    others = others.withColumn("n", F.size("term"))
    whole = written(explode_as(others.drop("terms").withColumnRenamed("term", "words"), "words", "term"), "prefix_others")
    vocabulary = index.terms.select("language", "term").distinct()
    found = written(
        with_prefixes(vocabulary, "term", wanted)
        .join(wanted, ["language", "prefix"])
        .select("query_id", "language", "clause", "term"),
        "prefix_terms",
    )
    hits = (
        _postings_of(found, index)
        .groupBy("query_id", "language", "clause", "id", "field")
        .agg(F.first(boost(F.col("field"))).alias("score"))
    )
    keys = ["query_id", "language", "clause"]
    held = _postings_of(whole, index).groupBy(*keys, "id", "field").agg(
        F.count(F.lit(1)).alias("n_held"), F.first("n").alias("n")
    )
    single = hits.join(whole.select(*keys).distinct(), keys, "left_anti")
    several = hits.join(held.filter("n_held = n").drop("n_held", "n"), [*keys, "id", "field"], "left_semi")
    return single.unionByName(several).select(*keys, "id", "score")


def phrase_starts(words: Column, size: Column, slop: Column) -> Column:
    """Places where a phrase begins, from `words`: array<struct(offsets, positions)>, one per distinct word.

    A word at position p that the phrase has at offset o speaks for the start p - o. An exact phrase starts where all
    its words agree. With a distance, a start s counts if every word of the phrase can be given an occurrence of its own
    that speaks for a start between s and s + distance. Of overlapping matches the first counts.
    """

    def spoken(word: Column) -> Column:
        return F.transform(word["offsets"], lambda o: F.transform(word["positions"], lambda p: p - o))

    every = F.flatten(F.transform(words, spoken))  # one array of starts per word of the phrase
    exact = F.aggregate(F.slice(every, 2, F.size(every)), F.get(every, F.lit(0)), F.array_intersect)

    def held(word: Column, start: Column) -> Column:
        """Give the word's offsets, in order, the first free position in reach of each; null if one gets none."""
        first = F.lit(-1)
        return F.aggregate(
            word["offsets"],
            first,
            lambda last, o: F.array_min(
                F.filter(word["positions"], lambda p: (p > last) & (p >= start + o) & (p <= start + o + slop))
            ),
        ).isNotNull()

    near = F.filter(F.array_distinct(F.flatten(every)), lambda s: F.forall(words, lambda w: held(w, s)))
    starts = F.array_sort(F.when(F.coalesce(slop, F.lit(0)) > 0, near).otherwise(exact))
    none = F.array().cast("array<int>")
    return F.aggregate(
        starts,
        none,
        lambda kept, s: F.when(
            (F.size(kept) == 0) | (s >= F.element_at(kept, -1) + size), F.concat(kept, F.array(s))
        ).otherwise(kept),
    )


def phrase_matches(parsed_clauses: DataFrame, index: Index) -> DataFrame:
    """Scores of `phrase` clauses: the phrase frequency takes the place of tf, the idf of its terms add up.

    The rarest term of a phrase names the candidate fields; the positions of the other terms are read for these only.
    Postings are read by bucket, no text is.
    """
    keys = ["query_id", "language", "clause"]
    phrases = parsed_clauses.filter("kind = 'phrase'").select(*keys, "terms", "distance")
    asked = phrases.select(*keys, F.posexplode("terms").alias("offset", "term"))
    # A term that a phrase repeats counts as often as it occurs there.
    per_phrase = asked.groupBy(*keys, "term").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
    known = per_phrase.join(index.terms, ["language", "term"]).join(index.stats, ["language", "field"])
    weights = (
        known.groupBy(*keys, "field")
        .agg(
            F.min_by("term", F.struct("df", "term")).alias("rarest"),
            F.sum(F.size("offsets") * F.expr(_IDF)).alias("idf"),
            F.first("avg_len").alias("avg_len"),
            F.count(F.lit(1)).alias("n_terms"),
        )
        .join(phrases, keys)
        .filter(F.col("n_terms") == F.size(F.array_distinct("terms")))
        .select(*keys, "field", "rarest", "idf", "avg_len", "n_terms", F.size("terms").alias("size"), "distance")
    )
    wanted = written(weights.join(per_phrase, keys), "phrases")
    first = written(_postings_of(wanted.filter("term = rarest"), index, "field"), "candidates")
    others = _postings_of(wanted.filter("term <> rarest").select(*keys, "field", "term", "offsets"), index, "field")
    place = [*keys, "field", "id"]
    held = others.join(first.select(*place), place, "left_semi").groupBy(*place)
    held = held.agg(F.collect_list(F.struct("offsets", "positions")).alias("others"))  # as many as the phrase has terms
    word = F.array(F.struct("offsets", "positions"))
    words = F.concat(word, F.coalesce("others", F.filter(word, lambda w: F.lit(False))))
    found = first.join(held, place, "left").withColumn("words", words).filter(F.size("words") == F.col("n_terms"))
    starts = phrase_starts(F.col("words"), F.col("size"), F.col("distance"))
    return found.withColumn("tf", F.size(starts)).filter("tf > 0").select(*keys, "id", _relevance(F.col("idf")).alias("score"))


# ---- evaluation ----------------------------------------------------------------------------------------------------


_FRAME = "struct<empty:boolean,score:double,op:string>"


def _merged(frame: Column, value: Column, op: Column) -> Column:
    """The frame of a group after its next part, which has a score or, if it does not match, null."""
    both = F.when(frame["score"].isNotNull() & value.isNotNull(), frame["score"] + value)
    either = F.when(
        frame["score"].isNotNull() | value.isNotNull(),
        F.coalesce(frame["score"], F.lit(0.0)) + F.coalesce(value, F.lit(0.0)),
    )
    score = F.when(frame["empty"], value).when(op == "and", both).otherwise(either)
    return F.struct(F.lit(False).alias("empty"), score.alias("score"), frame["op"].alias("op")).cast(_FRAME)


def _replaced_last(frames: Column, last: Column) -> Column:
    return F.concat(F.slice(frames, 1, F.size(frames) - 1), F.array(last))


def combine(matched: DataFrame, parsed_clauses: DataFrame) -> DataFrame:
    """query_id, language, id, score of the documents that satisfy a query, from clause matches.

    The parts of a group combine from left to right: `and` needs both sides and adds their scores, `or` needs one and
    adds the scores of those present. Groups are evaluated on a stack of frames, one per open group. The list per
    document is as long as the query has clauses.
    """
    per_clause = matched.groupBy("query_id", "language", "id", "clause").agg(F.sum("score").alias("score"))
    per_document = per_clause.groupBy("query_id", "language", "id").agg(
        F.map_from_entries(F.collect_list(F.struct("clause", "score"))).alias("found")
    )
    ops = parsed_clauses.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("clause", "op", "opens", "closes"))).alias("ops")
    )

    def fresh(op: Column) -> Column:
        return F.struct(F.lit(True).alias("empty"), F.lit(None).cast("double").alias("score"), op.alias("op")).cast(_FRAME)

    def close(frames: Column) -> Column:
        done, outer = F.element_at(frames, -1), F.element_at(frames, -2)
        return _replaced_last(F.slice(frames, 1, F.size(frames) - 1), _merged(outer, done["score"], done["op"]))

    def step(frames: Column, clause: Column) -> Column:
        own = F.try_element_at("found", clause["clause"])
        opened = F.concat(frames, F.transform(clause["opens"], fresh))
        filled = _replaced_last(opened, _merged(F.element_at(opened, -1), own, clause["op"]))
        return F.aggregate(F.array_repeat(F.lit(0), clause["closes"]), filled, lambda state, _: close(state))

    start = F.array(fresh(F.lit("or")))
    return (
        per_document.join(ops, "query_id")
        .select("query_id", "language", "id", F.element_at(F.aggregate("ops", start, step), 1)["score"].alias("score"))
        .filter(F.col("score").isNotNull())
    )


def restrict_domain(hits: DataFrame, parsed: DataFrame, index: Index) -> DataFrame:
    """Keep hits on the host a query names; queries without one keep everything.

    Of stored hosts the buckets of the named ones are read; no document is.
    """
    hosts = host_index(index.sites) if index.hosts is None else index.hosts
    named = written(parsed.filter("domain <> ''").select("query_id", "language", "domain"), "named-hosts")
    asked = named.withColumn("bucket", bucket_of(F.col("domain"))).filter("bucket >= 0")
    allowed = hosts.join(asked, ["language", "bucket", "domain"]).select("query_id", "language", "id")
    inside = hits.join(named, "query_id", "left_semi").join(allowed, ["query_id", "language", "id"], "left_semi")
    return hits.join(named, "query_id", "left_anti").unionByName(inside)


def exclude_terms(hits: DataFrame, parsed: DataFrame, index: Index) -> DataFrame:
    """Drop hits whose text holds an excluded word."""
    banned = written(explode_as(parsed.select("query_id", "language", "exclude"), "exclude", "term"), "banned")
    out = _postings_of(banned, index).filter("field = 'text'").select("query_id", "id")
    return hits.join(out, ["query_id", "id"], "left_anti")


def top_hits(hits: DataFrame, size: int = RESULT_SIZE) -> DataFrame:
    """Best `size` hits per query; ties by id. Tasks keep `size` rows per query before the exchange."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rounded"), "id")
    return (
        hits.withColumn("rounded", F.round("score", 6))
        .withColumn("rank_no", F.row_number().over(order))
        .filter(F.col("rank_no") <= size)
        .select("query_id", "rank_no", "language", "id", F.col("rounded").alias("score"))
    )


def matches(parsed_clauses: DataFrame, index: Index) -> DataFrame:
    """query_id, language, clause, id, score over the clause kinds that occur; there are four kinds in all."""
    by_kind = {
        "terms": term_matches,
        "fuzzy": fuzzy_matches,
        "prefix": prefix_matches,
        "phrase": phrase_matches,
    }
    present = {r.kind for r in parsed_clauses.select("kind").distinct().collect()} or {"terms"}
    return reduce(DataFrame.unionByName, [m(parsed_clauses, index) for kind, m in by_kind.items() if kind in present])


def plain_queries(parsed: DataFrame, split: DataFrame) -> DataFrame:
    """query_id of the queries that only ask for any of their words, on all hosts."""
    plain = (F.col("kind") == "terms") & ((F.col("op") == "or") | (F.col("clause") == 0))
    plain = plain & (F.size("opens") == 0) & (F.col("closes") == 0)
    asked = split.groupBy("query_id").agg(F.every(plain).alias("plain")).filter("plain")
    return asked.join(parsed.filter("coalesce(domain, '') = ''"), "query_id", "left_semi").select("query_id")


def reachable_blocks(split: DataFrame, parsed: DataFrame, index: Index, size: int = RESULT_SIZE) -> DataFrame:
    """The words of plain queries and the blocks whose documents can be among the best `size`: query_id, language, field,
    term, idf, avg_len, block, n.

    A document scores at most what its block allows for the words together. The best blocks of a query, up to
    FIRST_POSTINGS postings for each hit, are scored first; if they have `size` hits, blocks that cannot reach the last of
    these are left out.
    """
    wanted = split.select("query_id", "language", "clause", F.explode(F.array_distinct("terms")).alias("term"))
    weights = _weights(wanted, index)
    asked = weights.withColumn("bucket", bucket_of(F.col("term"))).filter("bucket >= 0")
    allowed = boost(F.col("field")) * F.col("idf") * F.col("top")
    bounds = index.blocks.join(asked, ["language", "bucket", "term", "field"]).withColumn("allowed", allowed)
    bounds = written(bounds, "block-bounds")
    place = ["query_id", "language", "block"]
    totals = bounds.groupBy(*place).agg(F.sum("allowed").alias("allowed"), F.sum("n").alias("n"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("allowed"), "block").rowsBetween(Window.unboundedPreceding, -1)
    totals = written(totals.withColumn("before", F.coalesce(F.sum("n").over(best_first), F.lit(0))), "block-totals")
    first = bounds.drop("allowed").join(totals.filter(F.col("before") < FIRST_POSTINGS * size), place, "left_semi")
    tried = exclude_terms(scored(first, index), parsed, index)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    least = tried.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == size)
    least = written(least.select("query_id", (F.col("score") - 1e-5).alias("least")), "least-scores")
    kept = totals.join(least, "query_id", "left").filter("least IS NULL OR allowed >= least")
    return bounds.drop("allowed").join(kept.select(*place), place, "left_semi")


def scored(words: DataFrame, index: Index) -> DataFrame:
    """query_id, language, id, score over the postings of `words` in their blocks."""
    asked = written(words.drop("top", "n"), "asked-blocks").filter("bucket >= 0")
    found = index.postings.join(asked, ["language", "bucket", "term", "field", "block"])
    return found.groupBy("query_id", "language", "id").agg(F.sum(_relevance(F.col("idf"))).alias("score"))


def search(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, rank_no, language, id, score for `queries(query_id, query, lang)`."""
    parsed = written(parse_queries(queries), "parsed")
    split = written(clauses(parsed), "clauses")
    plain = written(plain_queries(parsed, split), "plain-queries")
    if plain.isEmpty() or index.blocks is None:
        hits = combine(matches(split, index), split)
        return top_hits(exclude_terms(restrict_domain(hits, parsed, index), parsed, index))
    easy = split.join(plain, "query_id", "left_semi")
    found = exclude_terms(scored(reachable_blocks(easy, parsed, index), index), parsed, index)
    others = written(split.join(plain, "query_id", "left_anti"), "other-clauses")
    if not others.isEmpty():
        hits = combine(matches(others, index), others)
        found = found.unionByName(exclude_terms(restrict_domain(hits, parsed, index), parsed, index))
    return top_hits(found)


# ---- presentation --------------------------------------------------------------------------------------------------


def highlight_terms(queries: DataFrame) -> DataFrame:
    """query_id, marks array<struct(kind, term, distance)>: what a query marks in a text."""
    split = clauses(parse_queries(queries))
    each = split.select(
        "query_id",
        F.transform(
            "terms",
            lambda t: F.struct(F.col("kind").alias("kind"), t.alias("term"), F.col("distance").alias("distance")),
        ).alias("marks"),
    )
    return each.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"))


def fragments(text: Column, marks: Column) -> Column:
    """Up to five sentences of `text` that hold a marked word, with these tagged. Applied to hits only."""

    def is_hit(word: Column) -> Column:
        return F.exists(
            marks,
            lambda m: F.when(m["kind"] == "prefix", F.startswith(word, m["term"]))
            .when(m["kind"] == "fuzzy", F.levenshtein(word, m["term"]) <= m["distance"])
            .otherwise(word == m["term"]),
        )

    def tagged(sentence: Column) -> Column:
        pieces = F.regexp_extract_all(sentence, F.lit(rf"{TOKEN}|[^\p{{L}}\p{{N}}]+"), F.lit(0))
        return F.array_join(
            F.transform(
                pieces,
                lambda p: F.when(is_hit(F.lower(p)), F.concat(F.lit(PRE_TAG), p, F.lit(POST_TAG))).otherwise(p),
            ),
            "",
        )

    sentences = F.split(text, r"(?<=[.!?])\s+")
    return F.slice(
        F.filter(F.transform(sentences, tagged), lambda s: F.contains(s, F.lit(POST_TAG))), 1, MAX_FRAGMENTS
    )


def summary(text: Column, marked: Column) -> Column:
    """Fragments, each after '...', while the length so far is below 500; the start of the text if there is none."""
    joined = F.aggregate(
        marked,
        F.lit(""),
        lambda done, f: F.when(F.length(done) < SUMMARY_LENGTH, F.concat(done, F.lit("..."), f)).otherwise(done),
    )
    head = F.when(
        F.length(text) > SUMMARY_LENGTH, F.concat(F.substring(text, 1, SUMMARY_LENGTH), F.lit("..."))
    ).otherwise(text)
    return F.when(F.size(marked) > 0, joined).otherwise(head)


def with_fragments(hits: DataFrame, queries: DataFrame, sites: DataFrame) -> DataFrame:
    """Hits with their document and `fragments`; of stored documents only the shelves of hits are read."""
    return (
        documents.with_documents(written(hits, "hits"), sites)
        .join(highlight_terms(queries), "query_id", "left")
        .withColumn("fragments", F.when(F.col("marks").isNotNull(), fragments(F.col("text"), F.col("marks"))))
        .withColumn("fragments", F.coalesce("fragments", F.array().cast("array<string>")))
    )


def shape_hits(marked: DataFrame) -> DataFrame:
    """query_id, rank_no, title, link, text (summary), full_text, rank, tags."""
    optional = {
        "page_rank": F.lit(None).cast("double"),
        "tags": F.lit(None).cast("string"),
    }
    for name, empty in optional.items():
        if name not in marked.columns:
            marked = marked.withColumn(name, empty)
    return marked.select(
        "query_id",
        "rank_no",
        "title",
        "link",
        summary(F.col("text"), F.col("fragments")).alias("text"),
        F.col("text").alias("full_text"),
        F.coalesce("page_rank", F.lit(1.0)).alias("rank"),
        F.split("tags", ",").alias("tags"),
    )


def hits_json(shaped: DataFrame) -> DataFrame:
    """query_id, rank_no and one JSON document per hit, under the names clients read."""
    body = F.struct("title", "link", "text", F.col("full_text").alias("full-text"), "rank", "tags")
    return shaped.select("query_id", "rank_no", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def counts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, n_hits; a query that finds nothing, or cannot be run, has 0."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_hits")
    )


# ---- autocomplete --------------------------------------------------------------------------------------------------


def guarded(inputs: DataFrame) -> DataFrame:
    """`inputs(query_id, query, lang)` that get suggestions: no operators in the input; language lower-cased."""
    return inputs.filter(~F.col("query").rlike('domain:|-|"')).withColumn("lang", F.lower("lang"))


def autocomplete(
    inputs: DataFrame,
    sites: DataFrame,
    titles: DataFrame,
    hits: int = SUGGESTION_HITS,
    completed: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank_no, suggestion: up to six distinct lower-cased titles per input; `titles` are `title_grams`.

    A title scores one point per input word it holds, the last word counting as a prefix, and one more for every pair
    and triple of neighbouring input words it holds in that order, again with the last one as a prefix. One short word is
    looked up in `completed`, the `completions` of the titles for the same `hits`; other inputs find their sequences by
    the first letters. No title is cut while an input is answered.
    """
    asked = guarded(inputs).select(
        "query_id", F.col("lang").alias("language"), tokens(F.col("query")).alias("words")
    )
    asked = written(asked.filter(F.size("words") > 0), "asked")
    short = (F.size("words") == 1) & (F.length(F.get("words", F.lit(0))) <= COMPLETED)
    completed = completions(titles, hits) if completed is None else completed
    typed = written(
        asked.filter(short).select("query_id", "language", F.get("words", F.lit(0)).alias("prefix")), "typed"
    ).withColumn("bucket", bucket_of(F.col("prefix")))
    easy = completed.join(typed.filter("bucket >= 0"), ["language", "bucket", "prefix"])
    shingles = _shingles(F.col("words"))
    parts = explode_as(asked.filter(~short).select("query_id", "language", shingles.alias("s")), "s", "w").select(
        "query_id", "language", "w.at", "w.size", F.col("w.gram").alias("part"), "w.is_last",
        F.substring("w.gram", 1, HEAD).alias("head"),
    )
    wanted = written(parts.withColumn("bucket", bucket_of(F.col("head"))), "wanted").filter("bucket >= 0")
    held = F.when(F.col("is_last"), F.startswith("gram", F.col("part"))).otherwise(F.col("gram") == F.col("part"))
    points = (
        titles.join(wanted, ["language", "bucket", "head", "size"])
        .filter(held)
        .select("query_id", "language", "id", "at", "size")
        .distinct()
        .groupBy("query_id", "language", "id")
        .agg(F.count(F.lit(1)).alias("points"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("points"), "id")
    best = points.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= hits)
    columns = ("query_id", "language", "id", "at")
    best = written(best.select(*columns).unionByName(easy.select(*columns)), "best")
    # At most `hits` rows per input are left.
    titled = documents.with_documents(best, sites).withColumn("suggestion", F.lower("title"))
    first = titled.groupBy("query_id", "suggestion").agg(F.min("at").alias("at"))
    again = Window.partitionBy("query_id").orderBy("at")
    return (
        first.withColumn("rank_no", F.row_number().over(again))
        .filter(F.col("rank_no") <= SUGGESTIONS)
        .select("query_id", "rank_no", "suggestion")
    )


def _shingles(words: Column) -> Column:
    """array<struct(at, size, gram, is_last)> of the 1-, 2- and 3-word sequences; at is the place of the first word."""

    def of_size(n: int) -> Column:
        starts = F.filter(F.transform(words, lambda w, i: i), lambda i: i + n <= F.size(words))
        return F.transform(
            starts,
            lambda i: F.struct(
                i.alias("at"),
                F.lit(n).alias("size"),
                F.array_join(F.slice(words, i + 1, n), " ").alias("gram"),
                (i + n == F.size(words)).alias("is_last"),
            ),
        )

    return F.concat(of_size(1), of_size(2), of_size(3))
