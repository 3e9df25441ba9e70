"""Queries and checks for search and autocomplete over the accepted documents of `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import search
from webloom.plans import sql
from webloom.plans.derived import indexed_sites, search_index
from webloom.sources.tables import read_table

Row = tuple[int, str, str]

PLAIN: list[Row] = [
    (1, "the thinger", "en"),
    (2, "eriner attion anea", "en"),
    (3, "de la", "es"),
    (4, "Thanedble that's", "en"),
]
PHRASES: list[Row] = [(1, '"of the"', "en"), (2, '"that the" eriner', "en"), (3, '"de la"', "es")]
PREFIXES: list[Row] = [(1, "thaned*", "en"), (2, "erine* wher", "en"), (3, "asc*", "es")]
REQUIRED: list[Row] = [(1, "eriner +attion", "en"), (2, "eriner attion +th", "en"), (3, "anea +the +zzzz", "en")]
SLOPPY: list[Row] = [
    (1, '"of the"~3', "en"),
    (2, '"the that"~2 eriner', "en"),
    (3, '"the the"~5', "en"),
    (4, '"de la"~0', "es"),
]
GROUPS: list[Row] = [
    (1, "eriner +(attion | anea)", "en"),
    (2, '(the + thaned*) | (eriner + "of the")', "en"),
    (3, "anea +((zzzz | wher) +the", "en"),
    (4, "( ) eriner) + ( attion +(( )) anea)", "en"),
    (5, "(eriner + (attion | (anea + wher))) | thanedble", "en"),
]
FUZZY: list[Row] = [(1, "thanedbl~1", "en"), (2, "erniner~", "en"), (3, "eriner attoin~2", "en")]
DOMAINS: list[Row] = [
    (1, "the domain:blog.ththan.example.net", "en"),
    (2, "of domain:blog.ththan.example.net domain:m.tionsh.example.com", "en"),
    (3, "and", "en"),
]
EXCLUDED: list[Row] = [(1, "the -eriner", "en"), (2, "attion -The -zzzz", "en"), (3, "anea -wher", "en")]
COUNTED: list[Row] = [(1, "eriner", "en"), (2, "zzzz", "en"), (3, "-", "en"), (4, "the", "xx"), (5, "domain:x.y", "en")]
TYPED: list[Row] = [
    (1, "the", "EN"),
    (2, "of the", "en"),
    (3, "the erin", "en"),
    (4, "and ther", "en"),
    (5, "de l", "es"),
    (6, "zzzz", "en"),
    (7, "domain:the", "en"),
    (8, "the -of", "en"),
    (9, '"the', "en"),
    (10, "t", "en"),
    (11, "of the e", "en"),
    (12, "thereriners", "en"),
]


def query_table(spark: SparkSession, rows: list[Row]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id int, query string, lang string")


def _run(spark: SparkSession, folder: str, rows: list[Row]) -> DataFrame:
    return search.search(query_table(spark, rows), search_index(spark, folder))


def search_postings(spark: SparkSession, folder: str) -> DataFrame:
    return search.postings(indexed_sites(spark, folder)).drop("bucket", "block")


def search_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = search.field_stats(indexed_sites(spark, folder))
    return stats.select("language", "field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def parse_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of `benchmark` as a query, with operators between and around its words."""
    text = F.regexp_replace("text", "\n", " ")
    query = F.concat(
        F.lit("domain:one.example -"),
        F.regexp_extract("text", r"^(\S+)", 1),
        F.lit(" - "),
        text,
        F.lit(" domain:two.example domain: -X"),
    )
    asked = read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), query.alias("query"), F.lit("en").alias("lang")
    )
    parsed = search.parse_queries(asked)
    return parsed.select(
        "query_id", "language", "text", "domain", F.array_join("exclude", "|").alias("exclude")
    )


def _marked(spark: SparkSession, folder: str, rows: list[Row]) -> DataFrame:
    queries = query_table(spark, rows)
    return search.with_fragments(_run(spark, folder, rows), queries, indexed_sites(spark, folder))


def search_highlight(spark: SparkSession, folder: str) -> DataFrame:
    marked = _marked(spark, folder, PLAIN)
    return marked.select("query_id", "rank_no", "id", F.array_join("fragments", "\n").alias("fragments"))


def search_summary(spark: SparkSession, folder: str) -> DataFrame:
    return search.shape_hits(_marked(spark, folder, PLAIN)).select("query_id", "rank_no", "link", "text")


def search_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every other hit has a rank and tags of its own, made from its document: the others get what a missing one gets."""
    own = F.col("rank_no") % 2 == 1
    marked = _marked(spark, folder, PLAIN).withColumn("page_rank", F.when(own, F.length("title") / 4))
    marked = marked.withColumn("tags", F.when(own, F.regexp_replace("title", " ", ",")))
    shaped = search.shape_hits(marked)
    return shaped.select(
        "query_id", "rank_no", "title", "link", "full_text", "rank", F.size("tags").alias("n_tags"),
        F.get("tags", F.lit(1)).alias("second_tag"),
    )


def export_hits_json(spark: SparkSession, folder: str) -> DataFrame:
    return search.hits_json(search.shape_hits(_marked(spark, folder, PLAIN)))


def search_counts(spark: SparkSession, folder: str) -> DataFrame:
    return search.counts(query_table(spark, COUNTED), _run(spark, folder, COUNTED))


def autocomplete(spark: SparkSession, folder: str) -> DataFrame:
    index = search_index(spark, folder)
    return search.autocomplete(query_table(spark, TYPED), index.sites, index.titles, completed=index.completions)


def autocomplete_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Which titles could be typed as input: every title of the documents, its language in capitals."""
    typed = indexed_sites(spark, folder).select(
        F.col("id").alias("query_id"), F.col("title").alias("query"), F.upper("language").alias("lang")
    )
    return search.guarded(typed)


QUERIES = {
    "search_postings": search_postings,
    "search_stats": search_stats,
    "parse_queries": parse_queries,
    "search_bm25": lambda spark, folder: _run(spark, folder, PLAIN),
    "search_phrase": lambda spark, folder: _run(spark, folder, PHRASES),
    "search_sloppy": lambda spark, folder: _run(spark, folder, SLOPPY),
    "search_groups": lambda spark, folder: _run(spark, folder, GROUPS),
    "search_prefix": lambda spark, folder: _run(spark, folder, PREFIXES),
    "search_required": lambda spark, folder: _run(spark, folder, REQUIRED),
    "search_fuzzy": lambda spark, folder: _run(spark, folder, FUZZY),
    "search_domain": lambda spark, folder: _run(spark, folder, DOMAINS),
    "search_exclude": lambda spark, folder: _run(spark, folder, EXCLUDED),
    "search_highlight": search_highlight,
    "search_summary": search_summary,
    "search_hits": search_hits,
    "export_hits_json": export_hits_json,
    "search_counts": search_counts,
    "autocomplete": autocomplete,
    "autocomplete_guard": autocomplete_guard,
}

# ---- checks --------------------------------------------------------------------------------------------------------

_TOKEN = r"[\p{L}\p{N}]+"
_INDEXED = f"docs AS (SELECT * FROM sites WHERE language IN {sql.ACCEPTED})"
_TOKENS = f"""
field_tokens AS (
  SELECT language, id, field, regexp_extract_all(lower(body), '{_TOKEN}') AS toks FROM (
    SELECT language, id, 'title' AS field, title AS body FROM docs
    UNION ALL SELECT language, id, 'text', text FROM docs
    UNION ALL SELECT language, id, 'keywords', keywords FROM docs)
)"""
_POSTINGS = """
postings AS (
  SELECT language, field, term, id, count(*) AS tf, any_value(len) AS len, list(pos ORDER BY pos) AS positions
  FROM (SELECT language, id, field, len(toks) AS len, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos
        FROM field_tokens) GROUP BY ALL
),
dfs AS (SELECT language, field, term, count(*) AS df FROM postings GROUP BY ALL),
stats AS (
  SELECT language, field, count(*) AS n_docs, avg(len(toks)) AS avg_len FROM field_tokens
  WHERE len(toks) > 0 GROUP BY ALL
),
boosts AS (SELECT * FROM (VALUES ('title', 3.0), ('text', 1.0), ('keywords', 2.0)) AS t(field, boost))"""
_INDEX = (*sql.TO_SITES, _INDEXED, _TOKENS, _POSTINGS)

_IDF = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))"
_BM25 = f"boost * {_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"


def _asked(*rows: tuple[int, str, int, str]) -> str:
    """CTE asked(query_id, language, clause, term)."""
    values = ", ".join(f"({q}, '{lang}', {clause}, '{term}')" for q, lang, clause, term in rows)
    return f"asked AS (SELECT * FROM (VALUES {values}) AS t(query_id, language, clause, term))"


_TERM_HITS = f"""
matched AS (
  SELECT query_id, language, clause, id, sum({_BM25}) AS score
  FROM asked JOIN postings USING (language, term) JOIN dfs USING (language, field, term)
  JOIN stats USING (language, field) JOIN boosts USING (field) GROUP BY ALL
)"""


def _ranked(condition: str = "true", where: str = "true") -> str:
    return f"""
hits AS (
  SELECT query_id, language, id, round(sum(score), 6)::DOUBLE AS score FROM matched GROUP BY query_id, language, id
  HAVING {condition}
),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank_no, language, id, score
  FROM hits WHERE {where} QUALIFY rank_no <= 20
)"""


_SELECT = "SELECT query_id, rank_no, language, id, score FROM ranked"
_PLAIN_ASKED = _asked(
    (1, "en", 0, "the"),
    (1, "en", 1, "thinger"),
    (2, "en", 0, "eriner"),
    (2, "en", 1, "attion"),
    (2, "en", 2, "anea"),
    (3, "es", 0, "de"),
    (3, "es", 1, "la"),
    (4, "en", 0, "thanedble"),
    (4, "en", 1, "that"),
    (4, "en", 1, "s"),
)


def _term_search(asked: str, condition: str = "true", where: str = "true", select: str = _SELECT) -> str:
    return sql.with_ctes(*_INDEX, asked, _TERM_HITS, _ranked(condition, where), select=select)


def _phrases(*rows: tuple[int, str, int, str]) -> str:
    """Phrase matches by position: each term must stand at its offset after the first."""
    values = ", ".join(f"({q}, '{lang}', {clause}, '{phrase}')" for q, lang, clause, phrase in rows)
    return f"""
phrases AS (
  SELECT query_id, language, clause, phrase, unnest(string_split(phrase, ' ')) AS term,
         generate_subscripts(string_split(phrase, ' '), 1) - 1 AS offs, len(string_split(phrase, ' ')) AS size
  FROM (VALUES {values}) AS t(query_id, language, clause, phrase)
),
positions AS (
  SELECT language, id, field, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos, len(toks) AS len
  FROM field_tokens
),
phrase_starts AS (
  SELECT query_id, language, clause, phrase, id, field, len, pos - offs AS start
  FROM phrases JOIN positions USING (language, term) GROUP BY query_id, language, clause, phrase, id, field, len, size, start
  HAVING count(*) = size
),
phrase_idf AS (
  SELECT query_id, clause, field, sum({_IDF}) AS idf, any_value(avg_len) AS avg_len
  FROM phrases JOIN dfs USING (language, term) JOIN stats USING (language, field) GROUP BY ALL
),
phrase_matched AS (
  SELECT query_id, language, clause, id,
         sum(boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM (SELECT query_id, language, clause, id, field, any_value(len) AS len, count(*) AS tf
        FROM phrase_starts GROUP BY ALL) JOIN phrase_idf USING (query_id, clause, field) JOIN boosts USING (field)
  GROUP BY ALL
)"""


def _either(a: str, b: str) -> str:
    """The sum of those of two scores that are there, null if none is."""
    return f"(CASE WHEN ({a}) IS NULL THEN {b} WHEN ({b}) IS NULL THEN {a} ELSE {a} + {b} END)"


def _sloppy(*rows: tuple[int, str, int, str, int]) -> str:
    """Two-word phrases: starts that both words speak for within the distance, an occurrence of its own each."""
    values = ", ".join(f"({q}, '{lang}', {clause}, '{phrase}', {slop})" for q, lang, clause, phrase, slop in rows)
    return f"""
pairs AS (
  SELECT query_id, language, clause, slop, string_split(phrase, ' ')[1] AS one, string_split(phrase, ' ')[2] AS two
  FROM (VALUES {values}) AS t(query_id, language, clause, phrase, slop)
),
places AS (
  SELECT p.*, a.id, a.field, a.len, a.positions AS ones, list_transform(b.positions, lambda x: x - 1) AS twos
  FROM pairs p JOIN postings a ON a.language = p.language AND a.term = one
  JOIN postings b ON b.language = p.language AND b.term = two AND b.id = a.id AND b.field = a.field
),
sloppy_starts AS (
  SELECT DISTINCT query_id, language, clause, id, field, len, s FROM (
    SELECT *, unnest(list_concat(ones, twos)) AS s FROM places)
  WHERE len(list_filter(ones, lambda x: list_contains(range(s, s + slop + 1), x)
        AND len(list_filter(twos, lambda y: y >= s AND y <= s + slop AND (one <> two OR y + 1 > x))) > 0)) > 0
),
sloppy_runs AS (
  SELECT query_id, language, clause, id, field, any_value(len) AS len,
         list_reduce(list_concat([{{'n': 0, 'last': -9}}], list_transform(list(s ORDER BY s), lambda x: {{'n': 0, 'last': x}})),
           lambda a, b: CASE WHEN a.n = 0 OR b.last >= a.last + 2 THEN {{'n': a.n + 1, 'last': b.last}} ELSE a END).n AS tf
  FROM sloppy_starts GROUP BY ALL
),
sloppy_idf AS (
  SELECT query_id, clause, field, sum({_IDF}) AS idf, any_value(avg_len) AS avg_len
  FROM (SELECT query_id, language, clause, unnest([one, two]) AS term FROM pairs)
  JOIN dfs USING (language, term) JOIN stats USING (language, field) GROUP BY ALL
),
phrase_matched AS (
  SELECT query_id, language, clause, id,
         sum(boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM sloppy_runs JOIN sloppy_idf USING (query_id, clause, field) JOIN boosts USING (field) GROUP BY ALL
)"""


_FRAGMENTS = rf"""
sentences AS (
  SELECT query_id, rank_no, r.id, no, sentence,
         array_to_string(list_transform(regexp_extract_all(sentence, '{_TOKEN}|[^\p{{L}}\p{{N}}]+'),
           lambda p: CASE WHEN list_contains(words, lower(p)) THEN '<b>' || p || '</b>' ELSE p END), '') AS tagged
  FROM ranked r JOIN (SELECT query_id, list(term) AS words FROM asked GROUP BY query_id) USING (query_id)
  JOIN (SELECT language, id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS no
        FROM (SELECT language, id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts
              FROM docs)) s ON s.id = r.id AND s.language = r.language
),
fragments AS (
  SELECT query_id, rank_no, id, no, tagged, row_number() OVER (PARTITION BY query_id, rank_no ORDER BY no) AS nth
  FROM sentences WHERE contains(tagged, '</b>') QUALIFY nth <= 5
)"""
_SUMMARIES = """
summing AS (
  SELECT query_id, rank_no, 0 AS nth, '' AS summary FROM ranked
  UNION ALL
  SELECT s.query_id, s.rank_no, s.nth + 1,
         CASE WHEN length(summary) < 500 THEN summary || '...' || tagged ELSE summary END
  FROM summing s JOIN fragments f ON f.query_id = s.query_id AND f.rank_no = s.rank_no AND f.nth = s.nth + 1
),
summaries AS (SELECT query_id, rank_no, max_by(summary, nth) AS summary, max(nth) AS n FROM summing GROUP BY ALL)"""
_PLAIN_HITS = (*_INDEX, _PLAIN_ASKED, _TERM_HITS, _ranked())
_RANKED_DOCS = "FROM ranked r JOIN docs d ON d.id = r.id AND d.language = r.language"

_typed = ", ".join(
    f"({q}, '{text}', '{lang.lower()}')" for q, text, lang in TYPED if not any(m in text for m in ("domain:", "-", '"'))
)


def _shingles(source: str, keys: str) -> str:
    return f"""
  SELECT {keys}, slot, n AS size, array_to_string(list_slice(words, slot, slot + n - 1), ' ') AS gram,
         slot + n - 1 = len(words) AS is_last
  FROM {source}, (VALUES (1), (2), (3)) AS s(n), LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS slot) AS a"""


ORACLES = {
    "search_postings": sql.with_ctes(*_INDEX, select="SELECT language, field, term, id, tf, len, positions FROM postings"),
    "search_stats": sql.with_ctes(
        *_INDEX, select="SELECT language, field, n_docs, round(avg_len, 6) AS avg_len FROM stats"
    ),
    "parse_queries": r"""
SELECT item_id AS query_id, 'en' AS language,
       trim('- ' || array_to_string(list_filter(string_split(replace(text, chr(10), ' '), ' '),
            lambda w: NOT regexp_matches(w, '^-\S') AND NOT regexp_matches(w, '^domain:\S')), ' ') || ' domain:') AS text,
       'two.example' AS domain,
       array_to_string(list_transform(list_concat([lower(regexp_extract(text, '^(\S+)', 1))],
         list_concat(list_transform(list_filter(string_split(replace(text, chr(10), ' '), ' '),
           lambda w: regexp_matches(w, '^-\S')), lambda w: lower(substring(w, 2))), ['x'])), lambda w: w), '|') AS exclude
FROM benchmark""",
    "search_bm25": _term_search(_PLAIN_ASKED),
    "search_phrase": sql.with_ctes(
        *_INDEX,
        _asked((2, "en", 1, "eriner")),
        _phrases((1, "en", 0, "of the"), (2, "en", 0, "that the"), (3, "es", 0, "de la")),
        _TERM_HITS.replace("matched AS", "term_matched AS"),
        "matched AS (SELECT * FROM term_matched UNION ALL BY NAME SELECT * FROM phrase_matched)",
        _ranked(),
        select=_SELECT,
    ),
    "search_sloppy": sql.with_ctes(
        *_INDEX,
        _asked((2, "en", 1, "eriner")),
        _sloppy((1, "en", 0, "of the", 3), (2, "en", 0, "the that", 2), (3, "en", 0, "the the", 5), (4, "es", 0, "de la", 0)),
        _TERM_HITS.replace("matched AS", "term_matched AS"),
        "matched AS (SELECT * FROM term_matched UNION ALL BY NAME SELECT * FROM phrase_matched)",
        _ranked(),
        select=_SELECT,
    ),
    "search_groups": sql.with_ctes(
        *_INDEX,
        _asked(
            (1, "en", 0, "eriner"), (1, "en", 1, "attion"), (1, "en", 2, "anea"),
            (2, "en", 0, "the"), (2, "en", 2, "eriner"),
            (3, "en", 0, "anea"), (3, "en", 1, "zzzz"), (3, "en", 2, "wher"), (3, "en", 3, "the"),
            (4, "en", 0, "eriner"), (4, "en", 1, "attion"), (4, "en", 2, "anea"),
            (5, "en", 0, "eriner"), (5, "en", 1, "attion"), (5, "en", 2, "anea"), (5, "en", 3, "wher"),
            (5, "en", 4, "thanedble"),
        ),
        _phrases((2, "en", 3, "of the")),
        _TERM_HITS.replace("matched AS", "term_matched AS"),
        """
parts AS (
  SELECT query_id, language, clause, id, score FROM term_matched
  UNION ALL BY NAME SELECT query_id, language, clause, id, score FROM phrase_matched
  UNION ALL BY NAME
  SELECT 2 AS query_id, language, 1 AS clause, id, sum(boost) AS score FROM (
    SELECT DISTINCT language, id, field FROM postings WHERE language = 'en' AND starts_with(term, 'thaned'))
  JOIN boosts USING (field) GROUP BY language, id
),
wide AS (
  SELECT query_id, language, id, max(score) FILTER (clause = 0) AS a, max(score) FILTER (clause = 1) AS b,
         max(score) FILTER (clause = 2) AS c, max(score) FILTER (clause = 3) AS d, max(score) FILTER (clause = 4) AS e
  FROM parts GROUP BY ALL
),
matched AS (
  SELECT query_id, language, id, CASE query_id
    WHEN 1 THEN a + either(b, c)
    WHEN 2 THEN either(a + b, c + d)
    WHEN 3 THEN a + (either(b, c) + d)
    WHEN 4 THEN a + (b + c)
    ELSE either(a + either(b, c + d), e) END AS score
  FROM wide
)""".replace("either(a + either(b, c + d), e)", _either("a + " + _either("b", "c + d"), "e"))
        .replace("either(a + b, c + d)", _either("a + b", "c + d"))
        .replace("either(b, c)", _either("b", "c")),
        _ranked("sum(score) IS NOT NULL"),
        select=_SELECT,
    ),
    "search_prefix": sql.with_ctes(
        *_INDEX,
        _asked((2, "en", 1, "wher")),
        _TERM_HITS.replace("matched AS", "term_matched AS"),
        """
matched AS (
  SELECT * FROM term_matched
  UNION ALL BY NAME
  SELECT query_id, language, 0 AS clause, id, sum(boost) AS score FROM (
    SELECT DISTINCT query_id, p.language, id, field FROM postings p
    JOIN (VALUES (1, 'en', 'thaned'), (2, 'en', 'erine'), (3, 'es', 'asc')) AS t(query_id, language, prefix)
      ON t.language = p.language AND starts_with(term, prefix)) JOIN boosts USING (field) GROUP BY ALL
)""",
        _ranked(),
        select=_SELECT,
    ),
    "search_required": _term_search(
        _asked(
            (1, "en", 0, "eriner"),
            (1, "en", 1, "attion"),
            (2, "en", 0, "eriner"),
            (2, "en", 1, "attion"),
            (2, "en", 2, "th"),
            (3, "en", 0, "anea"),
            (3, "en", 1, "the"),
            (3, "en", 2, "zzzz"),
        ),
        """CASE query_id WHEN 1 THEN count(*) = 2 WHEN 3 THEN count(*) = 3
     ELSE bool_or(clause = 2) AND bool_or(clause < 2) END""",
    ),
    "search_fuzzy": sql.with_ctes(
        *_INDEX,
        """
asked AS (
  SELECT DISTINCT query_id, v.language, clause, term FROM (SELECT DISTINCT language, term FROM postings) v
  JOIN (VALUES (1, 'en', 0, 'thanedbl', 1), (2, 'en', 0, 'erniner', 2), (3, 'en', 0, 'eriner', 0), (3, 'en', 1, 'attoin', 2))
    AS t(query_id, language, clause, wanted, distance)
    ON t.language = v.language AND abs(length(term) - length(wanted)) <= distance
   AND levenshtein(term, wanted) <= distance
)""",
        _TERM_HITS,
        _ranked(),
        select=_SELECT,
    ),
    "search_domain": _term_search(
        _asked((1, "en", 0, "the"), (2, "en", 0, "of"), (3, "en", 0, "and")),
        where="""query_id = 3
     OR query_id = 1 AND id IN (SELECT id FROM docs WHERE domain = 'blog.ththan.example.net' AND language = 'en')
     OR query_id = 2 AND id IN (SELECT id FROM docs WHERE domain = 'm.tionsh.example.com' AND language = 'en')""",
    ),
    "search_exclude": _term_search(
        _asked((1, "en", 0, "the"), (2, "en", 0, "attion"), (3, "en", 0, "anea")),
        where="""(query_id, id) NOT IN (
    SELECT (x.query_id, p.id) FROM postings p
    JOIN (VALUES (1, 'eriner'), (2, 'the'), (2, 'zzzz'), (3, 'wher')) AS x(query_id, term)
      ON x.term = p.term WHERE field = 'text' AND language = 'en')""",
    ),
    "search_highlight": sql.with_ctes(
        *_PLAIN_HITS,
        _FRAGMENTS,
        select="""
SELECT r.query_id, r.rank_no, r.id, coalesce(string_agg(tagged, chr(10) ORDER BY nth), '') AS fragments
FROM ranked r LEFT JOIN fragments f ON f.query_id = r.query_id AND f.rank_no = r.rank_no GROUP BY ALL""",
    ),
    "search_summary": sql.with_ctes(
        *_PLAIN_HITS,
        _FRAGMENTS,
        _SUMMARIES,
        select=f"""
SELECT r.query_id, r.rank_no, d.link,
       CASE WHEN n > 0 THEN summary WHEN length(d.text) > 500 THEN substring(d.text, 1, 500) || '...' ELSE d.text END AS text
{_RANKED_DOCS} JOIN summaries s ON s.query_id = r.query_id AND s.rank_no = r.rank_no""",
    ),
    "search_hits": sql.with_ctes(
        *_PLAIN_HITS,
        select=f"""
SELECT query_id, rank_no, title, link, text AS full_text,
       CASE WHEN rank_no % 2 = 1 THEN length(title) / 4.0 ELSE 1.0 END::DOUBLE AS rank,
       CASE WHEN rank_no % 2 = 1 THEN len(string_split(replace(title, ' ', ','), ',')) END::INTEGER AS n_tags,
       CASE WHEN rank_no % 2 = 1 THEN string_split(replace(title, ' ', ','), ',')[2] END AS second_tag {_RANKED_DOCS}""",
    ),
    "export_hits_json": sql.with_ctes(
        *_PLAIN_HITS,
        _FRAGMENTS,
        _SUMMARIES,
        select=f"""
SELECT r.query_id, r.rank_no, json_object('title', d.title, 'link', d.link, 'text',
         CASE WHEN n > 0 THEN summary WHEN length(d.text) > 500 THEN substring(d.text, 1, 500) || '...' ELSE d.text END,
         'full-text', d.text, 'rank', 1.0::DOUBLE, 'tags', NULL)::VARCHAR AS json
{_RANKED_DOCS} JOIN summaries s ON s.query_id = r.query_id AND s.rank_no = r.rank_no""",
    ),
    "search_counts": _term_search(
        _asked((1, "en", 0, "eriner"), (2, "en", 0, "zzzz"), (4, "xx", 0, "the")),
        select="""
SELECT q.query_id, count(r.id) AS n_hits FROM (VALUES (1), (2), (3), (4), (5)) AS q(query_id)
LEFT JOIN ranked r ON r.query_id = q.query_id GROUP BY q.query_id""",
    ),
    "autocomplete": sql.with_ctes(
        *sql.TO_SITES,
        _INDEXED,
        f"""
typed AS (
  SELECT query_id, language, regexp_extract_all(lower(input), '{_TOKEN}') AS words
  FROM (VALUES {_typed}) AS t(query_id, input, language)
),
typed_grams AS ({_shingles('typed', 'query_id, language')}
),
titles AS (SELECT language, id, regexp_extract_all(lower(title), '{_TOKEN}') AS words FROM docs),
title_grams AS ({_shingles('titles', 'language, id')}
),
points AS (
  SELECT query_id, t.language, t.id, count(DISTINCT (q.slot, q.size)) AS points
  FROM typed_grams q JOIN title_grams t ON t.language = q.language AND t.size = q.size
   AND CASE WHEN q.is_last THEN starts_with(t.gram, q.gram) ELSE t.gram = q.gram END
  GROUP BY ALL
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, id) AS slot FROM points QUALIFY slot <= 20
),
suggested AS (
  SELECT query_id, lower(title) AS suggestion, min(slot) AS slot
  FROM best b JOIN docs d ON d.id = b.id AND d.language = b.language GROUP BY ALL
)""",
        select="""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS rank_no, suggestion
FROM suggested QUALIFY rank_no <= 6""",
    ),
    "autocomplete_guard": sql.with_ctes(
        *sql.TO_SITES,
        _INDEXED,
        select="""
SELECT id AS query_id, title AS query, language AS lang FROM docs
WHERE NOT contains(title, 'domain:') AND NOT contains(title, '-') AND NOT contains(title, '"')""",
    ),
}
