"""Secret scans with an inverted index of trigrams; DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: an OR of alternatives, each an AND of all trigrams
of the literals that the alternative cannot do without. The index holds the postings of the trigrams that occur in the
queries; intersecting them gives the documents that a rule may match, and the pattern decides there. A rule with an
alternative that needs no trigram is matched against every document.
"""

from __future__ import annotations

import re._constants as kind
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import written


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # read alike by Java and Python
    least: int  # characters that the group below must have
    group: int = 0


# The base rules, in order.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# Published forms of some other credentials.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0),
    Rule("hosting_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
MOST_ALTERNATIVES = 64  # a pattern with more is matched against every document

MOST_LETTERS = 6  # a class of so many letters counts as alternatives

# An alternative: finished literals, and the literal that the next letter continues.
Alternative = tuple[frozenset[str], str]
_NOTHING: list[Alternative] = [(frozenset(), "")]


def _closed(found: list[Alternative]) -> list[Alternative]:
    """The literals end here: what follows does not continue them."""
    return list(dict.fromkeys((done | {text}, "") for done, text in found))


def _literals(tree) -> list[Alternative] | None:
    """Alternatives of a parsed pattern, lower case; None if there are too many."""
    found = _NOTHING
    for op, value in tree:
        if op is kind.LITERAL:
            found = [(done, text + chr(value).lower()) for done, text in found]
            continue
        if op is kind.SUBPATTERN:
            inner = _literals(value[3])
        elif op is kind.BRANCH:
            parts = [_literals(branch) for branch in value[1]]
            inner = None if None in parts else [a for part in parts for a in part]
        elif op is kind.IN and len(value) <= MOST_LETTERS and all(o is kind.LITERAL and chr(v).isalnum() for o, v in value):
            inner = [(frozenset(), chr(v).lower()) for _, v in value]
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT) and value[:2] == (0, 1):
            inner = _literals(value[2])
            inner = None if inner is None else [*_NOTHING, *inner]
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT) and value[0] >= 1:
            inner = _literals(value[2])
            inner = None if inner is None else _closed(inner)
            found = _closed(found)
        else:  # a class, any character, an optional repetition or an assertion
            found = _closed(found)
            continue
        if inner is None or len(found) * len(inner) > MOST_ALTERNATIVES:
            return None
        # A group's first literal continues the text before it only while it has no finished literals.
        found = [
            (done | more, text + tail) if not more else (done | more | {text}, tail)
            for done, text in found
            for more, tail in inner
        ]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that every match needs; None if some match needs none."""
    found = _literals(parser.parse(pattern))
    if found is None:
        return None
    query = [
        frozenset(t[i : i + 3] for t in done | {text} for i in range(len(t) - 2)) for done, text in found
    ]
    return None if not all(query) else list(dict.fromkeys(query))


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """(trigram, id): which documents hold which of the trigrams, letters in either case."""
    folded = docs.select(docs[id_col].alias("id"), F.lower(docs[text_col]).alias("folded"))
    held = F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams])
    return folded.select("id", F.explode(F.array_compact(held)).alias("trigram"))


def may_match(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> tuple[DataFrame | None, set[str]]:
    """(id, rules): the rules with a trigram query that each document may match; and the names of these rules."""
    queries = {r.name: q for r in rules if (q := trigram_query(r.pattern))}
    if not queries:
        return None, set()
    needs = [(name, i, t, len(q)) for name, alternatives in queries.items() for i, q in enumerate(alternatives) for t in sorted(q)]
    spark = docs.sparkSession
    table = spark.createDataFrame(needs, "rule string, alternative int, trigram string, needed int")
    index = written(postings(docs, id_col, text_col, sorted({n[2] for n in needs})).distinct(), "trigram-postings")
    hits = index.join(F.broadcast(table), "trigram")  # a row per trigram of the rules
    both = hits.groupBy("id", "rule", "alternative", "needed").agg(F.count("*").alias("n")).filter("n = needed")
    return both.groupBy("id").agg(F.collect_set("rule").alias("rules")), set(queries)


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Spans of a rule in a text: array of (start, number, end), in code points, matches that are too short left out.

    Places are added up from the lengths of the matches and of the pieces between them.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = found if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(
        F.transform(between, F.length),
        F.zip_with(F.transform(found, F.length), F.transform(judged, F.length), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        lambda gap, x: F.struct(gap.alias("gap"), x["m"].alias("m"), x["g"].alias("g")),
    )
    span = "array<struct<start:int,kind:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        made = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind"), (begin + x["m"]).alias("end")))
        kept = F.when(x["g"] >= rule.least, F.concat(state["spans"], made)).otherwise(state["spans"])
        return F.struct((begin + x["m"]).alias("at"), kept.alias("spans"))

    return F.aggregate(steps, start, add)["spans"]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text",
         out_col: str = "found") -> DataFrame:
    """`docs` with a column out_col (replaced if it exists): spans of all rules as array<struct<start, kind, end>>, by start, then kind.

    kind is the place of the rule in `rules`; spans count code points, the end is exclusive. Matches of a rule are the
    leftmost ones that do not overlap; those whose judged group is shorter than the rule's least length are dropped.
    Null and empty texts have no spans. Rows with the same id, or none, are judged each by its own text. Other columns
    stay; an empty table gives an empty one.
    """
    candidates, indexed = may_match(docs, rules, id_col, text_col)
    joined = docs.withColumn("rules__", F.array().cast("array<string>"))
    if candidates is not None:
        named = candidates.select(F.col("id").alias("id__"), F.col("rules").alias("rules__"))
        joined = docs.join(named, docs[id_col].eqNullSafe(named["id__"]), "left").drop("id__")
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for number, rule in enumerate(rules):
        likely = F.array_contains("rules__", rule.name) if rule.name in indexed else F.lit(True)
        at_least = rule.pattern
        if rule.pattern.endswith("]+") and rule.pattern.startswith("[") and rule.pattern.count("[") == 1:
            at_least = f"{rule.pattern[:-1]}{{{rule.least},}}"  # a run of one class: as long as it must be
        hit = F.coalesce(likely, F.lit(False)) & text.rlike(at_least)
        parts.append(F.when(hit, matches(text, rule, number)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return joined.withColumn(out_col, F.array_sort(F.concat(*parts))).drop("rules__")


def count_of(found: str, number: int) -> Column:
    """Spans of one rule."""
    return F.size(F.filter(found, lambda s: s["kind"] == number)).cast("long")


def described(found: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as name:start:end, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    one = F.transform(
        found,
        lambda s: F.concat(
            F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
        ),
    )
    return F.array_join(one, ",")


def masked(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of overlapping or touching spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        apart = (s["start"] > state["at"]) | (state["at"] == 0)
        out = F.when(apart, F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, add, rest)).otherwise(text)
