"""Language profiles, identification, acceptance and routing.

Model: naive Bayes over the 1- to 3-grams of lower-cased words padded with one blank, add-one smoothing per gram
length. The log-likelihood splits into a part that only exists for grams known to a language and a part that depends
on nothing but the number of grams per length:

    score(lang) = sum_gram cnt * ln(known + 1)  -  sum_n cnt_n * ln(total(lang, n) + vocabulary(n))

so a text is scored with one join of its grams to the profile, where unknown grams cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.rows import explode_as
from webloom.functions.text import term_counts

# Fixed values.
ACCEPTED_LANGUAGES = ("en", "fa", "ar", "ru", "es")
LINKED_LANGUAGE = "en"
UNKNOWN = "error"
MAX_GRAM = 3


def words(text: Column) -> Column:
    """Runs of letters, in order: what lies between them is cut away, which costs half of extracting every match."""
    return F.array_remove(F.split(F.lower(text), r"\P{L}++"), "")


def grams_of_words(words_table: DataFrame, *keep: str) -> DataFrame:
    """One row per gram of each row's `word`, padded with one blank: `keep`, n, gram. The lone blank is no gram.

    Two generators over plain expressions instead of nested lambdas, so the whole step is compiled code.
    """
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" ")).alias("padded")
    placed = words_table.select(*keep, padded).select(
        *keep, "padded", F.explode(F.sequence(F.lit(1), F.length("padded"))).alias("at")
    )
    cut = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.substring("padded", F.col("at"), F.lit(n)).alias("gram"))
            for n in range(1, MAX_GRAM + 1)
        ]
    )
    each = placed.select(*keep, F.explode(cut).alias("g")).select(*keep, "g.n", "g.gram")
    return each.filter((F.length("gram") == F.col("n")) & (F.col("gram") != " "))


def n_grams_of_words(tf: Column, word: Column) -> list[Column]:
    """Numbers of 1- to 3-grams of `tf` times `word`: a word of k letters, padded, has k letters and k + 3 - n n-grams else."""
    letters = F.length(word).cast("long")
    return [tf * letters, *(tf * (letters + (3 - n)) for n in range(2, MAX_GRAM + 1))]


def word_counts(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per distinct word of a text: `keep`, word, tf. Words are counted inside the row; the text is not copied."""
    counted = explode_as(texts.select(*keep, term_counts(words(F.col(text))).alias("words")), "words", "w")
    return counted.select(*keep, F.col("w.term").alias("word"), F.col("w.tf").alias("tf"))


def profiles(labelled: DataFrame, text: str, lang: str, counted: DataFrame | None = None) -> DataFrame:
    """profiles(lang, n, gram, cnt) of labelled texts. With their `word_counts` (lang, word, tf) as `counted`, written
    before, the texts are not cut into words again."""
    # Count words first: the grams of a frequent word are cut once per language, not once per occurrence.
    if counted is None:
        named = explode_as(labelled.select(F.col(lang).alias("lang"), words(F.col(text)).alias("words")), "words", "word")
        per_word = named.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("w"))
    else:
        per_word = counted.groupBy(F.col(lang).alias("lang"), "word").agg(F.sum("tf").alias("w"))
    counts = grams_of_words(per_word, "lang", "w").groupBy("lang", "n", "gram").agg(F.sum("w").alias("cnt"))
    return counts.select("lang", "n", "gram", "cnt")


def profile_totals(profile: DataFrame) -> DataFrame:
    """lang, n, total and vocabulary: number of occurrences per language and of distinct grams over all languages."""
    vocabulary = profile.groupBy("n", "gram").agg(F.lit(1).alias("one")).groupBy("n").agg(
        F.count(F.lit(1)).alias("vocabulary")
    )
    totals = profile.groupBy("lang", "n").agg(F.sum("cnt").alias("total"))
    return totals.join(vocabulary, "n")


def scores(
    texts: DataFrame, profile: DataFrame, key: str, text: str, counted: DataFrame | None = None
) -> DataFrame:
    """key, lang, score (mean log-likelihood per gram) and n_grams for every text with at least one letter.

    Every distinct word of all texts is scored once, from the profile with one column per language: its grams, which
    outnumber it many times, exist once per word and not once per text. Texts then meet their words' sums in a join on
    the word, whose frequent words adaptive execution splits. The sums are partial before the exchange. Only grams that
    the profile knows are summed: how many a word has follows from its length.

    The words are read twice, for the vocabulary and for the texts. Give the `word_counts` of large `texts` as `counted`,
    written before, and the texts are cut into words once.
    """
    # The list of languages of the model; there are as many as there are languages.
    langs = [r.lang for r in profile.select("lang").distinct().orderBy("lang").collect()]
    gains = (
        profile.groupBy("gram")
        .pivot("lang", langs)
        .agg(F.first(F.log(F.col("cnt") + 1)))
        .select("gram", *[F.coalesce(F.col(f"`{lang}`"), F.lit(0.0)).alias(f"g{i}") for i, lang in enumerate(langs)])
    )
    counted = word_counts(texts, text, key) if counted is None else counted
    sizes = [f"n{n}" for n in range(1, MAX_GRAM + 1)]
    gained = [f"g{i}" for i in range(len(langs))]
    per_word = (
        grams_of_words(counted.select("word").distinct(), "word")
        .join(gains, "gram")
        .groupBy("word")
        .agg(*[F.sum(g).alias(g) for g in gained])
    )
    summed = (
        counted.join(per_word, "word", "left")
        .groupBy(key)
        .agg(
            *[F.sum(F.col("tf") * F.coalesce(g, F.lit(0.0))).alias(g) for g in gained],
            *[F.sum(n).alias(size) for size, n in zip(sizes, n_grams_of_words(F.col("tf"), F.col("word")))],
        )
    )
    costs = profile_totals(profile).agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.concat_ws(":", "lang", F.col("n").cast("string")),
                    F.log(F.col("total") + F.col("vocabulary")),
                )
            )
        ).alias("costs")
    )
    n_grams = sum((F.col(f"n{n}") for n in range(2, MAX_GRAM + 1)), F.col("n1"))

    def score(i: int, lang: str) -> Column:
        cost = [F.col(f"n{n}") * F.coalesce(F.col("costs")[f"{lang}:{n}"], F.lit(0.0)) for n in range(1, MAX_GRAM + 1)]
        return (F.col(f"g{i}") - sum(cost[1:], cost[0])) / n_grams

    entries = F.array(
        *[F.struct(F.lit(lang).alias("lang"), score(i, lang).alias("score")) for i, lang in enumerate(langs)]
    )
    priced = summed.withColumn("costs", costs.scalar())
    return priced.select(key, n_grams.alias("n_grams"), F.explode(entries).alias("s")).select(
        key, "s.lang", "s.score", "n_grams"
    )


def detect(
    texts: DataFrame, profile: DataFrame, key: str, text: str, counted: DataFrame | None = None
) -> DataFrame:
    """key, language for every text; 'error' where nothing can be scored, ties by language code. `counted` as in `scores`."""
    best = (
        scores(texts, profile, key, text, counted)
        .groupBy(key)
        .agg(F.min_by("lang", F.struct(-F.round("score", 9), F.col("lang"))).alias("language"))
    )
    return texts.select(key).join(best, key, "left").withColumn("language", F.coalesce("language", F.lit(UNKNOWN)))


def accepted(sites: DataFrame) -> DataFrame:
    return sites.filter(F.col("language").isin(*ACCEPTED_LANGUAGES))


def routed(sites: DataFrame) -> DataFrame:
    """Accepted sites with the stores each goes to: all to the document index, one language to the link table."""
    stores = F.when(
        F.col("language") == LINKED_LANGUAGE, F.array(F.lit("documents"), F.lit("links"))
    ).otherwise(F.array(F.lit("documents")))
    return accepted(sites).withColumn("stores", stores)
