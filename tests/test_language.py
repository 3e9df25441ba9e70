import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom.operators import language
from webloom.sources.profiles import read_profiles, write_profiles

TRAIN = [
    ("en", "The cat and the dog. THE END of it"),
    ("es", "el gato y la perra, el fin de la año"),
    ("ru", "кошка и собака"),
]
TEXTS = [(1, "the dog"), (2, "la perra el año año"), (3, "собака"), (4, "123 !!"), (5, "zzz"), (6, "")]


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        p = f" {w} "
        out.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")
    return out


def model():
    counts = {lang: grams(text) for lang, text in TRAIN}
    vocabulary = {n: len({g for c in counts.values() for g in c if len(g) == n}) for n in (1, 2, 3)}
    return counts, vocabulary


def best(text):
    counts, vocabulary = model()
    found = grams(text)
    if not found:
        return "error"
    score = {}
    for lang, known in counts.items():
        totals = {n: sum(c for g, c in known.items() if len(g) == n) for n in (1, 2, 3)}
        score[lang] = sum(
            k * math.log((known[g] + 1) / (totals[len(g)] + vocabulary[len(g)])) for g, k in found.items()
        ) / sum(found.values())
    return min(score, key=lambda lang: (-round(score[lang], 9), lang))


@pytest.fixture(scope="module")
def profile(spark):
    return language.profiles(spark.createDataFrame(TRAIN, "lang string, text string"), "text", "lang").cache()


def test_profiles(profile):
    counts, vocabulary = model()
    assert {(r.lang, r.gram): r.cnt for r in profile.collect()} == {
        (lang, g): c for lang, known in counts.items() for g, c in known.items()
    }
    assert {(r.n, r.vocabulary) for r in language.profile_totals(profile).collect()} == set(vocabulary.items())


def test_detect(spark, profile):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    got = {r.id: r.language for r in language.detect(df, profile, "id", "text").collect()}
    assert got == {i: best(t) for i, t in TEXTS}
    assert got[1] == "en" and got[2] == "es" and got[3] == "ru" and got[4] == got[6] == "error"


def test_routing(spark):
    sites = spark.createDataFrame([("en",), ("fa",), ("de",), ("error",)], "language string")
    got = {r.language: r.stores for r in language.routed(sites).select("language", F.col("stores")).collect()}
    assert got == {"en": ["documents", "links"], "fa": ["documents"]}


def test_profile_files(spark, profile, tmp_path):
    write_profiles(profile, str(tmp_path / "files"))
    assert sorted(read_profiles(spark, str(tmp_path / "files")).collect()) == sorted(profile.collect())
    (tmp_path / "one").write_text('{"freq": {"a": 3,\n " b": 2},\n "n_words": [3, 2, 0], "name": "xx"}')
    assert sorted(read_profiles(spark, str(tmp_path / "one")).collect()) == [("xx", 1, "a", 3), ("xx", 2, " b", 2)]


def test_profile_files_replace_each_other(spark, tmp_path):
    """Odd codes and grams survive; languages of an earlier write go; nothing but the files is left."""
    path = str(tmp_path / "files")
    schema = "lang string, n int, gram string, cnt long"
    write_profiles(spark.createDataFrame([("old", 1, "a", 1)], schema), path)
    rows = [("../x", 1, '"', 2), ("../x", 2, "é\\", 3), ("de", 1, "a", 2**40), ("de", 3, " ab", 1)]
    write_profiles(spark.createDataFrame([*rows, (None, 1, "z", 1)], schema), path)
    assert sorted(tuple(r) for r in read_profiles(spark, path).collect()) == sorted(rows)
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == ["%2E%2E%2Fx.json", "de.json"]
    one = json.loads((tmp_path / "files" / "de.json").read_text())
    assert one == {"freq": {"a": 2**40, " ab": 1}, "n_words": [2**40, 0, 1], "name": "de"}


def test_profile_writer_holds_one_gram(tmp_path):
    """Memory does not grow with the language: 400,000 grams pass through a writer below 4 MB."""
    import tracemalloc

    import pyarrow as pa

    from webloom.sources.profiles import ProfileWriter

    def batches():
        for at in range(0, 400_000, 1000):
            grams = [f"{i:06d}"[:3] + chr(0x4E00 + i % 1000) for i in range(at, at + 1000)]
            yield pa.record_batch({"lang": ["xx"] * 1000, "n": [3] * 1000, "gram": grams, "cnt": [1] * 1000})

    tracemalloc.start()
    writer = ProfileWriter(f"file:{tmp_path}", True)
    writer.commit([writer.write(batches())])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20 and (tmp_path / "xx.json").stat().st_size > 4_000_000


def test_words_are_cut_and_counted_in_one_pass(spark, profile):
    """Texts of other separators than blanks, letters beyond two bytes, none at all; runs of a word count as one row."""
    odd = [(1, "-a--b a\tB\n"), (2, "𐐀𐐀x1𐐀𐐀X"), (3, "12 ,"), (4, ""), (5, None), (6, "the")]
    texts = spark.createDataFrame(odd, "id long, text string")
    got = language.word_counts(texts, "text", "id")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2), (1, "b", 2), (2, "𐐨𐐨x", 2), (6, "the", 1)]
    counted = language.scores(texts, profile, "id", "text").select("id", "n_grams").distinct()
    assert sorted(map(tuple, counted.collect())) == [
        (i, sum(grams(t).values())) for i, t in odd if t and grams(t)
    ]
    kinds = texts.select(language.words(F.col("text")).alias("w")).collect()
    assert [r.w for r in kinds][2:5] == [[], [], None]


def test_profiles_from_counted_words(spark, profile, monkeypatch):
    """Words that were counted before are not cut again."""
    texts = spark.createDataFrame([*TRAIN, *TRAIN, (None, "eins")], "lang string, text string")
    whole = language.profiles(texts, "text", "lang")
    counted = language.word_counts(texts, "text", "lang").localCheckpoint()
    monkeypatch.setattr(language, "words", None)
    again = language.profiles(texts, "text", "lang", counted)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))
