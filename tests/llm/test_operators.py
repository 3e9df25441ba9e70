"""Each operator against a brute-force version, on a small table with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import (
    batches,
    bpe_automaton,
    components,
    decontaminate,
    fuzzy_hash,
    language_bits,
    quality_cnn,
    repeated_bytes,
    secrets,
    superminhash,
    token_files,
    warc,
)

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("id", T.StringType()),
        T.StructField("rep", T.IntegerType()),
        T.StructField("found", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)
RANDOM = random.Random(5)
WORDS = ["".join(RANDOM.choice("abcdeghilmnorstu") for _ in range(RANDOM.randint(1, 9))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def near(text: str, every: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


BASE, PASSAGE, ITEM = prose(120, 1), prose(60, 2), prose(30, 3)
TEXTS: list[tuple[int | None, str | None]] = [
    (1, BASE),
    (2, BASE),
    (3, BASE.upper()),
    (4, near(BASE, 40, 4)),
    (5, near(near(BASE, 40, 4), 31, 5)),
    (6, None),
    (7, ""),
    (8, " \n\t "),
    (9, "one two"),
    (10, "One  Two"),
    (11, prose(50, 6) + " " + PASSAGE + " " + prose(40, 7)),
    (12, prose(30, 8) + " " + PASSAGE + " " + prose(10, 9)),
    (13, "é ünïcode … 日本語 <|endoftext|> İ ΣΑΣ \x00 \x1c x " + PASSAGE[:70]),
    (14, prose(20, 10) + " " + near(ITEM, 7, 11) + " " + prose(20, 12)),
    (15, prose(20, 13) + " password = 'abcdefgh1' Token:short api_key=ABCDEFGHIJKL " + "0123456789abcdef" * 3),
    (16, "AKIA" + "Q" * 16 + " é " + "-----BEGIN RSA PRIVATE KEY----- secret: x ghp_" + "z" * 36),
    (17, "ab" * 4000 + " " + prose(3000, 14)),
    (18, "w" * 9000),
    (19, "la la la " * 60),
    (20, "la la la " * 61),
    (4, near(BASE, 40, 4)),
    (21, BASE[:300]),
    (None, BASE),
    (None, None),
]
ROWS = [(i, t, "xx", None, len(t or ""), "7", 3, "f", "r", "s") for i, t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def library():
    loaded = tokenizers.Tokenizer.from_file(PATH)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def test_automaton_agrees_with_library(docs, none):
    t = library()
    want = []
    for i, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        joined = " ".join(map(str, ids))
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (joined, decoded))))
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(bpe_automaton.encode_decode(docs, PATH), *names) == ordered(want)
    assert bpe_automaton.encode_decode(none, PATH).count() == 0


def test_automaton_on_random_words():
    automaton, t = bpe_automaton.compile_file(PATH), library()
    encoder = bpe_automaton.Encoder(automaton)
    texts = ["".join(RANDOM.choice("abcdeinthrs' 0!é.Z") for _ in range(RANDOM.randint(0, 90))) for _ in range(400)]
    for text, (ids, decoded) in zip(texts, encoder.run(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want))
        assert decoded == t.decode(want, skip_special_tokens=False)


def test_gadgets_on_repeated_letters():
    letters = {"a": 0, "b": 1, "a</w>": 2, "b</w>": 3, "aa": 4, "ab</w>": 5, "aaa": 6}
    automaton = bpe_automaton.Automaton(letters, [("a", "a"), ("a", "b</w>"), ("aa", "a")], {})
    assert automaton.encode(["aaaab", "aaab", "aab", "ab", "aaaaaab"]) == [
        [4, 4, 3],
        [4, 5],
        [4, 3],
        [5],
        [4, 4, 4, 3],
    ]


def test_token_files(spark, docs, none):
    t = library()
    want, start = [], 0
    for i, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = token_files.write_files(docs, PATH, 1)
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert rows_of(token_files.read_files(manifest), *names) == ordered(want)
    some = [w for w in want if w[0] in (4, 17)]
    assert rows_of(token_files.read_files(manifest, {4, 17}), *names) == ordered(some)
    assert token_files.read_files(token_files.write_files(none, PATH, 1)).count() == 0


def test_token_file_reads_only_what_is_asked(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    path = tmp_path / "x"
    with open(path, "wb") as sink:
        writer = token_files.Writer(sink)
        for i in range(50):
            writer.add(i, np.arange(i, i + 30, dtype="<u4"))
        writer.close()
    with open(path, "rb") as source:
        reader = token_files.Reader(source)
        read = []
        whole = reader.frame
        monkeypatch.setattr(reader, "frame", lambda n: read.append(n) or whole(n))
        (found,) = reader.documents(reader.rows_of([33]))
        assert found[0] == 33 and found[1].tolist() == list(range(33, 63)) and len(read) == 1
        assert [d for d, _ in reader.documents()] == list(range(50))
    data = bytearray(path.read_bytes())
    data[5] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as source, pytest.raises(Exception):  # noqa: B017 the frame or its checksum
        list(token_files.Reader(source).documents())
    path.write_bytes(data[:-1])
    with open(path, "rb") as source, pytest.raises(ValueError):
        token_files.Reader(source)


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates(docs, none):
    named = [(i, shingles(t)) for i, t in TEXTS if i is not None]
    group = {i: i for i, _ in named}
    for _ in named:
        for i, a in named:
            for j, b in named:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    want = [
        (i, len(shingles(t)), None if i is None else group[i], None if i is None else group[i] == i) for i, t in TEXTS
    ]
    names = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(superminhash.near_duplicates(docs), *names) == ordered(want)
    assert superminhash.near_duplicates(none).count() == 0


def test_superminhash_estimates():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        common, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (150, 25, 25))
        values = np.concatenate((common, a, common, b))
        one, two = superminhash.signatures(values, np.array([0, 175, 350]))
        errors.append((one == two).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.75 * 0.25 / superminhash.SLOTS) ** 0.5


def test_few_links_are_lost_on_estimates():
    n, p = superminhash.SLOTS, superminhash.SIMILAR / 100
    unlikely = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n) if k < superminhash.LIKELY * n)
    no_band = (1 - p**superminhash.ROWS) ** superminhash.BANDS
    assert unlikely < 1e-6 and no_band + unlikely < 2.1e-5


def test_links_that_no_centre_sees(spark):
    """A chain whose ends are unlike: components need links between members of a bucket, not only to its centre."""
    text, rows = prose(200, 20), []
    words = text.split(" ")
    for i in range(12):
        words = [f"new{i}x{k}" if k % 100 == i * 7 % 100 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(words)))
    found = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in found.collect()} == {0}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    found = dict(rows_of(components.components(df), "node", "component"))
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert {k: v for k, v in found.items() if k != v} == want
    assert components.components(df.limit(0)).count() == 0


def test_fuzzy_hash(docs, none):
    order = sorted(TEXTS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    result = fuzzy_hash.fingerprints(docs)
    # Several rows without an id are in no order that the contract names.
    named = lambda rows: [r for r in rows if r[0] is not None]
    assert named(rows_of(result, "doc_id", "n_chars", "edited_sha256"))[1:] == named(ordered(want))[1:]
    prints = {}
    for r in result.collect():
        prints.setdefault(r["doc_id"], r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[1] == prints[2] != prints[11]
    assert fuzzy_hash.fingerprints(none).count() == 0


def test_likeness():
    a, b = prose(900, 30), prose(900, 31)
    fa, fb, half = (fuzzy_hash.fingerprint(x.encode()) for x in (a, b, a[: len(a) // 2] + b[: len(a) // 2]))
    same, edited, other = fuzzy_hash.likeness([(fa, fa), (fa, half), (fa, fb)])
    assert same == 1 and 0.3 < edited < 0.9 and other < 0.2
    assert fuzzy_hash.fingerprint(b"") == fuzzy_hash.fingerprint(b"")


def repeats(texts):
    first = {}
    for i, t in texts:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            key = b[k : k + 50]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [15, 0])
def test_repeated_bytes(docs, none, monkeypatch, hot):
    monkeypatch.setattr(repeated_bytes, "HOT_SEGMENTS", hot)
    want = repeats([(2**62 if i is None else i, t) for i, t in TEXTS])
    want = [(None if r[0] == 2**62 else r[0], *r[1:]) for r in want]
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(repeated_bytes.remove_repeats(docs), *names) == ordered(want)
    assert repeated_bytes.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [15, 0])
def test_repeated_bytes_of_rows_with_one_id(spark, monkeypatch, hot):
    """Each row of an id loses what its own text repeats, nothing at the places of another one; copies of rows stay rows."""
    monkeypatch.setattr(repeated_bytes, "HOT_SEGMENTS", hot)
    passage, other = prose(60, 2), prose(70, 21)
    rows = [
        (1, passage), (2, passage + prose(40, 22)), (2, other), (2, other), (2, passage), (3, prose(5, 23) + other[50:]),
        (3, other), (3, None), (3, ""), (4, passage[80:200] + prose(20, 24)), (4, prose(60, 25)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(repeated_bytes.remove_repeats(docs), *names) == ordered(repeats(rows))


def test_suffixes_of_names():
    """The recursive step on its own: alphabets of any size, runs, periods, and sequences that need several levels."""
    from webloom.llm.suffix_sort import _sorted_names

    r = np.random.default_rng(3)
    cases = [r.integers(0, r.integers(1, 9), r.integers(1, 90)) for _ in range(300)]
    cases += [np.zeros(500, int), np.tile([0, 1], 300), np.tile([1, 0, 2, 0], 150), np.arange(400), np.arange(400)[::-1]]
    cases += [np.tile(r.integers(0, 900, 60), 8), np.append(np.tile([2, 1, 2, 0, 1], 90), [1, 0])]
    word = np.array([0])
    for _ in range(10):
        word = np.concatenate((word, 1 - word))  # no three equal stretches in a row
    for case in [*cases, word]:
        _, names = np.unique(case, return_inverse=True)
        letters = names.tolist()
        assert _sorted_names(names).tolist() == sorted(range(len(letters)), key=lambda i: letters[i:])


def test_suffix_arrays():
    from webloom.llm.suffix_sort import suffix_array

    for case in range(400):
        n, top = RANDOM.randint(0, 50), RANDOM.choice([1, 2, 4, 255])
        text = bytes(RANDOM.randint(0, top) for _ in range(n))
        if case % 4 == 0:
            text = text[: n // 5 + 1] * 7
        got = suffix_array(np.frombuffer(text, np.uint8)).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:])


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(
        [(1, ITEM), (2, PASSAGE.upper().replace(" ", ", ")), (3, "too short"), (4, None), (None, PASSAGE), (1, ITEM)],
        "item_id long, text string",
    )
    found = decontaminate.leaks(docs, bench)
    assert rows_of(found, "doc_id", "item_id") == [(11, 2), (12, 2), (14, 1)]
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[11]["n_equal"] == by_id[11]["n_tokens"] == 60 and by_id[11]["place"] == 50
    assert 0.8 <= by_id[14]["similarity"] < 1 and by_id[14]["place"] == 20
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("every", [4, 5, 6, 9])
def test_substituted_passages(spark, every):
    item = prose(40, 40)
    rows = [(1, prose(80, 41) + " " + near(item, every, 42)), (2, prose(200, 43))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.leaks(df, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert rows_of(found, "doc_id") == [(1,)]


def test_masks_hit_every_overlap():
    def hit(n, wrong):
        places = sum(1 << i for i in wrong)
        for mask in decontaminate.MASKS[min(n, decontaminate.LEAST_TOKENS)]:
            looked = int(mask[::-1], 2)
            if any(looked << k & places == 0 for k in range(n - len(mask) + 1)):
                return True
        return False

    # A stretch of 26 tokens or more has a half that is as equal as the whole.
    missed = [(n, wrong) for n in range(1, 26) for wrong in combinations(range(n), n // 5) if not hit(n, wrong)]
    assert missed == []


def test_leaks_against_all_alignments(spark):
    """All documents by all items by all shifts; words are replaced at random places and at every fourth or fifth."""
    r = random.Random(46)
    items, docs = [], []
    for n in [*range(1, 28), 40, 60]:
        item = [r.choice(WORDS) for _ in range(n)]
        items.append((n, " ".join(item)))
        for k, wrong in enumerate(
            (set(r.sample(range(n), n // 5)), set(r.sample(range(n), n // 3)), set(range(r.randrange(4), n, 4)), set(range(2, n, 5)))
        ):
            copy = ["other" if i in wrong else w for i, w in enumerate(item)][: r.choice([n, n, max(1, n - 3)])]
            docs.append((100 * n + k, " ".join([prose(r.randint(0, 6), n), *copy, prose(r.randint(0, 6), n + 1)]).strip()))
    want = set()
    for key, text in docs:
        for number, item in items:
            hashes, offsets = decontaminate.tokens([text, item])
            a, b = hashes[: offsets[1]].tolist(), hashes[offsets[1] :].tolist()
            for shift in range(-len(b) + 1, len(a)):
                equal = [a[i] == b[i - shift] for i in range(max(0, shift), min(len(a), shift + len(b)))]
                least = min(13, len(b))
                if any(
                    10 * sum(equal[i:j]) >= 8 * (j - i) for i in range(len(equal)) for j in range(i + least, len(equal) + 1)
                ):
                    want.add((key, number))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want


@pytest.mark.parametrize(("n", "wrong"), [(1, []), (3, []), (5, []), (5, [2]), (6, [3]), (8, [3]), (10, [3, 6]), (13, [4, 8])])
def test_short_overlaps(spark, n, wrong):
    item = [f"w{i}" for i in range(n)]
    text = " ".join([prose(30, 44), *("other" if i in wrong else w for i, w in enumerate(item)), prose(30, 45)])
    df = spark.createDataFrame([(1, text), (2, prose(99, 46))], "doc_id long, text string")
    found = decontaminate.leaks(df, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string"))
    assert [(r["doc_id"], r["place"], r["n_tokens"], r["n_equal"]) for r in found.collect()] == [(1, 30, n, n - len(wrong))]


@pytest.mark.parametrize(
    ("item", "text"),
    [
        ("我们昨天在图书馆里读了一本很有意思的书", "他说：我们昨天在图书馆里读了一本很有意思的书。然后"),
        ("ฉันชอบอ่านหนังสือที่ห้องสมุด", "เมื่อวานฉันชอบอ่านหนังสือที่ห้องสมุดมาก"),
        ("the cat — it was “old” — sat there", "so the cat it was old sat\u00a0there again"),
        ("cafe\u0301 au lait tre\u0300s chaud ici", "un café au lait très chaud ici"),
    ],
)
def test_overlaps_beyond_ascii(spark, item, text):
    df = spark.createDataFrame([(1, text), (2, "别的 อื่น other")], "doc_id long, text string")
    found = decontaminate.leaks(df, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert rows_of(found, "doc_id", "similarity") == [(1, 1.0)]


PATTERNS = [
    re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
]


def test_secrets(spark, docs, none):
    rules = secrets.BASE + secrets.MORE
    found = secrets.scan(docs, rules, out_col="spans")
    assert set(docs.columns) < set(found.columns)
    for row in found.collect():
        text, want = row["text"] or "", []
        for kind, (pattern, least) in enumerate(zip(PATTERNS, (8, 16, 32))):
            for m in pattern.finditer(text):
                if len(m[1] if kind == 0 else m[0]) >= least:
                    want.append((m.start(), kind, m.end()))
        assert [tuple(s) for s in row["spans"] if s["kind"] < 3] == sorted(want)
    kinds = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in found.collect()}
    assert kinds[15] == {0, 2} and kinds[16] == {1, 3, 4} and not kinds[6]
    masked = found.withColumn("text", secrets.masked(F.col("text"), F.col("spans"))).collect()
    texts = {r["doc_id"]: r["text"] for r in masked}
    assert texts[16] == "[SECRET] é [SECRET] secret: x [SECRET]" and texts[6] is None and texts[11] == TEXTS[10][1]
    assert secrets.scan(none, rules).count() == 0


def test_trigram_queries():
    query = secrets.trigram_query(r"(?:abcd|xyz)\d+(?:ghp|gho)_")
    assert frozenset({"abc", "bcd", "ghp", "hp_"}) in query and len(query) == 4
    assert secrets.trigram_query(r"[0-9]+") is None
    assert secrets.trigram_query(r"abc|d+") is None
    assert secrets.trigram_query(r"ab?cde") == [frozenset({"acd", "cde"}), frozenset({"abc", "bcd", "cde"})]
    assert secrets.trigram_query(r"(?:abc)*def") == [frozenset({"def"})]


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x"), (2, "http://b\r\nX: y", "<p>x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 9000),
             (6, "u", "WARC/1.1\r\n\r\nnot a record"), (None, "n", "<p>x"), (2, "again", "<p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    last = {}
    for i, _, html in pages:
        if i is not None:
            last[html or ""] = max(last.get(html or "", 0), i)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        refers = None if i is None or last[html or ""] == i else last[html or ""]
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), sha, "response" if refers is None else "revisit", refers))
    found = warc.read_archives(warc.write_archives(df))
    assert found.filter("kind = 'gap'").count() == 0
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(found, *names) == ordered(want)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_long_url(spark):
    url = "http://a/" + "\t" * 700_000 + "x" * 100
    df = spark.createDataFrame([(1, url, "<p>x"), (2, "u", "<p>y")], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(df)).collect()}
    assert {i: r["kind"] for i, r in found.items()} == {1: "record", 2: "record"}
    assert found[1]["url"] == warc.one_line(url) and len(found[1]["url"]) > 2_000_000
    one = [warc.page_record(i, u, b"<p>x", None) for i, u in ((1, url), (2, "u"))]
    assert [x[0] for x in warc.salvage(b"".join(one))] == ["record", "record"]


def test_warc_damage_within_a_member():
    """A stream of records in one member: what is good before and after a bad record stays, also if the end is missing."""
    one = [warc.page_record(i, f"http://x/{i}", f"<p>{i} ".encode() + RANDOM.randbytes(900), None) for i in range(5)]
    bad = one[2][:-30] + b"x" * 26 + one[2][-4:]
    whole = warc.member(b"".join([*one[:2], bad, *one[3:]])) + warc.member(one[0])
    found = list(warc.salvage(whole))
    assert [(x[0], (x[3] or {}).get("page-id")) for x in found] == [
        ("record", "0"), ("record", "1"), ("gap", None), ("record", "3"), ("record", "4"), ("record", "0"),
    ]
    member = warc.member(b"".join(one))
    for data in (member[: len(member) * 3 // 4], member[: len(member) * 3 // 4] + b"x" * 50 + warc.member(one[4])):
        found = list(warc.salvage(data))
        kept = [x[3]["page-id"] for x in found if x[0] == "record"]
        assert kept[:3] == ["0", "1", "2"] and [x[0] for x in found].count("gap") == 1
        assert (kept[-1] == "4") == (len(data) > len(member))
    checked = bytearray(member)
    checked[-8] ^= 1  # the checksum of the member
    assert [x[0] for x in warc.salvage(bytes(checked))] == ["record"] * 5 + ["gap"]


def test_warc_digests_of_other_algorithms():
    body = b"payload"
    for name, value in [
        ("md5", hashlib.md5(body).hexdigest()), ("sha256", hashlib.sha256(body).hexdigest()),
        ("SHA-256", base64.b32encode(hashlib.sha256(body).digest()).decode()), ("blake9", "whatever"),
        ("sha1", warc.digest(body).lower()),
    ]:
        data = warc.record([("WARC-Type", "resource"), ("WARC-Payload-Digest", f"{name}:{value}")], body)
        assert [x[0] for x in warc.salvage(data)] == ["record"], name
        if name != "blake9":
            assert [x[0] for x in warc.salvage(data.replace(b"payload", b"Payload"))] == ["gap"], name


def test_paths_name_their_file_system(spark):
    path = batches.shared_output(spark, "x")
    assert path.startswith("file:/") and batches.filesystem(path)[1].startswith("/")
    with pytest.raises(ValueError):
        batches.filesystem("/user/job/x")


@pytest.mark.parametrize("zipped", [True, False])
def test_warc_salvage(zipped):
    one = [warc.page_record(i, f"http://x/{i}", f"<p>{i} WARC/1.1 ".encode() * 40, None) for i in range(6)]
    parts = [warc.member(r) for r in one] if zipped else one
    damaged = bytearray(b"".join(parts))
    at = len(b"".join(parts[:2])) + len(parts[2]) // 2
    damaged[at : at + 3] = b"\0\0\0"
    data = bytes(damaged[: len(damaged) - 20])
    found = list(warc.salvage(data))
    pages = [int(x[3]["page-id"]) for x in found if x[0] == "record"]
    gaps = [(x[1], x[2]) for x in found if x[0] == "gap"]
    assert pages == [0, 1, 3, 4]
    assert gaps == [(len(b"".join(parts[:2])), len(b"".join(parts[:3]))), (len(b"".join(parts[:5])), len(data))]
    assert all(x[5] for x in found if x[0] == "gap") and list(warc.salvage(b"")) == []
    assert [x[0] for x in warc.salvage(b"junk" + data[: len(parts[0])])] == ["gap", "record"]


def junk(seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS).upper() + "!!" for _ in range(80))


def test_quality(spark, docs, none):
    rows = [(i, junk(i) if i % 2 else prose(90, 100 + i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    net = quality_cnn.fit(df.filter("doc_id % 5 != 0"), labels)
    scores = dict(rows_of(quality_cnn.score(df, net), "doc_id", "score"))
    assert np.mean([(scores[i] >= 0.3) == (i % 2 == 0) for i in range(0, 300, 5)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in quality_cnn.score(docs, net).collect())
    kept = quality_cnn.keep_good(docs, net, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert quality_cnn.score(none, net).count() == 0
    for some in (labels.limit(0), labels.filter("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        lone = quality_cnn.fit(df, some)
        assert all(r["score"] > 0.9 for r in quality_cnn.score(df.limit(3), lone).collect())


def test_chunks_cover_the_document():
    for n in (0, 1, 511, 512, 513, 896, 897, 5000):
        data = bytes(RANDOM.randint(1, 255) for _ in range(n))
        cut = quality_cnn.chunked(data)
        assert cut.shape[1] == quality_cnn.CHUNK
        assert cut[0].tobytes().rstrip(b"\0") == data[:512] and cut[-1].tobytes().rstrip(b"\0") == data[-512:]
        assert len(cut) == 1 or len(cut) * quality_cnn.CHUNK >= n


def test_language(spark, docs, none):
    def text(lang, seed):
        r = random.Random(seed)
        parts = {"aa": ["kra", "pto", "mil", "zan"], "bb": ["wou", "ley", "shi", "dun"]}[lang]
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(40))

    rows = [(i, text("ab"[i % 2] * 2, i), "ab"[i % 2] * 2) for i in range(200)]
    df = spark.createDataFrame([*rows, (500, None, "aa"), (501, "kra", None)], "doc_id long, text string, lang string")
    filters = language_bits.fit(df.filter("doc_id % 4 != 2"))
    found = {r["doc_id"]: r for r in language_bits.predict(df, filters).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows)
    assert found[500]["lang_pred"] == "und" and found[500]["score"] == 0
    odd = {r["doc_id"]: r for r in language_bits.predict(docs, filters).collect()}
    assert [odd[i]["lang_pred"] for i in (6, 7, 8)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "bb", "und") for r in odd.values())
    assert language_bits.predict(none, filters).count() == 0
    empty = language_bits.fit(df.limit(0))
    assert {r["lang_pred"] for r in language_bits.predict(df, empty).collect()} == {"und"}


def test_many_languages(spark):
    """More languages than bits in one word."""
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 70) + k % 30) * 5 for k in range(60)), f"l{i % 70:02}") for i in range(210)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_bits.predict(df, language_bits.fit(df)).join(df, "doc_id")
    assert found.filter("lang_pred = lang").count() == 210
