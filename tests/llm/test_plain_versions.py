"""op5's fingerprints and likeness, op9's forward pass and op10's n-grams against plain programs that follow their definitions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from webloom.llm import fuzzy_hash, language_bits, quality_cnn

R = random.Random(11)
M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def hash_at(data: bytes, end: int) -> int:
    """Hash of the seven bytes that end at a place, byte by byte."""
    x = sum((data[end - k] + 1) * pow(0x01000193, k) for k in range(7) if k <= end) & M32
    x ^= x >> 15
    x = x * 0x2C1B3C6D & M32
    return x ^ x >> 12


def letter(total: int) -> str:
    x = total
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & M64
    return fuzzy_hash.LETTERS[(x ^ x >> 31) >> 58]


def plain_letters(hashes: list[int], size: int) -> str:
    out, total, closed = "", 0, 0
    for at, h in enumerate(hashes):
        total = (total + ((h * 0x9E3779B97F4A7C15 & M64) >> 7)) & M64
        ends = h % size == size - 1 and closed < fuzzy_hash.LENGTH - 1
        if ends or at == len(hashes) - 1:
            out, total, closed = out + letter(total), 0, closed + 1
    return out


def plain_fingerprint(data: bytes) -> str:
    if not data:
        return "3::"
    hashes = [hash_at(data, i) for i in range(len(data))]

    def boundaries(size: int) -> int:
        return sum(h % size == size - 1 for h in hashes)

    size = 3
    while size * fuzzy_hash.LENGTH < len(data):
        size *= 2
    while size > 3 and boundaries(size) < fuzzy_hash.LENGTH // 2:
        size //= 2
    return f"{size}:{plain_letters(hashes, size)}:{plain_letters(hashes, 2 * size)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions and deletions that turn a into b, by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] if x == y else 1 + min(last[j], row[-1]))
    return row[-1]


def plain_likeness(x: str, y: str) -> float:
    if x == y:
        return 1.0
    (m, *xs), (n, *ys) = x.split(":"), y.split(":")
    best = 0.0
    for i, a in enumerate(xs):
        for j, b in enumerate(ys):
            run = max(1, min(7, min(len(a), len(b)) // 3))
            alike = any(a[k : k + run] in b for k in range(len(a) - run + 1))
            if int(m) << i == int(n) << j and a and b and alike:
                best = max(best, 1 - edit_distance(a, b) / (len(a) + len(b)))
    return best


def some_texts() -> list[bytes]:
    words = ["".join(R.choice("abcdefghäß漢") for _ in range(R.randint(1, 8))) for _ in range(200)]
    texts = [" ".join(R.choice(words) for _ in range(n)).encode() for n in (1, 3, 9, 40, 150, 400, 900)]
    texts += [texts[-1][:1500] + texts[-2][:1500], texts[-1][300:], texts[-2] + b"!", texts[-2][:900] + texts[-3]]
    return [*texts, b"", b"a", b"a" * 3000, b"ab" * 700, bytes(range(1, 128)) * 9]


def test_fingerprints_and_likeness():
    texts = some_texts()
    prints = [fuzzy_hash.fingerprint(t) for t in texts]
    assert prints == [plain_fingerprint(t) for t in texts]
    pairs = [(a, b) for a in prints for b in prints]
    want = [plain_likeness(*p) for p in pairs]
    assert fuzzy_hash.likeness(pairs) == pytest.approx(want, abs=1e-12)
    assert sum(0.2 < w < 1 for w in want) >= 4  # some are alike without being equal
    assert fuzzy_hash.likeness([(b, a) for a, b in pairs]) == pytest.approx(want, abs=1e-12)


def plain_score(net: quality_cnn.Network, data: bytes) -> float:
    """Probability of good quality: every chunk, every place and every filter in turn."""
    starts = [0]
    while starts[-1] + quality_cnn.CHUNK < len(data):
        starts.append(min(starts[-1] + quality_cnn.STEP, len(data) - quality_cnn.CHUNK))
    worst = -math.inf
    for start in starts:
        chunk = data[start : start + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
        top = np.full(quality_cnn.FILTERS, -np.inf)
        for at in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.HOP):
            under = np.concatenate([net.embed[b] for b in chunk[at : at + quality_cnn.WIDTH]]).astype(float)
            top = np.maximum(top, under @ net.filters.astype(float))
        inputs = np.append(np.maximum(top + net.bias, 0), chunk.count(0) / quality_cnn.CHUNK)
        hidden = np.maximum(inputs @ net.dense.astype(float) + net.dense_bias, 0)
        worst = max(worst, float(hidden @ net.out.astype(float) + net.out_bias[0]))
    return 1 / (1 + math.exp(worst))


def test_forward_pass_of_the_network():
    net = quality_cnn.fresh(3)
    r = np.random.default_rng(3)
    for array in (net.bias, net.dense_bias, net.out_bias):
        array += r.normal(size=array.shape).astype(np.float32) / 4
    texts = [t.decode(errors="ignore") for t in some_texts()]
    texts += ["x" * n for n in (511, 512, 513, 896, 897)]
    got = quality_cnn.score_texts(net, texts)
    assert got == pytest.approx([plain_score(net, t.encode()) for t in texts], abs=1e-5)
    assert len(set(np.round(got, 6))) > 8


def plain_grams(text: str) -> list[tuple[str, ...]]:
    """3- and 4-grams whose inner characters are letters; other characters are one boundary, which texts begin and end with."""
    marks = ["", *(c if c.isalpha() else "" for c in text.lower()), ""]
    return [tuple(marks[i : i + n]) for n in language_bits.LENGTHS for i in range(len(marks) - n + 1) if all(marks[i + 1 : i + n - 1])]


def test_grams_of_a_text_wherever_it_stands_in_a_batch():
    letters = np.unpackbits(language_bits.letter_table()).astype(bool)
    texts = ["Abc", "", "ab", "one two, THREE", "Ünï 漢字漢字 x", "12 .", "a", "\n", "one two, THREE", "Abc"]
    whole, number = [], {}
    for strings in (texts, texts[3:], texts[::-1], texts[4:5]):
        values, owner, count = language_bits.grams(strings, letters)
        assert count.tolist() == [sum(c.isalpha() for c in t.lower()) for t in strings]
        for i, text in enumerate(strings):
            found, want = sorted(values[owner == i].tolist()), plain_grams(text)
            assert len(found) == len(want)
            assert number.setdefault(text, found) == found  # the same wherever it stands
            whole.append((len(set(found)), len(set(want))))
    assert all(a == b for a, b in whole)
