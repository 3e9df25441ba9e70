"""Suffix arrays by induced sorting, and repeated windows from permuted common prefixes; numpy, linear passes."""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type); the empty suffix is the smallest of all."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1] = -1
    decided = np.flatnonzero(step)
    return step[decided[np.searchsorted(decided, np.arange(n))]] > 0


def _names(text: np.ndarray, small: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings (each from its start to the next one's): equal ranks for equal ones.

    Letters and types are packed six to a word, an end counting less than any letter; words are compared one after the other, later ones only where a
    substring is that long and shares its earlier words with another one.
    """
    letters = ((text.astype(np.uint64) << np.uint64(1)) | small) + np.uint64(1)
    length = np.append(starts[1:] + 1, len(text)) - starts
    wide = np.pad(letters, (0, 6))
    packed = np.zeros(len(text), np.uint64)
    for k in range(6):
        packed |= wide[k : k + len(text)] << np.uint64(10 * (5 - k))
    keep = np.array([((1 << 60) - 1) ^ ((1 << (10 * (6 - k))) - 1) for k in range(7)], np.uint64)
    _, rank = np.unique(packed[starts] & keep[np.minimum(length, 6)], return_inverse=True)
    done = 6
    while True:
        on = np.flatnonzero(length > done)
        if len(on):
            on = on[np.bincount(rank)[rank[on]] > 1]
        if not len(on):
            return rank
        word = packed[starts[on] + done] & keep[np.minimum(length[on] - done, 6)]
        order = np.lexsort((word, rank[on]))
        a, b = rank[on][order], word[order]
        new = np.append(False, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        sub = np.zeros(len(rank), np.int64)
        sub[on[order]] = np.cumsum(new) + 1
        # Substrings of one rank are all longer than `done` or all end before, so the order inside ranks is complete.
        _, rank = np.unique(rank * (len(on) + 2) + sub, return_inverse=True)
        done += 6


def _same_substrings(names: np.ndarray, first: np.ndarray, second: np.ndarray, length: np.ndarray, short: int = 16) -> np.ndarray:
    """Whether the stretches of the given lengths from the first and from the second places hold the same names."""
    equal = np.ones(len(first), bool)
    on = np.flatnonzero(length <= short)
    for at in range(short):
        on = on[length[on] > at]
        differ = names[first[on] + at] != names[second[on] + at]
        equal[on[differ]] = False
        on = on[~differ]
    for i in np.flatnonzero(length > short).tolist():
        a, b, n = int(first[i]), int(second[i]), int(length[i])
        equal[i] = np.array_equal(names[a : a + n], names[b : b + n])
    return equal


def _induced(names: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order of all suffixes induced from leftmost-smaller ones in the order given.

    If these are in the order of their suffixes, so is the result; if they are in any order, the result has the
    leftmost-smaller substrings in theirs. There may be as many buckets as names, so entries move one by one.
    """
    n = len(names)
    end = np.cumsum(np.bincount(names))
    order = np.argsort(names[seeds], kind="stable")
    letter = names[seeds[order]]
    last = np.searchsorted(letter, letter, side="right")
    places = np.full(n, -1, np.int64)
    places[end[letter] - last + np.arange(len(letter))] = seeds[order]
    before = np.append(-1, names)  # by suffix: the name before it; the last entry answers for empty places
    larger, smaller = before.copy(), before.copy()
    larger[1:][small] = -1
    smaller[1:][~small] = -1
    larger[n] = smaller[n] = -1
    out, goes, head = places.tolist(), larger.tolist(), np.append(0, end[:-1]).tolist()
    start = int(names[-1])  # the last suffix is larger than the empty one behind it
    out[head[start]] = n - 1
    head[start] += 1
    for suffix in out:
        name = goes[suffix]
        if name >= 0:
            out[head[name]] = suffix - 1
            head[name] += 1
    goes, tail = smaller.tolist(), end.tolist()
    for suffix in reversed(out):
        name = goes[suffix]
        if name >= 0:
            tail[name] -= 1
            out[tail[name]] = suffix - 1
    return np.array(out, np.int64)


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of names (ranks without gaps): the method itself, one level up.

    The leftmost-smaller substrings of names are sorted by inducing, named in turn, and their suffixes sorted by a call
    of this function, whose sequence is half as long at most; from these all suffixes are induced.
    """
    n = len(names)
    if int(names.max()) + 1 == n:
        return np.argsort(names, kind="stable")
    small = suffix_types(names)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        number = np.full(n, -1, np.int64)
        number[lms] = np.arange(len(lms))
        length = np.append(lms[1:] + 1, n) - lms
        found = _induced(names, small, lms)
        found = number[found]
        found = found[found >= 0]
        # The last substring ends with the sequence and equals none.
        a, b = found[:-1], found[1:]
        alike = np.flatnonzero((length[a] == length[b]) & (a != len(lms) - 1) & (b != len(lms) - 1))
        new = np.ones(len(lms), bool)
        new[1 + alike] = ~_same_substrings(names, lms[a[alike]], lms[b[alike]], length[a[alike]])
        rank = np.empty(len(lms), np.int64)
        rank[found] = np.cumsum(new) - 1
        lms = lms[_sorted_names(rank)]
    return _induced(names, small, lms)


class _Buckets:
    """Entries put into the bucket of their letter, in the order of arrival."""

    def __init__(self, top: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(top)]

    def deal(self, entries: np.ndarray, letters: np.ndarray) -> None:
        if not len(entries):
            return
        order = np.argsort(letters, kind="stable")
        entries, letters = entries[order], letters[order]
        cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        for letter, part in zip(letters[np.append(0, cuts)].tolist(), np.split(entries, cuts)):
            self.parts[letter].append(part)

    def take(self, letter: int) -> np.ndarray:
        return np.concatenate(self.parts[letter]) if self.parts[letter] else np.empty(0, np.int32)


def _same_letter(text: np.ndarray, entries: np.ndarray, letter: int) -> np.ndarray:
    """The entries, then those that they induce in their own bucket, then those that these induce, and so on."""
    found = [entries]
    while len(entries):
        before = entries[entries > 0] - 1
        entries = before[text[before] == letter]
        found.append(entries)
    return np.concatenate(found)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of bytes (uint8), as int32.

    Suffixes are classified; the leftmost-smaller substrings are named and their suffixes sorted by names; from them
    the larger suffixes are induced bucket by bucket upwards, and from those all smaller ones downwards.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = suffix_types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        lms = lms[_sorted_names(_names(text, small, lms))]
    top = int(text.max()) + 1
    seeds = _Buckets(top)
    seeds.deal(lms, text[lms])
    large = _Buckets(top)
    large.parts[int(text[-1])].append(np.array([n - 1], np.int32))
    upper: list[np.ndarray] = []
    for letter in range(top):
        upper.append(_same_letter(text, large.take(letter), letter))
        source = np.concatenate((upper[letter], seeds.take(letter)))
        before = source[source > 0] - 1
        before = before[text[before] > letter]
        large.deal(before, text[before])
    smaller = _Buckets(top)
    out: list[np.ndarray] = []
    for letter in range(top - 1, -1, -1):
        lower = _same_letter(text, smaller.take(letter), letter)
        out += [lower, upper[letter][::-1]]
        source = np.concatenate(out[-2:])
        before = source[source > 0] - 1
        before = before[text[before] < letter]
        smaller.deal(before, text[before])
    return np.concatenate(out)[::-1]


def equal_prefixes(text: np.ndarray, first: np.ndarray, second: np.ndarray, window: int) -> np.ndarray:
    """Whether `window` bytes from the first and from the second places agree, eight bytes at a time."""
    word = np.zeros(len(text), np.uint64)
    wide = np.pad(text, (0, 8)).astype(np.uint64)
    for k in range(8):
        word |= wide[k : k + len(text)] << np.uint64(8 * k)
    equal = np.zeros(len(first), bool)
    on = np.arange(len(first))
    for at in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        on = on[word[first[on] + at] == word[second[on] + at]]
    equal[on] = True
    return equal


def repeated_windows(text: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, groups) of the windows that start at `valid` places: equal windows have equal group numbers.

    Neighbours in suffix order are compared by their permuted common prefix, cut at the window's length; a suffix
    between two with a common prefix shares it, so places that are not valid can be left out.
    """
    order = suffix_array(text)
    order = order[valid[order]].astype(np.int64)
    if not len(order):
        return order, order
    same = equal_prefixes(text, order[:-1], order[1:], window)
    return order, np.append(0, np.cumsum(~same))
