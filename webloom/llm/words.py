"""Pre-splitting of texts into words, as the lower-casing word BPE does it.

A text is cut at the special tokens (matched as they stand), then normalized (canonical composition, lower case) and
split into contractions, runs of letters, single digits and runs of other visible characters; white space is dropped. Letter classes and lower case are those of the installed Unicode tables;
code points assigned after Unicode 15.1 may differ from the tokenizer library's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import regex

# Fixed values of the vocabulary file: its split pattern, special tokens and mark of word ends.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
START, END = "<|startoftext|>", "<|endoftext|>"
WORD_END = "</w>"

_SPECIAL = regex.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
_WORD = regex.compile(PATTERN)
_SPACE = regex.compile(r"\s+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")  # white space to str.split, but not to the pattern


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    # Lower case is taken letter by letter: no final form of sigma.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _visible(text: str) -> list[str]:
    return [r for r in _SPACE.split(text) if r] if _SEPARATORS.search(text) else text.split()


def visible_runs(text: str) -> list[str]:
    """The normalized runs between white space; a special token is a run of its own, with a blank before it.

    No word crosses a run, so a run's words do not depend on what stands around it.
    """
    if "<|" not in text:
        return _visible(_normal(text))
    out: list[str] = []
    for part in _SPECIAL.split(text):
        if part in (START, END):
            out.append(f" {part}")
        elif part:
            out += _visible(_normal(part))
    return out


def words_of(run: str) -> list[str]:
    """The words of a run."""
    if run.isalpha():
        return [run]
    if run[-1] in ".,;:!?" and run[:-1].isalpha():
        return [run[:-1], run[-1]]
    return [run[1:]] if run[0] == " " else _WORD.findall(run)


def split_words(text: str) -> list[str]:
    """The words of a text in order; a special token is one word. An empty text has none."""
    return [w for run in visible_runs(text) for w in words_of(run)]


class Memory:
    """Values of frequent keys, in two generations of about `limit` keys each; only speed depends on it."""

    def __init__(self, limit: int):
        self.limit = limit
        self.now: dict = {}
        self.before: dict = {}

    def __getstate__(self) -> dict:
        return {"limit": self.limit, "now": {}, "before": {}}

    def of(self, lines: list[list], make: Callable[[list], list]) -> list[list]:
        """The values of the keys of each line; `make` gives the values of keys that are not remembered."""
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}
        out = [list(map(self.now.get, keys)) for keys in lines]
        gaps = [[i for i, value in enumerate(values) if value is None] for values in out]
        missing = {keys[i] for keys, places in zip(lines, gaps) for i in places}
        known = {k: self.before[k] for k in missing & self.before.keys()}
        new = list(missing - known.keys())
        known.update(zip(new, make(new)))
        self.now |= known
        for keys, values, places in zip(lines, out, gaps):
            for i in places:
                values[i] = known[keys[i]]
        return out
