"""BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the token sequences that BPE produces. It has one state per token ("the token just
read") and an arc p -t-> t where t may follow p. It starts with the atoms, all arcs allowed, and takes one merge gadget
per rule (a, b) -> c, in order of the rules:

- state c is added; its outgoing arcs are those that state b has now,
- the arc a -b-> b is removed,
- every state with an arc labelled a gets an arc labelled c.

Each gadget changes one state, one arc label and one arc, so the automaton is kept as these changes: `right` and `left`
(which state, which label was copied), `birth` (when) and `cut` (which arc was removed, when). `follows` reads an arc by
walking the copies back to the atoms; it costs table look-ups only and the tables grow with the rules, not with their
square. Every prefix of a word has exactly one accepted sequence, so encoding runs forward over the places of a word
and keeps one state per place; all words of a batch advance together.

Decoding emits the labels of the arcs, separated by a blank, which is what the vocabulary file's (absent) decoder does.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.batches import held, map_batches, share, slices, texts
from webloom.llm.words import WORD_END, Memory, visible_runs, words_of

REMEMBERED = 200_000  # runs of visible characters kept per generation with their ids; only speed depends on it


class Table:
    """Open-addressing map from non-negative 64-bit keys to 32-bit values, read for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            chosen, first = np.unique(slot[free], return_index=True)
            rows = left[free][first]
            self.keys[chosen], self.values[chosen] = keys[rows], values[rows]
            stay = self.keys[slot] != keys[left]
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        out = np.full(len(keys), -1, np.int32)
        slot, rows = self._slot(keys), None
        while len(keys):
            found = self.keys[slot]
            hit = found == keys
            if rows is None:
                out[hit] = self.values[slot[hit]]
            else:
                out[rows[hit]] = self.values[slot[hit]]
            on = np.flatnonzero(~hit & (found >= 0))
            rows = on if rows is None else rows[on]
            keys, slot = keys[on], (slot[on] + 1) & self.mask
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Automaton:
    """Compiled from the vocabulary (label to id) and the merge rules in order."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        size = max([*vocabulary.values(), *special.values(), 0]) + 1
        self.size, self.special = size, special
        self.labels = [""] * size
        for label, number in (vocabulary | special).items():
            self.labels[number] = label
        self.left, self.right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.birth = np.full(size, -1, np.int32)
        cut: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            first, second, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            cut.setdefault(first * size + second, rank)
            if self.birth[made] < 0:
                self.left[made], self.right[made], self.birth[made] = first, second, rank
        self.cut = Table(np.fromiter(cut, np.int64, len(cut)), np.fromiter(cut.values(), np.int32, len(cut)))
        self._trie(vocabulary, {letter: b for b, letter in enumerate(byte_letters())})

    def _trie(self, vocabulary: dict[str, int], letters: dict[str, int]) -> None:
        children: dict[int, int] = {}
        middle, last = [-1], [-1]
        for label, number in vocabulary.items():
            ends = label.endswith(WORD_END)
            node = 0
            for letter in label.removesuffix(WORD_END) if ends else label:
                key = node * 256 + letters[letter]
                if key not in children:
                    children[key] = len(middle)
                    middle.append(-1)
                    last.append(-1)
                node = children[key]
            (last if ends else middle)[node] = number
        self.children = Table(
            np.fromiter(children, np.int64, len(children)), np.fromiter(children.values(), np.int32, len(children))
        )
        self.middle, self.last = np.array(middle, np.int32), np.array(last, np.int32)

    def follows(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether the state has an arc with the label, for arrays of both."""
        out = np.zeros(len(state), bool)
        rows = np.arange(len(state))
        until = np.full(len(state), np.iinfo(np.int32).max, np.int32)  # changes of this rank and later don't count
        while len(rows):
            rank = self.cut.get(state.astype(np.int64) * self.size + label)
            intact = (rank < 0) | (rank >= until)
            born, named = self.birth[state], self.birth[label]
            atoms = intact & (born < 0) & (named < 0)
            out[rows[atoms]] = True
            on = intact & ~atoms
            rows, state, label, born, named = rows[on], state[on], label[on], born[on], named[on]
            copied = born > named
            # The state's arcs were copied before its gadget's removal, arc labels after it.
            until = np.where(copied, born, named + 1)
            state, label = np.where(copied, self.right[state], state), np.where(copied, label, self.left[label])
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (not empty); words are split already."""
        ordinary = [i for i, w in enumerate(words) if w not in self.special]
        out: list[list[int]] = [[self.special[w]] if w in self.special else [] for w in words]
        raw = [words[i].encode() for i in ordinary]
        if not raw:
            return out
        text = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.cumsum(lengths) - lengths
        place = np.arange(len(text)) - np.repeat(begin, lengths)
        ends_at = np.repeat(begin + lengths, lengths)
        # All labels that start at each place: (start, end, label).
        start = np.arange(len(text))
        node, spans = np.zeros(len(text), np.int32), []
        reach = start
        while len(start):
            node = self.children.get(node.astype(np.int64) * 256 + text[reach])
            on = node >= 0
            start, reach, node = start[on], reach[on] + 1, node[on]
            closing = reach == ends_at[start]
            label = np.where(closing, self.last[node], self.middle[node])
            good = label >= 0
            spans.append((start[good], reach[good], label[good]))
            on = ~closing
            start, reach, node = start[on], reach[on], node[on]
        start, reach, label = (np.concatenate(x) for x in zip(*spans))
        order = np.argsort(place[start], kind="stable")
        start, reach, label = start[order], reach[order], label[order]
        bounds = np.searchsorted(place[start], np.arange(int(lengths.max()) + 1))
        # state[e]: the state after the prefix that ends at e (e > begin of its word); came[e]: where its label starts.
        state, came = np.full(len(text) + 1, -1, np.int32), np.zeros(len(text) + 1, np.int64)
        for step in range(int(lengths.max())):
            s, e, t = (x[bounds[step] : bounds[step + 1]] for x in (start, reach, label))
            if step:
                before = state[s]
                known = before >= 0
                s, e, t = s[known], e[known], t[known]
                arc = self.follows(before[known], t)
                s, e, t = s[arc], e[arc], t[arc]
            state[e], came[e] = t, s
        at = begin + lengths
        found: list[list[int]] = [[] for _ in raw]
        rows = np.arange(len(raw))
        while len(rows):
            for row, number in zip(rows.tolist(), state[at].tolist()):
                found[row].append(number)
            at = came[at]
            on = at > begin[rows]
            rows, at = rows[on], at[on]
        for i, ids in zip(ordinary, found):
            out[i] = ids[::-1]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


def compile_file(path: str) -> Automaton:
    """The automaton of a tokenizers file with a BPE model and word ends."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    model = stored["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    return Automaton({k: v for k, v in model["vocab"].items() if k not in special}, merges, special)


class Encoder:
    """Ids and labels of texts. What a run between white space gives is remembered, over the tasks of a worker too."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.memory = automaton, Memory(REMEMBERED)

    def _encode(self, runs: list[str]) -> list[tuple[str, str]]:
        words = [words_of(r) for r in runs]
        distinct = list({w for some in words for w in some})
        ids_of = dict(zip(distinct, self.automaton.encode(distinct)))
        out = []
        for some in words:
            ids = [i for w in some for i in ids_of[w]]
            out.append((" ".join(map(str, ids)), self.automaton.decode(ids)))
        return out

    def run(self, documents: list[str]) -> Iterator[tuple[str, str]]:
        """Per text: decimal ids joined by one blank, and the decoded text."""
        for found in self.memory.of([visible_runs(t) for t in documents], self._encode):
            yield " ".join([f[0] for f in found]), " ".join([f[1] for f in found])


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again; digests of both.

    Returns id_col, n_tokens, ids_sha256 (decimal ids joined by one blank), decoded_sha256. Null and empty texts and
    texts of white space have 0 tokens and the digests of the empty string. Repeated rows are kept, other columns are
    ignored, an empty table gives an empty one. `tokenizer` is read on the driver; executors get the compiled tables,
    whose size is that of the vocabulary.
    """
    shared = share(docs.sparkSession, Encoder(compile_file(tokenizer)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = held(shared)
        for batch in batches:
            strings, keys = texts(batch), batch.column("id")
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for first, last in slices(strings):
                for ids, decoded in encoder.run(strings[first:last]):
                    out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                    out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            yield {"id": keys} | out

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    done = map_batches(rows, work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.withColumnRenamed("id", id_col)
