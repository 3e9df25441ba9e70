"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all its bytes. A chunk's bytes are embedded, filters run over it,
each filter keeps its maximum, and a small dense layer turns the maxima into the chunk's evidence of low quality. The
document keeps the maximum over its chunks, and a logistic function gives one probability. Embedding, filters and
dense layers are learned together by gradient descent on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import held, map_batches, share, slices, texts
from webloom.session import written

CHUNK, STEP = 512, 384  # bytes of a chunk, and from one chunk to the next
WIDTH, HOP = 8, 2  # bytes under a filter, and from one place to the next
EMBEDDING, FILTERS, HIDDEN = 4, 48, 16
PLACES = (CHUNK - WIDTH) // HOP + 1
PAD = 0  # byte that fills up the last chunk
TRAIN_PER_CLASS = 2500  # labelled documents of each class that training uses (expected number)
TRAIN_CHUNKS = 12  # chunks of each of them, spread over the document; scoring takes all chunks
TRAIN_STEPS, TRAIN_DOCS, RATE = 900, 32, 0.004


@dataclass
class Network:
    embed: np.ndarray  # byte by EMBEDDING
    filters: np.ndarray  # WIDTH * EMBEDDING by FILTERS
    bias: np.ndarray
    dense: np.ndarray  # FILTERS + 1 by HIDDEN
    dense_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # one number

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]


def fresh(seed: int = 7) -> Network:
    r = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (r.standard_normal(shape) * scale).astype(np.float32)

    return Network(
        normal(256, EMBEDDING, scale=0.5),
        normal(WIDTH * EMBEDDING, FILTERS, scale=(1 / (WIDTH * EMBEDDING)) ** 0.5),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS + 1, HIDDEN, scale=(1 / FILTERS) ** 0.5),
        np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, scale=0.3),
        np.zeros(1, np.float32),
    )


def chunked(data: bytes) -> np.ndarray:
    """All chunks of a text, at least one, as rows of CHUNK bytes; the last one ends with the text."""
    whole = np.frombuffer(data, np.uint8)
    if len(data) <= CHUNK:
        return np.pad(whole, (0, CHUNK - len(data)), constant_values=PAD)[None]
    starts = np.append(np.arange(0, len(data) - CHUNK, STEP), len(data) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[starts]


def emptiness(chunks: np.ndarray) -> np.ndarray:
    """Share of padding in each chunk; an input of the dense layer beside the filters' maxima."""
    return (chunks == PAD).mean(axis=1, dtype=np.float32)[:, None]


def windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    """Embedded bytes under every place of a filter: chunk by place by WIDTH * EMBEDDING."""
    x = net.embed[chunks].reshape(len(chunks), CHUNK * EMBEDDING)
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBEDDING, axis=1)[:, :: HOP * EMBEDDING]


def maxima(net: Network, chunks: np.ndarray) -> np.ndarray:
    """Each filter's maximum over the places of each chunk, before bias and rectifier (which keep the order)."""
    flat = np.ascontiguousarray(windows(net, chunks)).reshape(-1, WIDTH * EMBEDDING)
    return (flat @ net.filters).reshape(len(chunks), PLACES, FILTERS).max(axis=1)


def evidence(net: Network, chunks: np.ndarray, batch: int = 64) -> np.ndarray:
    """Logit of low quality of each chunk."""
    out = np.empty(len(chunks), np.float32)
    for at in range(0, len(chunks), batch):
        part = chunks[at : at + batch]
        pooled = np.hstack((np.maximum(maxima(net, part) + net.bias, 0), emptiness(part)))
        hidden = np.maximum(pooled @ net.dense + net.dense_bias, 0)
        out[at : at + batch] = hidden @ net.out + net.out_bias[0]
    return out


def train(chunks: np.ndarray, starts: np.ndarray, low: np.ndarray, seed: int = 7) -> Network:
    """Learn from documents given as rows of `chunks`; document i has rows starts[i]:starts[i+1], low[i] is 1 for low
    quality. With one class only, or no documents, the network answers with that class's rate.
    """
    net, n = fresh(seed), len(low)
    if not n or low.min() == low.max():
        net.out[:] = 0
        net.out_bias[:] = 4 if n and low.min() else -4
        return net
    r = np.random.default_rng(seed)
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, TRAIN_STEPS + 1):
        docs = r.choice(n, TRAIN_DOCS)
        rows = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
        ends = np.cumsum([starts[d + 1] - starts[d] for d in docs])
        begin = ends - np.array([starts[d + 1] - starts[d] for d in docs])
        part = chunks[rows]
        view = np.ascontiguousarray(windows(net, part)).reshape(-1, WIDTH * EMBEDDING)
        scores = (view @ net.filters).reshape(len(part), PLACES, FILTERS)
        where = scores.argmax(axis=1)
        top = np.take_along_axis(scores, where[:, None, :], 1)[:, 0] + net.bias
        pooled = np.hstack((np.maximum(top, 0), emptiness(part)))
        before = pooled @ net.dense + net.dense_bias
        hidden = np.maximum(before, 0)
        logit = hidden @ net.out + net.out_bias[0]
        best = np.array([b + logit[b:e].argmax() for b, e in zip(begin, ends)])
        p = 1 / (1 + np.exp(-logit[best]))
        slope = ((p - low[docs]) / len(docs)).astype(np.float32)
        g_out, g_out_bias = hidden[best].T @ slope, slope.sum(keepdims=True)
        g_before = slope[:, None] * net.out * (before[best] > 0)
        g_dense, g_dense_bias = pooled[best].T @ g_before, g_before.sum(0)
        g_top = (g_before @ net.dense[:FILTERS].T) * (top[best] > 0)
        g_bias = g_top.sum(0)
        places = where[best]  # document by filter
        under = view.reshape(len(part), PLACES, -1)[best[:, None], places]  # document, filter, inputs
        g_filters = np.einsum("dfi,df->if", under, g_top)
        g_under = (g_top[:, :, None] * net.filters.T[None]).reshape(len(best), FILTERS, WIDTH, EMBEDDING)
        letters = part[best[:, None, None], places[:, :, None] * HOP + np.arange(WIDTH)]
        g_embed = np.zeros_like(net.embed)
        np.add.at(g_embed, letters.ravel(), g_under.reshape(-1, EMBEDDING))
        rate = RATE * min(1, step / 50) * (1 if step < 0.7 * TRAIN_STEPS else 0.25)
        grads = [g_embed, g_filters, g_bias, g_dense, g_dense_bias, g_out, g_out_bias]
        for a, g, m, v in zip(net.arrays(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def sampled(labels: DataFrame, most: int = TRAIN_PER_CLASS) -> DataFrame:
    """(id, low) of about `most` rows of each class: all, or those with the smallest hashes of their id."""
    counts = {r["low"]: r["n"] for r in labels.groupBy("low").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for kind, n in counts.items():
        keep = keep | ((F.col("low") == kind) & (share < most / n))
    return labels.filter(keep)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Network:
    """Learn from documents and their labels (1: good, 0: low; other and missing labels are left out, and of several
    labels for an id the lower counts).

    A sample of the labels, about TRAIN_PER_CLASS of each class, picks its documents by a join; executors cut them into
    chunks, and the driver gets TRAIN_CHUNKS chunks of each (2 * 2500 * 12 * 512 bytes) and trains there.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id"))
    picked = written(sampled(known.agg((F.min(label_col) == 0).cast("int").alias("low"))), "quality-labels")
    texts_of = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts_of.join(picked, "id").select("id", "text", "low")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            cut = []
            for text in texts(batch):
                all_chunks = chunked(text.encode())
                pick = np.unique(np.linspace(0, len(all_chunks) - 1, min(len(all_chunks), TRAIN_CHUNKS)).astype(int))
                cut.append(all_chunks[pick].tobytes())
            yield {"id": batch.column("id"), "low": batch.column("low"), "chunks": cut}

    found = map_batches(rows, work, "id long, low int, chunks binary").collect()
    found.sort(key=lambda r: (r["id"] is None, r["id"], r["chunks"]))
    lengths = [len(r["chunks"]) // CHUNK for r in found]
    chunks = np.frombuffer(b"".join(r["chunks"] for r in found), np.uint8).reshape(-1, CHUNK)
    starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return train(chunks, starts, np.array([r["low"] for r in found], np.float32))


def score_texts(net: Network, strings: list[str]) -> np.ndarray:
    """Probability of good quality of each text."""
    cut = [chunked(t.encode()) for t in strings]
    if not cut:
        return np.empty(0)
    starts = np.concatenate(([0], np.cumsum([len(c) for c in cut])[:-1]))
    logits = np.maximum.reduceat(evidence(net, np.concatenate(cut)), starts)
    return 1 / (1 + np.exp(np.clip(logits.astype(np.float64), -60, 60)))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1, higher: better) of every text, over all its bytes. Null texts are empty, an empty text
    is one chunk of padding. Repeated rows are kept; an empty table gives an empty one; equal texts get equal scores.
    """
    shared = share(docs.sparkSession, net)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        net = held(shared)
        for batch in batches:
            keys, strings = batch.column("id"), texts(batch)
            yield {"id": keys, "score": np.concatenate([score_texts(net, strings[at:to]) for at, to in slices(strings, most=64)] or [np.empty(0)])}

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, work, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores `least` or more, with all their columns."""
    shared = share(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = texts(batch, text_col)
            for at, to in slices(strings, most=64):
                yield batch.slice(at, to - at).filter(pa.array(score_texts(held(shared), strings[at:to]) >= least))

    return docs.mapInArrow(run, docs.schema)
