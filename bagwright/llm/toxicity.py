"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII bytes with A-Z lower-cased; features are the distinct
words, their beginnings of STEMS bytes (inflected forms share them), pairs of neighbours and pairs with
one word between, hashed to BUCKETS; those in fewer than SEEN texts of the sample are not learned. Each coordinate has its
own learning rate; the L1 penalty leaves few weights, which are broadcast (their number is bounded by
BUCKETS). The model is fitted on at most 2 * SAMPLE labelled rows with SAMPLE_BYTES of features; see
labelled.py.

Null and empty texts have no features and score the intercept's probability. Every row, repeated or
not, gets a score from its whole text, a very long one piece by piece; extra columns are ignored. Without
labels of both classes all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwright.llm.common import map_batches
from bagwright.llm.labelled import sample
from bagwright.llm.textscan import LOWER, Distinct, Hasher, chunks, mix, spans

BUCKETS = 1 << 22
#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 6000
#: Bytes of their features that reach the driver, at most; a text has 4 for each of its distinct buckets.
SAMPLE_BYTES = 128 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 8.0, 1.0, 4
STEMS, SEEN = (4, 5, 6, 7, 8), 3
_U = np.uint64

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each chunk of a text column its rows, buckets of its words, pairs and skip-pairs, and the row of each.

    A long text comes in pieces, of which the last two words go along to the next one's pairs.
    """
    row, carried = -1, np.zeros(0, _U)
    for lo, hi, offs, data in chunks(column, border=~_WORD):
        data = LOWER[data]
        starts, ends, at = spans(_WORD[data], offs)
        hashes = Hasher(data)
        h = hashes(starts, ends)
        text = np.repeat(np.arange(lo, hi), np.diff(at))
        found, where = [h], [text]
        for k in STEMS:
            long = ends - starts > k
            found.append(hashes(starts[long], starts[long] + k) ^ _U(k))
            where.append(text[long])
        if hi - lo == 1:
            carried = carried if lo == row else carried[:0]
            row, old = lo, len(carried)
            h = np.concatenate([carried, h])
            text, carried = np.full(len(h), lo), h[-2:]
        else:
            old = 0
        for gap in (1, 2):
            if len(h) > gap:
                same = (text[gap:] == text[:-gap]) & (np.arange(gap, len(h)) >= old)
                found.append(mix(h[:-gap] * _U(3) + mix(h[gap:] + _U(gap)))[same])
                where.append(text[gap:][same])
        yield lo, hi, (np.concatenate(found) >> _U(42)).astype(np.int32), np.concatenate(where)


def features(column: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of each text, sorted."""
    out = [Distinct() for _ in range(len(column))]
    for lo, hi, bucket, text in buckets(column):
        order = np.argsort(text, kind="stable")
        cut = np.searchsorted(text[order], np.arange(lo, hi + 1))
        bucket = bucket[order].astype(_U)
        for i in range(hi - lo):
            out[lo + i].add(bucket[cut[i] : cut[i + 1]])
    return [d.values().astype(np.int32) for d in out]


class Ftrl:
    """Per-coordinate FTRL-proximal; features are binary."""

    def __init__(self, size: int = BUCKETS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.last = size  # the intercept, not penalised

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.last, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, y: int, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Buckets with a weight, sorted; their weights; the intercept."""
        at = np.flatnonzero(np.abs(self.z[:-1]) > L1)
        return at.astype(np.int32), self.weights(at), float(self.weights(np.array([self.last]))[0])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float] | None:
    """Sparse weights; None without labelled rows of both classes."""

    def found(column: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in features(column)], pa.binary())

    rows = sample(docs, labels, usable, label_col, SAMPLE, found, "binary", SAMPLE_BYTES)
    y, weight, column = rows["y"].to_numpy(), rows["weight"].to_numpy(), rows["x"].combine_chunks()
    if len(set(y.tolist())) < 2:
        return None
    _, ends, data = column.cast(pa.large_binary()).buffers()
    flat = np.frombuffer(data or b"", np.int32)
    cut = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8) // 4
    frequent = np.bincount(flat, minlength=BUCKETS) >= SEEN
    texts = [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    texts = [np.append(t[frequent[t]], np.int32(BUCKETS)) for t in texts]
    # Tasks end in any order; the order in which rows are learned shall not depend on it.
    first = np.lexsort((y, [int(mix(t.astype(_U)).sum(dtype=_U)) >> 1 for t in texts]))
    weight = weight / weight.mean()
    model, order = Ftrl(), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in first[order.permutation(len(texts))].tolist():
            model.update(texts[i], int(y[i]), float(weight[i]))
    return model.sparse()


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        if model is not None:
            table = np.zeros(BUCKETS, np.float32)
            table[model[0]] = model[1]

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            total = np.zeros(batch.num_rows)
            found = [np.zeros(0, np.int64)]
            for _, _, bucket, text in buckets(batch.column(1)) if model is not None else ():
                on = np.flatnonzero(table[bucket])
                found.append(np.unique(text[on].astype(np.int64) * BUCKETS + bucket[on]))
            if model is not None:
                each = np.unique(np.concatenate(found))  # a bucket counts once, in whichever pieces it is
                total = np.bincount(each // BUCKETS, table[each % BUCKETS], batch.num_rows)
            out = np.zeros(len(total)) if model is None else 1 / (1 + np.exp(-np.clip(total + model[2], -35, 35)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

        return f

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
