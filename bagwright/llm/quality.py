"""Quality by a generalised additive model with pairwise interactions.

Numeric features of a text are cut into bins. Cyclic boosting visits them in turn, fitting a shallow
tree over one feature's bins to the loss's gradient each time; the trees of a feature add up to one
lookup table. Then the pairs with the greatest remaining gain get tables over coarse bins, fitted by
trees of one cut each way. A score is the sigmoid of sums of table entries.

Fitted on at most 2 * SAMPLE labelled rows; see labelled.py. Null and empty texts have all-zero
features and a score of their own; every row, repeated or not, is scored from its whole text, a very long
one piece by piece; extra columns are ignored. Without labels of both classes all scores are the class
that there is, 0 without labels.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwright.llm.common import map_batches, small_reads
from bagwright.llm.labelled import sample
from bagwright.llm.textscan import LOWER, SPACE, Distinct, chunks, span_hashes, spans

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 8000
#: Bytes of their features that reach the driver, at most (a row has about 120).
SAMPLE_BYTES = 16 << 20
BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE = 48, 8, 150, 6, 40, 0.1, 5.0


def _class(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


#: The classes of bytes whose shares are features.
CLASSES = {
    "symbols": _class("#$%&*@^~=+<>\\_"),
    "bang": _class("!"),
    "pipe": _class("|"),
    "stop": _class(".,;:?"),
    "digit": _class("0123456789"),
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _class("abcdefghijklmnopqrstuvwxyz"),
    "bracket": _class("(){}[]/\"'"),
    "break": _class("\n"),
}
KINDS = CLASSES | {"wide": np.arange(256) >= 128}
NAMES = ["words", "length", *KINDS, "distinct", "longest", "lines"]


def features(column: pa.Array) -> np.ndarray:
    """(texts, features) of a text column."""
    n = len(column)
    words, length, longest, distinct, size = (np.zeros(n) for _ in range(5))
    counts = np.zeros((len(KINDS), n))
    row, seen = -1, Distinct()
    for lo, hi, offs, data in chunks(column):
        starts, ends, at = spans(~SPACE[data], offs)
        text, long = np.repeat(np.arange(lo, hi), np.diff(at)), ends - starts
        words[lo:hi] += np.diff(at)
        size[lo:hi] += np.diff(offs)
        length += np.bincount(text, long, n)
        np.maximum.at(longest, text, long)
        for k, kind in enumerate(KINDS.values()):
            total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
            counts[k, lo:hi] += total[offs[1:]] - total[offs[:-1]]
        h = span_hashes(LOWER[data], starts, ends)
        if hi - lo == 1:  # maybe a piece of a long text
            row, seen = (lo, Distinct()) if lo != row else (row, seen)
            seen.add(h)
            distinct[lo] = len(seen.values()) if int(size[lo]) == _bytes(column, lo) else 0
            continue
        order = np.lexsort((h, text))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
        distinct += np.bincount(text[order], new, n)
    some, bytes_ = np.maximum(words, 1), np.maximum(size, 1)
    lines = 1 + counts[list(KINDS).index("break")]
    grid = np.stack([np.log1p(words), length / some, *(counts / bytes_), distinct / some**0.9, np.log1p(longest), np.log1p(bytes_ / lines)], 1)
    grid[size == 0] = 0
    return grid


def _bytes(column: pa.Array, row: int) -> int:
    return pc.binary_length(column[row]).as_py() or 0


def _leaf(g, h):
    return -g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain, and the bin before which to cut."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    i = int(gain.argmax())
    return float(gain[i]), i + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a tree over ordered bins."""
    gain, at = _cut(g, h)
    if depth == 0 or gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts a grid once each way."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(s):
        return s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1]

    gs, hs = quarters(a), quarters(b)
    gain = sum(_gain(x, y) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for k, part in enumerate((np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])):
        out[part] = _leaf(gs[k][i, j], hs[k][i, j])
    return float(gain[i, j] - _gain(g.sum(), h.sum())), out


class Additive:
    """edges of the bins, tables by feature, tables by pair of features, intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        q = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(f, q)) for f in x.T]
        self.coarse = [np.unique(np.quantile(f, np.linspace(0, 1, COARSE + 1)[1:-1])) for f in x.T]
        bins, rough = self._bins(x, self.edges), self._bins(x, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        share = float((weight * y).sum() / weight.sum())
        self.base = float(np.log(share / (1 - share)))
        total = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-total))
            return weight * (p - y), weight * p * (1 - p)

        for _ in range(ROUNDS):
            for k, table in enumerate(self.tables):
                g, h = slopes()
                tree = RATE * _tree(np.bincount(bins[k], g, len(table)), np.bincount(bins[k], h, len(table)))
                table += tree
                total += tree[bins[k]]
        g, h = slopes()
        shape = [len(e) + 1 for e in self.coarse]

        def grids(i, j, g, h):
            cell = rough[i] * shape[j] + rough[j]
            return [np.bincount(cell, v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h)]

        pairs = [(i, j) for i, j in itertools.combinations(range(x.shape[1]), 2) if min(shape[i], shape[j]) > 1]
        pairs.sort(key=lambda p: -_cross(*grids(*p, g, h))[0])
        self.pairs = {p: np.zeros((shape[p[0]], shape[p[1]])) for p in pairs[:PAIRS]}
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in self.pairs.items():
                tree = RATE * _cross(*grids(i, j, *slopes()))[1]
                table += tree
                total += tree[rough[i], rough[j]]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, f, "right") for e, f in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, rough = self._bins(x, self.edges), self._bins(x, self.coarse)
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for (i, j), table in self.pairs.items():
            total += table[rough[i], rough[j]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality") -> Additive | float:
    """The model; without labels of both classes the share of the one that there is, 0 without labels."""
    small_reads(docs.sparkSession)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = sample(docs, labels, usable, label_col, SAMPLE, lambda column: pa.array(list(features(column)), pa.list_(pa.float64())), "array<double>", SAMPLE_BYTES, files=cores)
    y = rows["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return float(y.max(initial=0))
    x = np.array(rows["x"].to_pylist())
    order = np.lexsort((*x.T, y))  # tasks end in any order; sums shall not depend on it
    return Additive(x[order], y[order].astype(float), rows["weight"].to_numpy()[order])


def score(docs: DataFrame, model: Additive | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    small_reads(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(features(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

        return f

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
