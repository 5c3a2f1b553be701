"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; keys are compared by
two independent 64-bit hashes (h, g). Line counts are shuffled once, into buckets by h. Each batch of
documents becomes a run of (h, g, n_docs), a table bucketed and sorted by h: before it is added, it is
merge-anti-joined with what the runs have already settled (keys in min_docs documents), then what is
left becomes a run of level 0. As soon as a level holds `fanout` runs they are merged into one run of
the next level, so that a table of n batches keeps about log(n) runs. Runs share their buckets, so
anti-joins and merges are merge joins bucket by bucket, without a shuffle.

Documents are rows: a repeated row is a further document, whatever its id. Null and empty texts have one
empty line. Lines with fewer than min_points code points are never dropped. A text of any length is
scanned in pieces. Texts come back whole but for the dropped lines; a null text stays null. All columns
of the input come through, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwright.llm.common import discard, fresh, map_batches, materialize, small_batches, trim
from bagwright.llm.textscan import BREAK, LOWER, SPACE, Hasher, chunks

#: Settled keys are broadcast up to this many (16 bytes each); beyond it they are joined.
BROADCAST_KEYS = 1 << 20
#: Counts a task holds before it passes them on.
HELD = 1 << 20
#: Bytes of input for each bucket of the runs.
BUCKET_BYTES = 64 << 20
N_LINES, N_DROPPED = "_n_lines", "_n_dropped"
_U = np.uint64


class Lines(NamedTuple):
    """The lines of a chunk: rows lo to hi, its bytes, the number of the first row's first line, and of each line ...

    start, end, the key's two hashes and whether the key has enough code points; `at`: each row's first line.
    """

    lo: int
    hi: int
    data: np.ndarray
    number: int
    starts: np.ndarray
    ends: np.ndarray
    h: np.ndarray
    g: np.ndarray
    ok: np.ndarray
    at: np.ndarray


def scan(column: pa.Array, min_points: int = 1) -> Iterator[Lines]:
    """The lines of a text column, chunk by chunk; a long text comes in pieces that end after a line feed."""
    held, number = None, 0
    for chunk in itertools.chain(chunks(column, border=BREAK), [None]):
        if held is not None:
            goes_on = chunk is not None and chunk[0] == held[0]
            out = _lines(*held, number, min_points, goes_on)
            yield out
            number = number + len(out.starts) if goes_on else 0
        held = chunk


def _lines(lo: int, hi: int, offs: np.ndarray, data: np.ndarray, number: int, min_points: int, goes_on: bool) -> Lines:
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    # A line that begins where the next text does belongs to the text before it: it is that one's empty last line.
    at = np.arange(len(offs)) + np.searchsorted(breaks, offs)
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[at[1:] - 1] = offs[1:]
    if goes_on:  # the line after a piece's last line feed is the next piece's first
        starts, ends, at = starts[:-1], ends[:-1], at - [0, 1]
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = b > a
    s, e = starts.copy(), starts.copy()
    s[full], e[full] = solid[a[full]], solid[b[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    hashes = Hasher(LOWER[data])
    return Lines(lo, hi, data, number, starts, ends, hashes(s, e), hashes(s, e, 1), points[e] - points[s] >= min_points, at)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of (rows, 3) keys, and the sums of their counts."""
    order = np.lexsort(keys.T[::-1])
    keys, n = keys[order], n[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def batch_counts(df: DataFrame, batch: str, text: str, min_points: int, buckets: int) -> DataFrame:
    """(batch, h, g, n_docs): in how many documents of a batch each key occurs; partitioned by h."""
    spark = df.sparkSession
    small_batches(spark)

    def passed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in (1, 2)), pa.array(n)], names=["batch", "h", "g", "n_docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for rows in batches:
            no = rows.column(0).to_numpy(zero_copy_only=False).astype(_U)
            found = []
            for x in scan(rows.column(1), min_points):
                doc = np.repeat(np.arange(x.lo, x.hi), np.diff(x.at))[x.ok]
                found.append(_summed(np.stack([doc.astype(_U), x.h[x.ok], x.g[x.ok]], 1), np.ones(len(doc), np.int64))[0])
            keys, _ = _summed(np.concatenate(found or [np.zeros((0, 3), _U)]), np.zeros(sum(map(len, found)), np.int64))
            keys[:, 0] = no[keys[:, 0].astype(np.int64)]
            held.append(_summed(keys, np.ones(len(keys), np.int64)))
            size += len(held[-1][1])
            if size > HELD:
                keys, n = _summed(*(np.concatenate(p) for p in zip(*held, strict=True)))
                held, size = [(keys, n)], len(n)
                if size > HELD // 2:
                    yield passed(keys, n)
                    held, size = [], 0
        if held:
            yield passed(*_summed(*(np.concatenate(p) for p in zip(*held, strict=True))))
        trim()

    src = df.select(F.col(batch).cast("int").alias("batch"), F.col(text).cast("string").alias("text"))
    sent = src.mapInArrow(run, "batch int, h long, g long, n_docs long").repartition(buckets, "h")
    return sent.groupBy("batch", "h", "g").agg(F.sum("n_docs").alias("n_docs"))


def bucket_count(df: DataFrame) -> int:
    """Buckets in proportion to the size of df's input; spark.sql.shuffle.partitions where that is not known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 62:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(-(-size // BUCKET_BYTES), 8), 1 << 16)


class LineRuns:
    """Sorted runs of (h, g, n_docs) by level, as bucketed tables of the warehouse."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int = 8):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets
        self.levels: list[list[str]] = []
        self.tables: set[str] = set()

    def write(self, df: DataFrame) -> str:
        """Writes a table that is bucketed and sorted by h; df is partitioned so already, else each task writes to all buckets."""
        name = f"bagwright_run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.tables.add(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.tables.discard(name)

    def close(self) -> None:
        self.drop(*self.tables)

    def _settled(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("n_docs") >= self.min_docs)

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's (h, g, n_docs), keys unique."""
        for name in [n for level in self.levels for n in level]:
            run = self._settled(self.spark.table(name)).select(F.col("h").alias("h2"), F.col("g").alias("g2"))
            counts = counts.join(run.hint("merge"), _same(), "left_anti")
        name, level = self.write(counts.select("h", "g", "n_docs")), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            name = self._merged(self.levels[level])
            self.levels[level] = []
            level += 1

    def _merged(self, names: list[str]) -> str:
        """The one table that sorted runs merge into, two at a time; the runs go."""
        name = names[0]
        for other in names[1:]:
            run = self.spark.table(other).select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("n_docs").alias("n2"))
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))
            both = self.spark.table(name).join(run.hint("merge"), _same(), "full")
            merged = self.write(both.select(F.coalesce("h", "h2").alias("h"), F.coalesce("g", "g2").alias("g"), n.alias("n_docs")))
            self.drop(name, other)
            name = merged
        return name

    def settled(self) -> DataFrame:
        """(h, g): keys in min_docs documents or more. Compacts all runs into one."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "h long, g long")
        one = self._merged(names)
        self.levels = [*([] for _ in self.levels[:-1]), [one]]
        return self._settled(self.spark.table(one)).select("h", "g")


def _same():
    """Equal keys, joined by h alone, which runs are bucketed by; g is tested beside it."""
    return (F.col("h") == F.col("h2")) & F.col("g").between(F.col("g2"), F.col("g2"))


def _strip(column: pa.Array, drops: Callable[[Lines], np.ndarray], min_points: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without dropped lines, numbers of lines and of dropped ones. drops: which lines of a chunk go."""
    n_lines, n_dropped = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    new: dict[int, list[bytes]] = {}
    for x in scan(column, min_points):
        gone = drops(x) & x.ok
        n_lines[x.lo : x.hi] += np.diff(x.at)
        here = np.add.reduceat(gone, x.at[:-1], dtype=np.int64) if len(gone) else np.zeros(x.hi - x.lo, np.int64)
        n_dropped[x.lo : x.hi] += here
        long = x.hi - x.lo == 1  # maybe a piece: lines may go from a later one
        for d in range(1) if long else np.flatnonzero(here).tolist():
            kept = np.flatnonzero(~gone[x.at[d] : x.at[d + 1]]) + x.at[d]
            if len(kept) == x.at[d + 1] - x.at[d] and len(kept):
                part = x.data[x.starts[kept[0]] : x.ends[kept[-1]]].tobytes()
            else:
                raw = memoryview(x.data)
                part = b"\n".join(raw[a:b] for a, b in zip(x.starts[kept].tolist(), x.ends[kept].tolist(), strict=True))
            new.setdefault(x.lo + d, []).extend([part] if len(kept) else [])
    rows = sorted(i for i in new if n_dropped[i])
    if rows:
        mask = np.zeros(len(column), bool)
        mask[rows] = True
        column = pc.replace_with_mask(column, pa.array(mask), pa.array([b"\n".join(new.pop(i)) for i in rows], pa.binary()).cast(column.type))
    return column, n_lines, n_dropped


def drop_lines(df: DataFrame, settled: DataFrame, text_col: str = "text", min_points: int = 1, most: int = BROADCAST_KEYS) -> DataFrame:
    """df with its texts stripped of lines whose key is settled, and two more columns, of its lines and its dropped ones.

    These are _n_lines and _n_dropped, with more underscores where df has such names. settled is read at
    once (and removed, if it is a scratch table); where its keys are too many to broadcast they are joined,
    each text's dropped lines by its digest.
    """
    spark, names = df.sparkSession, df.columns
    counts = [fresh(N_LINES, names), fresh(N_DROPPED, names)]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    i = names.index(text_col)

    def put(columns: list[pa.Array], stripped: tuple) -> pa.RecordBatch:
        columns[i] = stripped[0]
        return pa.RecordBatch.from_arrays([*columns, pa.array(stripped[1]), pa.array(stripped[2])], names=[f.name for f in schema])

    table = settled.limit(most + 1).toArrow()
    if len(table) <= most:
        h, g = (table[c].to_numpy().astype(np.int64).view(_U) for c in ("h", "g"))
        discard(settled)
        order = np.lexsort((g, h))
        shared = spark.sparkContext.broadcast((h[order], g[order]))

        def make():
            h, g = shared.value
            twins = int(np.bincount(np.searchsorted(h, h)).max()) if len(h) else 0  # keys that share h

            def drops(x: Lines) -> np.ndarray:
                out, at = np.zeros(len(x.h), bool), np.searchsorted(h, x.h)
                for k in range(twins):
                    here = np.minimum(at + k, len(h) - 1)
                    out |= (h[here] == x.h) & (g[here] == x.g)
                return out

            return lambda batch: put(batch.columns, _strip(batch.column(i), drops, min_points))

        return map_batches(df, make, schema)

    settled = settled if "_scratch" in vars(settled) else materialize(settled, "lines-settled")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)

    def make_lines():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(np.repeat(np.arange(x.lo, x.hi), np.diff(x.at))[x.ok], (x.number + np.arange(len(x.h)) - np.repeat(x.at[:-1], np.diff(x.at)))[x.ok], x.h[x.ok], x.g[x.ok]) for x in scan(batch.column(1), min_points)]
            row, place, h, g = (np.concatenate(p) for p in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(row)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=["t", "place", "h", "g"])

        return f

    lines = map_batches(df.select(digest.alias("t"), F.col(text_col).cast("string").alias("text")), make_lines, "t string, place int, h long, g long")
    gone = lines.join(settled, ["h", "g"], "left_semi").groupBy("t").agg(F.collect_set("place").alias("gone"))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), digest.alias("d"))
    keyed = whole.join(gone, F.col("d") == F.col("t"), "left").select("row", "gone")

    def make_strip():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists, columns = batch.column(1), batch.column(0).flatten()

            def drops(x: Lines) -> np.ndarray:
                out = np.zeros(len(x.h), bool)
                for d in range(x.hi - x.lo):
                    if lists[x.lo + d].is_valid:
                        places = lists[x.lo + d].values.to_numpy() - x.number
                        out[x.at[d] + places[(places >= 0) & (places < x.at[d + 1] - x.at[d])]] = True
                return out

            return put(columns, _strip(columns[i], drops, min_points))

        return f

    return map_batches(keyed, make_strip, schema)


def dedup_lines(df: DataFrame, min_docs: int = 10, min_points: int = 1, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drops from every document the lines whose key occurs in min_docs documents or more."""
    spark, buckets = df.sparkSession, bucket_count(df)
    dealt = df.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).alias("batch"), F.col(text_col).alias("text"))
    runs = LineRuns(spark, min_docs, fanout, buckets)
    try:
        counts = runs.write(batch_counts(dealt, "batch", "text", min_points, buckets))
        for k in range(batches):
            runs.add(spark.table(counts).filter(F.col("batch") == k).select("h", "g", "n_docs"))
        settled = materialize(runs.settled(), "lines-settled")
    finally:
        runs.close()
    return drop_lines(df, settled, text_col, min_points)
