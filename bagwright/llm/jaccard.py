"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are the hashes of its distinct k-word shingles; two link if their sets' Jaccard
similarity reaches percent. Equal sets are one node. Tokens are ordered by the class of their frequency,
then by hash. A set of n tokens shares at least ceil(percent * n) with any partner, so misses at most
n - ceil(percent * n) = p - 1 of its tokens. Its prefix is extended until

    (rare tokens) + sum over groups of frequent tokens of max(0, size - 1) >= p

and indexes rare tokens singly and frequent ones by pairs within their group. Two linking sets share a
rare token or a pair: were it otherwise, the set whose prefix ends first would miss p tokens of the
other. Groups are chosen so that pairs stay proportional to the prefix; as that depends on the size,
sets index their pairs for their size band and the next, where any partner has to meet them.

Frequencies come from one count sketch over all texts. Its cells grow with the texts, within what a task
can hold and the driver broadcast; beyond that bound only more frequent tokens count as such. Wrong counts change which tokens are indexed, never the result: classes are the
same for all sets, and every candidate is verified on the whole sets.

Buckets are not expanded into rows of pairs, and of buckets with the same members one stays. First each
node is verified against one pseudo-random member of its buckets, so that a hot group of near copies
collapses along a star. Buckets that still hold several components are then compared in blocks of BLOCK
members by parity bitmaps: each token flips one of about 2 n bits, so the distance of two bitmaps is at
most the sets' symmetric difference, and a pair that exceeds what percent allows cannot link. Of what
is left each node sends its nearest partner of another component, within its largest bucket, to
verification on whole sets, round after round; when few of these link, all pairs that the bitmaps leave
between components in any bucket are verified, each from the first bucket that its members share, so no
link between components is lost.

Null texts and texts without words have no tokens and link with nothing; each is its own component.
Rows with a null doc_id take part, but a component is named by its least id that is not null. Repeated
rows are equal sets. A text of any length is scanned in pieces. Extra columns are ignored. An empty table
gives an empty result. Tokens are 64-bit hashes; sets are named by such too, with a second one as a check:
should two sets ever share the first, all starts again with other hashes.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwright.llm.common import discard, map_batches, materialize, small_batches, trim
from bagwright.llm.components import components
from bagwright.llm.textscan import mix, sets

SLICES, BLOCK = 64, 4096
#: Cells of the sketch: one for each CELL_BYTES of text (about 16 tokens), from CELLS to MOST_CELLS; a task holds 2 bytes of each.
CELL_BYTES, CELLS, MOST_CELLS = 112, 1 << 22, 1 << 25
#: Of the buckets that a member is in, this many first ones come along, to tell where a pair has met before.
FIRST_SIGS = 24
#: A round by nearest partners is followed by another while at least this share of its pairs link.
WORTH = 0.5
#: Bits that tell which index entries occur twice; they only save shuffling, and save less as entries outnumber them.
ENTRY_BITS = 1 << 27
#: Representatives are broadcast up to this many (16 bytes each); beyond it they are joined.
BROADCAST_ROWS = 1 << 20
_U = np.uint64


def node_of(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Two hashes of a whole set, as signed integers, of its tokens' sum and exclusive or; others for each salt."""
    s = mix(s + _U(salt))
    total, crossed = int(s.sum(dtype=_U)) + len(s), int(np.bitwise_xor.reduce(mix(s ^ _U(0x5851F42D4C957F2D))))
    both = np.array([(total ^ crossed) & (1 << 64) - 1, (total + 3 * crossed) & (1 << 64) - 1], _U)
    return tuple(mix(both).view(np.int64).tolist())


def _gather(df: DataFrame, arrays, add) -> list[bytes]:
    """What tasks gather over df's batches in arrays of fixed size, added up slice by slice in two steps.

    arrays(batches) gives a task's arrays, add(old, new) adds new slices of them to old ones. Gives the
    slices of the last array, compressed; nothing without a task.
    """
    small_batches(df.sparkSession)
    kind = "slice int, task int, parts array<binary>"

    def pack(no: int, task: int, parts: list[np.ndarray]) -> dict:
        return {"slice": no, "task": task // 64, "parts": [zlib.compress(p.tobytes(), 1) for p in parts]}

    schema = pa.schema([("slice", pa.int32()), ("task", pa.int32()), ("parts", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = []

        def seen():
            for b in batches:
                task[:] = task or [b.column(b.num_columns - 1)[0].as_py()]
                yield b

        full = [a.reshape(SLICES, -1) for a in arrays(seen())]
        if task:
            yield pa.RecordBatch.from_pylist([pack(i, task[0], [a[i].astype(k, copy=False) for a, k in zip(full, arrays.kinds, strict=True)]) for i in range(SLICES)], schema)
        del full
        trim()

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        total = None
        for packed in rows["parts"]:
            parts = [np.frombuffer(zlib.decompress(p.as_py()), a) for p, a in zip(packed, arrays.kinds, strict=True)]
            total = [p.copy() for p in parts] if total is None else add(total, parts)
        return pa.Table.from_pylist([pack(key[0].as_py(), 0, total)], schema)

    sent = df.withColumn("_task", F.spark_partition_id()).mapInArrow(run, kind)
    rows = sent.groupBy("slice", "task").applyInArrow(merge, kind).groupBy("slice").applyInArrow(merge, kind).select("slice", F.element_at("parts", -1).alias("part")).collect()
    return [r["part"] for r in sorted(rows, key=lambda r: r["slice"])]


def cell_count(df: DataFrame, text_col: str = "text") -> int:
    """Cells of the sketch in proportion to the bytes of all texts, a power of two within bounds."""
    size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).collect()[0][0] or 0
    return min(max(CELLS, 1 << math.ceil(math.log2(max(size / CELL_BYTES, 1)))), MOST_CELLS)


def frequency_classes(df: DataFrame, k: int, text_col: str = "text", cells: int = CELLS) -> tuple[bytes, int]:
    """A class (8 log2 of the count, at most 255) for each cell of token hashes, compressed; and the first frequent class."""
    shift = 64 - int(cells).bit_length() + 1

    def arrays(batches):
        n = np.zeros(cells, np.uint16)
        for number, batch in enumerate(batches):
            held, size = [], 0
            for s in itertools.chain(sets(batch.column(0), k), [None]):
                if held and (s is None or size > 1 << 17):
                    np.add.at(n, np.concatenate(held) >> _U(shift), np.uint16(1))
                    held, size = [], 0
                if s is not None:
                    held.append(s)
                    size += len(s)
            if number % 8 == 7:  # a batch adds at most about ARROW_ROWS to a cell
                np.minimum(n, 50_000, out=n)
        return [n]

    def add(old, new):
        total = old[0].astype(np.uint64) + new[0]
        return [np.minimum(total, (1 << 32) - 1).astype(np.uint32)]

    arrays.kinds = (np.uint32,)
    found = _gather(df.select(F.col(text_col).cast("string").alias("text")), arrays, add)
    if not found:
        return zlib.compress(bytes(cells), 1), 256
    total, packed, packer = 0, [], zlib.compressobj(1)
    for part in found:
        counts = np.frombuffer(zlib.decompress(part), np.uint32)
        total += int(counts.sum(dtype=np.uint64))
        packed.append(packer.compress(np.minimum(np.floor(8 * np.log2(1 + counts.astype(np.float32))), 255).astype(np.uint8).tobytes()))
    mean = total / cells
    return b"".join([*packed, packer.flush()]), math.ceil(8 * math.log2(1 + max(16.0, mean + 6 * math.sqrt(mean) + 16)))


def _places(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = sigs.view(_U) & _U(ENTRY_BITS - 1)
    return (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8)


def repeated_entries(base: DataFrame) -> list[bytes]:
    """Slices of bits, compressed, of the index entries that occur more than once; others may share a bit with such."""

    def arrays(batches):
        once, twice = np.zeros(ENTRY_BITS // 8, np.uint8), np.zeros(ENTRY_BITS // 8, np.uint8)
        for batch in batches:
            byte, bit = _places(np.sort(batch.column(0).flatten().to_numpy()))
            again = once[byte] & bit
            np.bitwise_or.at(twice, byte, again)
            place = byte * 8 + np.bitwise_count(bit - np.uint8(1))
            values, first, n = np.unique(place, return_index=True, return_counts=True)
            np.bitwise_or.at(twice, byte[first[n > 1]], bit[first[n > 1]])
            np.bitwise_or.at(once, byte, bit)
        return [once, twice]

    def add(old, new):
        return [old[0] | new[0], old[1] | new[1] | (old[0] & new[0])]

    arrays.kinds = (np.uint8, np.uint8)
    return _gather(base.select("sigs"), arrays, add) or [zlib.compress(bytes(ENTRY_BITS // 8), 1)]


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each of 2^k >= 2 n bits."""
    size = max(64, 2 << (len(s) - 1).bit_length()) if len(s) else 64
    flips = np.bincount((s & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _fold(x: np.ndarray) -> np.ndarray:
    """Rows of bitmaps, halved."""
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:]


def _band(n: int, percent: int) -> int:
    return int(math.log(n) / math.log(100 / percent))


def _pairs(frequent: np.ndarray, need: int, band: int, percent: int) -> np.ndarray:
    """Hashes of the pairs that a band's index holds of a set's frequent tokens, of which `need` have to count."""
    groups = max(1, round((100 - percent) / 100 * (100 / percent) ** band / 2))
    group = mix(frequent + _U(band)) % _U(groups)
    _, first = np.unique(group, return_index=True)
    counts = np.ones(len(frequent), np.int64)
    counts[first] = 0
    enough = int(np.searchsorted(np.cumsum(counts), need)) + 1
    frequent, group = frequent[:enough], group[:enough]
    order = np.lexsort((frequent, group))
    frequent, group = frequent[order], group[order]
    out = [np.zeros(0, _U)]
    gap = 1
    while gap < len(frequent):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        out.append(mix(mix(frequent[:-gap][same] + _U(band)) + frequent[gap:][same]))
        gap += 1
    return np.concatenate(out)


def signatures(s: np.ndarray, classes: np.ndarray, shift: int, frequent_from: int, percent: int) -> np.ndarray:
    """What the index holds of a set."""
    n = len(s)
    if n * (100 - percent) < percent:  # only an equal set could link
        return np.zeros(0, _U)
    need = n + percent * -n // 100 + 1  # n - ceil(percent * n / 100) + 1
    of = classes[s >> _U(shift)]
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    rare = int(np.searchsorted(of, frequent_from))
    if rare >= need:
        return s[:need]
    band = _band(n, percent)
    return np.unique(np.concatenate([s[:rare], *(_pairs(s[rare:], need - rare, b, percent) for b in (band, band + 1))]))


def index(df: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, salt: int = 0) -> DataFrame:
    """(doc_id, t, n, node, check, bits, sigs) of each row; t is a hash of the text, node and check two of the set, null for an empty one."""
    packed, frequent_from = frequency_classes(df, k, text_col, cells)
    shared, shift = df.sparkSession.sparkContext.broadcast(packed), 64 - int(cells).bit_length() + 1

    def make():
        classes = np.frombuffer(zlib.decompress(shared.value), np.uint8)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, node, check, bits, sigs = [], [], [], [], []
            for s in sets(batch.column(2), k):
                n.append(len(s))
                names = node_of(s, salt) if len(s) else (None, None)
                node.append(names[0])
                check.append(names[1])
                bits.append(bitmap(s) if len(s) else None)
                sigs.append(signatures(s, classes, shift, frequent_from, percent).view(np.int64))
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(bits, pa.binary()), lists], names=["doc_id", "t", "n", "node", "check", "bits", "sigs"])

        return f

    src = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, make, f"doc_id {df.schema[id_col].dataType.simpleString()}, t long, n long, node long, check long, bits binary, sigs array<long>")


def _shared(base: DataFrame) -> DataFrame:
    """(sig, node): the buckets with more than one node; of those with equal members one."""
    shared = base.sparkSession.sparkContext.broadcast(repeated_entries(base))

    def make():
        twice = np.frombuffer(b"".join(map(zlib.decompress, shared.value)), np.uint8)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            sigs = lists.flatten().to_numpy()
            byte, bit = _places(sigs)
            on = (twice[byte] & bit) != 0
            of = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(sigs[on]), pa.array(of[on].astype(np.int64))], names=["sig", "node"])

        return f

    rows = map_batches(base.filter("size(sigs) > 0").select("node", "sigs"), make, "sig long, node long")
    ends = rows.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("sig")
    rows = materialize(rows.join(ends, "sig").distinct(), "jac-members")
    members = [F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    one = rows.groupBy("sig").agg(*members).groupBy("c", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    out = materialize(rows.join(one, "sig", "left_semi"), "jac-buckets")
    discard(rows)
    return out


def _few(df: DataFrame, size: int) -> DataFrame:
    """df, of so many narrow rows: broadcast up to BROADCAST_ROWS, else left to a shuffled join."""
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def _token_sets(df: DataFrame, base: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str, salt: int) -> DataFrame:
    """(node, tokens) of the wanted nodes, from one document each."""
    rep = base.select("node", "doc_id", "t").join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("r"))
    rep = materialize(rep.select(F.col("r.doc_id").alias("rd"), F.col("r.t").alias("rt")), "jac-reps")
    size = rep.count()
    src = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    src = src.join(_few(rep, size), (F.col("t") == F.col("rt")) & F.col("doc_id").eqNullSafe(F.col("rd")), "left_semi").select("text")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = list(sets(batch.column(0), k))
            return pa.RecordBatch.from_arrays([pa.array([node_of(s, salt)[0] if len(s) else None for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "tokens"])

        return f

    out = materialize(map_batches(src, make, "node long, tokens binary"), "jac-sets")
    discard(rep)
    if out.count() > size:  # rows that repeat an id and a text
        twice, out = out, materialize(out.dropDuplicates(["node"]), "jac-sets")
        discard(twice)
    return out


def _ends(pairs: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
    """Pairs (a, b) with each side's columns of facts, as name_a and name_b; only facts that are asked for are shuffled."""
    out, size = pairs, pairs.count()
    for side in ("a", "b"):
        asked = facts.join(_few(pairs.select(F.col(side).alias("node")).distinct(), size), "node", "left_semi")
        out = out.join(asked.select(F.col("node").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in names]), side)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return f

    return map_batches(_ends(pairs, sets, "tokens").select("a", "b", "tokens_a", "tokens_b"), make, "a long, b long")


def _passing(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and bitmaps leave."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            for i in np.flatnonzero(keep).tolist():
                x, y = (np.frombuffer(batch.column(j)[i].as_buffer(), _U)[None] for j in (4, 5))
                x, y = (x, y) if x.size <= y.size else (y, x)
                while y.size > x.size:
                    y = _fold(y)
                keep[i] = int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= int(sizes[0][i] + sizes[1][i]) * (100 - percent)
            return batch.select(["a", "b"]).filter(pa.array(keep))

        return f

    return map_batches(_ends(pairs, facts, "n", "bits").select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), make, "a long, b long")


def _compare(nodes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray, bits: list[np.ndarray], percent: int, first: list[set] | None, sig: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block that bitmaps leave between components: of each node the nearest one, or, with the
    first buckets of each, all that have no bucket before sig in common.

    sides: 0 and 1 for a pair of blocks, whose members meet only across; all -1 for one block alone.
    """
    width = np.array([len(b) for b in bits])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    near, best = np.full(len(nodes), -1), np.full(len(nodes), 1 << 60)
    maps = {w: np.stack([bits[i] for i in np.flatnonzero(width == w)]) for w in np.unique(width).tolist()}
    where = {w: np.flatnonzero(width == w) for w in maps}
    for w, x in maps.items():
        for v in (w, 2 * w):
            if v not in maps:
                continue
            y = maps[v] if v == w else _fold(maps[v])
            step = max(1, (1 << 20) // (len(y) * w))
            for lo in range(0, len(x), step):
                i, j = where[w][lo : lo + step], where[v]
                ok = (labels[i, None] != labels[j]) & (100 * np.minimum(sizes[i, None], sizes[j]) >= percent * np.maximum(sizes[i, None], sizes[j]))
                ok &= (sides[i, None] < 0) | (sides[i, None] != sides[j])
                if not ok.any():
                    continue
                apart = np.bitwise_count(x[lo : lo + step, None] ^ y[None]).sum(2, dtype=np.int64)
                ok &= apart * (100 + percent) <= (sizes[i, None] + sizes[j]) * (100 - percent)
                r, c = np.nonzero(ok)
                if first is not None:
                    r, c = i[r], j[c]
                    if v == w:  # each pair has come both ways
                        r, c = r[r < c], c[r < c]
                    new = np.array([not any(o < sig for o in first[p] & first[q]) for p, q in zip(r.tolist(), c.tolist(), strict=True)], bool)
                    left.append(r[new])
                    right.append(c[new])
                    continue
                apart = np.where(ok, apart, 1 << 60)
                for own, other, d in ((i, j, apart), (j, i, apart.T)):
                    at = d.argmin(1)
                    d = d[np.arange(len(own)), at]
                    closer = d < best[own]
                    best[own[closer]], near[own[closer]] = d[closer], other[at[closer]]
    if first is None:
        left.append(np.flatnonzero(near >= 0))
        right.append(near[near >= 0])
    a, b = nodes[np.concatenate(left)], nodes[np.concatenate(right)]
    return np.minimum(a, b), np.maximum(a, b)


class _Joiner:
    """The state of the rounds: labels of nodes that have linked, token sets fetched so far."""

    def __init__(self, df: DataFrame, base: DataFrame, buckets: DataFrame, k: int, percent: int, id_col: str, text_col: str, salt: int):
        self.base, self.buckets, self.percent = base, buckets, percent
        self.fetch = lambda wanted: _token_sets(df, base, wanted, k, id_col, text_col, salt)
        own = base.select("node", "n", "bits").join(buckets.select("node").distinct(), "node", "left_semi")
        self.facts = materialize(own.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "jac-facts")
        self.labels: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.used: list[DataFrame] = [self.facts, buckets]

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """A scratch table that close() removes."""
        self.used.append(materialize(df, tag))
        return self.used[-1]

    def close(self) -> None:
        """Removes scratch tables; labels stay."""
        discard(*self.used)

    def open_buckets(self) -> DataFrame:
        """(sig, node, label, members) of buckets that still hold several components."""
        rows = self.buckets.withColumn("label", F.col("node"))
        if self.labels is not None:
            rows = self.buckets.join(self.labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
        ends = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo < hi")
        return self.keep(rows.join(ends.select("sig", "members"), "sig"), "jac-open")

    def verify(self, pairs: DataFrame) -> float:
        """Verifies pairs (a, b) and merges what links; which share of them did."""
        pairs = self.keep(pairs, "jac-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = self.keep(wanted, "jac-wanted")
        if not wanted.isEmpty():
            new = self.fetch(wanted)
            self.used.append(new)
            self.sets = new if self.sets is None else self.sets.unionAll(new)
        if self.sets is None:
            return 0
        links = self.keep(_verified(pairs, self.sets, self.percent), "jac-links")
        share = links.count() / max(pairs.count(), 1)
        if not share:
            return 0
        self.labels = self.merged(links)
        return share

    def merged(self, links: DataFrame) -> DataFrame:
        """Labels after new links: components of the links between labels, each link read once over all rounds."""
        if self.labels is None:
            return components(links)
        old = self.labels.select("node", "label")
        ends = links
        for side in ("a", "b"):
            mine = old.select(F.col("node").alias("n"), F.col("label").alias(f"l{side}"))
            ends = ends.join(mine, F.col(side) == F.col("n"), "left").drop("n").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
        new = components(self.keep(ends.filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "jac-contracted"))
        alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(old, "node", "left_anti").select("node", F.col("node").alias("label"))
        led = new.select(F.col("node").alias("n"), F.col("label").alias("least"))
        out = old.unionAll(alone).join(led, F.col("label") == F.col("n"), "left").select("node", F.coalesce("least", "label").alias("label"))
        out = materialize(out, "jac-labels")
        discard(new, self.labels)
        return out

    def star_round(self) -> None:
        """Verifies each node against one pseudo-random member of its buckets."""
        hubs = self.buckets.groupBy("sig").agg(F.min_by("node", F.xxhash64("node", F.lit(5))).alias("hub"))
        met = self.buckets.join(hubs, "sig").filter("node <> hub").groupBy("node").agg(F.min_by("hub", F.xxhash64("hub", F.lit(5))).alias("hub"))
        pairs = self.keep(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "jac-star")
        self.verify(_passing(pairs, self.facts, self.percent))

    def block_pairs(self, rows: DataFrame, every: bool) -> DataFrame:
        """Pairs (a, b) from comparing the members of open buckets; see _compare()."""
        if not every:
            largest = rows.groupBy("node", "label").agg(F.max(F.struct("members", "sig")).alias("m")).select("node", "label", F.col("m.sig").alias("sig"))
            rows = self.keep(largest, "jac-largest")
            rows = rows.join(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "sig")
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
        if every:
            sigs = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, FIRST_SIGS).alias("first"))
            facts = self.facts.join(sigs, "node")
        else:
            facts = self.facts.withColumn("first", F.lit(None).cast("array<long>"))
        # A member meets its own block alone and each other block across.
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
        rows = rows.select("sig", low.alias("low"), high.alias("high"), side.alias("side"), "node", "label").join(facts, "node")
        rows = rows.select("sig", "low", "high", "side", "node", "label", "n", "bits", "first").repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")
        percent = self.percent
        small_batches(rows.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: pa.Table | None = None
            for batch in itertools.chain(batches, [None]):
                table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                if table is None or not len(table):
                    continue
                keys = [table[c].to_numpy() for c in ("sig", "low", "high")]
                new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
                cuts = [0, *new.tolist(), *([len(table)] if batch is None else [])]
                rest = table.slice(cuts[-1]) if batch is not None else None
                if len(cuts) < 2:
                    continue
                nodes, labels, sizes, sides = (table[c].to_numpy() for c in ("node", "label", "n", "side"))
                bits = [np.frombuffer(v.as_buffer(), _U) for v in table["bits"].slice(0, cuts[-1])]
                first = [set(v or ()) for v in table["first"].slice(0, cuts[-1]).to_pylist()] if every else None
                for lo, hi in itertools.pairwise(cuts):
                    a, b = _compare(nodes[lo:hi], sizes[lo:hi], labels[lo:hi], sides[lo:hi], bits[lo:hi], percent, first and first[lo:hi], int(keys[0][lo]))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            trim()

        return rows.mapInArrow(run, "a long, b long").distinct()

    def run(self) -> DataFrame | None:
        """Labels of all nodes that link."""
        if self.buckets.isEmpty():
            return None
        self.star_round()
        while True:
            rows = self.open_buckets()
            if rows.isEmpty():
                return self.labels
            if self.verify(self.block_pairs(rows, every=False)) < WORTH:
                break
        rows = self.open_buckets()
        self.verify(self.block_pairs(rows, every=True))
        return self.labels


def join(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """(doc_id, t, n_shingles, component_id) of each row; t is a hash of its text."""
    return groups(df, k, percent, id_col, text_col, cells).drop("first")


def groups(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None, salt: int = 0) -> DataFrame:
    """join() with `first`, the (no_id, doc_id, t) of the row that leads its group: null ids last; null for an empty set."""
    cells = cells or cell_count(df, text_col)
    base = materialize(index(df, k, percent, id_col, text_col, cells, salt), "jac-base")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    nodes = base.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(row).alias("first"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    nodes = materialize(nodes, "jac-nodes")
    if not nodes.filter("lo <> hi").isEmpty():  # two sets have one hash: take another
        return groups(df, k, percent, id_col, text_col, cells, salt + 1)
    joiner = _Joiner(df, base, _shared(base), k, percent, id_col, text_col, salt)
    labels = joiner.run()
    if labels is None:
        named = nodes.select("node", F.col("least").alias("component_id"), "first")
    else:
        led = nodes.join(labels, "node", "left").select("node", "least", "first", F.coalesce("label", "node").alias("label"))
        least = led.groupBy("label").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
        named = led.select("node", "label").join(least, "label").select("node", "component_id", "first")
    joiner.close()
    out = base.select("doc_id", "t", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    return out.select("doc_id", "t", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "first")
