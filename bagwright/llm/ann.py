"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors form one node that carries its k + 1 smallest ids (no query can need more of them). Nodes
are dealt by hash into shards, whose size grows with the root of their number. A shard's graph is built in
one task by insertion, members of high layers first: in each layer a new member searches those before it,
links to near ones that no kept neighbour is closer to, and they link back. A layer is stored as a flat
array of neighbours, DEGREE a node at most. Queries come in blocks, descend the layers of every shard's
graph with a beam of UPPER and sweep the lowest with one of BEAM; each layer is entered at all members
that the one above it gave, so that a group of near copies that links only itself does not hold a walk.
Shards' results are merged. Scores are recomputed in double precision from the original components.

Vectors that are null or empty, zero, or hold null or non-finite components take no part, nor do rows
without id. Vectors of different length never meet. Exactly repeated rows count once; vectors are told apart
by two 64-bit hashes. Ties go to the
smaller id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwright.llm.common import materialize
from bagwright.llm.textscan import mix

#: Rows of a shard: ROOT times the root of all, from SHARD up to MOST_ROWS and MOST_NUMBERS components; queries of a block.
SHARD, ROOT, MOST_ROWS, MOST_NUMBERS, BLOCK = 8192, 32, 1 << 16, 1 << 24, 2048
#: Tasks that build shards, at most.
MOST_TASKS = 20_000
#: Links a member chooses, candidates it chooses from, links it holds; beams of inserting and of searching.
LINKS, NEAR, DEGREE, BUILD, BEAM = 20, 40, 40, 48, 128
#: The beam in upper layers.
UPPER = 65
#: Members inserted at once at most, members opened in a step, members of the layer above that an insertion starts from, and the beam that finds them.
BATCH, EXPAND, ENTRIES, ENTER = 512, 8, 8, 16
#: Members that an insertion searches without a walk.
PLAIN = 1 << 15
_LAYERS = 1 / np.log(16)


def usable(col: Column) -> Column:
    """Whether a vector takes part. The search for NaN finds it, or is NULL where a component is."""
    least, most, inf = F.array_min(col), F.array_max(col), float("inf")
    solid = ~F.array_contains(col, F.lit(float("nan"))) & (least > -inf) & (most < inf)
    return F.coalesce(solid & ((least != 0) | (most != 0)), F.lit(False))


def _diverse(x: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Which of each row's candidates (nearest first, -1 beyond) it links to: those that no kept one is nearer to, LINKS at most."""
    keep = np.zeros(ids.shape, bool)
    for lo in range(0, len(ids), 256):
        near = x[ids[lo : lo + 256]]
        norm = (near * near).sum(2)
        apart = norm[:, :, None] + norm[:, None] - 2 * near @ near.transpose(0, 2, 1)
        kept, d = keep[lo : lo + 256], dist[lo : lo + 256]
        for j in range(ids.shape[1]):
            shadowed = (kept[:, :j] & (apart[:, j, :j] < d[:, j, None])).any(1)
            kept[:, j] = np.isfinite(d[:, j]) & ~shadowed & (kept.sum(1) < LINKS)
    return keep


def _merged(d: np.ndarray, size: int, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The `size` least of each row of d, in any order, and the same places of the others."""
    if d.shape[1] <= size:
        return d, *others
    at = np.argpartition(d, size - 1, axis=1)[:, :size]
    return tuple(np.take_along_axis(a, at, 1) for a in (d, *others))


def _sweep(q: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best members found from each query's starts (-1: none), nearest first (-1 beyond), and their squared distances.

    All queries go in step; each step opens the EXPAND nearest members of the beam that are not open yet.
    """
    m, beam = len(start), max(beam, start.shape[1])
    seen = np.zeros((m, len(x)), bool)
    ids = np.full((m, beam), -1, np.int32)
    dist = np.full(ids.shape, np.inf, np.float32)
    done = np.ones(ids.shape, bool)
    r, c = np.nonzero(start >= 0)
    seen[r, start[r, c]] = True
    ids[r, c], done[r, c] = start[r, c], False
    dist[r, c] = ((x[start[r, c]] - q[r]) ** 2).sum(1)
    live = np.arange(m)
    while len(live):
        open_dist = np.where(done[live], np.inf, dist[live])
        at = np.argpartition(open_dist, EXPAND - 1, axis=1)[:, :EXPAND] if beam > EXPAND else np.broadcast_to(np.arange(beam), open_dist.shape)
        some = np.isfinite(np.take_along_axis(open_dist, at, 1))
        more = some.any(1)
        live, at, some = live[more], at[more], some[more]
        if not len(live):
            break
        r, c = np.nonzero(some)
        done[live[r], at[r, c]] = True
        near = links[np.where(some, np.take_along_axis(ids[live], at, 1), 0)]
        near[~some] = -1
        near = np.sort(near.reshape(len(live), -1), axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # several opened members may link one
        fresh &= ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        to = near[r, c]
        seen[live[r], to] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = ((x[to] - q[live[r]]) ** 2).sum(1)
        d, near, fresh = _merged(d, beam, near, fresh)
        dist[live], ids[live], done[live] = _merged(np.concatenate([dist[live], d], 1), beam, np.concatenate([ids[live], near], 1), np.concatenate([done[live], ~fresh], 1))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def _insert(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(n, DEGREE) neighbours of one layer's members, -1 where there are fewer, nearest first.

    Members are inserted in their order, in batches that double up to BATCH: each searches those before it,
    meets its batch, links to the diverse ones of what it found, and they link back, the DEGREE nearest of
    them. Among up to PLAIN members the search is a plain one, which costs less there than a walk; beyond, it
    walks the graph from its own starts (places of earlier members; -1: the first member).
    """
    n = len(x)
    links, apart = np.full((n, DEGREE), -1, np.int32), np.full((n, DEGREE), np.inf, np.float32)
    lo = 1
    while lo < n:
        hi = min(n, lo + min(lo, BATCH))
        q = x[lo:hi]
        begin = np.where(start[lo:hi] < lo, start[lo:hi], -1)
        begin[(begin < 0).all(1), 0] = 0
        walks = lo > PLAIN
        seen = x[lo if walks else 0 : hi]  # a batch meets its mates, and a small graph, without a walk
        d = (q * q).sum(1)[:, None] + (seen * seen).sum(1) - 2 * q @ seen.T
        d[np.arange(hi - lo), np.arange(len(seen) - (hi - lo), len(seen))] = np.inf
        dist, ids = _merged(np.maximum(d, 0), NEAR, np.broadcast_to(np.arange(hi - len(seen), hi, dtype=np.int32), d.shape))
        if walks:
            found, far = _sweep(q, x[:lo], links[:lo], begin, BUILD)
            dist, ids = _merged(np.concatenate([dist, far], 1), NEAR, np.concatenate([ids, found], 1))
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        a, col = np.nonzero(_diverse(x, ids, dist))
        b, d = ids[a, col], dist[a, col]
        a = a.astype(np.int32) + np.int32(lo)
        # Links both ways, beside those that their members have.
        touched = np.unique(b[b < lo])
        r, c = np.nonzero(links[touched] >= 0)
        a, b, d = np.concatenate([a, b, touched[r]]), np.concatenate([b, a, links[touched[r], c]]), np.concatenate([d, d, apart[touched[r], c]])
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # both directions may have chosen a link; its copies tie and so adjoin
        a, b, d = a[new], b[new], d[new]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        fits = place < DEGREE
        links[a[fits], place[fits]], apart[a[fits], place[fits]] = b[fits], d[fits]
        lo = hi
    return links


class Graph:
    """vectors (n, dim) in double, ids as offsets and values, and of each layer its members and neighbours."""

    def __init__(self, vectors: np.ndarray, id_at: np.ndarray, ids: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.id_at, self.ids, self.layers = vectors, id_at, ids, layers
        self.scale = float(np.abs(vectors).max())
        self.small = (vectors / self.scale).astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, id_at: np.ndarray, ids: np.ndarray) -> Graph:
        small = (vectors / np.abs(vectors).max()).astype(np.float32)
        h = mix(ids[id_at[:-1]].astype(np.uint64) + np.uint64(11))
        u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        level = np.floor(-np.log(u + 1e-18) * _LAYERS).astype(int)
        layers: list[tuple[np.ndarray, np.ndarray]] = []
        for height in range(level.max(), -1, -1):
            members = np.flatnonzero(level >= height)
            # Members of higher layers come first, so that all others can start from those that they find there.
            order = members[np.lexsort((h[members], -level[members]))]
            start = np.full((len(order), ENTRIES), -1, np.int64)
            place = np.empty(len(vectors), np.int64)
            place[order] = np.arange(len(order))
            if layers and len(order) > PLAIN:
                fresh = np.flatnonzero(level[order] == height)
                for lo in range(0, len(fresh), BATCH):
                    at = fresh[lo : lo + BATCH]
                    found = cls._descend(small[order[at]], small, layers, ENTER)[:, :ENTRIES]
                    start[at] = np.where(found < 0, -1, place[found])
            links = _insert(small[order], start)
            # Stored by the order of nodes.
            links = np.where(links < 0, -1, np.searchsorted(members, order[links])).astype(np.int32)
            layers.insert(0, (members.astype(np.int32), links[np.argsort(order, kind="stable")]))
        return cls(vectors, id_at, ids, layers)

    @staticmethod
    def _descend(q: np.ndarray, small: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], beam: int) -> np.ndarray:
        """Nodes found nearest to each query in the lowest of these upper layers, entered from the highest; -1 beyond."""
        start = np.full((len(q), 1), layers[-1][0][0], np.int64)
        for members, links in reversed(layers):
            found, _ = _sweep(q, small[members], links, np.where(start < 0, -1, np.searchsorted(members, start)), beam)
            start = np.where(found < 0, -1, members[found])
        return start

    def to_bytes(self) -> bytes:
        parts = [np.array([len(self.vectors), self.vectors.shape[1], len(self.ids), len(self.layers), *(len(m) for m, _ in self.layers)], np.int64), self.vectors, self.id_at.astype(np.int64), self.ids.astype(np.int64)]
        for members, links in self.layers:
            parts += [members, links]
        return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, block: bytes) -> Graph:
        at = 0

        def read(kind, n):
            nonlocal at
            out = np.frombuffer(block, kind, n, at)
            at += out.nbytes
            return out

        n, dim, n_ids, height = read(np.int64, 4).tolist()
        sizes = read(np.int64, height).tolist()
        vectors, id_at, ids = read(np.float64, n * dim).reshape(n, dim), read(np.int64, n + 1), read(np.int64, n_ids)
        return cls(vectors, id_at, ids, [(read(np.int32, m), read(np.int32, m * DEGREE).reshape(m, DEGREE)) for m in sizes])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of each query's k nearest other ids in this graph."""
        out: list[tuple] = []
        for lo in range(0, len(queries), 256):
            exact, own = queries[lo : lo + 256], query_ids[lo : lo + 256]
            q = np.clip(exact / self.scale, -1e15, 1e15).astype(np.float32)
            members, links = self.layers[0]
            if len(self.layers) > 1:
                start = self._descend(q, self.small, self.layers[1:], UPPER)
            else:
                start = np.zeros((len(q), 1), np.int64)
            found, _ = _sweep(q, self.small, links, start, max(beam, k + 1))
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                score = np.sqrt(((self.vectors[nodes] - exact[i]) ** 2).sum(1))
                close = np.argsort(score, kind="stable")
                # Nodes that tie with the last one needed stay: their ids decide.
                close = close[score[close] <= score[close[min(k, len(close) - 1)]]]
                pairs = [(score[j], v) for j in close for v in self.ids[self.id_at[nodes[j]] : self.id_at[nodes[j] + 1]].tolist() if v != own[i] or score[j] > 0]
                out += [(own[i], v, s) for s, v in sorted(pairs)[:k]]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return np.array(a, np.int64), np.array(b, np.int64), np.array(c, np.float64)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, h, g) of the rows that take part, with two hashes that tell vectors apart (-0 is 0); components keep their width where they are floating."""
    kind = df.schema[vec_col].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    src = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(T.ArrayType(kind)).alias("vec"))
    return src.filter(usable(F.col("vec"))).withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(1), "vec")})


def _nodes(vectors: DataFrame, k: int) -> DataFrame:
    """(h, g, vec, dim, ids): each distinct vector with its k + 1 smallest ids. Vectors move once, one a task of those that are equal."""
    vecs = vectors.groupBy("h", "g").agg(F.first("vec").alias("vec"))
    ranked = vectors.select("h", "g", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).filter(F.col("r") <= k + 1)
    ids = ranked.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return vecs.join(ids, ["h", "g"]).withColumn("dim", F.size("vec"))


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows. is_query: of the column `id`."""
    nodes = materialize(_nodes(_vectors(df, id_col, vec_col), k), "ann-nodes")
    n = F.count(F.lit(1))
    most = F.lit(shard_rows) if shard_rows else F.greatest(F.lit(1024), F.least(F.greatest(F.lit(SHARD), ROOT * F.sqrt(n)), F.lit(MOST_ROWS), F.floor(F.lit(MOST_NUMBERS) / F.col("dim"))))
    shards = nodes.groupBy("dim").agg(F.ceil(n / most).cast("int").alias("shards"))
    tasks = min(2 * int(shards.agg(F.sum("shards")).collect()[0][0] or 1), MOST_TASKS)
    # Builds are dealt to tasks by number, as their input is small for the work that it makes.
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod("h", F.col("shards")).cast("int")).repartition(tasks, "dim", "shard")

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        lists = rows["ids"].combine_chunks()
        first = lists.flatten().to_numpy()[np.cumsum([0, *lists.value_lengths().to_pylist()])[:-1]]
        order = np.argsort(first, kind="stable")
        rows = rows.take(pa.array(order))
        lists = rows["ids"].combine_chunks()
        at = np.cumsum([0, *lists.value_lengths().to_pylist()])
        graph = Graph.build(_matrix(rows["vec"], dim), at, lists.flatten().to_numpy())
        return pa.table({"dim": [dim], "shard": pa.array([key[1].as_py()], pa.int32()), "graph": pa.array([graph.to_bytes()], pa.large_binary())}).cast(pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary())]))

    index = materialize(dealt.select("dim", "shard", "vec", "ids").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"), "ann-index")

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(is_query)
    asked = _vectors(picked, "id", "vec").dropDuplicates(["id", "h", "g"]).select("id", "vec")
    asked = asked.withColumn("dim", F.size("vec")).join(shards, "dim")
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")
    asked = asked.join(asked.groupBy("dim").agg(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = asked.groupBy("dim", "shards", "block").agg(F.collect_list(F.struct("id", "vec")).alias("asked"))
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")

    def find(key: tuple, rows: pa.Table) -> pa.Table:
        graph = Graph.from_bytes(rows["graph"][0].as_py())
        asked = rows["asked"].combine_chunks().flatten()
        ids = asked.field("id").to_numpy()
        vecs = asked.field("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), key[0].as_py())
        a, b, c = graph.search(ids, vecs, k)
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    found = index.join(packed, ["dim", "shard"]).repartition(tasks, "dim", "shard", "block").groupBy("dim", "shard", "block").applyInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
