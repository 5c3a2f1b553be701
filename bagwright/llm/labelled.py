"""Bounded samples of rows for the classifiers, without ordering any class or language in one task.

`limits` bounds a sample by least hashes: positions of hashes in their range are counted in fine steps for
each key, and the steps that hold at most `most` distinct hashes make the sample. Rows of one hash are one.

`sample` joins labels to texts on doc_id; null ids join nothing and null labels are left out; labels that
repeat an id and a class count once, as do documents that repeat an id and a text. At most `most` ids of
each class and then at most `most` of their texts are taken, those of least hash, and of these, in that
order, as many as have features of at most `most_bytes` in all (one text at least). So rows and bytes that
reach the driver are bounded. A row's weight is its class's size over that of its sample, so scores keep
the classes' true shares.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwright.llm.common import discard, map_batches, materialize

#: Steps of hash positions in which a sample of `most` is expected, and those that are counted.
STEPS, COUNTED = 64, 90


def _step(h: Column, scale: Column) -> Column:
    return F.floor((h.cast("double") / float(1 << 64) + 0.5) * scale)


def limits(df: DataFrame, most: int) -> dict:
    """Of (key, h) for each key: its number of distinct hashes (about), the steps in h's range, and the first step beyond the sample.

    One row a key is collected, and COUNTED more.
    """
    n = {r["key"]: r["n"] for r in df.groupBy("key").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not n:
        return {}
    scale = _by_key(F.col("key"), {k: float(v) / most * STEPS for k, v in n.items()})
    steps = df.withColumn("step", _step(F.col("h"), scale)).filter(F.col("step") < COUNTED)
    counts: dict = {k: [0] * COUNTED for k in n}
    for r in steps.groupBy("key", "step").agg(F.count_distinct("h").alias("n")).collect():
        counts[r["key"]][int(r["step"])] = r["n"]
    return {k: (v, float(v) / most * STEPS, int(np.searchsorted(np.cumsum(counts[k]), most, "right"))) for k, v in n.items()}


def _by_key(key: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), key)


def within(key: Column, h: Column, found: dict) -> Column:
    """Whether a row is in the sample that limits() found; keys that it does not know are not."""
    if not found:
        return F.lit(False)
    step = _step(h, _by_key(key, {k: v[1] for k, v in found.items()}))
    return F.coalesce(step < _by_key(key, {k: v[2] for k, v in found.items()}), F.lit(False))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label_col: str,
    most: int,
    features: Callable[[pa.Array], pa.Array],
    kind: str,
    most_bytes: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
) -> pa.Table:
    """(y, weight, x) of the sampled rows; x of the SQL type `kind` is what `features` gives for a text column. usable: of labels.

    files: of the scratch table at most, for narrow features; else one for each partition of a shuffle.
    """
    known = labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("key"), F.xxhash64(id_col).alias("h"))
    ids = limits(known.select("key", "h"), most)
    chosen = known.filter(within(F.col("key"), F.col("h"), ids)).select("id", "key").distinct()  # at most 2 * most
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("id"))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(batch.column(2))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["key", "h", "x"])

        return f

    rows = map_batches(texts.select("key", F.xxhash64("id", "text").alias("h"), "text"), make, f"key int, h long, x {kind}")
    size = F.octet_length("x") if kind == "binary" else 8 * F.size("x")
    rows = rows.dropDuplicates(["key", "h"]).withColumn("size", size)
    rows = materialize(rows.coalesce(files) if files else rows, "labelled")
    taken = rows.filter(within(F.col("key"), F.col("h"), limits(rows.select("key", "h"), most)))
    sizes = taken.select("key", "h", "size").toPandas()  # at most 2 * most narrow rows
    last = {}
    for key, part in sizes.sort_values("h").groupby("key"):
        n = max(1, int(np.searchsorted(part["size"].cumsum().to_numpy(), most_bytes // 2, "right")))
        last[int(key)] = (int(part["h"].iloc[n - 1]), max(1.0, ids[int(key)][0] / n))
    if not last:
        out = taken.limit(0)
    else:
        out = taken.filter(F.col("h") <= _by_key(F.col("key"), {k: v[0] for k, v in last.items()}))
    weight = _by_key(F.col("key"), {k: v[1] for k, v in last.items()}) if last else F.lit(1.0)
    table = out.select(F.col("key").alias("y"), weight.alias("weight"), "x").toArrow()
    discard(rows)
    return table
