"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / w: u is uniform, from a digest of seed and doc_id (of the text where
there is no id), and w its quality weight. Sources share the words of all by their weights, a source at
most `cap` times its own words; what it cannot take is shared again by weight. A source's target is met by
whole epochs over all its documents first; the words still missing come from its documents in ascending
order of key, then of a digest of id and text, the last of them cut to fit. Rows that tie on both are
equal and so interchangeable: the first of them in their place in the table are taken.

No source is ordered in one task: the place at which a budget ends is found by running sums over coarse
classes of keys, then buckets of about BUCKET_ROWS rows within the one class, then digests within the one
bucket, then tasks and rows among equal ones, each sum pre-aggregated. Null and blank texts have no words;
a null source is a source, the last. A text of any length is counted in pieces. Extra columns are ignored,
or come through in mixed_rows(). An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwright.llm.common import discard, map_batches, materialize
from bagwright.llm.textscan import SPACE, chunks, spans

BUCKET_ROWS = 4096
#: Buckets of a coarse class.
COARSE = 4096
#: Plans of at most this many sources are broadcast.
BROADCAST_SOURCES = 100_000
#: The symbols that lower a document's quality weight, and that weight's least value.
SYMBOLS = "!#$%&*+/<=>@\\^_|~"
LEAST_WEIGHT = 0.25


def sizes_and_weights(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, keep: bool = False) -> DataFrame:
    """(doc_id, source, size, key, tie, no): words of the text, the sampling key, the digest that breaks ties and the row's number.

    With keep, all columns of df come first, as `row`. The result is a scratch table: numbers have to stay as they are.
    """
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    text_at = df.columns.index(text_col)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, marks, length = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, offs, data in chunks(pc.struct_field(batch.column(0), [text_at]) if keep else batch.column(batch.num_columns - 1)):
                _, _, at = spans(~SPACE[data], offs)
                size[lo:hi] += np.diff(at)
                total = np.concatenate([[0], np.cumsum(symbol[data], dtype=np.int64)])
                marks[lo:hi] += total[offs[1:]] - total[offs[:-1]]
                length[lo:hi] += np.diff(offs)
            weight = np.clip(1 - 4 * (marks / np.maximum(length, 1)), LEAST_WEIGHT, 1)
            n = batch.num_columns - (not keep)
            return pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(size), pa.array(weight)], names=[*batch.schema.names[:n], "size", "weight"])

        return f

    name, text = F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(str(seed)), F.coalesce(F.concat(F.lit("|"), name), F.concat(F.lit("~"), text))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    tie = F.substring(F.md5(F.concat(F.coalesce(name, F.lit("")), F.lit("|"), text).cast("binary")), 1, 16)
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if keep else []
    own = [] if keep else [F.col(text_col).alias("text")]
    src = df.select(*row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), u.alias("u"), tie.alias("tie"), *own)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in src.schema.fields if f.name not in ("text", "row"))
    schema = T.StructType([*(f for f in src.schema.fields if f.name == "row"), *T.StructType.fromDDL(kinds + "size long, weight double").fields])
    out = map_batches(src, make, schema).withColumn("key", -F.log("u") / F.col("weight")).withColumn("no", F.monotonically_increasing_id())
    return materialize(out.drop("u", "weight"), "mix-base")


def targets(base: DataFrame, weight: Column, cap: int) -> DataFrame:
    """(source, source_size, n, target): one row per source. weight: of the 0-based rank `rank` of a source by code point."""
    src = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    src = src.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("w", weight.cast("double"))
    src = src.withColumn("most", (cap * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("most") / F.col("w"), "rank")
    every = Window.partitionBy()
    src = src.withColumn("full_before", F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("w_rest", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("level", (F.sum("source_size").over(every).cast("double") - F.col("full_before")) / F.col("w_rest"))
    src = src.withColumn("full", F.col("most") / F.col("w") <= F.col("level"))
    # Sources fill up in this order, so the first that does not sets the level of all that do not.
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return src.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("w"))).select("source", "source_size", "n", "target")


def _upto(df: DataFrame, *by: str) -> DataFrame:
    """Of (s, rest, size, ...) the row of each source in which the running sum reaches `rest`, with the sum `before` it."""
    order = Window.partitionBy("s").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("upto", F.sum("size").over(order)).withColumn("before", F.col("upto") - F.col("size"))
    return df.filter((F.col("upto") >= F.col("rest")) & (F.col("before") < F.col("rest")))


def plan(base: DataFrame, weight: Column, cap: int = 3) -> DataFrame:
    """targets() with epochs, rest (words of the fractional pass) and the row that it ends in: cut (its key, tie and no) and cut_words (the words taken of it)."""
    src = materialize(targets(base, weight, cap), "mix-sources")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    src = src.withColumn("epochs", F.least(epochs, F.lit(cap)).cast("long"))
    src = src.withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    src = src.withColumn("rest", F.when(F.col("epochs") >= cap, F.lit(0)).otherwise(F.col("rest")).cast("long"))
    ranged = src.filter("rest > 0").select(F.col("source").alias("s"), "rest", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    keyed = base.filter("size > 0").select("source", "key", "tie", "no", "size").join(_small(ranged), F.col("source").eqNullSafe(F.col("s")))
    # Keys lie between those of weight 1 and of the least weight; the mean of both distributions leaves no bucket much above the mean.
    spread = 1 - (F.exp(-F.col("key")) + F.exp(-LEAST_WEIGHT * F.col("key"))) / 2
    bucket = F.least(F.floor(spread * F.col("buckets")), F.col("buckets") - 1)
    keyed = keyed.withColumn("bucket", bucket).withColumn("part", F.floor(F.col("bucket") / COARSE)).drop("source")

    def inside(df: DataFrame, edge: DataFrame, *by: str) -> DataFrame:
        """Rows of df in the classes that edge names, with what is still missing there."""
        edge = edge.select(F.col("s").alias("s2"), (F.col("rest") - F.col("before")).alias("rest2"), *[F.col(c).alias(f"{c}_2") for c in by])
        same = F.col("s").eqNullSafe(F.col("s2"))
        for c in by:
            same = same & (F.col(c) == F.col(f"{c}_2"))
        return df.join(_small(edge), same).drop("rest", "s2", *[f"{c}_2" for c in by]).withColumnRenamed("rest2", "rest")

    def summed(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy("s", "rest", *by).agg(F.sum("size").alias("size"))

    sums = materialize(summed(keyed, "part", "bucket"), "mix-sums")
    part = _upto(summed(sums, "part"), "part")
    bucket = materialize(_upto(inside(sums, part, "part"), "bucket"), "mix-bucket")
    found = materialize(inside(keyed, bucket, "bucket"), "mix-rows")
    rows = found.withColumn("task", F.shiftright("no", 33))
    equal = materialize(_upto(summed(rows, "key", "tie"), "key", "tie"), "mix-equal")
    twins = inside(rows, equal, "key", "tie")
    task = materialize(_upto(summed(twins, "task"), "task"), "mix-task")
    last = _upto(inside(twins, task, "task"), "no")
    at = last.select(F.col("s").alias("s3"), F.struct("key", "tie", "no").alias("cut"), (F.col("rest") - F.col("before")).alias("cut_words"))
    out = materialize(src.join(at, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3"), "mix-plan")
    discard(src, sums, bucket, found, equal, task)
    return out


def _small(df: DataFrame) -> DataFrame:
    """A table of one row per source: broadcast if it is small, else left to the join that the planner picks."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def take(base: DataFrame, planned: DataFrame) -> DataFrame:
    """base with source_size, target, epochs and taken: the words that the mix takes of a row, repeats counted."""
    p = planned.select(F.col("source").alias("s"), "source_size", "target", "epochs", "cut", "cut_words")
    out = base.join(_small(p), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    own = F.struct("key", "tie", "no")
    part = F.when((F.col("size") > 0) & (own < F.col("cut")), F.col("size")).when(own == F.col("cut"), F.col("cut_words")).otherwise(F.lit(0))
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("cut", "cut_words")


def cyclic(weights: tuple[float, ...] = (1, 2, 3)) -> Column:
    """Weights by a source's rank, repeating."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))


def mix_table(df: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) of each row."""
    base = sizes_and_weights(df, id_col, source_col, text_col, seed)
    return take(base, plan(base, cyclic(weights), cap)).select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


def mixed_rows(df: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42) -> DataFrame:
    """The mix itself: each row of df as often as it is taken, whole; the one in which a budget ends comes whole too.

    A row without words (null, empty or blank text) is never taken, in whole epochs neither: a mix is made of words.
    """
    base = sizes_and_weights(df, id_col, source_col, text_col, seed, keep=True)
    rows = take(base, plan(base, cyclic(weights), cap)).filter("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return rows.select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")
