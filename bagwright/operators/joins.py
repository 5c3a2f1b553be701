"""Joins that Spark SQL lacks or that need care at scale; all others are DataFrame.join itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def right_semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of right with a partner in left."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of right without a partner in left."""
    return right.join(left, on, "left_anti")


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on IS NOT DISTINCT FROM; still a hash or sort-merge join."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return left.join(right, condition, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner", by: Callable[..., DataFrame] = DataFrame.join) -> DataFrame:
    """Equality on all shared names, which come first and once; no shared name makes it a cross join. by: DataFrame.join or few_keys."""
    shared = [c for c in left.columns if c in right.columns]
    return by(left, right, shared, how) if shared else left.crossJoin(right)


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    tie: str,
    how: str = "left",
    slices: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Each left row with `values` of the nearest right row at or before it, of rows at one time the greatest `tie`.

    Both sides are merged and read once in time order within `by`: one shuffle, and no pairs are made,
    however dense the right side is. The right side's columns come out under the names in `values`.
    slices, a rising function of time (such as its day), cuts a hot key: slices are ordered apart, and each
    takes over the last right row before it from a table of one row a slice.
    """
    if clash := set(values) & set(left.columns):
        raise ValueError(f"rename these first: {sorted(clash)}")
    row = F.struct(*[F.col(c) for c in left.columns])
    got = F.struct(*[F.col(c) for c in values])
    a = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_tie"), row.alias("_row"), F.lit(None).alias("_got"))
    b = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).alias("_row"), got.alias("_got"))
    both = a.unionByName(b)
    keys = [F.col(c) for c in by]
    if slices is not None:
        both = both.withColumn("_slice", slices(F.col("_at")))
        keys.append(F.col("_slice"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("_at").isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    out = both.withColumn("_seen", F.when(known, F.last("_got", ignorenulls=True).over(order))).filter("_side = 1")
    if slices is not None:
        last = b.withColumn("_slice", slices(F.col("_at"))).groupBy(*by, "_slice").agg(F.max_by("_got", F.struct("_at", "_tie")).alias("_last"))
        asked = a.withColumn("_slice", slices(F.col("_at"))).select(*by, "_slice").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))
        before = Window.partitionBy(*by).orderBy("_slice", "_asks").rowsBetween(Window.unboundedPreceding, -1)
        steps = last.withColumn("_asks", F.lit(1)).unionByName(asked.withColumn("_asks", F.lit(0)))
        carried = steps.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).filter("_asks = 0 AND _carried IS NOT NULL")
        carried = carried.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_slice").alias("_s"), "_carried")
        same = F.col("_slice") == F.col("_s")
        for i, c in enumerate(by):
            same = same & (F.col(c) == F.col(f"_k{i}"))
        out = out.join(carried, same, "left").withColumn("_seen", F.coalesce("_seen", F.when(known, F.col("_carried"))))
    if how == "inner":
        out = out.filter(F.col("_seen").isNotNull())
    return out.select("_row.*", *[F.col(f"_seen.{c}").alias(c) for c in values])


def apply_top(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], order: Sequence[Column], n: int, outer: bool = False) -> DataFrame:
    """CROSS or OUTER APPLY of `SELECT … FROM right WHERE right.b = left.a ORDER BY order LIMIT n`.

    The limit is taken once per key on the right side, before the join.
    """
    keys = [b for _, b in on]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = right.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    condition = F.lit(True)
    for a, b in on:
        condition = condition & (left[a] == top[b])
    return left.join(top, condition, "left" if outer else "inner")


def key_histogram(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(key, left_n, right_n, pairs) of an equi-join, without making its pairs. Null keys match nothing."""
    a = left.filter(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("key")).agg(F.count(F.lit(1)).alias("left_n"))
    b = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("key")).agg(F.count(F.lit(1)).alias("right_n"))
    return a.join(b, "key").withColumn("pairs", F.col("left_n") * F.col("right_n"))


def salted(big: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join on a name both share, a hot key's rows of `big` dealt over `salts` partitions; `small` is repeated."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the salted side has to be kept or matched")
    a = big.withColumn("_salt", (F.rand(7) * salts).cast("int"))
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "_salt"], how).drop("_salt")


#: Arrays that the right rows of one key are gathered in.
BLOCKS = 16


def few_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on shared names whose few keys have many rows on both sides; they come out first and once. right is the smaller side.

    Left rows are dealt over tiles by a hash of their values; right rows, gathered in arrays, are repeated in every
    tile. So the pairs of one key are made by many tasks, one left row after another, by reading arrays. Right rows
    without a partner are found apart, as no tile knows all of left.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"not a join of these: {how}")
    mine, other = ([c for c in d.columns if c not in on] for d in (left, right))
    if clash := set(mine) & set(other):
        raise ValueError(f"rename these first: {sorted(clash)}")
    if not other:
        raise ValueError("right has no columns of its own")
    session = left.sparkSession
    tiles = max(int(session.conf.get("spark.sql.shuffle.partitions")), 16 * session.sparkContext.defaultParallelism)
    key = F.struct(*on)  # in a struct, null equals null
    if not null_safe:
        for c in on:
            key = F.when(F.col(c).isNotNull(), key)

    a = left.select(key.alias("_a"), F.pmod(F.xxhash64(*left.columns), F.lit(tiles)).cast("int").alias("_tile"), F.struct(*left.columns).alias("_left")).repartition(tiles, "_a", "_tile")
    b = right.select(key.alias("_b"), F.pmod(F.xxhash64(*right.columns), F.lit(BLOCKS)).alias("_block"), F.struct(*other).alias("_row")).filter(F.col("_b").isNotNull())
    b = b.groupBy("_b", "_block").agg(F.collect_list("_row").alias("_rows"))
    plain = len(other) == 1  # read faster than structs
    b = b.select("_b", F.col(f"_rows.{other[0]}" if plain else "_rows").alias("_rows"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_copy")).repartition(tiles, "_b", "_copy").hint("merge")
    kept = how in ("left", "full")
    found = a.join(b, (F.col("_a") == F.col("_b")) & (F.col("_tile") == F.col("_copy")), "left" if kept else "inner")
    pairs = found.select("_left", "_b", (F.explode_outer if kept else F.explode)("_rows").alias("_row"))
    key_of = "_b" if how == "right" else "_left"
    out = pairs.select(*[F.col(f"{key_of}.{c}") for c in on], *[F.col(f"_left.{c}") for c in mine], *[F.col("_row").alias(c) if plain else F.col(f"_row.{c}") for c in other])
    if how in ("inner", "left"):
        return out
    known = left.select(*[F.col(c).alias(f"_a_{c}") for c in on]).distinct()
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c).eqNullSafe(F.col(f"_a_{c}")) if null_safe else F.col(c) == F.col(f"_a_{c}"))
    alone = right.join(known, same, "left_anti")
    return out.unionByName(alone.select(*on, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in mine], *other))


def match_report(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(side, status, n): matched, unmatched and null-keyed rows of either side."""

    def side(name: str, a: DataFrame, ak: str, b: DataFrame, bk: str) -> DataFrame:
        keys = b.filter(F.col(bk).isNotNull()).select(F.col(bk).alias("_k")).distinct()
        found = a.join(keys, F.col(ak) == F.col("_k"), "left")
        status = F.when(F.col(ak).isNull(), "NULL_KEY").when(F.col("_k").isNull(), "UNMATCHED").otherwise("MATCHED")
        return found.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "status", "n")

    return side("left", left, left_key, right, right_key).unionAll(side("right", right, right_key, left, left_key))
