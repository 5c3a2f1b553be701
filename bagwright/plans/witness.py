"""Witnesses: obligations that rows meet, their algebra, and example rows for and against a query's filters.

join_cases, group_cases, rank_cases and membership_cases find the witnesses that given relations hold: for
each case of an operator the obligation its rows meet, how many do, and the least key of one as example.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bagwright.plans import domains as D
from bagwright.plans.facts import Facts, analyse_sql

SUFFICIENT, NECESSARY, EQUIVALENT = "sufficient", "necessary", "equivalent"
_SWAP = {SUFFICIENT: NECESSARY, NECESSARY: SUFFICIENT, EQUIVALENT: EQUIVALENT}


@dataclass(frozen=True)
class Obligation:
    """A condition on rows and how it relates to the claim it stands for."""

    text: str
    strength: str = EQUIVALENT

    def both(self, other: Obligation) -> Obligation:
        return Obligation(f"({self.text} AND {other.text})", _weaker(self.strength, other.strength))

    def either(self, other: Obligation) -> Obligation:
        return Obligation(f"({self.text} OR {other.text})", _weaker(self.strength, other.strength))

    def negated(self) -> Obligation:
        """What is sufficient for a claim is necessary for its contrary's failure, and the other way round."""
        return Obligation(f"(NOT {self.text})", _SWAP[self.strength])


def _weaker(a: str, b: str) -> str:
    kinds = {a, b} - {EQUIVALENT}
    if len(kinds) == 2:
        raise ValueError("a sufficient and a necessary obligation do not combine")
    return kinds.pop() if kinds else EQUIVALENT


def _between(low, high):
    if isinstance(low, str):
        return low + "m"
    if isinstance(low, date):
        return low + timedelta(days=1)
    return (low + high) / 2 if high is not None else low + 1


def pick(d: D.Domain):
    """(found, value): a value in a known domain; whole numbers and bounds first."""
    if d.parts is None:
        return False, None
    for p in d.parts:
        if p.low is None and p.high is None:
            return True, Decimal(1)
        if p.low is not None and p.low_in:
            return True, p.low
        if p.high is not None and p.high_in:
            return True, p.high
        if p.low is None:
            value = p.high - 1 if isinstance(p.high, Decimal) else p.high - timedelta(days=1) if isinstance(p.high, date) else ""
        else:
            value = p.low + 1 if isinstance(p.low, Decimal) and (p.high is None or p.low + 1 < p.high) else _between(p.low, p.high)
        if value in p:
            return True, value
    return (True, None) if d.nulls else (False, None)


def pick_outside(d: D.Domain):
    """(found, value): a value that is not in a known domain; NULL where that is one."""
    if d.parts is None:
        return False, None
    if not d.nulls:
        return True, None
    if not d.parts:
        return True, Decimal(1)
    for p in d.parts:
        for edge, inside, step in ((p.low, p.low_in, -1), (p.high, p.high_in, 1)):
            if edge is None:
                continue
            if edge not in d:
                return True, edge
            value = edge + step if isinstance(edge, Decimal) else edge + timedelta(days=step) if isinstance(edge, date) else None
            if value is not None and value not in d:
                return True, value
    return False, None


def rows(facts: Facts, qualifying: bool = True) -> dict[str, dict] | None:
    """Per relation, values of the columns that filters name: a row that qualifies, or one that does not.

    None where the filters are impossible or not wholly known.
    """
    if facts.impossible or not facts.exact:
        return None
    out: dict[str, dict] = {r: {} for r in facts.sources}
    for (relation, column), d in facts.columns.items():
        found, value = pick(d)
        if not found:
            return None
        out.setdefault(relation, {})[column] = value
    if qualifying:
        return out
    for (relation, column), d in facts.columns.items():
        found, value = pick_outside(d)
        if found:
            out[relation][column] = value
            return out
    return None


def check(spark: SparkSession, sql: str) -> dict[str, bool | None]:
    """Whether the example rows do what they should, tried on one-row tables; None where there is no example.

    For queries over one relation. The session's view of it is put back afterwards.
    """
    facts = analyse_sql(spark, sql)
    if len(facts.sources) != 1:
        raise ValueError("only queries over one relation are tried")
    name = facts.sources[0]
    real = spark.table(name)
    out: dict[str, bool | None] = {}
    try:
        for kind in (True, False):
            example = rows(facts, kind)
            out["qualifies" if kind else "rejected"] = None if example is None else (_one(real, example[name], spark, name, sql) > 0) is kind
    finally:
        real.createOrReplaceTempView(name)
    return out


def _one(real: DataFrame, values: dict, spark: SparkSession, name: str, sql: str) -> int:
    row = spark.range(1).select(*[F.lit(None if values.get(f.name) is None else str(values[f.name])).cast(f.dataType).alias(f.name) for f in real.schema])
    row.createOrReplaceTempView(name)
    return spark.sql(sql).count()


def _cases(df: DataFrame, cases: dict[str, tuple[str, Column]], example: str) -> DataFrame:
    """(case, obligation, n, example) of every case, those without rows too, from one aggregation."""
    facts = [x for i, (_, c) in enumerate(cases.values()) for x in (F.count(F.when(c, 1)).alias(f"n{i}"), F.min(F.when(c, F.col(example).cast("string"))).alias(f"e{i}"))]
    row = df.agg(*facts)
    listed = F.array(*[F.struct(F.lit(name).alias("case"), F.lit(text).alias("obligation"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("example")) for i, (name, (text, _)) in enumerate(cases.items())])
    return row.select(F.explode(listed).alias("x")).select("x.*")


def join_cases(left: DataFrame, right: DataFrame, left_key: str, right_key: str, example: str) -> DataFrame:
    """Rows of left that an equi-join matches, leaves unmatched because no right key is equal, or because theirs is NULL."""
    keys = right.filter(F.col(right_key).isNotNull()).select(F.col(right_key).alias("_k")).distinct()
    met = left.join(keys, F.col(left_key) == F.col("_k"), "left")
    a, b = f"left.{left_key}", f"right.{right_key}"
    null, hit = F.col(left_key).isNull(), F.col("_k").isNotNull()
    return _cases(met, {"matched": (f"{a} = {b} for some right row", hit), "unmatched": (f"{a} <> {b} for every right row", ~hit & ~null), "null_key": (f"{a} IS NULL", null)}, example)


def group_cases(df: DataFrame, by: str, aggregate: Column, having: str) -> DataFrame:
    """Groups for which a HAVING condition (on the column `value`, the aggregate) is TRUE, FALSE or UNKNOWN."""
    groups = df.groupBy(by).agg(aggregate.alias("value"))
    truth = F.expr(having)
    return _cases(groups, {"qualifying": (having, F.coalesce(truth, F.lit(False))), "rejected": (f"NOT ({having})", F.coalesce(~truth, F.lit(False))), "unknown": (f"({having}) IS UNKNOWN", truth.isNull())}, by)


def rank_cases(df: DataFrame, by: list[str], order: list[Column], most: int, example: str) -> DataFrame:
    """Rows that `rank() <= most` keeps, keeps as ties at the edge, or drops."""
    over = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumns({"_rank": F.rank().over(over), "_number": F.row_number().over(over)})
    kept, tied = F.col("_rank") <= most, F.col("_number") > most
    return _cases(ranked, {"kept": (f"rank <= {most} and row number <= {most}", kept & ~tied), "tied": (f"rank <= {most} < row number", kept & tied), "dropped": (f"rank > {most}", ~kept)}, example)


def membership_cases(outer: DataFrame, column: str, inner: DataFrame, inner_column: str, example: str) -> DataFrame:
    """Rows for which IN is TRUE, FALSE or UNKNOWN."""
    from bagwright.operators.subqueries import with_in

    tested = with_in(outer, [column], inner, [inner_column], "_in")
    truth = F.col("_in")
    return _cases(tested, {"member": (f"{column} = {inner_column} for some inner row", F.coalesce(truth, F.lit(False))), "no_member": ("comparison FALSE with every inner row", F.coalesce(~truth, F.lit(False))), "unknown": ("no comparison TRUE and one UNKNOWN", truth.isNull())}, example)
