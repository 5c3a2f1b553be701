"""Ordered writes as state transforms: every statement maps a state of named relations to the next.

A State is immutable; a statement yields a Transition with before, after, the affected rows and what
RETURNING shows. Rolling back is keeping the earlier state. Conditions follow three-valued logic: only
rows for which they are TRUE are changed. Constraints are checked by queries that return violations.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Constraint:
    """kind: primary_key, unique, not_null, foreign_key, accepted_values or check."""

    kind: str
    columns: tuple[str, ...] = ()
    parent: str = ""
    parent_columns: tuple[str, ...] = ()
    values: tuple = ()
    check: str = ""


@dataclass(frozen=True)
class Identity:
    """The number that the next row without one gets, and the step to the one after."""

    following: int = 1
    step: int = 1


@dataclass(frozen=True)
class Relation:
    """made: what a materialized view shows, of a state; rows are what it showed when last refreshed."""

    rows: DataFrame
    defaults: Mapping[str, Column] = field(default_factory=dict)
    generated: Mapping[str, Column] = field(default_factory=dict)
    constraints: tuple[Constraint, ...] = ()
    identity: Mapping[str, Identity] = field(default_factory=dict)
    made: Callable[[State], DataFrame] | None = None

    @property
    def columns(self) -> list[str]:
        return self.rows.columns


@dataclass(frozen=True)
class Transition:
    before: State
    after: State
    relation: str
    affected: DataFrame
    returning: DataFrame | None = None


class ConstraintError(Exception):
    pass


def violations(relation: Relation, state: State | None = None) -> DataFrame:
    """(constraint, detail, n): rows or keys that break each constraint. UNKNOWN checks and null foreign keys pass."""
    df, found = relation.rows, []
    for c in relation.constraints:
        cols = [F.col(x) for x in c.columns]
        label = F.lit(f"{c.kind}({', '.join(c.columns) or c.check})").alias("constraint")
        known = F.lit(True)
        for x in cols:
            known = known & x.isNotNull()
        text = F.concat_ws(", ", *[F.coalesce(x.cast("string"), F.lit("NULL")) for x in cols]).alias("detail")
        if c.kind in ("primary_key", "unique"):
            bad = df.filter(known).groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(label, text, "n")
            if c.kind == "primary_key":
                bad = bad.unionAll(df.filter(~known).groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n")).select(label, text, "n"))
        else:
            if c.kind == "not_null":
                rows = df.filter(~known)
            elif c.kind == "foreign_key":
                parent = state[c.parent].rows.select(*[F.col(x).alias(f"_p{i}") for i, x in enumerate(c.parent_columns)])
                rows = df.filter(known).join(parent, [x == F.col(f"_p{i}") for i, x in enumerate(cols)], "left_anti")
            elif c.kind == "accepted_values":
                rows = df.filter(~cols[0].isin(*c.values))
            elif c.kind == "check":
                rows, text = df.filter(~F.expr(c.check)), F.lit(c.check).alias("detail")
            else:
                raise ValueError(f"unknown constraint {c.kind}")
            bad = rows.groupBy(label, text).agg(F.count(F.lit(1)).alias("n"))
        found.append(bad)
    if not found:
        return df.sparkSession.createDataFrame([], "constraint string, detail string, n bigint")
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


class State(Mapping):
    """Relations by name."""

    def __init__(self, relations: Mapping[str, Relation | DataFrame] = ()):
        self._relations = {k: v if isinstance(v, Relation) else Relation(v) for k, v in dict(relations).items()}

    def __getitem__(self, name: str) -> Relation:
        return self._relations[name]

    def __iter__(self):
        return iter(self._relations)

    def __len__(self):
        return len(self._relations)

    def put(self, name: str, relation: Relation | DataFrame) -> State:
        return State({**self._relations, name: relation})

    def without(self, name: str) -> State:
        return State({k: v for k, v in self._relations.items() if k != name})

    def views(self) -> None:
        """Temporary views of all relations, for SQL text."""
        for name, relation in self._relations.items():
            relation.rows.createOrReplaceTempView(name)

    def checked(self, name: str) -> State:
        """This state, if the relation and those that refer to it keep their constraints."""
        for other, relation in self._relations.items():
            if other == name or any(c.parent == name for c in relation.constraints):
                bad = violations(relation, self).limit(3).collect()
                if bad:
                    raise ConstraintError(f"{other}: " + "; ".join(f"{r['constraint']}: {r['detail']}" for r in bad))
        return self

    def _moved(self, name: str, rows: DataFrame, affected: DataFrame, returning: Sequence[str] | None) -> Transition:
        after = self.put(name, replace(self[name], rows=rows))
        return Transition(self, after, name, affected, affected.select(*returning) if returning else None)


def create(state: State, name: str, rows: DataFrame | str, spark: SparkSession | None = None, or_replace: bool = False, **facts) -> Transition:
    """CREATE TABLE name AS rows, or of a schema string without rows."""
    if name in state and not or_replace:
        raise ValueError(f"{name} exists")
    if isinstance(rows, str):
        rows = spark.createDataFrame([], T._parse_datatype_string(rows))
    return Transition(state, state.put(name, Relation(rows, **facts)), name, rows)


def drop(state: State, name: str, if_exists: bool = False) -> Transition:
    if name not in state and not if_exists:
        raise KeyError(name)
    gone = state[name].rows if name in state else None
    return Transition(state, state.without(name), name, gone)


def rename(state: State, name: str, new: str) -> Transition:
    if new in state:
        raise ValueError(f"{new} exists")
    after = state.without(name).put(new, state[name])
    for other, relation in after.items():
        if any(c.parent == name for c in relation.constraints):
            after = after.put(other, replace(relation, constraints=tuple(replace(c, parent=new) if c.parent == name else c for c in relation.constraints)))
    return Transition(state, after, new, state[name].rows.limit(0))


def materialize_view(state: State, name: str, made: Callable[[State], DataFrame]) -> Transition:
    """CREATE MATERIALIZED VIEW: a relation that shows what made(state) gave when it was last refreshed."""
    from bagwright.operators.scratch import write_out

    if name in state:
        raise ValueError(f"{name} exists")
    rows = write_out(made(state))
    return Transition(state, state.put(name, Relation(rows, made=made)), name, rows)


def refresh(state: State, name: str) -> Transition:
    """REFRESH MATERIALIZED VIEW."""
    from bagwright.operators.scratch import write_out

    if state[name].made is None:
        raise ValueError(f"{name} is no materialized view")
    rows = write_out(state[name].made(state))
    return state._moved(name, rows, rows, None)


def truncate(state: State, name: str) -> Transition:
    return state._moved(name, state[name].rows.limit(0), state[name].rows, None)


def _generate(relation: Relation, rows: DataFrame) -> DataFrame:
    """rows with generated columns computed anew."""
    kinds = {f.name: f.dataType for f in relation.rows.schema}
    return rows.withColumns({c: e.cast(kinds[c]) for c, e in relation.generated.items()}) if relation.generated else rows


def complete(relation: Relation, rows: DataFrame) -> DataFrame:
    """rows with the relation's columns: defaults for missing ones, generated ones computed."""
    if extra := set(rows.columns) - set(relation.columns):
        raise ValueError(f"no such columns: {sorted(extra)}")
    if fixed := set(rows.columns) & set(relation.generated):
        raise ValueError(f"generated columns take no values: {sorted(fixed)}")
    kinds = {f.name: f.dataType for f in relation.rows.schema}
    base = rows.select(*[(F.col(c) if c in rows.columns else relation.defaults.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in relation.columns])
    return _generate(relation, base)


def _numbered(rows: DataFrame, identity: Mapping[str, Identity]) -> tuple[DataFrame, int]:
    """rows with their identity columns, in the order of their other columns, and how many they are.

    Rows are sorted in ranges, counted by task and numbered from the counts of the tasks before: nothing is ordered in one task.
    """
    from bagwright.operators.scratch import write_out

    order = write_out(rows.orderBy(*rows.columns)).withColumn("_no", F.monotonically_increasing_id())
    task = F.shiftright("_no", 33)
    sizes = {r["task"]: r["count"] for r in order.groupBy(task.alias("task")).count().collect()}  # a row a task
    starts, total = [], 0
    for t in sorted(sizes):
        starts.append((t, total))
        total += sizes[t]
    at = order.sparkSession.createDataFrame(starts, "task long, start long")
    order = order.join(F.broadcast(at), task == F.col("task")).withColumn("_at", F.col("start") + F.col("_no").bitwiseAND((1 << 33) - 1))
    return order.select(*rows.columns, *[(F.lit(v.following) + F.col("_at") * v.step).alias(c) for c, v in identity.items()]), total


def insert(state: State, name: str, rows: DataFrame, returning: Sequence[str] | None = None, on_conflict: Sequence[str] | None = None) -> Transition:
    """INSERT of rows by name. on_conflict: columns of a key whose taken values are left out (DO NOTHING).

    Identity columns that rows lack are numbered in the order of the rows' other columns.
    """
    relation = state[name]
    if asked := {c: v for c, v in relation.identity.items() if c not in rows.columns}:
        rows, total = _numbered(rows, asked)
        relation = replace(relation, identity={**relation.identity, **{c: replace(v, following=v.following + total * v.step) for c, v in asked.items()}})
        state = state.put(name, relation)
    new = complete(relation, rows)
    if on_conflict:
        keys = list(on_conflict)
        if not any(c.kind in ("primary_key", "unique") and set(c.columns) == set(keys) for c in relation.constraints):
            raise ValueError("ON CONFLICT needs a declared key")
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        # Nulls never conflict; of new rows with one key the first in column order stays.
        firsts = new.filter(known).groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in new.columns])).alias("_r")).select("_r.*")
        new = firsts.join(relation.rows, keys, "left_anti").select(*new.columns).unionAll(new.filter(~known))
    return state._moved(name, relation.rows.unionAll(new), new, returning)


def update(state: State, name: str, assign: Mapping[str, Column], where: Column | None = None, source: DataFrame | None = None, on: Column | None = None, row_id: Sequence[str] = (), returning: Sequence[str] | None = None) -> Transition:
    """UPDATE [FROM source ON on]. Assignments see the old row; a row that several source rows match raises as the query runs.

    row_id: columns that identify a target row; without them rows are numbered for the time of the join.
    """
    relation = state[name]
    cols = relation.columns
    if bad := (set(assign) - set(cols)) | (set(assign) & set(relation.generated)):
        raise ValueError(f"cannot be assigned: {sorted(bad)}")
    if source is None:
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        rows = relation.rows.withColumn("_hit", hit)
    else:
        marked = source.withColumn("_hit", F.lit(True))
        condition = on if where is None else on & where
        target = relation.rows if row_id else relation.rows.withColumn("_row", F.monotonically_increasing_id())
        rows = target.join(marked, condition, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        rows = _single(rows, [relation.rows[c] for c in row_id] or ["_row"])
    kinds = {f.name: f.dataType for f in relation.rows.schema}
    new = rows.select(*[F.when(F.col("_hit"), assign[c]).otherwise(relation.rows[c]).cast(kinds[c]).alias(c) if c in assign else relation.rows[c] for c in cols], "_hit")
    new = _generate(relation, new)
    return state._moved(name, new.select(*cols), new.filter("_hit").select(*cols), returning)


def _single(rows: DataFrame, row_id: Sequence[str | Column]) -> DataFrame:
    """Raises as the query runs if a row id with hits comes more than once."""
    from pyspark.sql import Window

    n = F.sum(F.col("_hit").cast("int")).over(Window.partitionBy(*row_id))
    return rows.withColumn("_hit", F.when(n > 1, F.raise_error(F.lit("a target row has more than one match"))).otherwise(F.col("_hit")))


def delete(state: State, name: str, where: Column | None = None, using: DataFrame | None = None, on: Column | None = None, returning: Sequence[str] | None = None) -> Transition:
    """DELETE [USING]: removes the rows for which the condition is TRUE."""
    rows = state[name].rows
    if using is not None:
        condition = on if where is None else on & where
        return state._moved(name, rows.join(using, condition, "left_anti"), rows.join(using, condition, "left_semi"), returning)
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return state._moved(name, rows.filter(~hit), rows.filter(hit), returning)


@dataclass(frozen=True)
class Branch:
    """A MERGE branch. on: matched, not_matched or not_matched_by_source; action: update, delete or insert."""

    on: str
    action: str
    values: Mapping[str, Column] = field(default_factory=dict)
    condition: Column | None = None


def merge(state: State, name: str, source: DataFrame, keys: Sequence[tuple[str, str]], branches: Sequence[Branch], alias: str = "target", source_alias: str = "source") -> Transition:
    """MERGE by one full outer equi-join; the first branch that applies to a row acts.

    keys: (target, source) names. Conditions and values may name either side by its alias. A target row that
    several source rows match raises as the query runs. Generated columns follow the new values.
    """
    relation = state[name]
    cols = relation.columns
    if bad := {c for b in branches for c in b.values} & set(relation.generated):
        raise ValueError(f"generated columns take no values: {sorted(bad)}")

    def old(c: str) -> Column:
        return F.col(f"{alias}.`{c}`")

    # Source rows are counted per key before the join, which so cannot multiply target rows unnoticed.
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*[b for _, b in keys]))
    counted = source.withColumns({"_n": n, "_s": F.lit(True)}).alias(source_alias)
    target = relation.rows.withColumn("_t", F.lit(True)).alias(alias)
    same = F.lit(True)
    for a, b in keys:
        same = same & (old(a) == F.col(f"{source_alias}.`{b}`"))
    joined = target.join(counted, same, "full")
    both, only_s = F.col("_t").isNotNull() & F.col("_s").isNotNull(), F.col("_t").isNull()
    group = F.when(both, "matched").when(only_s, "not_matched").otherwise("not_matched_by_source")
    group = F.when(both & (F.col("_n") > 1), F.raise_error(F.lit("a target row has more than one match"))).otherwise(group)
    number = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(branches))):
        applies = group == b.on
        if b.condition is not None:
            applies = applies & F.coalesce(b.condition, F.lit(False))
        number = F.when(applies, i).otherwise(number)
    joined = joined.withColumn("_branch", number)
    gone = [i for i, b in enumerate(branches) if b.action == "delete"]
    values = {}
    for c in cols:
        value = old(c)
        for i, b in enumerate(branches):
            if b.action in ("update", "insert"):
                default = relation.defaults.get(c, F.lit(None)) if b.action == "insert" else old(c)
                value = F.when(F.col("_branch") == i, b.values.get(c, default)).otherwise(value)
        values[c] = value.cast(relation.rows.schema[c].dataType)
    keep = F.when(only_s, F.col("_branch").isNotNull()).otherwise(~F.coalesce(F.col("_branch").isin(*gone), F.lit(False)) if gone else F.lit(True))
    full = _generate(relation, joined.select(*[v.alias(c) for c, v in values.items()], "_branch", keep.alias("_keep")))
    return state._moved(name, full.filter("_keep").select(*cols), full.filter("_branch IS NOT NULL").select(*cols), None)


def add_column(state: State, name: str, column: str, kind: str, default: Column | None = None) -> Transition:
    value = (default if default is not None else F.lit(None)).cast(kind)
    rows = state[name].rows.withColumn(column, value)
    moved = state._moved(name, rows, rows, None)
    if default is None:
        return moved
    return replace(moved, after=moved.after.put(name, replace(moved.after[name], defaults={**moved.after[name].defaults, column: default})))


def _needs(relation: Relation, e: Column, column: str) -> bool:
    """Whether an expression on the relation's rows names a column."""
    from pyspark.errors import AnalysisException

    try:
        relation.rows.drop(column).select(e)
    except AnalysisException:
        return True
    return False


def _referring(state: State, name: str, column: str) -> list[str]:
    return sorted(k for k, r in state.items() if any(c.parent == name and column in c.parent_columns for c in r.constraints))


def drop_column(state: State, name: str, column: str) -> Transition:
    """DROP COLUMN; raises where a constraint, a generated column or another relation's foreign key needs it."""
    relation = state[name]
    if any(column in c.columns or (c.check and _needs(relation, F.expr(c.check), column)) for c in relation.constraints):
        raise ValueError(f"a constraint needs {column}")
    if any(c != column and _needs(relation, e, column) for c, e in relation.generated.items()):
        raise ValueError(f"a generated column needs {column}")
    if others := _referring(state, name, column):
        raise ValueError(f"{', '.join(others)} refers to {column}")
    rows = relation.rows.drop(column)
    kept = {k: {c: v for c, v in getattr(relation, k).items() if c != column} for k in ("defaults", "generated", "identity")}
    return Transition(state, state.put(name, replace(relation, rows=rows, **kept)), name, rows)


def rename_column(state: State, name: str, column: str, new: str) -> Transition:
    """RENAME COLUMN with all that is declared of it, other relations' foreign keys too; raises where an expression names it."""
    relation = state[name]
    if new in relation.columns:
        raise ValueError(f"{new} exists")
    for c in relation.constraints:
        if c.check and _needs(relation, F.expr(c.check), column):
            raise ValueError(f"check {c.check} names {column}")
    if any(c != column and _needs(relation, e, column) for c, e in relation.generated.items()):
        raise ValueError(f"a generated column names {column}")

    def moved(names):
        return tuple(new if x == column else x for x in names)

    kept = {k: {new if c == column else c: v for c, v in getattr(relation, k).items()} for k in ("defaults", "generated", "identity")}
    rows = relation.rows.withColumnRenamed(column, new)
    after = state.put(name, replace(relation, rows=rows, constraints=tuple(replace(c, columns=moved(c.columns)) for c in relation.constraints), **kept))
    for other in _referring(state, name, column):
        theirs = tuple(replace(c, parent_columns=moved(c.parent_columns)) if c.parent == name else c for c in after[other].constraints)
        after = after.put(other, replace(after[other], constraints=theirs))
    return Transition(state, after, name, rows)


def set_type(state: State, name: str, column: str, kind: str) -> Transition:
    relation = state[name]
    rows = relation.rows.withColumn(column, F.col(column).cast(kind))
    return state._moved(name, _generate(replace(relation, rows=rows), rows), rows, None)


def select(state: State, name: str, rows: Callable[[State], DataFrame]) -> Transition:
    """A read between writes: the state stays, what it shows is recorded as returned."""
    shown = rows(state)
    return Transition(state, state, name, shown.limit(0), shown)


Statement = Callable[[State], Transition]


def script(state: State, statements: Sequence[Statement | str], check: bool = True, cut_every: int = 8) -> list[Transition]:
    """Runs statements in order. "BEGIN", "COMMIT" and "ROLLBACK" save, keep and restore the state.

    Lineage is cut by a checkpoint after each `cut_every` statements on one relation.
    """
    from bagwright.operators.scratch import write_out

    out: list[Transition] = []
    saved: State | None = None
    depth: dict[str, int] = {}
    for s in statements:
        if isinstance(s, str):
            word = s.strip().upper()
            if word == "BEGIN":
                if saved is not None:
                    raise ValueError("a transaction is open")
                saved = state
            elif word in ("COMMIT", "ROLLBACK"):
                if saved is None:
                    raise ValueError("no transaction is open")
                before, state, saved = state, saved if word == "ROLLBACK" else state, None
                out.append(Transition(before, state, "", None))
            else:
                raise ValueError(f"unknown statement {s}")
            continue
        moved = s(state)
        state, name = moved.after, moved.relation
        if check and name in state and moved.after is not moved.before:
            if any(c.parent == name for r in state.values() for c in r.constraints) or state[name].constraints:
                # The check reads what is written, so that no statement before is run again.
                state = state.put(name, replace(state[name], rows=write_out(state[name].rows)))
                depth[name] = 0
            state = state.checked(name)
        depth[name] = depth.get(name, 0) + 1
        if depth[name] % cut_every == 0 and name in state:
            state = state.put(name, replace(state[name], rows=write_out(state[name].rows)))
        out.append(replace(moved, after=state))
    return out
