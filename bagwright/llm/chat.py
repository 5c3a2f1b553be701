"""Chat formatting: collapse of cumulative snapshots, then rendering; DataFrame operations only.

Logs hold a conversation several times, each time with more turns. Turns are ordered by turn, then role
and text; position and rolling hashes of the turns up to it (two 64-bit hashes, each an exclusive or of
hashes of position, role and text) identify every prefix. A conversation that equals a proper prefix
of another goes (anti-join on length and hashes); of equal conversations the smallest conv_id stays.
Prefixes are made distinct before the join, so that frequent first turns cost no pairs.

Texts are hashed where they are read: only hashes are shuffled to find what stays, and a text moves once,
if its conversation is kept. Text decides the order only where a conversation has several turns with one
number and role; those conversations alone are ordered with their texts.

A null role or text is a value of its own and renders as an empty one; a null turn comes first. Rows with a
null conv_id form one conversation, which yields to equal ones with an id. Turns that tie on number, role
and text are equal, and repeated turns are turns. Texts and conversations may be long, but a rendered
conversation is one value and so is built in one task. Extra columns are ignored, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagwright.llm.common import materialize


def _source(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))


def prefixes(turns: DataFrame, exact: bool = True, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, h1, h2, n, tied): position from 1, hashes of the turns up to it, turns in all.

    Unless exact, texts that tie on turn and role are ordered by their hashes instead, and `tied` tells whether a conversation has such.
    """
    src = _source(turns, conv_col, turn_col, role_col, text_col)
    marks = [F.coalesce(F.length(c), F.lit(-1)) for c in ("role", "text")]
    src = src.withColumns({"a": F.xxhash64(F.lit(1), *marks, "role", "text"), "b": F.xxhash64(F.lit(2), "text", "role", *marks, F.lit(7))})
    last = "text" if exact else "a"
    src = src.select("conv_id", "turn", "role", "a", "b", *(["text"] if exact else []))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", last)
    before = F.lag(F.struct("turn", "role", "a")).over(by)
    twin = before["turn"].eqNullSafe(F.col("turn")) & before["role"].eqNullSafe(F.col("role")) & (before["a"] != F.col("a"))
    src = src.withColumns({"pos": F.row_number().over(by), "twin": F.coalesce(twin & before.isNotNull(), F.lit(False))})
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    hashes = {"h1": F.bit_xor(F.xxhash64("pos", "a")).over(upto), "h2": F.bit_xor(F.xxhash64("b", "pos")).over(upto)}
    every = Window.partitionBy("conv_id")
    out = src.withColumns(hashes).withColumns({"n": F.count(F.lit(1)).over(every), "tied": F.max("twin").over(every)})
    return out.select("conv_id", "pos", "h1", "h2", "n", "tied")


def collapse(turns: DataFrame, **cols: str) -> DataFrame:
    """(conv_id, n_turns, n_equal): the maximal conversations, and how many conversations equal each."""
    steps = materialize(prefixes(turns, exact=False, **cols), "chat-steps")
    tied = steps.filter("tied AND pos = n").select(F.col("conv_id").alias("tied_id"))
    if not tied.isEmpty():
        mine = turns.join(tied, F.col(f"`{cols.get('conv_col', 'conv_id')}`").eqNullSafe(F.col("tied_id")), "left_semi")
        steps = steps.filter("NOT tied").unionAll(prefixes(mine, **cols))
    inner = steps.filter("pos < n").select("pos", "h1", "h2").distinct()
    whole = steps.filter("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    return whole.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), F.col("n_equal").cast("long"))


def render(turns: DataFrame, kept: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """kept with its conversations as `<|role|>` and text lines, each turn ended by `<|end|>`."""
    ids = kept.select(F.col("conv_id").alias("kept"), "n_turns", "n_equal")
    mine = _source(turns, conv_col, turn_col, role_col, text_col).join(ids, F.col("conv_id").eqNullSafe(F.col("kept")))
    listed = mine.groupBy("conv_id", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = F.transform("turns", lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n")))
    return listed.select("conv_id", "n_turns", "n_equal", F.array_join(line, "").alias("chat"))


def format_chats(turns: DataFrame, **cols: str) -> DataFrame:
    """(conv_id, n_turns, n_equal, chat) of the maximal conversations."""
    kept = materialize(collapse(turns, **cols), "chat-kept")
    return render(turns, kept, **cols)
