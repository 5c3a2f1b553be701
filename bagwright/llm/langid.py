"""Language ID by language-bitmask n-gram filters.

Bit-sliced Bloom filters: one array of rows, in which bit l of a row belongs to language l's filter; the
and of an n-gram's K rows has the bit of every language that contains it. A text's n-grams (3 and 5
bytes of lower-cased words with their borders) are counted by language; the counts, corrected for each
filter's false positives and for how much of its own language's text a filter covers, decide.

Filters are learned from at most SAMPLE distinct labelled texts a language, taken by least hash (n copies of
a text count as 1 + log2 n), and hold at most GRAMS n-grams each: the most frequent of those seen SEEN times or more whose frequency is at least
SHARE of the greatest in any language, in whole classes of like counts. Languages are the non-null lang
values, in code point order; of more than LANGS the most frequent ones.

A text without a letter (null and empty ones too) is `und` with score 0. One with letters but no known
n-gram takes the most frequent language with score 0, as all do ties to the first language. With no
labelled row at all every text is `und`. Whole texts are read, long ones piece by piece; each row, repeated or not, gets a
result; extra columns come through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwright.llm.common import discard, fresh, map_batches, materialize
from bagwright.llm.labelled import limits, within
from bagwright.llm.textscan import chunks, mix

LANGS, SAMPLE, GRAMS, SEEN, SHARE = 1000, 2000, 60_000, 3, 0.25
SIZES, K = (3, 5), 2
LANG, SCORE = "_lang_pred", "_lang_score"
_U = np.uint64
_LETTER = regex.compile(r"\p{L}")

#: Bytes of words: a-z and those of other characters; everything else is a border.
_WORD = np.full(256, 0x20, np.uint8)
_WORD[97:123] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
_BORDER = _WORD == 0x20


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's n-grams, and of each its text. Borders stand before, between and after texts."""
    n = len(offs) - 1
    room = np.full(len(data) + n + 1, 0x20, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offs))
    room[at] = _WORD[data]
    begin = offs[:-1] + np.arange(n)
    gap = room == 0x20
    gaps = np.concatenate([[0], np.cumsum(gap, dtype=np.int64)])
    found, where = [], []
    for size in SIZES:
        m = len(room) - size + 1
        if m <= 0:
            continue
        start = np.flatnonzero(gaps[size - 1 : size - 1 + m] == gaps[1 : 1 + m])  # no border inside
        h = np.full(len(start), _U(size))
        for j in range(size):
            h = h << _U(8) | room[start + j]
        found.append(mix(h))
        where.append(np.searchsorted(begin, start, "right") - 1)
    return (np.concatenate(found), np.concatenate(where)) if found else (np.zeros(0, _U), np.zeros(0, np.int64))


class Filters:
    """bits: rows of the bit-sliced filters, ceil(languages / 64) words each."""

    def __init__(self, langs: list[str], prior: int, cover: np.ndarray, gram: np.ndarray, lang: np.ndarray):
        self.langs, self.prior, self.cover = langs, prior, np.maximum(cover, 1e-9)
        self.rows = 1 << max(16, int(8 * max(len(np.unique(gram)), 1) - 1).bit_length())
        self.bits = np.zeros((self.rows, max(1, -(-len(langs) // 64))), _U)
        for at in self._places(gram):
            np.bitwise_or.at(self.bits, (at, lang >> 6), _U(1) << (lang & 63).astype(_U))
        full = np.array([np.count_nonzero(self.bits[:, i >> 6] >> _U(i & 63) & _U(1)) / self.rows for i in range(len(langs))])
        self.false = full**K

    def _places(self, gram: np.ndarray) -> list[np.ndarray]:
        step = gram >> _U(32) | _U(1)
        return [((gram + _U(k) * step) & _U(self.rows - 1)).astype(np.int64) for k in range(K)]

    def hits(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages): n-grams in each language's filter, and (texts): all n-grams."""
        gram, text = grams(data, offs)
        n = len(offs) - 1
        rows = [self.bits[at] for at in self._places(gram)]
        found = rows[0]
        for r in rows[1:]:
            found = found & r
        out = np.zeros((n, len(self.langs)))
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(text, (found[:, i >> 6] >> _U(i & 63) & _U(1)).astype(np.float64), n)
        return out, np.bincount(text, minlength=n)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(column), np.zeros(len(column))
        if not self.langs:
            return names, score
        column = pc.fill_null(column, "")
        votes, sure = np.zeros((len(column), len(self.langs))), np.zeros(len(column), bool)
        for lo, hi, offs, data in chunks(pc.utf8_lower(column), border=_BORDER):
            hit, n = self.hits(data, offs)
            votes[lo:hi] += hit - self.false * n[:, None]
            letters = np.concatenate([[0], np.cumsum((data >= 97) & (data < 123), dtype=np.int64)])
            sure[lo:hi] |= letters[offs[1:]] > letters[offs[:-1]]
        votes = np.maximum(votes, 0) / (1 - self.false) / self.cover
        best, total = votes.argmax(1), votes.sum(1)
        for d in range(len(column)):
            if sure[d] or _LETTER.search(column[d].as_py()):
                names[d] = self.langs[best[d] if total[d] > 0 else self.prior]
                score[d] = votes[d, best[d]] / total[d] if total[d] > 0 else 0.0
        return names, np.clip(score, 0, 1)


def learn(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from the rows of docs that are usable and have a lang."""
    labelled = docs.filter(usable & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    totals = {r["key"]: r["count"] for r in labelled.groupBy("key").count().orderBy(F.desc("count"), "key").limit(LANGS).collect()}
    langs = sorted(totals)
    if not langs:
        return Filters([], 0, np.zeros(0), np.zeros(0, _U), np.zeros(0, np.int64))
    known = labelled.filter(F.col("key").isin(langs)) if len(langs) == LANGS else labelled
    known = known.withColumn("h", F.xxhash64("text"))
    chosen = known.filter(within(F.col("key"), F.col("h"), limits(known.select("key", "h"), SAMPLE))).groupBy("key", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("c"))
    chosen = chosen.select("key", "text", (1 + F.floor(F.log2("c"))).cast("long").alias("times"))
    index = {x: i for i, x in enumerate(langs)}

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = pc.utf8_lower(pc.fill_null(batch.column(1), ""))
            of, times = np.array([index[x] for x in batch.column(0).to_pylist()]), batch.column(2).to_numpy()
            found: dict[int, list] = {code: [] for code in np.unique(of).tolist()}
            for lo, hi, offs, data in chunks(text, border=_BORDER):
                gram, where = grams(data, offs)
                own = of[lo:hi][where]
                for code in np.unique(of[lo:hi]).tolist():
                    values, at = np.unique(gram[own == code], return_inverse=True)
                    found[code].append((values, np.bincount(at, times[lo:hi][where[own == code]], len(values))))
            out = []
            for code, parts in found.items():
                gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                values, at = np.unique(gram, return_inverse=True)
                out.append((np.full(len(values), code, np.int32), values.view(np.int64), np.bincount(at, n, len(values)).astype(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["lang", "gram", "n"])

        return f

    counted = map_batches(chosen, make, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "lang-grams")
    total = {r["lang"]: float(r["n"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not total:  # no n-gram in any text
        table = counted.withColumn("p", F.lit(0.0)).limit(0).toArrow()
    else:
        size = F.element_at(F.create_map(*[F.lit(x) for item in total.items() for x in item]), F.col("lang"))
        often = counted.filter(F.col("n") >= SEEN).withColumn("p", F.col("n") / size)
        often = often.withColumn("most", F.max("p").over(Window.partitionBy("gram"))).filter(F.col("p") >= SHARE * F.col("most"))
        often = materialize(often.select("lang", "gram", "n", "p"), "lang-often")
        # Of each language the classes of counts (8 a doubling), from the greatest down, as long as their n-grams fit.
        often = often.withColumn("class", F.floor(8 * F.log2("n")).cast("int"))
        room, least = dict.fromkeys(total, GRAMS), {}
        for r in sorted(often.groupBy("lang", "class").count().collect(), key=lambda r: (r["lang"], -r["class"])):
            room[r["lang"]] -= r["count"]
            if room[r["lang"]] >= 0:
                least[r["lang"]] = r["class"]
        fits = F.element_at(F.create_map(*[F.lit(x) for item in least.items() for x in item]), F.col("lang")) if least else F.lit(None)
        table = often.filter(F.col("class") >= fits).select("lang", "gram", "p").toArrow()
        discard(often)
    discard(counted)
    lang, gram = table["lang"].to_numpy().astype(np.int64), table["gram"].to_numpy().astype(np.int64).view(_U)
    cover = np.bincount(lang, table["p"].to_numpy(), len(langs))
    prior = max(range(len(langs)), key=lambda i: (totals[langs[i]], -i))
    return Filters(langs, prior, cover, gram, lang)


def identify(df: DataFrame, filters: Filters, text_col: str = "text", only_known: bool = False) -> DataFrame:
    """df with the columns _lang_pred and _lang_score (with more underscores where df has such names); with only_known, without them and the rows that are `und`."""
    shared, i = df.sparkSession.sparkContext.broadcast(filters), df.columns.index(text_col)
    schema = df.schema if only_known else T.StructType([*df.schema.fields, T.StructField(fresh(LANG, df.columns), T.StringType()), T.StructField(fresh(SCORE, df.columns), T.DoubleType())])

    def make():
        model = shared.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, score = model.predict(batch.column(i))
            if only_known:
                return batch.filter(pa.array([x != "und" for x in names]))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[f.name for f in schema])

        return f

    return map_batches(df, make, schema)
