"""From documents to token digests in five stages.

language ID drops documents whose language is not known (no letter at all); line dedup drops the lines
that ten documents or more share; the n-gram Jaccard join (five words, similarity 0.8) keeps the
document with the smallest id of each group; mixing repeats or samples documents until each source has
its target of words, and drops documents without words, such as those that line dedup has emptied;
encoding gives each remaining row's token count and digests.

Stages work on any columns beside doc_id, text and source, which come through, whatever their names;
n_chars, where there is one, follows the text. Every stage takes empty tables, null texts, texts of any
length and repeated rows. Ties are settled alike in every run: between near duplicates by id and then by
text, between rows at the end of a source's budget as mixing.py says, between languages by code point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwright.llm import jaccard, langid, lines, mixing
from bagwright.llm.bpe import Bpe
from bagwright.llm.common import held_out, load, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is `und`: null texts and texts without a letter. Learns as op8 does, from docs itself."""
    filters = langid.learn(docs, ~held_out(F.col("doc_id"), 3, 1))
    return langid.identify(docs, filters, only_known=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in ten documents or more."""
    kept = lines.dedup_lines(docs, min_docs=10)
    length = [i for i, c in enumerate(docs.columns) if c == "n_chars"]
    out = kept.select([F.col(f"`{c}`") for c in kept.columns[: len(docs.columns)]])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if length else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the smallest id, and one of rows that repeat id and text.

    A row without id yields to any document of its group that has one; of several texts under the smallest
    id, or of a group without ids, the one whose text has the least hash stays. Of rows that repeat id and
    text but differ elsewhere, the one with the least hash of its columns stays.
    """
    groups = materialize(jaccard.groups(docs, k=5, percent=80).select("doc_id", "t", "first"), "groups")

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").alias("i2"), F.col("t").alias("t2"))

    same = F.col("t").eqNullSafe(F.col("t2")) & F.col("i").eqNullSafe(F.col("i2"))
    leads = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    gone = named(groups.filter(F.col("first").isNotNull() & ~leads).select("doc_id", "t").distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.select(row.alias("row"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("t")).join(gone, same, "left_anti")
    often = named(groups.groupBy("doc_id", "t").count().filter("count > 1"))
    if not often.isEmpty():
        one = kept.join(often, same, "left_semi").groupBy("i", "t").agg(F.min_by("row", F.xxhash64(*[F.col("row").getField(c) for c in docs.columns])).alias("row"))
        kept = kept.join(often, same, "left_anti").unionAll(one.select("row", "i", "t"))
    return kept.select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating, and none is taken more than three times."""
    return mixing.mixed_rows(docs, weights=(1, 2, 3), cap=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    import public_tokenizers

    bpe = Bpe(public_tokenizers.path("byte_bpe_50k.json")).fit(docs)
    return bpe.encoded_digests(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]
#: Language ID cannot be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
