"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwright.llm.common import held_out, load


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagwright.llm.mixing import mix_table

    return mix_table(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagwright.llm.chat import format_chats

    return format_chats(load(spark, sf_dir, "conversations"))


def _classified(spark: SparkSession, sf_dir: str, kind, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) by a model of `kind` that learns from rows that aren't held out."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = kind.learn(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    scored = kind.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagwright.llm import quality

    return _classified(spark, sf_dir, quality, 0.3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagwright.llm import toxicity

    return _classified(spark, sf_dir, toxicity, 0.5)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagwright.llm.jaccard import join

    return join(load(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from bagwright.llm.bpe import Bpe

    docs = load(spark, sf_dir, "documents")
    return Bpe(public_tokenizers.path("byte_bpe_50k.json")).fit(docs).encoded_digests(docs)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagwright.llm.ann import search

    return search(load(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagwright.llm import langid

    docs = load(spark, sf_dir, "documents")
    filters = langid.learn(docs, ~held_out(F.col("doc_id"), 3, 1))
    found = langid.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col(langid.LANG).alias("lang_pred"), F.col(langid.SCORE).alias("score"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagwright.llm.lines import N_DROPPED, N_LINES, dedup_lines

    kept = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col(N_LINES).alias("n_lines"), F.col(N_DROPPED).alias("n_dropped"), digest.alias("kept_sha256"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagwright.llm.media import encode_media, media_features

    return media_features(encode_media(load(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard": op5_jaccard,
    "op6_bpe": op6_bpe,
    "op7_neighbours": op7_neighbours,
    "op8_langid": op8_langid,
    "op9_lines": op9_lines,
    "op10_media": op10_media,
}

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES: dict[str, str] = {
    "op1_mix": r"""
WITH base AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 16) AS tie,
         -ln((('0x' || substr(md5('42' || coalesce('|' || doc_id::VARCHAR, '~' || coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.25, least(1.0, 1 - 4 * ((strlen(coalesce(text, '')) - strlen(regexp_replace(coalesce(text, ''), '[!#$%&*+/<=>@\\^_|~]+', '', 'g')))::DOUBLE
                                             / greatest(strlen(coalesce(text, '')), 1)))) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (3 * sum(size))::DOUBLE AS most,
         (1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::DOUBLE AS w,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM base GROUP BY source),
filled AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY most / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
targets AS (
  SELECT source, source_size,
         CASE WHEN most / w <= level THEN most ELSE max(CASE WHEN most / w > level THEN level END) OVER () * w END AS target
  FROM filled),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target)::BIGINT // source_size) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.epochs,
         CASE WHEN p.epochs >= 3 THEN 0 ELSE floor(p.target)::BIGINT - p.epochs * p.source_size END AS rest,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM running
""",
    "op2_chat": """
WITH turns AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
convs AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS l,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS chat
  FROM turns GROUP BY conv_id),
heads AS (
  SELECT DISTINCT i, list_slice(l, 1, i) AS head FROM (SELECT l, n, unnest(range(1, n)) AS i FROM convs)),
whole AS (
  SELECT l, n, min(conv_id) AS conv_id, count(*) AS n_equal, any_value(chat) AS chat FROM convs GROUP BY l, n)
SELECT conv_id, n::BIGINT AS n_turns, n_equal::BIGINT AS n_equal, chat
FROM whole w WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.i = w.n AND h.head = w.l)
""",
    "op9_lines": f"""
WITH lines AS (
  SELECT r, doc_id, i, s[i] AS line,
         translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_ABC}) AS k
  FROM (SELECT r, doc_id, s, unnest(range(1, len(s) + 1)) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
often AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(o.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o USING (k) GROUP BY r, doc_id
""",
}
