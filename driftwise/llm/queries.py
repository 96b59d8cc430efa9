"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.llm import (bpe, decontaminate, importance, jaccard_join, language, language_model, line_dedup, neighbours, periodic_runs,
                           quality, substring_dedup, token_counts, token_store)
from driftwise.llm.common import fold, table, vocabulary
from driftwise.session import scratch_path

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = token_store.write_store(docs, scratch_path(spark, "token-store"), vocabulary(TOKENIZER))
    return token_store.fetch(spark, store, docs.select("doc_id").distinct()).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    weights = quality.train(docs, labels)
    return quality.score_texts(docs.select("doc_id", "text"), weights).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model.score_corpus(docs, fold("doc_id", 10)).select(
        "doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold("doc_id", 5) != 0))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(BPE_RANKS))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the hash of its id, goes on from one of its words with a period taken from that hash."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(hashed % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    chosen = docs.withColumns({"_w": words, "_h": hashed}).withColumns({"_n": F.size("_w").cast("bigint"), "_g": F.floor(F.col("_h") / 10)})
    rest = F.col("_n") - F.col("_a")
    sized = chosen.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", 1 + F.floor(rest / (3 + F.col("_g") % 8)))
    unit = F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    again = F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("_p")).cast("int")))
    tail = F.slice(again, F.lit(1), rest.cast("int"))
    head = F.slice("_w", F.lit(1), F.col("_a").cast("int"))
    text = F.when(F.col("_n") > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return sized.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ordered = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    best = found.withColumn("_best", F.array_max(ordered))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"), F.expr("(1000 * _best.length) div -_best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(PIECES))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_model": op4_language_model,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_language": op8_language,
    "op9_neighbours": op9_neighbours,
    "op10_bpe": op10_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_counts": op12_token_counts,
    "op13_importance": op13_importance,
}

_OP3 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeats AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT d.doc_id, d.line, d.i, r.k IS NOT NULL AND d.doc_id > r.first AS gone
  FROM keyed d LEFT JOIN repeats r ON d.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP7 = f"""
WITH texts AS (
  SELECT 0 AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents),
worded AS (
  SELECT kind, id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
  FROM texts),
shingles AS (
  SELECT DISTINCT kind, id, text, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s
  FROM worded WHERE len(w) >= 5),
sized AS (SELECT *, count(*) OVER (PARTITION BY id, text) AS q FROM shingles WHERE kind = 0),
pairs AS (
  SELECT i.id AS item_id, d.id AS doc_id, i.text, d.text AS doc_text, count(*) AS matched, any_value(q) AS n_shingles
  FROM sized i JOIN shingles d ON i.s = d.s AND d.kind = 1 GROUP BY 1, 2, 3, 4)
SELECT item_id, doc_id, max(matched) AS matched, max(n_shingles) AS n_shingles, max(matched / n_shingles) AS containment
FROM pairs WHERE 10 * matched >= 8 * n_shingles GROUP BY 1, 2
"""

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": _OP3, "op7_decontaminate": _OP7}
