"""The corpus pipeline: from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that go on; its
result is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collections.abc import Callable

from driftwise.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from driftwise.llm.common import fold, stored, table, vocabulary
from driftwise.llm.queries import BPE_RANKS


def _aside(docs: DataFrame, taken: tuple[str, ...]) -> dict[str, str]:
    """Free names for the columns of ``docs`` that are named like an operator's results."""
    mark = "_own_"
    while any(c.startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    return {c: mark + c for c in docs.columns if c in taken}


def _beside(docs: DataFrame, taken: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` makes of ``docs`` while its columns named like the results stand aside."""
    return operator(docs.withColumnsRenamed(_aside(docs, taken)))


def _own(docs: DataFrame, taken: tuple[str, ...]) -> list:
    """The columns of ``docs`` again, those that stood aside under their own names."""
    aside = _aside(docs, taken)
    return [F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns]


QUALITY, LINES = ("score", "predicted"), ("kept_text", "n_lines", "n_dropped")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of the documents it gets.

    Defined cases: a null or empty text is scored like any other; repeated ids and repeated rows are
    judged each; columns named like the classifier's results keep their values; an empty table stays empty.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = _beside(docs, QUALITY, lambda d: quality.score_texts(d, weights))
    return scored.where("predicted = 1").select(*_own(docs, QUALITY))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that several documents hold stays in the first; ``n_chars`` follows the text.

    Defined cases: a null text becomes empty; rows with a null id keep their lines; rows of one id are
    one document's; columns named like the operator's results keep their values.
    """
    kept = _beside(docs, LINES, line_dedup.dedup_lines).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*_own(docs, LINES))


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id.

    Defined cases: texts without words are linked with nothing; rows with a null id stay.
    """
    return jaccard_join.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Defined cases: null and empty texts hold nothing; a null id is an id of its own.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to.

    Defined cases: a null text has no ids; repeated rows are encoded each; columns beyond
    ``doc_id``, ``lang`` and ``source`` go.
    """
    coded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary(BPE_RANKS))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", keep_first_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("tokens", to_tokens),
]

# The quality classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
