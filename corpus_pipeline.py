"""A corpus pipeline in five stages; each is written as Parquet and read again as the next one's documents.

Toxic documents go, one document of each near-duplicate group stays, personal data is masked in the texts, sources are mixed to
their target weights (rows repeat), and the texts become token ids. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, mixing, pii, simhash, toxicity
from palimpsest.llm.common import bounded_batches, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the factorization machine, learned from ``labels``, predicts toxic."""
    return toxicity.without_toxic(bounded_batches(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8), by the index of positional bytes over
    bytes of least hashes: SimHash bits can't reach that similarity (see simhash.deduplicated)."""
    return simhash.deduplicated(bounded_batches(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind in brackets and n_chars set anew; no row goes."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the entropy-balanced mix takes it, none to three times."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of each row; the texts end here."""
    coded = bpe.with_encoding(bounded_batches(docs).select("doc_id", "lang", "source", "text"))
    return coded.selectExpr("doc_id", "lang", "source", "ids", "size(ids) as n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("positional_byte_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the trained, hashed and iterative stages; tests/llm holds each to its operator's brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
