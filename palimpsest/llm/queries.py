"""The queries of the text operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitplane, bpe, fingerprint, infill, langid, lm, mixing, phrases, pii, quality, setsketch, simhash, toxicity
from .common import documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predicted(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balanced(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(documents(spark, sf_dir))


def op7_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.round_trip(documents(spark, sf_dir))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_in(documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(documents(spark, sf_dir))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(documents(spark, sf_dir))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.grouped(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_fingerprints, op4_quality, op5_simhash, op6_language, op7_bitplane, op8_lm, op9_bpe, op10_pii, op11_phrases, op12_infill, op13_setsketch, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op11_phrases": phrases.SQL, "op12_infill": infill.SQL, "op13_setsketch": setsketch.SQL}
