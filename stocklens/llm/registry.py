"""Registered queries of the training-data operators, over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stocklens.llm import bpe, ctph, extract, langid, mixing, phrases, pii, quality, runs, secrets, simhash, tokenfiles, topk
from stocklens.llm.common import shared_folder, short_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return short_batches(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(table(spark, folder, "documents"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, folder, "documents"), shared_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents")).drop("spans")


def op6_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return ctph.compare_with_next(table(spark, folder, "documents"))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse(table(spark, folder, "documents"), edit=runs.repeat_tail)


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_simhash, op3_token_files, op4_topk, op5_language, op6_extract, op7_quality, op8_mix, op9_secrets, op10_fingerprints, op11_runs, op12_phrases, op13_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": topk.ORACLE_SQL, "op8_mix": mixing.ORACLE_SQL, "op12_phrases": phrases.ORACLE_SQL}
