"""The training-data pipeline: from raw ``documents`` to token ids.

1. Documents that the quality classifier rejects go.
2. Of each group of near copies by SimHash, the document of the smallest id stays.
3. Secrets are replaced by a mark; no document goes.
4. Sources are mixed to their target weights: documents stay as often as the mix takes them.
5. What is left is encoded, and decoded as a check.

Every stage works on all rows of the one before, which are written as Parquet and read again. All stages but the last
return the columns of ``documents``. The stages' own rules for nulls, empty texts and repeated rows hold.
"""

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stocklens.llm import bpe, mixing, quality, secrets, simhash
from stocklens.llm.common import short_batches, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs, shingle=3, radius=2)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact(docs)
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


def staged(function):
    """A stage with short batches between Spark and Python."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(short_batches(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", staged(keep_good)),
    ("SimHash near-dedup", staged(drop_near_copies)),
    ("secret scans", staged(redact_secrets)),
    ("mixing sources to target weights", staged(mix_sources)),
    ("BPE encoding and decoding", staged(encode)),
]

#: Learned models, hashed fingerprints and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
