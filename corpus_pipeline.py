"""The corpus pipeline: language ID, line dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the
shared folder and hands it, read again, to the next. All stages but the last return documents' columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import lang_id, line_dedup, near_dedup, packing, secrets
from sigloom.llm._common import Stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language is undetermined: it has no letters, or the nearest codewords are an exact tie.
#: Others that language ID flags as ambiguous stay.
LEAST_SCORE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    """Documents' columns, n_chars counted again."""
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Ambiguous ones stay, exact ties go; without a training row, all with letters stay."""
    docs = docs.select(*COLUMNS)
    model = lang_id.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = lang_id.predict(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") > LEAST_SCORE)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.dedup_lines(docs, keep=("lang", "source")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    gone = near_dedup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(secrets.redact_secrets(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL has no byte-level BPE, no trained classifier and no packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stage(spark, "pipeline"), []
    for _, step in STAGES:
        docs = stage.put(step(spark, docs, sf_dir))
        stage.drop(*before)  # the stage after it has been written
        before = [docs]
    return docs
