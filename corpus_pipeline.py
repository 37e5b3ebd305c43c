"""A training-data pipeline over the documents table: five stages, each stored and read again by the next one.

Documents without a sure language go, one document of each group of near copies stays, secrets are masked, sources are
mixed to their target shares, and the mix is encoded to token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from handbook_spark.llm import byte_bpe, language, mixing, part_enum, secrets
from handbook_spark.llm.queries import fold, tokenizer_file
from handbook_spark.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure; a missing language is filled in."""
    learned = language.learn(docs.select("doc_id", "text", "lang"), fold("doc_id", 4) != 2)
    found = language.identify(docs, learned, *COLUMNS).filter(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component; documents without id stay."""
    docs = docs.select(*COLUMNS)
    kept = part_enum.near_copies(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    found = docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
    return found.withColumn("row", one).filter("row = 1").select(*COLUMNS).union(docs.filter("doc_id IS NULL"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    found = secrets.scan_documents(docs, "doc_id", "lang", "source", "n_chars")
    masked = F.size("spans") > 0
    return found.withColumnRenamed("clean", "text").withColumn(
        "n_chars", F.when(masked, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, those of sources with large targets twice; a cut text is shorter."""
    mixed = mixing.mixed_documents(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the hashes of the ids and of the text that they decode to."""
    return byte_bpe.digests(docs, tokenizer_file("byte_bpe_50k.json"), "doc_id", "lang", "source", with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("bpe_encoding", encode),
]

#: Compression, signature joins and token ids have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
