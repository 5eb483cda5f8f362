"""From raw documents to token ids: five stages, each one operator's decisions in effect.

Every stage works on all rows that the one before it kept. All but the last return the columns of
``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kittally.llm import bpe, decontam, lines, quality, simhash
from kittally.llm.common import table
from kittally.session import cut

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay unless the rule ensemble rejects them (operator 8); a null key is never rejected."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    rejected = scored.where("predicted = 0").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches leave the texts (operator 1); all documents stay."""
    done = lines.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest key (operator 3)."""
    lost = simhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of a benchmark item go (operator 2), each judged by its own text."""
    leaked = decontam.row_leaks(docs, table(spark, sf_dir, "benchmark")).select("row").distinct()
    return docs.withColumn("row", decontam.row_of("doc_id", "text")).join(leaked, "row", "left_anti").select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each text, and whether they decode to it again (operator 6)."""
    done = bpe.round_trip(docs, TOKENIZER)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
