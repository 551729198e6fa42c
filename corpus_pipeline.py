"""The corpus pipeline: documents to training sequences.

Each stage gets what the one before kept, written and read again as Parquet, and all but the last return the columns of
documents: quality rules drop documents, line dedup takes lines that an earlier document holds out of their text, one document
of each group of near-duplicates stays, secrets are replaced in the text, and packing makes the pieces of training sequences.

Null and empty texts have no words, so the quality rules drop them; later stages, given such rows, keep them (as empty texts
where they write text). Null ids, languages and sources are carried on; rows with a null id count as one document in line dedup.
Repeated rows fall together in near-dedup, ties go to the smallest id. Columns other than those of documents are left out,
whatever their names. An empty table passes all stages and ends as no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.llm import divergence, linededup, neardup, packing, secrets
from nearmark.llm.registry import vocabulary
from nearmark.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return divergence.keep(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs, "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan),
          ("packing", pack_sequences)]
#: SQL can't say what the stages do; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a folder; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
