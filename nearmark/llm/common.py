"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.session import scratch_path


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) with a null text read as empty; other columns go."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], size: int = 16 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        n, lo = batch.num_rows, 0
        if not n:
            continue
        each = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        total = 0
        for i, x in enumerate(each):
            if total and total + x > size:
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += x
        yield batch.slice(lo)


def is_latin(text: str) -> bool:
    """Whether all code points are below 256."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


STEP_ROWS, FEW_FILES = 1 << 17, 8


class Steps:
    """Writes tables of one run to the shared folder and gives them as read: Spark then knows their sizes, keeps no plan or lineage
    of how they were made, and a lost executor costs no earlier step.

    With ``most``, a number of rows that a table doesn't exceed, tasks of up to some ``STEP_ROWS`` rows write it, instead of a file of
    a few rows from each of the session's shuffle partitions.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, scratch_path(spark, name), 0

    def __call__(self, df: DataFrame, most: int | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.base}-{self.n}"
        if most is not None:
            df = df.coalesce(max(FEW_FILES, -(-most // STEP_ROWS)))
        df.write.parquet(path)
        return self.spark.read.parquet(path)
