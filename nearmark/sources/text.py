"""Pipe-delimited text formats of the reference.

Readers parse with ``split`` + ANSI ``cast``: a malformed id fails the job,
trailing extra fields are ignored. Writers put their result in the place of an
earlier one, once it is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PIPE = r"\|"


def _field(parts, k: int, typ: str):
    # element_at is 1-based and, under ANSI mode, fails on a missing field.
    return F.element_at(parts, k + 1).cast(typ)


# ---- parsers over a ``value`` column (what spark.read.text yields) -------------

def parse_log(lines: DataFrame) -> DataFrame:
    """``t|u|a...`` -> (u, i); the time field is dropped."""
    p = F.split(F.col("value"), _PIPE)
    return lines.select(_field(p, 1, "bigint").alias("u"), _field(p, 2, "bigint").alias("i"))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """``u|i...`` -> (u, i)."""
    p = F.split(F.col("value"), _PIPE)
    return lines.select(_field(p, 0, "bigint").alias("u"), _field(p, 1, "bigint").alias("i"))


def parse_scores(lines: DataFrame) -> DataFrame:
    """S3: ``u|i|s`` -> (u, i, d = 1 - s)."""
    p = F.split(F.col("value"), _PIPE)
    return lines.select(_field(p, 0, "bigint").alias("u"), _field(p, 1, "bigint").alias("i"),
                        (F.lit(1.0) - _field(p, 2, "double")).alias("d"))


# ---- file readers -------------------------------------------------------------

def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_pairs(spark.read.text(path))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return parse_scores(spark.read.text(path))


def read_scored_csv(spark: SparkSession, path: str, headers=("u", "i", "sui")) -> DataFrame:
    """Headerless ``|`` CSV read as strings, then cast explicitly (ANSI: bad cells fail)."""
    raw = spark.read.option("sep", "|").option("header", "false").option("inferSchema", "false").csv(path)
    raw = raw.toDF(*headers)
    types = {"u": "bigint", "i": "bigint", "j": "bigint"}
    return raw.select(*[F.col(h).cast(types.get(h, "double")).alias(h) for h in headers])


# ---- sinks ----------------------------------------------------------------------

def replace_with(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Runs ``write`` on a path beside ``path`` and, once that is whole, puts its result in the place of what ``path`` holds.

    A write that fails leaves the old data as they are. The swap is two renames; a driver lost between them leaves the new data
    whole beside the target and the old ones under ``<path>.old-...``.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    tag = uuid.uuid4().hex
    new, old = (f"{path.rstrip('/')}.{kind}-{tag}" for kind in ("new", "old"))
    target = jvm.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new)
    except BaseException:
        fs.delete(jvm.Path(new), True)
        raise
    there = fs.exists(target)
    if there and not fs.rename(target, jvm.Path(old)):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(jvm.Path(new), target):
        if there:
            fs.rename(jvm.Path(old), target)
        raise OSError(f"cannot move {new} to {path}")
    if there:
        fs.delete(jvm.Path(old), True)



def write_pairs(df: DataFrame, path: str, num_files: int | None = None) -> None:
    """``u|i`` text; ``num_files`` fixes the output file count.

    A file is written by one task, so what this reads is the two numbers of a pair; the text is made behind the exchange."""
    out = df.select("u", "i")
    if num_files:
        out = out.repartition(num_files)
    out = out.select(F.concat_ws("|", F.col("u").cast("string"), F.col("i").cast("string")).alias("value"))
    replace_with(df.sparkSession, path, out.write.text)


def write_scores(df: DataFrame, path: str) -> None:
    """Headerless ``|`` CSV of the frame's columns."""
    replace_with(df.sparkSession, path, df.write.option("sep", "|").option("header", "false").csv)


def format_positions(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.concat(F.col(id_col).cast("string"), F.lit(":"),
                              F.concat_ws(",", F.transform(vec_col, lambda x: x.cast("string")))).alias("value"))


def write_positions(df: DataFrame, path: str, id_col: str = "id", vec_col: str = "p", num_files: int = 8) -> None:
    """``id:x1,x2,...`` text in ``num_files`` files."""
    replace_with(df.sparkSession, path, format_positions(df, id_col, vec_col).repartition(num_files).write.text)


def read_positions(spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "p") -> DataFrame:
    lines = spark.read.text(path)
    parts = F.split(F.col("value"), ":")
    return lines.select(F.element_at(parts, 1).cast("bigint").alias(id_col),
                        F.transform(F.split(F.element_at(parts, 2), ","), lambda x: x.cast("double")).alias(vec_col))


def write_test_set(df: DataFrame, path: str, num_files: int | None = None) -> None:
    """S8 in long form, ``u|part|i`` with part used or target: a user with very many items stays many rows."""
    out = df.select(F.concat_ws("|", F.col("u").cast("string"), "part", F.col("i").cast("string")).alias("value"))
    if num_files:
        out = out.repartition(num_files)
    replace_with(df.sparkSession, path, out.write.text)


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.col("value"), _PIPE)
    return spark.read.text(path).select(_field(p, 0, "bigint").alias("u"), _field(p, 1, "string").alias("part"),
                                        _field(p, 2, "bigint").alias("i"))
