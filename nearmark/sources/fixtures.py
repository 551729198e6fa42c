"""Bindings from the driver's parquet tables to the pipeline's inputs.

The TPC-H-like tables stand in for usage logs:
  cust_part   u = o_custkey, i = l_partkey   (filters, split, similarity)
  cust_supp   u = o_custkey, i = l_suppkey   (scoring and ranking: few items)
  raw log     'shipdate|custkey|partkey' lines, one per line item (not distinct)
  vectors     embeddings(vec_id, embedding) with id -> vec_id = id % (#embeddings)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.operators.indexing import tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _order_lines(spark: SparkSession, sf_dir: str, item_col: str, extra=()) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", item_col, *extra)
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # as many tasks as the line items ask for, and nothing sorted
    n = tasks_for(spark, li.count())
    li, od = li.repartition(n, "l_orderkey"), od.repartition(n, "o_orderkey")
    return li.join(od.hint("shuffle_hash"), li.l_orderkey == od.o_orderkey)


def usage_rows(spark: SparkSession, sf_dir: str, item: str = "part") -> DataFrame:
    """(u, i) per line item, duplicates kept."""
    item_col = {"part": "l_partkey", "supp": "l_suppkey"}[item]
    j = _order_lines(spark, sf_dir, item_col)
    return j.select(F.col("o_custkey").alias("u"), F.col(item_col).alias("i"))


def pairs(spark: SparkSession, sf_dir: str, item: str = "part") -> DataFrame:
    """Distinct (u, i) interactions."""
    n = tasks_for(spark, table(spark, sf_dir, "lineitem").count())
    return usage_rows(spark, sf_dir, item).repartition(n, "u", "i").distinct()


def cust_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, "part")


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, "supp")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log as text lines ``t|u|a`` in a ``value`` column (what spark.read.text gives)."""
    j = _order_lines(spark, sf_dir, "l_partkey", extra=("l_shipdate",))
    return j.select(F.concat_ws("|", F.col("l_shipdate").cast("string"),
                                F.col("o_custkey").cast("string"),
                                F.col("l_partkey").cast("string")).alias("value"))


def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs as text ``u|i|s`` (s = the line's discount), one per line item."""
    j = _order_lines(spark, sf_dir, "l_partkey", extra=("l_discount",))
    return j.select(F.concat_ws("|", F.col("o_custkey").cast("string"),
                                F.col("l_partkey").cast("string"),
                                F.col("l_discount").cast("string")).alias("value"))


def vectors(spark: SparkSession, sf_dir: str, ids: DataFrame, id_col: str, out_col: str) -> DataFrame:
    """Attach an ARRAY<DOUBLE> position to each id: the embedding ``id % n_embeddings``.

    The modulus is a scalar subquery, so nothing goes through the driver; the
    embedding table joins on an equi-key and Spark sizes the join itself.
    """
    emb = table(spark, sf_dir, "embeddings")
    n = emb.agg(F.count(F.lit(1))).scalar()
    keyed = ids.withColumn("_vec", F.pmod(F.col(id_col), n))
    e = emb.select(F.col("vec_id").alias("_vec"),
                   F.transform("embedding", lambda x: x.cast("double")).alias(out_col))
    return keyed.join(e, "_vec").drop("_vec")
