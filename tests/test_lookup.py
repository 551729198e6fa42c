"""Slot tables: lookups give the wanted rows and read only their slots; sinks keep the old data when a write fails."""

import pytest
from pyspark.sql import functions as F

from nearmark.operators.lookup import SlotTable, paged
from nearmark.sources import text


def scanned(df):
    """Rows that the file scans of a run of ``df`` put out, from Spark's own metrics."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        for name in ("executedPlan", "plan"):
            if node.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage"):
                try:
                    todo.append(getattr(node, name)())
                    break
                except Exception:
                    continue
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return rows


def test_lookups_scan_what_the_keys_ask_for(spark):
    table = SlotTable.write(spark.range(40_000).select(F.col("id").alias("u"), (F.col("id") * 2).alias("v")), ["u"], slot_rows=100)
    assert table.slots == 400 and table.all().count() == 40_000
    for n in (1, 4, 16):
        wanted = spark.createDataFrame([(k * 1777,) for k in range(n)], "u bigint")
        assert sorted(map(tuple, table.join(wanted).collect())) == [(k * 1777, k * 3554) for k in range(n)]
        assert n <= scanned(table.of(wanted)) <= n * 170  # slots hold 100 rows on average
    assert table.join(spark.createDataFrame([], "u bigint")).count() == 0
    assert table.join(spark.createDataFrame([(-1,)], "u bigint"), "left").collect() == [(-1, None)]


def test_a_table_without_rows(spark):
    table = SlotTable.write(spark.range(0).select(F.col("id").alias("u")), ["u"])
    assert table.slots == 1 and table.join(spark.createDataFrame([(1,)], "u bigint")).count() == 0


def test_pages_hold_a_long_group_in_order(spark):
    rows = [(1, k, k * k) for k in range(25)] + [(2, 0, 7)]
    got = {(r.u, r.page): r.x for r in paged(spark.createDataFrame(rows, "u bigint, ord bigint, x bigint").repartition(5), ["u"], "ord", ["x"], 10).collect()}
    assert got == {(1, p): [k * k for k in range(p * 10, min(25, p * 10 + 10))] for p in range(3)} | {(2, 0): [7]}


def test_a_failed_write_keeps_the_old_data(spark, tmp_path):
    path = str(tmp_path / "pairs")
    good = spark.createDataFrame([(1, 2), (3, 4)], "u bigint, i bigint")
    bad = good.withColumn("i", F.when(F.col("u") == 3, F.raise_error(F.lit("broken row")).cast("bigint")).otherwise(F.col("i")))
    text.write_pairs(good, path)
    for write in (text.write_pairs, text.write_scores):
        with pytest.raises(Exception, match="broken row"):
            write(bad, path)
        assert sorted(map(tuple, text.read_pairs(spark, path).collect())) == [(1, 2), (3, 4)]
    text.write_pairs(good.limit(1), path, num_files=1)
    assert text.read_pairs(spark, path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["pairs"]
