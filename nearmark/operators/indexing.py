"""Dense, gap-free 0-based positions over a total order, without a global window.

A ``row_number()`` over an unpartitioned window runs in one task. Here the rows
are range-partitioned on the sort key (so one heavy key value still spreads
over many tasks), numbered inside each partition, and shifted by the row
counts of the partitions before them. The only small table is one row per
partition, which is broadcast.

How many partitions there are follows from the number of rows (``tasks_for``): a fixed number would give tasks that grow with
the data, and so do the partitions that adaptive execution joins by their compressed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


TASK_ROWS, FEW_ROWS = 1 << 19, 1 << 16
GROUP_ROWS = 1 << 17  # a larger group is numbered by many tasks


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of at most ``TASK_ROWS`` rows; of a small number of rows as many as the session asks for, ``FEW_ROWS`` rows in each at least."""
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // TASK_ROWS), min(asked, -(-rows // FEW_ROWS)))


def distinct_rows(df: DataFrame) -> DataFrame:
    """The different rows of ``df``, in tasks of a bounded number of rows. ``df`` is read twice, so it should be cheap to read."""
    return df.repartition(tasks_for(df.sparkSession, df.count()), *df.columns).distinct()


def sorted_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` order.

    ``order_cols`` must be unique per row, so positions are deterministic.
    Eager: the range-partitioned rows are checkpointed to the shared folder, and before that, if ``num_partitions`` is not
    given, the rows as they come.
    """
    tagged = _ranged(df, order_cols, num_partitions)
    # monotonically_increasing_id = (partition << 33) + row position in the partition
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    out = tagged.join(F.broadcast(_offsets(tagged, F.lit(1))), "_pid")
    return out.withColumn(name, F.col("_off") + local).drop("_pid", "_mid", "_off")


def _ranged(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """df sorted over the cluster, with _pid (partition) and _mid (rising within it), written once.

    What is counted per partition and the rows themselves must come from ONE range partitioning: two evaluations may sample
    different bounds (column pruning keeps Spark from reusing the exchange). A reliable checkpoint fixes the partition contents
    once, also across executor loss. The sort reads the rows twice (once to sample its bounds). Without ``num_partitions`` they
    are written before that, and their number gives that of the partitions.
    """
    if num_partitions is None:
        df = df.checkpoint()
        num_partitions = tasks_for(df.sparkSession, df.count())
    ranged = df.repartitionByRange(num_partitions, *order_cols).sortWithinPartitions(*order_cols)
    return ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()


def _offsets(tagged: DataFrame, weight) -> DataFrame:
    """(_pid, _off): the weight of all partitions before each. One row per partition: a window over it is tiny, and so is its
    broadcast."""
    counts = tagged.groupBy("_pid").agg(F.sum(weight).cast("bigint").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("_pid", F.coalesce(before, F.lit(0)).alias("_off"))


def flagged_before(df: DataFrame, group_col: str, order_cols: list[str], flag: str, name: str) -> DataFrame:
    """The rows without ``flag``, with ``name`` = how many flagged rows of their group stand before them in the order.

    A running count over one sorted table: inside each sorted part by a window, across parts by their totals. No group needs
    to fit into a task.
    """
    tagged = _ranged(df, [group_col, *order_cols])
    one = F.col(flag).cast("bigint")
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = tagged.withColumn("_in", F.sum(one).over(inside)).join(F.broadcast(_offsets(tagged, one)), "_pid")
    run = run.withColumn("_run", F.col("_off") + F.col("_in"))
    starts = run.groupBy(group_col).agg(F.min(F.col("_run") - one).alias("_start"))
    return run.where(~F.col(flag)).join(starts.hint("shuffle_hash"), group_col).withColumn(name, F.col("_run") - F.col("_start")) \
        .drop("_pid", "_mid", "_in", "_off", "_run", "_start", flag)


def ordinal_within(df: DataFrame, group_col: str, order_cols: list[str], name: str = "ord",
                   size_name: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its ``group_col`` group, in ``order_cols`` order.

    Built from one global ``sorted_index`` over (group, order...) minus the
    group's first position, so a group holding a third of all rows is still
    numbered by many tasks. Optionally adds the group size.
    """
    idx = sorted_index(df, [group_col, *order_cols], name="_gidx", num_partitions=num_partitions)
    aggs = [F.min("_gidx").alias("_start")]
    if size_name:
        aggs.append(F.count(F.lit(1)).alias(size_name))
    starts = idx.groupBy(group_col).agg(*aggs)
    return (idx.join(starts.hint("shuffle_hash"), group_col)
            .withColumn(name, F.col("_gidx") - F.col("_start"))
            .drop("_gidx", "_start"))


def ordinal_by_group(df: DataFrame, group_col: str, order_cols: list[str], name: str = "ord", size_name: str = "n",
                     derived: dict[str, Column] | None = None, sizes: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """What ``ordinal_within`` gives, with the group size, for many groups of which few or none are large: rows go to the task of
    their group and are numbered there, one exchange and one sort. The groups of more than ``most`` rows are numbered by
    ``ordinal_within``, so that no group grows a task.

    Columns in ``derived`` are computed behind the exchange. ``sizes`` are the groups with their numbers of rows (_n), if known.
    ``df`` is read several times, so it should be written.
    """
    most, derived = most or GROUP_ROWS, derived or {}
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes
    large = sizes.where(F.col("_n") > most).select(group_col).checkpoint()
    one = Window.partitionBy(group_col).orderBy(*order_cols)
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of the other: one pass for both

    def numbered(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col(group_col).isNotNull()).repartition(tasks_for(df.sparkSession, df.count()), group_col)
        return rows.withColumns(derived).withColumns({name: F.row_number().over(one).cast("bigint") - 1, size_name: F.count(F.lit(1)).over(whole)})

    if large.isEmpty():
        return numbered(df)
    return numbered(df.join(F.broadcast(large), group_col, "left_anti")).unionByName(ordinal_within(
        df.join(F.broadcast(large), group_col, "left_semi").withColumns(derived), group_col, order_cols, name, size_name))
