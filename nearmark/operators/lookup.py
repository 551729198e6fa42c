"""Point lookups in large written tables: rows dealt into slots by their key, of which a lookup reads only those asked for.

A table is written as Parquet with a folder for each slot, slot = hash of the key modulo their number, which follows from the
number of rows. A lookup gathers the slots of the wanted keys and reads these folders only (partition pruning), so what is
scanned follows the number of wanted keys, not the size of the table. The slots that go through the driver are at most as many as the wanted
keys and as ``MOST_SLOTS``.

``paged`` turns long sorted groups into rows of ``PAGE`` entries, so that a group of any size is many rows with keys of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.session import scratch_path

PAGE = 1024
SLOT_ROWS, MOST_SLOTS = 4096, 65536


def slot_of(keys: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slots_for(rows: int, slot_rows: int = SLOT_ROWS) -> int:
    return min(MOST_SLOTS, max(1, -(-rows // slot_rows)))


@dataclass
class SlotTable:
    """A table in slots by the hash of ``keys``."""
    path: str
    keys: list[str]
    slots: int
    schema: str
    rows: DataFrame  # with the column _slot

    @classmethod
    def write(cls, df: DataFrame, keys: list[str], slot_rows: int = SLOT_ROWS, path: str | None = None, slots: int | None = None) -> SlotTable:
        """Writes ``df``; without a number of ``slots`` twice: as it comes, to know its size, and dealt into slots."""
        spark = df.sparkSession
        path = path or scratch_path(spark, "slots")
        if slots is None:
            df.write.parquet(f"{path}-flat")
            df = spark.read.schema(df.schema).parquet(f"{path}-flat")
            slots = slots_for(df.count(), slot_rows)
        df.withColumn("_slot", slot_of(keys, slots)).repartition("_slot").write.partitionBy("_slot").parquet(path)
        return cls.read(spark, path, keys, slots, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))

    @classmethod
    def read(cls, spark: SparkSession, path: str, keys: list[str], slots: int, schema: str) -> SlotTable:
        """A table that ``write`` has made; ``schema`` is given, as a table without rows has no file to tell it."""
        return cls(path, keys, slots, schema, spark.read.schema(f"{schema}, _slot int").parquet(path))

    def all(self) -> DataFrame:
        return self.rows.drop("_slot")

    def of(self, wanted: DataFrame) -> DataFrame:
        """The rows of the slots that the rows of ``wanted`` (with the key columns) fall into. ``wanted`` is small and written."""
        slots = [r[0] for r in wanted.select(slot_of(self.keys, self.slots).alias("s")).distinct().collect()]
        return self.rows.where(F.col("_slot").isin(slots) if slots else F.lit(False)).drop("_slot")

    def join(self, wanted: DataFrame, how: str = "inner") -> DataFrame:
        """``wanted`` with the columns of its keys' rows."""
        return wanted.join(self.of(wanted), self.keys, how)


def paged(df: DataFrame, group: list[str], order: str, values: list[str], page: int = PAGE, per_group: list[str] | None = None) -> DataFrame:
    """(group..., page, per_group..., values as arrays): ``page`` consecutive rows of each group by their position ``order`` (0, 1, ...)
    as one row; ``per_group`` columns are the same over a group."""
    per_group = per_group or []
    rows = df.withColumn("page", F.floor(F.col(order) / page).cast("long"))
    sorted_rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    out = rows.groupBy(*group, "page").agg(*[F.first(c).alias(c) for c in per_group], sorted_rows.alias("_rows"))
    return out.select(*group, "page", *per_group, *[F.col(f"_rows.{v}").alias(v) for v in values])
