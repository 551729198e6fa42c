"""Operator 6: reversible line dedup with sharded cuckoo filters over exact reference tables.

``LineStore`` keeps, in a folder that all executors share,

* ``refs``     one row per (line key, block of documents): the ids of the documents of the block that hold the line.
               Their total is the exact reference count of the key; a very common line has a row per block, not per document.
* ``filters``  one row per shard: the tables of its cuckoo filter, in which every key with a reference has one fingerprint.
* ``seen``     keys that the filter knew when they came again. Only these can have two references, so only these are
               counted exactly; a false hit costs a count, never a line.

``insert`` adds documents, ``delete`` takes documents back (references go, and with the last one the fingerprint), and
``clean`` gives documents without the lines that a smaller doc_id holds. After a deletion the lines of the next holder are
back, so the state is the one that inserting only the rest would have given.

A line's key is a 128-bit digest of the line, stripped and in lower case (A-Z). Shards follow a hash of the key and their
number follows the number of different keys, and counts are summed by key before the shards are made: a shard's task gets one
row for each of its keys, about ``KEYS_PER_SHARD``, however long the documents are and however common a line is.

Null or empty text: one empty line. Keys under ``min_chars`` code points never go. Rows with the same doc_id are one
document; null ids are one document that comes last. Of several lines with one key inside a document all stay or all go.
Only the columns doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.llm.common import slices
from nearmark.session import scratch_path

MIN_CHARS = 10
KEYS_PER_SHARD = 1 << 18
NO_ID = (1 << 63) - 1
WHITE = " \t\n\x0b\x0c\r"
UPPER = re.compile("[A-Z]+")


def line_key(line: str) -> str:
    line = line.strip(WHITE)
    return line.lower() if line.isascii() else UPPER.sub(lambda m: m[0].lower(), line)


def line_keys(text: str, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The digest of each line's key, None where the key is too short to count."""
    return [hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=16).digest() if len(k) >= min_chars else None
            for k in map(line_key, text.split("\n"))]


class CuckooFilter:
    """Tables of buckets of four 16-bit fingerprints; a full table is followed by one of twice the size."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @staticmethod
    def load(blob: bytes | None) -> CuckooFilter:
        tables, at = [], 0
        while blob and at < len(blob):
            n = int.from_bytes(blob[at:at + 8], "little")
            tables.append(np.frombuffer(blob, "<u2", 4 * n, at + 8).reshape(n, 4).copy())
            at += 8 + 8 * n
        return CuckooFilter(tables)

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.astype("<u2").tobytes() for t in self.tables)

    @staticmethod
    def _places(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each 16-byte key in a table of n = 2**k buckets."""
        halves = keys.view("<u8").reshape(-1, 2)
        mark = (halves[:, 1] & 0xFFFF).astype(np.uint16)
        mark[mark == 0] = 1
        first = (halves[:, 0] & np.uint64(n - 1)).astype(np.int64)
        return mark, first, CuckooFilter._other(first, mark, n)

    @staticmethod
    def _other(bucket, mark, n: int):
        return bucket ^ (mark.astype(np.int64) * 0x5BD1E995 >> 3 & n - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for t in self.tables:
            mark, a, b = self._places(keys, len(t))
            found |= (t[a] == mark[:, None]).any(1) | (t[b] == mark[:, None]).any(1)
        return found

    def insert(self, keys: np.ndarray) -> None:
        """Adds one fingerprint for each of the keys."""
        size = 1 << max(4, int(len(keys) * 1.2 / 4).bit_length())
        if not self.tables:
            self.tables.append(np.zeros((size, 4), np.uint16))
        rest = self._fill(self.tables[-1], keys)
        while len(rest):
            self.tables.append(np.zeros((max(size, 2 * len(self.tables[-1])), 4), np.uint16))
            rest = self._fill(self.tables[-1], rest)

    def _fill(self, t: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Puts keys into free slots, then by kicking; gives back what found no place."""
        mark, a, b = self._places(keys, len(t))
        left = np.arange(len(keys))
        for bucket in (a, b):  # all keys at once: the r-th key of a bucket takes its r-th free slot
            order = left[np.argsort(bucket[left], kind="stable")]
            at = bucket[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
            free = t[at] == 0
            nth = np.cumsum(free, axis=1)
            fits = rank < nth[:, -1]
            slot = np.argmax((nth == rank[:, None] + 1) & free, axis=1)
            t[at[fits], slot[fits]] = mark[order[fits]]
            left = order[~fits]
        if (t == 0).sum() < 0.05 * t.size:
            return keys[left]
        homeless = []
        for i in left.tolist():
            trail, m, at = [], mark[i], int(b[i])
            for kick in range(200):
                free = np.flatnonzero(t[at] == 0)
                if len(free):
                    t[at, free[0]] = m
                    break
                s = (kick + int(m)) % 4
                trail.append((at, s, t[at, s]))
                m, t[at, s] = t[at, s], m
                at = int(self._other(np.int64(at), np.int64(m), len(t)))
            else:
                for at, s, old in reversed(trail):  # as it was, so that no other key is lost
                    t[at, s] = old
                homeless.append(i)
        return keys[homeless]

    def remove(self, keys: np.ndarray) -> None:
        """Takes one fingerprint of each key out; the keys must have been inserted.

        A key whose fingerprint stands in several tables stays: which of them is its own can't be told, and another key's may
        not go. That costs false hits only.
        """
        found = np.zeros((len(self.tables), len(keys)), bool)
        for k, t in enumerate(self.tables):
            mark, a, b = self._places(keys, len(t))
            found[k] = (t[a] == mark[:, None]).any(1) | (t[b] == mark[:, None]).any(1)
        found &= found.sum(0) == 1
        for t, here in zip(self.tables, found, strict=True):
            mark, a, b = self._places(keys, len(t))
            left = np.flatnonzero(here)
            while len(left):  # of the keys that point to one slot the first takes it, the others look again
                hits = np.concatenate([t[a[left]], t[b[left]]], axis=1) == mark[left, None]
                slot = hits.argmax(1)
                place = np.where(slot < 4, a[left], b[left]) * 4 + slot % 4
                has = np.flatnonzero(hits.any(1))
                first = has[np.unique(place[has], return_index=True)[1]]
                if not len(first):
                    break
                t.reshape(-1)[place[first]] = 0
                left = np.delete(left, first)


def as_keys(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 16) if len(column) else np.zeros((0, 16), np.uint8)


def _ids(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


class LineStore:
    """Lines of documents under ``path``; see the module's text. ``shards`` is fixed by the first insertion."""

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None, min_chars: int = MIN_CHARS):
        self.spark, self.path, self.shards, self.min_chars = spark, path, shards, min_chars
        self.written = 0
        self.tables: dict[str, list[str]] = {"refs": [], "filters": [], "seen": []}  # the folders that make up each table

    def _write(self, df: DataFrame) -> str:
        self.written += 1
        df.write.parquet(path := f"{self.path}/{self.written}")
        return path

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = self.tables[table]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def refs(self) -> DataFrame:
        """The exact references."""
        return self._read("refs", "key binary, docs array<bigint>")

    def filters(self) -> DataFrame:
        return self._read("filters", "shard int, filter binary")

    def seen(self) -> DataFrame:
        return self._read("seen", "key binary")

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def _references(self, docs: DataFrame) -> DataFrame:
        min_chars = self.min_chars

        def run(batches):
            for b in slices(batches):
                held: dict[bytes, dict[int, None]] = {}
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    for k in line_keys(text, min_chars):
                        if k is not None:
                            held.setdefault(k, {})[doc] = None
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()),
                                                  pa.array([list(d) for d in held.values()], pa.list_(pa.int64()))], ["key", "docs"])

        return _ids(docs).mapInArrow(run, "key binary, docs array<bigint>")

    def insert(self, docs: DataFrame) -> LineStore:
        """Adds documents whose ids the store doesn't hold."""
        fresh = self._write(self._references(docs))
        counts = self.spark.read.parquet(self._write(self.spark.read.parquet(fresh).groupBy("key").agg(F.sum(F.size("docs")).alias("n"))))
        if self.shards is None:
            self.shards = max(8, -(-counts.count() // KEYS_PER_SHARD))

        def run(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.load(before["filter"].iloc[0] if len(before) else None)
            keys = as_keys(rows["key"])
            known = f.contains(keys)
            f.insert(np.ascontiguousarray(keys[~known]))
            again = rows["key"][known | (rows["n"].to_numpy() > 1)].tolist()
            shard = int((rows if len(rows) else before)["shard"].iloc[0])
            return pd.DataFrame({"shard": shard, "key": [*again, None], "filter": [None] * len(again) + [f.dump()]})

        new = counts.select(self._shard(), "key", "n")
        ran = self._write(new.groupBy("shard").cogroup(self.filters().groupBy("shard"))
                          .applyInPandas(run, "shard int, key binary, filter binary"))
        self.tables["refs"].append(fresh)
        self.tables["filters"] = [self._write(self.spark.read.parquet(ran).where("filter is not null").select("shard", "filter"))]
        self.tables["seen"].append(self._write(self.spark.read.parquet(ran).where("key is not null").select("key")))
        return self

    def delete(self, docs: DataFrame) -> LineStore:
        """Takes the documents with these doc_ids back.

        A key in ``seen`` may have come in under another key's fingerprint, so its own stays: that costs false hits only.
        """
        gone = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc")).distinct()
        each = self.refs().select("key", F.explode("docs").alias("doc"))
        touched = each.join(gone, "doc", "left_semi").select("key").distinct()
        rest = each.join(touched, "key", "left_semi").join(gone, "doc", "left_anti")
        rest = self._write(rest.select("key", F.array("doc").alias("docs")))
        dead = touched.join(self.spark.read.parquet(rest).select("key"), "key", "left_anti").join(self.seen(), "key", "left_anti") \
            .select(self._shard(), "key")
        kept = self._write(self.refs().join(touched, "key", "left_anti").select("key", "docs"))

        def run(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.load(before["filter"].iloc[0] if len(before) else None)
            f.remove(as_keys(rows["key"]))
            return pd.DataFrame({"shard": [int((before if len(before) else rows)["shard"].iloc[0])], "filter": [f.dump()]})

        filters = self._write(dead.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(run, "shard int, filter binary"))
        self.tables["refs"], self.tables["filters"] = [kept, rest], [filters]
        return self

    def shared(self) -> DataFrame:
        """(key, owner) of the keys that at least two documents hold; owner is the smallest of them."""
        seen = self.seen().distinct()
        return self.refs().join(seen, "key", "left_semi").groupBy("key") \
            .agg(F.min(F.array_min("docs")).alias("owner"), F.max(F.array_max("docs")).alias("last")) \
            .where("owner < last").select("key", "owner")

    def losses(self) -> DataFrame:
        """(doc_id, keys) of the documents that lose lines."""
        shared = self.spark.read.parquet(self._write(self.shared()))
        lost = self.refs().join(shared, "key").select("key", "owner", F.explode("docs").alias("doc_id"))
        return lost.where("doc_id <> owner").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def clean(self, docs: DataFrame, *more: str) -> DataFrame:
        """(doc_id, kept text, n_lines, n_dropped, *more) for each row of docs, of documents that the store holds."""
        min_chars = self.min_chars

        def run(batches):
            for b in slices(batches):
                out = []
                for text, gone in zip(b.column("text").to_pylist(), b.column("keys").to_pylist(), strict=True):
                    lines = text.split("\n")
                    kept = lines
                    if gone:
                        gone = set(gone)
                        kept = [x for x, k in zip(lines, line_keys(text, min_chars), strict=True) if k not in gone]
                    out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
                text, n, dropped = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string()), pa.array(n, pa.int64()),
                                                  pa.array(dropped, pa.int64()), *[b.column(c) for c in more]],
                                                 ["doc_id", "text", "n_lines", "n_dropped", *more])

        rows = _ids(docs, *more)
        kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
        out = rows.join(self.losses(), "doc_id", "left").select("doc_id", "text", "keys", *more) \
            .mapInArrow(run, f"doc_id bigint, text string, n_lines bigint, n_dropped bigint{kinds}")
        return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def dedup_lines(docs: DataFrame, *more: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """``LineStore.clean`` of documents put into a new store."""
    spark = docs.sparkSession
    return LineStore(spark, scratch_path(spark, "lines"), min_chars=min_chars).insert(docs).clean(docs, *more)


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
