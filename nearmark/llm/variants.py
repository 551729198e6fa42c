"""Operator 13: spelling variant grouping by dense prefix-suffix tiling.

Words whose spellings differ by one inserted, deleted or replaced code point are near. A word's form is its near word with the
largest count, if that is ``FACTOR`` times its own at least.

1. Words and their counts are summed in the tasks, then over the cluster, and written once.
2. Of two near words of lengths L and L or L + 1, the shorter is cut into segments of about ``GAP`` code points, ``SEGMENTS`` at
   most. The edit touches one segment; what stands before and after it is the same in both. So a word goes, for its length and for
   its length less one, into a bucket for each segment: the hash of the length, the segment's number, and the word without the segment.
3. The words of a bucket are rows of two matrices of code points, padded on the right and padded on the left. Blocks of pairs of
   rows are compared whole: the first difference in the one gives the common prefix, the last in the other the common suffix, and
   if both together reach the longer length less one, the pair is near. A pair counts in the first segment that shows it. Hashes
   that collide only cost a comparison.
4. Near words of a word are counted and the best kept within the tasks, then once more over the cluster.

Buckets are small, as their words differ in a segment only; one of more than ``TILE`` words is dealt into parts, and each pair of
parts is a tile of its own, wherever it is compared. Tasks read sorted tiles as a stream and hold some ``ROWS`` rows. Nothing of
the vocabulary is collected or broadcast.

Null text: no words. A null doc_id draws as an empty one. Repeated rows count each; of near words with equal counts the smaller in code
points is the form. A word longer than any other of its neighbourhood is no special case; its cost grows with its length times ``SEGMENTS``.
An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmark.llm.common import slices, texts_of
from nearmark.llm.neardup import LOWER
from nearmark.session import scratch_path

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST, TWICE, FACTOR, DROP = 7, 2, 10, 31
GAP, SEGMENTS = 2, 8
TILE, ROWS, PAIR_CELLS, HELD = 1024, 16384, 1 << 22, 500_000


def counted_runs(doc_id, text: str, least: int = LEAST) -> dict[str, int]:
    """The words of a text, changed by the draw of the document and the run, with their counts."""
    runs = Counter(x for x in RUN.findall(text.encode("utf-8").translate(LOWER).decode("utf-8")) if len(x) >= least)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: dict[str, int] = {}
    for run, n in runs.items():
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % DROP == 0:
            cut = h % len(run)
            run = run[:cut] + run[cut + 1:]
            if len(run) < least:
                continue
        out[run] = out.get(run, 0) + n
    return out


def words(docs: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """(word, n): the words of ``least`` code points or more that occur ``twice`` or more often in all documents."""

    def frame(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: dict[str, int] = {}
        for b in slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for w, n in counted_runs(doc_id, text, least).items():
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD:
                    yield frame(held)
                    held = {}
        yield frame(held)

    return texts_of(docs).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def bounds(length: int) -> np.ndarray:
    """Where the segments of a word of some length begin, and the length."""
    k = max(1, min(SEGMENTS, -(-length // GAP)))
    return np.array([length * j // k for j in range(k + 1)])


def keyed(table: DataFrame) -> DataFrame:
    """(len, seg, bucket, word, n): each word in the buckets of its own length and of the one below."""
    size = F.length("word")
    rows = table.select("word", "n", F.explode(F.array(size - 1, size)).alias("len")).where("len > 0")
    k = F.greatest(F.lit(1), F.least(F.lit(SEGMENTS), F.ceil(F.col("len") / GAP).cast("int")))
    rows = rows.select("*", k.alias("k"), F.explode(F.sequence(F.lit(0), k - 1)).alias("seg"))

    def cut(j: Column) -> Column:
        return F.floor(F.col("len") * j / F.col("k")).cast("int")

    tail = F.col("len") - cut(F.col("seg") + 1)  # code points after the segment
    bucket = F.xxhash64("len", "seg", F.substring("word", F.lit(1), cut(F.col("seg"))), F.substring("word", F.length("word") - tail + 1, tail))
    return rows.select("len", "seg", bucket.alias("bucket"), "word", "n")


def tiles(rows: DataFrame) -> DataFrame:
    """``rows`` with (i, j, part): the tile of a row and the part of the bucket that it is of. Buckets of one word are left out."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(sizes, "bucket")
    k = F.ceil(F.col("size") / TILE).cast("int")
    rows = rows.withColumn("k", k).withColumn("part", F.pmod(F.xxhash64("word", "bucket"), k).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select("len", "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "seg", "word", "n")


def matrices(some: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words, padded on the right and on the left to ``width``."""
    out = []
    for pad in (str.ljust, str.rjust):
        joined = "".join([pad(w, width, "\0") for w in some])
        try:
            flat = np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        out.append(flat.reshape(len(some), width))
    return out[0], out[1]


def common(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefix and suffix of the rows x and y, up to the padded width."""
    off = left[x] != left[y]
    before = np.where(off.any(axis=1), off.argmax(axis=1), off.shape[1])
    off = (right[x] != right[y])[:, ::-1]
    return before, np.where(off.any(axis=1), off.argmax(axis=1), off.shape[1])


def near_pairs(length: int, tile: np.ndarray, whole: np.ndarray, part: np.ndarray, seg: np.ndarray, some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of near rows of the same tile, which stand together; ``length``: that of the shorter of a pair."""
    left, right = matrices(some, length + 1)
    size = np.array([len(w) for w in some])
    cut = bounds(length)
    end = np.searchsorted(tile, tile, "right")
    each = end - np.arange(len(tile)) - 1
    chunk = (np.cumsum(each) - each) // max(1, PAIR_CELLS // (length + 1))
    for lo, hi in zip(*(np.searchsorted(chunk, np.unique(chunk), side) for side in ("left", "right")), strict=True):
        first = np.arange(lo, hi)
        x = np.repeat(first, each[first])
        y = np.arange(len(x)) - np.repeat(np.cumsum(each[first]) - each[first], each[first]) + x + 1
        go = (np.minimum(size[x], size[y]) == length) & (whole[x] | (part[x] != part[y]))
        x, y = x[go], y[go]
        before, after = common(left, right, x, y)
        before, after = np.minimum(before, length), np.minimum(after, length)
        longer = np.maximum(size[x], size[y])
        go = (before + after >= longer - 1) & ~((size[x] == size[y]) & (before == length))
        go &= np.searchsorted(cut[1:], length - after) == seg[x]
        yield x[go], y[go]


def neighbours(rows: DataFrame) -> DataFrame:
    """(word, near, best): how many near words the tiles show and the best of them as (count below zero, word), in parts."""
    best = pa.struct([("below", pa.int64()), ("word", pa.string())])

    def found(b: pa.Table) -> Iterator[pa.RecordBatch]:
        length, bucket, i, j, part, seg, n = (b.column(c).to_numpy() for c in ("len", "bucket", "i", "j", "part", "seg", "n"))
        some = b.column("word").to_pylist()
        key = np.stack([length, bucket, i, j])
        tile = np.concatenate([[0], np.cumsum(np.any(key[:, 1:] != key[:, :-1], axis=0))])
        pairs = []
        for size in np.unique(length):
            lo, hi = np.searchsorted(length, [size, size + 1])
            at = slice(lo, hi)
            pairs += [(x + lo, y + lo) for x, y in near_pairs(int(size), tile[at], i[at] == j[at], part[at], seg[at], some[lo:hi])]
        x = np.concatenate([p[k] for p in pairs for k in (0, 1)]) if pairs else np.zeros(0, np.int64)
        y = np.concatenate([p[k] for p in pairs for k in (1, 0)]) if pairs else x
        if not len(x):
            return
        rank = np.unique(np.array(some, object), return_inverse=True)[1]
        order = np.lexsort((rank[y], -n[y], rank[x]))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.append(True, rank[x[1:]] != rank[x[:-1]]))
        near = np.diff(np.append(first, len(x)))
        yield pa.RecordBatch.from_arrays([
            pa.array([some[k] for k in x[first]], pa.string()), pa.array(near, pa.int64()),
            pa.StructArray.from_arrays([pa.array(-n[y[first]]), pa.array([some[k] for k in y[first]], pa.string())], fields=list(best))], ["word", "near", "best"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([table.column(c).to_numpy() for c in ("len", "bucket", "i", "j")])
            last = size - 1 - int(np.argmax(np.any(key[:, ::-1] != key[:, -1:], axis=0))) if np.any(key[:, 0] != key[:, -1]) else -1
            yield from found(table.slice(0, last + 1)) if last >= 0 else ()
            held, size = table.slice(last + 1).to_batches(), size - last - 1  # the last tile may go on
        if size:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("len", "bucket", "i", "j")
    return dealt.mapInArrow(run, "word string, near bigint, best struct<below:bigint,word:string>")


def follow(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the last form that can be reached. Counts grow along a chain, so it ends; each round
    doubles the steps taken."""
    spark = links.sparkSession
    while True:
        ahead = links.select(F.col("word").alias("form"), F.col("form").alias("further"))
        path = scratch_path(spark, "variants-roots")
        links.join(ahead, "form", "left").select("word", F.coalesce("further", "form").alias("form"), F.col("further").isNotNull().alias("moved")).write.parquet(path)
        done = spark.read.parquet(path)
        if not done.where("moved").limit(1).count():
            return done.select("word", F.col("form").alias("root"))
        links = done.select("word", "form")


def group(table: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each (word, n) of a table of distinct words."""
    spark = table.sparkSession
    path = scratch_path(spark, "variants")
    table.select("word", "n").write.parquet(f"{path}-words")
    held = spark.read.parquet(f"{path}-words")
    none = F.lit(None).cast("struct<below:bigint,word:string>")
    own = held.select("word", "n", F.lit(0).cast("bigint").alias("near"), none.alias("best"))
    seen = neighbours(tiles(keyed(held))).select("word", F.lit(None).cast("bigint").alias("n"), "near", "best")
    each = own.unionByName(seen).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.below") >= factor * F.col("n")
    each.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.below")).alias("form_n")) \
        .write.parquet(f"{path}-forms")
    forms = spark.read.parquet(f"{path}-forms")
    roots = follow(forms.where("form is not null").select("word", "form"))
    out = forms.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs."""
    return group(words(docs))
