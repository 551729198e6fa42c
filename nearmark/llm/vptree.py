"""Operator 9: nearest neighbours by cosine, with a vantage-point tree per shard.

Vectors are dealt into shards of about ``SHARD`` rows by a hash of their id. Each shard becomes one row of the index table: its
distinct vectors, scaled to length one, and a tree over them. A node has a vantage point and the median distance from it;
nearer points are inside, the others outside. Queries go down in blocks, all queries of a block at once: the near side
first, the far side only if ``|d - median| <= factor * r`` for the distance r of the k-th best so far. That is the triangle
inequality for ``factor`` 1 (exact search); a smaller factor prunes more and may miss. Neighbours of length-one vectors by
distance are those by cosine. Distances are kept squared and compared with the slack of ``slack``, a bound of their rounding
(near 0 a root would blow it up), so vectors of one direction are all candidates of each other. The candidates of all shards are scored again on the original vectors in double precision.

A task holds one shard and one block of ``QUERY_BLOCK`` queries. Equal vectors are one point of the tree with its smallest
ids, so a very common vector costs nothing and ties go to smaller ids.

Vectors that are null, empty or zero or have null or non-finite components take no part, nor do rows without an id; rows
with one id count once (the smallest vector); vectors of another length than the query's are not its candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearmark.session import scratch_path

SHARD, QUERY_BLOCK, LEAF = 16384, 8192, 256

def slack(dim: int) -> float:
    """Twice the most by which a computed squared distance can differ from 2 - 2 * (the score that ``cosine`` computes).

    With unit roundoff u = eps / 2: a dot product of length-one vectors is off by dim * u at most, each scaling to length one by
    (dim / 2 + 4) * u, and ``cosine`` by (2 * dim + 5) * u; twice their sum is under (4 * dim + 16) * eps, here with room.
    """
    return (16 * dim + 64) * float(np.finfo(np.float64).eps)



def length_one(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from left to right."""
    fold = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    return fold(a * b) / (np.sqrt(fold(a * a)) * np.sqrt(fold(b * b)))


class VpTree:
    """Over the rows of ``points`` (length one). ``nodes`` rows: first, last, vantage point, squared radius, inside, outside; the
    points of a leaf (vantage -1) are order[first:last]."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.nodes = points, []
        self.order = np.arange(len(points))
        rng = np.random.default_rng(3)

        def build(lo: int, hi: int) -> int:
            at = len(self.nodes)
            self.nodes.append([lo, hi, -1, 0.0, -1, -1])
            if hi - lo <= leaf:
                return at
            pick = lo + int(rng.integers(hi - lo))
            self.order[[lo, pick]] = self.order[[pick, lo]]
            rest = self.order[lo + 1:hi]
            d = self.distance(self.points[self.order[lo]][None], rest)[0]
            half = len(rest) // 2
            by = np.argpartition(d, half)
            self.order[lo + 1:hi] = rest[by]
            self.nodes[at][2:4] = [int(self.order[lo]), float(d[by[half]])]
            self.nodes[at][4] = build(lo + 1, lo + 1 + half)
            self.nodes[at][5] = build(lo + 1 + half, hi)
            return at

        if len(points):
            build(0, len(points))

    def distance(self, queries: np.ndarray, rows) -> np.ndarray:
        """Squared."""
        return np.maximum(2 - 2 * (queries @ self.points[rows].T), 0)

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, point) pairs of the k nearest points of each query, with near ties of the last; distances computed."""
        more = slack(self.points.shape[1])
        best = np.full((len(queries), k), np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        work = 0

        def meet(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
            nonlocal work
            d = self.distance(queries[q], rows)
            work += d.size
            best[q] = np.sort(np.concatenate([best[q], np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]], axis=1), axis=1)[:, :k]
            x, y = np.nonzero(d <= best[q][:, -1:] + more)
            found.append((q[x], rows[y], d[x, y]))
            return d

        def visit(node: int, q: np.ndarray) -> None:
            lo, hi, vantage, radius, inside, outside = self.nodes[node]
            if not len(q):
                return
            if vantage < 0:
                meet(q, self.order[lo:hi])
                return
            d = meet(q, np.array([vantage]))[:, 0]
            near = d < radius
            # the least distance of the query from points of the far side
            gap = np.sqrt(np.maximum(np.maximum(d, radius) - more, 0)) - np.sqrt(np.minimum(d, radius) + more)
            for mine, first, second in ((near, inside, outside), (~near, outside, inside)):
                visit(first, q[mine])
                visit(second, q[mine][gap[mine] <= factor * np.sqrt(best[q[mine], -1] + 2 * more)])

        if len(self.points):
            visit(0, np.arange(len(queries)))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), work
        q, p, d = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = d <= best[q, -1] + more
        return q[keep], p[keep], work


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where("vec_id is not null and v is not null and size(v) > 0").where(finite & F.exists("v", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame, k: int, leaf: int = LEAF, shard_rows: int = SHARD) -> DataFrame:
    """One row per shard and vector length: dim, shard, ids and vectors of the distinct points, and the tree.

    ``vectors`` as ``valid`` gives them. Of equal vectors the k + 1 smallest ids are kept: a query's own and k more.
    """
    shards = max(1, -(-vectors.count() // shard_rows))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x, ids = np.stack(group["v"].to_numpy()), group["vec_id"].to_numpy()
        _, which = np.unique(x, axis=0, return_inverse=True)
        which = which.ravel()
        first = np.full(which.max() + 1, -1)
        first[which[::-1]] = np.arange(len(which))[::-1]
        order = np.argsort(which, kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(which[order], which[order], "left")
        order = order[rank <= k]
        points = x[first]
        tree = VpTree(length_one(points), leaf)
        nodes = np.array(tree.nodes, np.float64)
        return pd.DataFrame({"dim": [x.shape[1]], "shard": [int(group["shard"].iloc[0])], "points": [points.tobytes()],
                             "ids": [ids[order].astype(np.int64).tobytes()], "owner": [which[order].astype(np.int64).tobytes()],
                             "tree_order": [tree.order.astype(np.int64).tobytes()], "nodes": [nodes.tobytes()]})

    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return rows.groupBy("dim", "shard").applyInPandas(
        run, "dim int, shard int, points binary, ids binary, owner binary, tree_order binary, nodes binary")


def load_tree(row) -> tuple[VpTree, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of an index row, its original points, and (ids, owner) in order of owner."""
    points = np.frombuffer(row["points"]).reshape(-1, row["dim"])
    tree = VpTree.__new__(VpTree)
    tree.points = length_one(points)
    tree.order = np.frombuffer(row["tree_order"], np.int64)
    tree.nodes = [[int(a), int(b), int(c), r, int(i), int(o)] for a, b, c, r, i, o in np.frombuffer(row["nodes"]).reshape(-1, 6)]
    return tree, points, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owner"], np.int64)


def search(index: DataFrame, queries: DataFrame, k: int, factor: float = 1.0, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query but itself. ``queries`` as ``valid`` gives them."""
    blocks = max(1, -(-queries.count() // query_block))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shards = index.select("dim", "shard")
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    right = right.join(shards, "dim").select(*[F.col(c).alias(f"q_{c}") for c in ("vec_id", "v", "dim", "shard", "block")])

    def run(tree_row: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if not len(tree_row) or not len(mine):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        tree, points, ids, owner = load_tree(tree_row.iloc[0])
        x, own = np.stack(mine["q_v"].to_numpy()), mine["q_vec_id"].to_numpy()
        q, p, _ = tree.search(length_one(x), k + 1, factor)
        score = cosine(x[q], points[p])
        lo, hi = np.searchsorted(owner, p, "left"), np.searchsorted(owner, p, "right")
        each = np.repeat(np.arange(len(q)), hi - lo)
        at = np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]
        out = pd.DataFrame({"query_id": own[q[each]], "vec_id": ids[at], "score": score[each]})
        out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return out.groupby("query_id").head(k)

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("q_dim", "q_shard", "q_block")) \
        .applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int, factor: float = 1.0) -> DataFrame:
    """Builds the index of all vectors in the shared folder and searches it for those where ``is_query`` (of vec_id) holds."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "vptree")
    rows = valid(vectors).checkpoint()
    build_index(rows, k).write.parquet(path)
    return search(spark.read.parquet(path), rows.where(is_query), k, factor)
