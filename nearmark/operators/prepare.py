"""Job 1 operators: degree filters, dense ids, the per-user split, counts.

Interactions are (u, i) BIGINT frames. Degrees are grouped counts (partial
aggregation before the shuffle), filters are anti-joins with the keys below a
degree where these are few, semi-joins else, so a heavy user or item never has
to sit in one task. The joins look their keys up in hash tables: the pairs are
not sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.functions.hashing import hash_key
from nearmark.operators.indexing import distinct_rows, ordinal_by_group, sorted_index
from nearmark.session import written

MIN_DEGREE = 10
FEW_KEYS = 1 << 18  # so many keys are given to every task
TRAIN_WEIGHT = 0.8


def _only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``keys``, which has one row for each."""
    return df.join(keys.hint("shuffle_hash"), key, "left_semi")


def _of_degree(df: DataFrame, key: str, min_degree: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` has at least ``min_degree`` of them. ``df`` is read twice, so it should be cheap to read.

    Where few keys fall below, these are what every task looks up, and the rows stay where they are."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    below = written(n.where(F.col("n") < min_degree).select(key), "below")
    if below.count() <= FEW_KEYS:
        return df.where(F.col(key).isNotNull()).join(F.broadcast(below), key, "left_anti")
    return _only(df, n.where(F.col("n") >= min_degree).select(key), key)


def interaction_stats(df: DataFrame) -> DataFrame:
    """A2: distinct users, distinct items and rows (rows are not de-duplicated)."""
    return df.agg(F.count_distinct("u").alias("n_users"),
                  F.count_distinct("i").alias("n_items"),
                  F.count(F.lit(1)).alias("n_rows"))


def user_degree(df: DataFrame) -> DataFrame:
    """Distinct items per user (nu)."""
    return df.select("u", "i").distinct().groupBy("u").agg(F.count(F.lit(1)).alias("nu"))


def item_degree(df: DataFrame) -> DataFrame:
    """Distinct users per item (ni)."""
    return df.select("u", "i").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("ni"))


def filter_users(df: DataFrame, min_degree: int = MIN_DEGREE) -> DataFrame:
    """Distinct pairs of users with >= ``min_degree`` distinct items. The pairs are read twice, so they are written once."""
    d = written(df.select("u", "i").distinct(), "pairs")
    return _of_degree(d, "u", min_degree)


def interaction_filter(df: DataFrame, min_degree: int = MIN_DEGREE) -> DataFrame:
    """P1 then P2, one pass each (users first; not an iterated k-core)."""
    p1 = filter_users(df, min_degree)  # distinct pairs already
    return _of_degree(p1, "i", min_degree).select("u", "i")


def renumber(df: DataFrame) -> DataFrame:
    """W1 + J1: dense 0-based ids for users and items in key order.

    Returns (u_key, i_key, u, i): the original keys and the new ids. The id
    tables are built by a distributed ``sorted_index`` and joined back. The pairs
    are read three times, so they are written once.
    """
    d = df.select("u", "i").distinct().checkpoint()
    uidx = sorted_index(d.select("u").distinct(), ["u"], name="u_new")
    iidx = sorted_index(d.select("i").distinct(), ["i"], name="i_new")
    out = d.join(uidx, "u").join(iidx, "i")
    return out.select(F.col("u").alias("u_key"), F.col("i").alias("i_key"),
                      F.col("u_new").alias("u"), F.col("i_new").alias("i"))


def split_order_key(seed: int):
    """The per-user shuffle order of the split: md5 of 'u|i|seed' (ties by i)."""
    return F.md5(hash_key(F.col("u"), F.col("i"), seed))


def split_train_valid(df: DataFrame, seed: int = 42, w_train: float = TRAIN_WEIGHT,
                      min_degree: int = MIN_DEGREE, distinct: bool = False) -> DataFrame:
    """W2 + P3: per-user split; the first floor(w*n) items in hash order go to train.

    Users with fewer than ``min_degree`` items vanish from both parts. The
    positions of a user with very many items come from a global sorted index, not a per-user window.
    ``distinct`` says that no pair of ``df`` is repeated.
    Returns (u, i, part) with part in {'train', 'valid'}, written once: both parts are read from it.
    """
    d = written(df.select("u", "i"), "pairs")
    d = d if distinct else written(distinct_rows(d), "distinct")
    o = ordinal_by_group(d, "u", ["_h", "i"], name="_ord", size_name="_n", derived={"_h": split_order_key(seed)})
    o = o.where(F.col("_n") >= min_degree)
    cut = F.floor(F.col("_n") * F.lit(float(w_train)))
    return written(o.select("u", "i", F.when(F.col("_ord") < cut, F.lit("train")).otherwise(F.lit("valid")).alias("part")), "split")


def train_part(split: DataFrame) -> DataFrame:
    return split.where(F.col("part") == "train").select("u", "i")


def valid_part(split: DataFrame) -> DataFrame:
    return split.where(F.col("part") == "valid").select("u", "i")


def warm_test_items(train: DataFrame, test: DataFrame) -> DataFrame:
    """P4 + J13: test pairs whose item occurs in train (users left with none disappear)."""
    items = train.select("i").distinct()
    return _only(distinct_rows(test.select("u", "i")), items, "i").select("u", "i")


def score_to_distance(scores: DataFrame, score_col: str = "sui") -> DataFrame:
    """P5 + P6: d = 1 - s, shifted so that the minimum is 0.

    The minimum is a scalar subquery (no driver round trip, no cross join).
    """
    d = scores.select("u", "i", (F.lit(1.0) - F.col(score_col)).alias("d"))
    mn = d.agg(F.min("d")).scalar()
    return d.select("u", "i", (F.col("d") - mn).alias("d"))


def distance_stats(edges: DataFrame) -> DataFrame:
    """Count, mean, population stdev, max, min of the distances."""
    return edges.agg(F.count(F.lit(1)).alias("count"), F.avg("d").alias("mean"),
                     F.stddev_pop("d").alias("stdev"), F.max("d").alias("max"), F.min("d").alias("min"))


def test_with_used_items(train: DataFrame, test: DataFrame) -> DataFrame:
    """T1 (long form): users in both train and warm test, with every train item
    ('used') and their warm test items ('target'). Columns (u, part, i)."""
    tr = distinct_rows(train.select("u", "i"))
    te = warm_test_items(tr, test)
    users = _only(te.select("u").distinct(), tr.select("u").distinct(), "u")
    used = _only(tr, users, "u").select("u", F.lit("used").alias("part"), "i")
    target = _only(te, users, "u").select("u", F.lit("target").alias("part"), "i")
    return used.unionByName(target)


def used_items_union(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per user, the union of train and test items (distinct pairs)."""
    return distinct_rows(train.select("u", "i").unionByName(test.select("u", "i")))
