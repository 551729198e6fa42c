"""The three jobs of the pipeline, each a composition of DataFrame operators.

  prepare     raw log -> clean pairs, dense ids, train / valid split
  similarity  train pairs -> (u, i, sui) with the chosen method
  train_eval  scored pairs + test pairs -> positions, metrics

Paths are text directories in the reference's formats; every output is
written with overwrite semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.operators import evaluate, prepare, similarity, training
from nearmark.sources import text


def prepare_job(spark: SparkSession, log_dir: str, pairs_dir: str, cv_dir: str, seed: int = 42,
                num_files: int | None = None) -> dict:
    """Job 1. Returns the reported (users, items, rows) counts of each stage."""
    raw = text.read_log(spark, log_dir).checkpoint()  # read again for each stage and statistic
    clean = prepare.interaction_filter(raw).checkpoint()
    ids = prepare.renumber(clean).select("u", "i")
    text.write_pairs(ids, pairs_dir, num_files)
    inter = text.read_pairs(spark, pairs_dir)
    split = prepare.split_train_valid(inter, seed=seed).checkpoint()
    train, valid = prepare.train_part(split), prepare.valid_part(split)
    text.write_pairs(train, f"{cv_dir.rstrip('/')}/train", num_files)
    text.write_pairs(valid, f"{cv_dir.rstrip('/')}/valid", num_files)
    stats = {}
    for name, df in (("raw", raw), ("clean", clean), ("train", train), ("valid", valid)):
        stats[name] = tuple(prepare.interaction_stats(df).first())
    return stats


def similarity_job(spark: SparkSession, train_dir: str, out_dir: str, method: str,
                   alpha: float | None = None) -> str:
    """Job 2: scores written as ``u|i|sui`` under ``out_dir/method``."""
    if method not in similarity.METHODS:
        raise ValueError(f"unknown similarity method {method!r}")
    pairs = text.read_pairs(spark, train_dir)
    scores = similarity.score(pairs, method, alpha)
    target = f"{out_dir.rstrip('/')}/{method}"
    text.write_scores(scores, target)
    return target


def train_eval_job(spark: SparkSession, scores_dir: str, test_dir: str, pos_dir: str,
                   settings: training.Settings, seed: int = 0, ks=evaluate.K_LIST) -> dict:
    """Job 3: train on (u, i, 1 - s) shifted to min 0, evaluate, save positions."""
    edges = prepare.score_to_distance(text.read_scores(spark, scores_dir).select(
        "u", "i", (F.lit(1.0) - F.col("d")).alias("sui")))
    edges = edges.checkpoint()
    stats = prepare.distance_stats(edges).first().asDict()
    test_pairs = text.read_pairs(spark, test_dir)
    test_long = prepare.test_with_used_items(edges.select("u", "i"), test_pairs).checkpoint()
    users, items, history = training.train(edges, test_long, settings, seed)
    counts = evaluate.target_counts(users, items, test_long)  # one scan for all metrics
    report = {
        "distance_stats": stats,
        "history": history,
        "gain": evaluate.rank_gain(users, items, test_long, counts).first()[0],
        "precision_recall": sorted(tuple(r) for r in evaluate.precision_recall_at_k(users, items, test_long, ks, counts).collect()),
        "ranking": tuple(evaluate.ranking_metrics(users, items, test_long, counts).first()),
    }
    text.write_positions(users, f"{pos_dir.rstrip('/')}/user", "u", "w")
    text.write_positions(items, f"{pos_dir.rstrip('/')}/item", "i", "h")
    return report
