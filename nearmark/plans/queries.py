"""Registered queries: each reads the driver's tables at ``sf_dir`` in full.

Bindings: ``part`` = (o_custkey, l_partkey) pairs, ``supp`` = (o_custkey,
l_suppkey) pairs; ``kc`` = after both degree filters; the split uses seed 42;
positions are the embedding ``id % #embeddings``. Double outputs are rounded
to 6 places (the oracle SQL rounds the same way); vectors are given in long
form (id, k, x) so that they compare as plain rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearmark.functions.vectors import minus, plus
from nearmark.operators import evaluate, prepare, similarity, training, vectors
from nearmark.operators.pairjoin import with_ends
from nearmark.session import ensure_checkpoint_dir, scratch_path, written
from nearmark.sources import fixtures, text

SEED = 42
ALPHA_AA = 1.0
MARGIN = 0.5
LOSS_WEIGHT = 0.5
CLIP_RADIUS = 0.8
DROP_RATIO = 0.3
DROP_SEED = 7
INIT_SEED = 11
INIT_DIM = 8
TOP_K = 10
# one sampled round used by sample_batches / approx_rank / gradient_round / adagrad_round
ROUND = dict(batch_size=200, block_num=4, neg_num=5, seed=5, rnd=0)
ROUND_SETTINGS = training.Settings(learning_rate=0.1, drop_rate=0.0, clip=1.0, margin=MARGIN,
                                   neg_num=ROUND["neg_num"], batch_size=ROUND["batch_size"],
                                   block_num=ROUND["block_num"], loss_weight=LOSS_WEIGHT)
DROPOUT_SETTINGS = dataclasses.replace(ROUND_SETTINGS, drop_rate=0.3)


def round6(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def long_form(df: DataFrame, id_cols: list[str], vec: str, out: str = "x") -> DataFrame:
    """A row for each component; a null or empty vector has none.

    The outer form: of the other one Spark infers a filter on the vector, which it moves below grouping and joins, so that the
    vector is computed there for every row."""
    return df.select(*id_cols, F.posexplode_outer(vec).alias("k", out)).where(F.col("k").isNotNull())


# ---- bindings ----------------------------------------------------------------------

def kc(spark, sf, item="part"):
    return prepare.interaction_filter(fixtures.pairs(spark, sf, item))


def split(spark, sf, item="part"):
    return prepare.split_train_valid(kc(spark, sf, item), seed=SEED, distinct=True)  # the filter gives each pair once


def train_valid(spark, sf, item="supp"):
    s = split(spark, sf, item)
    return prepare.train_part(s), prepare.valid_part(s)


def user_pos(spark, sf, ids: DataFrame) -> DataFrame:
    return fixtures.vectors(spark, sf, ids.select("u").distinct(), "u", "w")


def item_pos(spark, sf, ids: DataFrame) -> DataFrame:
    return fixtures.vectors(spark, sf, ids.select("i").distinct(), "i", "h")


def eval_inputs(spark, sf):
    """Positions for the users and train items of the supp split, and T1."""
    train, valid = train_valid(spark, sf, "supp")
    # the split is written; positions and the test set are tables the scorer reads several times
    test = written(prepare.test_with_used_items(train, valid), "test")
    return written(user_pos(spark, sf, train), "users"), written(item_pos(spark, sf, train), "items"), train, test


def edges(spark, sf):
    """Training edges of the supp split: d = 1 - tfidf, shifted to min 0."""
    train, _ = train_valid(spark, sf, "supp")
    return written(prepare.score_to_distance(similarity.tfidf_scores(train, distinct=True)), "edges")


def round_inputs(spark, sf):
    e = edges(spark, sf)
    users = written(user_pos(spark, sf, e).withColumn("sg", F.lit(0.0)), "users")
    items = written(item_pos(spark, sf, e).withColumn("sg", F.lit(0.0)), "items")
    idx = training.build_sample_index(e, items, ROUND["block_num"])
    return e, users, items, idx


# ---- queries -----------------------------------------------------------------------------

def _as_file(spark, lines: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    lines.select("value").write.text(path)
    return path


def q_scan_log(spark, sf):
    return text.read_log(spark, _as_file(spark, fixtures.log_lines(spark, sf), "log"))


def q_scan_pairs(spark, sf):
    lines = fixtures.cust_part(spark, sf).select(F.concat_ws("|", "u", "i").alias("value"))
    return text.read_pairs(spark, _as_file(spark, lines, "pairs"))


def q_scan_scores(spark, sf):
    return text.read_scores(spark, _as_file(spark, fixtures.score_lines(spark, sf), "scores"))


def q_pairs_roundtrip(spark, sf):
    """Written twice to one path: the second write takes the place of the first."""
    path = scratch_path(spark, "pairs")
    text.write_pairs(fixtures.cust_part(spark, sf), path, num_files=2)
    text.write_pairs(kc(spark, sf), path, num_files=4)
    return text.read_pairs(spark, path)


def q_scores_roundtrip(spark, sf):
    path = scratch_path(spark, "scores")
    text.write_scores(similarity.tfidf_scores(kc(spark, sf)), path)
    return text.read_scored_csv(spark, path)


def q_positions_roundtrip(spark, sf):
    path = scratch_path(spark, "positions")
    text.write_positions(item_pos(spark, sf, fixtures.cust_supp(spark, sf)), path, "i", "h")
    return long_form(text.read_positions(spark, path, "i", "h"), ["i"], "h")


def q_test_set_roundtrip(spark, sf):
    path = scratch_path(spark, "testset")
    train, valid = train_valid(spark, sf, "supp")
    text.write_test_set(prepare.test_with_used_items(train, valid), path)
    return text.read_test_set(spark, path)


def q_user_degree_filter(spark, sf):
    return prepare.filter_users(fixtures.cust_part(spark, sf))


def q_interaction_filter(spark, sf):
    return kc(spark, sf)


def q_interaction_stats(spark, sf):
    return prepare.interaction_stats(text.parse_log(fixtures.log_lines(spark, sf)))


def q_renumber_ids(spark, sf):
    return prepare.renumber(kc(spark, sf))


def q_split_train_valid(spark, sf):
    return split(spark, sf)


def q_warm_test_items(spark, sf):
    train, valid = train_valid(spark, sf, "part")
    return prepare.warm_test_items(train, valid)


def q_score_to_distance(spark, sf):
    return prepare.score_to_distance(similarity.tfidf_scores(kc(spark, sf)))


def q_distance_stats(spark, sf):
    return prepare.distance_stats(prepare.score_to_distance(similarity.tfidf_scores(kc(spark, sf))))


def q_user_degree(spark, sf):
    return prepare.user_degree(kc(spark, sf))


def q_item_degree(spark, sf):
    return prepare.item_degree(kc(spark, sf))


def q_user_aa_weight(spark, sf):
    return similarity.user_aa_weight(kc(spark, sf), ALPHA_AA)


def q_tfidf_scores(spark, sf):
    return similarity.tfidf_scores(kc(spark, sf))


def q_item_cooccurrence(spark, sf):
    return similarity.item_cooccurrence(kc(spark, sf), distinct=True)


def q_item_jaccard(spark, sf):
    return similarity.item_jaccard(kc(spark, sf), distinct=True)


def q_item_aa(spark, sf):
    return similarity.item_aa(kc(spark, sf), ALPHA_AA, distinct=True)


def q_jaccard_scores(spark, sf):
    return similarity.jaccard_scores(kc(spark, sf), distinct=True)


def q_aa_scores(spark, sf):
    return similarity.aa_scores(kc(spark, sf), ALPHA_AA, distinct=True)


def q_used_items_union(spark, sf):
    train, valid = train_valid(spark, sf, "part")
    return prepare.used_items_union(train, valid)


def q_test_with_used_items(spark, sf):
    train, valid = train_valid(spark, sf, "supp")
    return prepare.test_with_used_items(train, valid)


def q_vector_arithmetic(spark, sf):
    p = written(kc(spark, sf, "supp"), "pairs")
    p = with_ends(p, user_pos(spark, sf, p), item_pos(spark, sf, p))
    p = p.select("u", "i", minus("w", "h").alias("diff"), plus("w", "h", 0.5, 2.0).alias("comb"))
    return p.select("u", "i", F.posexplode(F.arrays_zip("diff", "comb")).alias("k", "z")) \
        .select("u", "i", "k", F.col("z.diff").alias("diff"), F.col("z.comb").alias("comb"))


def q_pairwise_distance(spark, sf):
    p = written(kc(spark, sf, "supp"), "pairs")
    return evaluate.pairwise_distance(p, user_pos(spark, sf, p), item_pos(spark, sf, p))


def q_clip_vectors(spark, sf):
    u = user_pos(spark, sf, kc(spark, sf, "supp"))
    return long_form(vectors.clip_vectors(u, "w", CLIP_RADIUS), ["u"], "w")


def q_dropout_vectors(spark, sf):
    u = user_pos(spark, sf, kc(spark, sf, "supp"))
    return long_form(vectors.dropout_vectors(u, "u", "w", DROP_RATIO, DROP_SEED), ["u"], "w")


def q_init_positions(spark, sf):
    train, _ = train_valid(spark, sf, "supp")
    users = vectors.init_positions(train.select("u"), "u", INIT_DIM, INIT_SEED, "u", out="p").withColumnRenamed("u", "id")
    items = vectors.init_positions(train.select("i"), "i", INIT_DIM, INIT_SEED, "i", out="p").withColumnRenamed("i", "id")
    both = users.withColumn("side", F.lit("u")).unionByName(items.withColumn("side", F.lit("i")))
    return long_form(both, ["side", "id"], "p")


def q_vector_sum(spark, sf):
    train, _ = train_valid(spark, sf, "supp")
    j = train.join(user_pos(spark, sf, train), "u")
    return long_form(vectors.vector_sum(j, "i", "w"), ["i"], "w")


def q_topk_unseen(spark, sf):
    users, items, train, _ = eval_inputs(spark, sf)
    return evaluate.topk_unseen(users, items, train, TOP_K)


def q_topk_unseen_near(spark, sf):
    users, items, train, _ = eval_inputs(spark, sf)
    return evaluate.topk_unseen_near(users, items, train, TOP_K)


def q_precision_recall_at_k(spark, sf):
    users, items, _, test = eval_inputs(spark, sf)
    return evaluate.precision_recall_at_k(users, items, test)


def q_ranking_metrics(spark, sf):
    users, items, _, test = eval_inputs(spark, sf)
    return evaluate.ranking_metrics(users, items, test)


def q_rank_gain(spark, sf):
    users, items, _, test = eval_inputs(spark, sf)
    return evaluate.rank_gain_per_user(users, items, test)


def q_evaluation(spark, sf):
    """All metrics of the three queries above from one scan, as rows."""
    users, items, _, test = eval_inputs(spark, sf)
    return evaluate.evaluation(users, items, test)


def loss_inputs(spark, sf):
    e = edges(spark, sf)
    return e, written(user_pos(spark, sf, e), "users"), written(item_pos(spark, sf, e), "items")


def q_pull_loss(spark, sf):
    return training.pull_loss(*loss_inputs(spark, sf))


def q_push_loss(spark, sf):
    return training.push_loss(*loss_inputs(spark, sf), MARGIN)


def q_train_objective(spark, sf):
    return training.train_objective(*loss_inputs(spark, sf), LOSS_WEIGHT, MARGIN)


def q_sample_batches(spark, sf):
    _, _, _, idx = round_inputs(spark, sf)
    draws, negs = training.sample_batches(idx, ROUND["batch_size"], ROUND["block_num"], ROUND["neg_num"],
                                          ROUND["seed"], ROUND["rnd"])
    d = draws.select("b", "n", "u", "i", "d", F.lit(-1).alias("c"), F.lit(None).cast("long").alias("j"))
    n = negs.join(draws.select("b", "n", "u", "i", "d"), ["b", "n"]).select("b", "n", "u", "i", "d", "c", "j")
    return d.unionByName(n)


def _ranked(spark, sf):
    e, users, items, idx = round_inputs(spark, sf)
    return training.ranked_draws(idx, users, items, ROUND_SETTINGS, ROUND["seed"], ROUND["rnd"]), users, items


def q_approx_rank(spark, sf):
    ranked, _, _ = _ranked(spark, sf)
    return ranked.select("b", "n", "u", "i", "nk", "j_near", "rank", "rank_weight")


def _gradients(spark, sf, settings):
    ranked, _, _ = _ranked(spark, sf)
    gu, gi = training.gradient_round(ranked, settings, ROUND["seed"], ROUND["rnd"])
    a = long_form(gu.select(F.lit("u").alias("side"), F.col("u").alias("id"), "g"), ["side", "id"], "g", "g")
    b = long_form(gi.select(F.lit("i").alias("side"), F.col("i").alias("id"), "g"), ["side", "id"], "g", "g")
    return a.unionByName(b)


def q_gradient_round(spark, sf):
    return _gradients(spark, sf, ROUND_SETTINGS)


def q_gradient_round_dropout(spark, sf):
    return _gradients(spark, sf, DROPOUT_SETTINGS)


def q_adagrad_round(spark, sf):
    ranked, users, items = _ranked(spark, sf)
    gu, gi = training.gradient_round(ranked, ROUND_SETTINGS, ROUND["seed"], ROUND["rnd"])
    u2, i2 = training.adagrad_round(users, items, gu, gi, ROUND_SETTINGS)
    a = long_form(u2.select(F.lit("u").alias("side"), F.col("u").alias("id"), "sg", "w"), ["side", "id", "sg"], "w")
    b = long_form(i2.select(F.lit("i").alias("side"), F.col("i").alias("id"), "sg", "h"), ["side", "id", "sg"], "h")
    return a.unionByName(b)


def q_score_methods(spark, sf):
    """The method choice: the scores of all three names, two of them from one expansion."""
    pairs = written(kc(spark, sf), "pairs")
    both = similarity.both_scores(pairs, ALPHA_AA, distinct=True)
    parts = [similarity.score(pairs, m, ALPHA_AA, both, distinct=True).select(F.lit(m).alias("method"), "u", "i", "sui") for m in similarity.METHODS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TRAIN_SETTINGS = training.Settings(learning_rate=0.1, drop_rate=0.1, clip=1.0, n_dim=16, margin=MARGIN,
                                   neg_num=5, max_iter_times=2, batch_size=200, block_num=4,
                                   batch_per_iter=3, loss_weight=LOSS_WEIGHT)


def q_train_model(spark, sf):
    """Training with the report of every step: the positions, and as side 'report' the step's objective (norm) and gain (p)."""
    ensure_checkpoint_dir(spark)
    e = edges(spark, sf)
    _, valid = train_valid(spark, sf, "supp")
    test = prepare.test_with_used_items(e.select("u", "i"), valid).checkpoint()
    users, items, history = training.train(e, test, TRAIN_SETTINGS, seed=3)
    report = spark.createDataFrame([("report", s, o, [g]) for s, o, g in history], "side string, id bigint, norm double, p array<double>")
    a = users.select(F.lit("u").alias("side"), F.col("u").alias("id"), F.col("w").alias("p"))
    b = items.select(F.lit("i").alias("side"), F.col("i").alias("id"), F.col("h").alias("p"))
    return a.unionByName(b).select("side", "id", F.sqrt(F.aggregate(
        F.transform("p", lambda x: x * x), F.lit(0.0), lambda s, v: s + v)).alias("norm"), "p").unionByName(report)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_log": q_scan_log,
    "scan_pairs": q_scan_pairs,
    "scan_scores": q_scan_scores,
    "pairs_roundtrip": q_pairs_roundtrip,
    "scores_roundtrip": q_scores_roundtrip,
    "positions_roundtrip": q_positions_roundtrip,
    "test_set_roundtrip": q_test_set_roundtrip,
    "user_degree_filter": q_user_degree_filter,
    "interaction_filter": q_interaction_filter,
    "interaction_stats": q_interaction_stats,
    "renumber_ids": q_renumber_ids,
    "split_train_valid": q_split_train_valid,
    "warm_test_items": q_warm_test_items,
    "score_to_distance": q_score_to_distance,
    "distance_stats": q_distance_stats,
    "user_degree": q_user_degree,
    "item_degree": q_item_degree,
    "user_aa_weight": q_user_aa_weight,
    "tfidf_scores": q_tfidf_scores,
    "item_cooccurrence": q_item_cooccurrence,
    "item_jaccard": q_item_jaccard,
    "item_aa": q_item_aa,
    "jaccard_scores": q_jaccard_scores,
    "aa_scores": q_aa_scores,
    "score_methods": q_score_methods,
    "used_items_union": q_used_items_union,
    "test_with_used_items": q_test_with_used_items,
    "vector_arithmetic": q_vector_arithmetic,
    "pairwise_distance": q_pairwise_distance,
    "clip_vectors": q_clip_vectors,
    "dropout_vectors": q_dropout_vectors,
    "init_positions": q_init_positions,
    "vector_sum": q_vector_sum,
    "topk_unseen": q_topk_unseen,
    "topk_unseen_near": q_topk_unseen_near,
    "precision_recall_at_k": q_precision_recall_at_k,
    "ranking_metrics": q_ranking_metrics,
    "rank_gain": q_rank_gain,
    "evaluation": q_evaluation,
    "pull_loss": q_pull_loss,
    "push_loss": q_push_loss,
    "train_objective": q_train_objective,
    "sample_batches": q_sample_batches,
    "approx_rank": q_approx_rank,
    "gradient_round": q_gradient_round,
    "gradient_round_dropout": q_gradient_round_dropout,
    "adagrad_round": q_adagrad_round,
    "train_model": q_train_model,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries with their double columns rounded to 6 places."""
    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round6(f(spark, sf_dir))
        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        return run
    return {k: wrap(f) for k, f in QUERIES.items()}
