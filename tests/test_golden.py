"""Golden values from the inline sample (values in FIXTURES.md)."""

import math

import pytest
from pyspark.sql import functions as F

from nearmark.operators import evaluate, prepare, similarity, training

JACCARD = {(0, 0): 0.583333, (0, 2): 0.583333, (1, 0): 0.625, (1, 1): 0.625, (2, 2): 1.0, (3, 1): 0.666667,
           (3, 3): 0.666667, (4, 2): 1.0, (5, 0): 0.625, (5, 3): 0.625, (6, 2): 1.0}
AA = {(0, 0): 0.617079, (0, 2): 0.617079, (1, 0): 0.704124, (1, 1): 0.704124, (2, 2): 1.0, (3, 1): 0.75,
      (3, 3): 0.75, (4, 2): 1.0, (5, 0): 0.704124, (5, 3): 0.704124, (6, 2): 1.0}
TFIDF = {(0, 0): 0.666667, (0, 2): 0.5, (1, 0): 0.666667, (1, 1): 1.0, (2, 2): 1.0, (3, 1): 1.0, (3, 3): 1.0,
         (4, 2): 1.0, (5, 0): 0.666667, (5, 3): 1.0, (6, 2): 1.0}


def _scores(df):
    return {(r.u, r.i): round(r.sui, 6) for r in df.collect()}


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_jaccard_golden(golden_pairs, chunk):
    assert _scores(similarity.jaccard_scores(golden_pairs, chunk=chunk)) == JACCARD


@pytest.mark.parametrize("chunk", [1, 1024])
def test_aa_golden(golden_pairs, chunk):
    assert _scores(similarity.aa_scores(golden_pairs, 1.0, chunk=chunk)) == AA


def test_tfidf_golden(golden_pairs):
    assert _scores(similarity.tfidf_scores(golden_pairs)) == TFIDF


def test_method_dispatch(golden_pairs):
    assert _scores(similarity.score(golden_pairs, "jaccard")) == JACCARD
    with pytest.raises(ValueError):
        similarity.score(golden_pairs, "cosine")


def test_distance_stats_golden(golden_edges):
    st = prepare.distance_stats(golden_edges).first()
    assert st["count"] == 11
    assert st["mean"] == pytest.approx(0.4)
    assert st["stdev"] == pytest.approx(0.229624, abs=1e-6)
    assert (st["max"], st["min"]) == (pytest.approx(0.8), pytest.approx(0.1))
    shifted = prepare.score_to_distance(golden_edges.select("u", "i", (1 - F.col("d")).alias("sui")))
    st2 = prepare.distance_stats(shifted).first()
    assert st2["mean"] == pytest.approx(0.3)
    assert st2["min"] == pytest.approx(0.0, abs=1e-12)


def test_one_training_step_golden(spark):
    """2-d, drop 0, alpha 0.5, margin 0.5, batch 1, one negative, 4 items,
    a one-positive user, d = 0.1, eta 0.1, accumulators 0, no clipping."""
    users = spark.createDataFrame([(0, [0.5, 0.0], 0.0)], "u bigint, w array<double>, sg double")
    items = spark.createDataFrame([(1, [0.0, 0.0], 0.0), (2, [0.6, 0.0], 0.0), (3, [5.0, 5.0], 0.0),
                                   (4, [-5.0, 5.0], 0.0)], "i bigint, h array<double>, sg double")
    draws = spark.createDataFrame([(0, 0, 0, 1, 0.1, 1)], "b int, n int, u bigint, i bigint, d double, du bigint")
    negs = spark.createDataFrame([(0, 0, 0, 2)], "b int, n int, c int, j bigint")
    s = training.Settings(learning_rate=0.1, drop_rate=0.0, clip=100.0, n_dim=2, margin=0.5, neg_num=1,
                          batch_size=1, block_num=1, loss_weight=0.5)
    ranked = training.approx_rank(draws, negs, users, items, s.margin, s.neg_num, 4)
    r = ranked.first()
    assert (r.nk, r.j_near, r.rank) == (1, 2, 3)
    assert r.rank_weight == pytest.approx(math.log2(5))
    gu, gi = training.gradient_round(ranked, s, seed=0, rnd=0)
    g = {("u", x.u): x.g for x in gu.collect()} | {("i", x.i): x.g for x in gi.collect()}
    assert g[("u", 0)] == pytest.approx([1.543157, 0.0], abs=1e-6)
    assert g[("i", 1)] == pytest.approx([-1.310964, 0.0], abs=1e-6)
    assert g[("i", 2)] == pytest.approx([-0.232193, 0.0], abs=1e-6)
    u2, i2 = training.adagrad_round(users, items, gu, gi, s)
    uu = u2.first()
    assert uu.sg == pytest.approx(2.381333, abs=1e-6)
    assert uu.w == pytest.approx([0.4, 0.0], abs=1e-6)
    it = {x.i: x for x in i2.collect()}
    assert it[1].sg == pytest.approx(1.718627, abs=1e-6) and it[1].h == pytest.approx([0.1, 0.0], abs=1e-6)
    assert it[2].sg == pytest.approx(0.053914, abs=1e-6) and it[2].h == pytest.approx([0.7, 0.0], abs=1e-6)
    # items without a gradient are untouched
    assert it[3].h == [5.0, 5.0] and it[3].sg == 0.0


def _line_positions(spark):
    users = spark.createDataFrame([(7, [0.0, 0.0])], "u bigint, w array<double>")
    items = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in
                                   [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (9, 0.5)]], "i bigint, h array<double>")
    return users, items


def test_ranking_metrics_golden(spark):
    """Hits [0, 1, 0] with 3 test items: MAP 0.833333, MRR 0.166667, NDCG 0.296082."""
    users, items = _line_positions(spark)
    test = spark.createDataFrame([(7, "used", 9), (7, "target", 2), (7, "target", 4), (7, "target", 5)],
                                 "u bigint, part string, i bigint")
    m = evaluate.ranking_metrics(users, items, test).first()
    assert (round(m["map"], 6), round(m["mrr"], 6), round(m["ndcg"], 6)) == (0.833333, 0.166667, 0.296082)
    pr = {r.k: (r.precision, r.recall) for r in evaluate.precision_recall_at_k(users, items, test, ks=(1, 2, 5, 20)).collect()}
    assert pr[1] == (0.0, 0.0)
    assert pr[2] == (0.5, pytest.approx(1 / 3))
    assert pr[5] == (pytest.approx(0.6), 1.0)
    # fewer candidates (5) than k = 20: precision still divides by k
    assert pr[20] == (pytest.approx(0.15), 1.0)


def test_used_items_without_position_take_no_candidates(spark):
    """Used items 90 and 91 have no position: both items stay candidates, and target 1 is the nearest of them."""
    users = spark.createDataFrame([(7, [0.0, 0.0])], "u bigint, w array<double>")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0])], "i bigint, h array<double>")
    test = spark.createDataFrame([(7, "used", 90), (7, "used", 91), (7, "target", 1)], "u bigint, part string, i bigint")
    assert tuple(evaluate.ranking_metrics(users, items, test).first()) == (1.0, 1.0, 1.0)


def test_topk_and_rank_gain(spark):
    users, items = _line_positions(spark)
    train = spark.createDataFrame([(7, 9)], "u bigint, i bigint")
    top = [(r.rank, r.i) for r in evaluate.topk_unseen(users, items, train, k=3).orderBy("rank").collect()]
    assert top == [(1, 1), (2, 2), (3, 3)]
    test = spark.createDataFrame([(7, "used", 9), (7, "target", 3)], "u bigint, part string, i bigint")
    # unused = items minus {9, 3}: 1, 2 are at or below item 3's distance
    g = evaluate.rank_gain(users, items, test).first()[0]
    assert g == pytest.approx(1 / math.log2(4))


def test_textbook_variants_golden(spark):
    """Same list, hits [0, 1, 0]: textbook AP = (1/2)/3, first-hit MRR = 1/2."""
    users, items = _line_positions(spark)
    test = spark.createDataFrame([(7, "used", 9), (7, "target", 2), (7, "target", 4), (7, "target", 5)],
                                 "u bigint, part string, i bigint")
    m = evaluate.textbook_ranking_metrics(users, items, test).first()
    assert (round(m["map"], 6), round(m["mrr"], 6)) == (0.166667, 0.5)
