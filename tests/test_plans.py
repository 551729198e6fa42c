"""Plan checks: the heavy queries never plan a cross product or a nested-loop join."""

import pytest

from support import SF001

HEAVY = ["jaccard_scores", "aa_scores", "item_aa", "tfidf_scores", "topk_unseen", "topk_unseen_near",
         "precision_recall_at_k", "ranking_metrics", "rank_gain", "push_loss", "approx_rank", "adagrad_round"]


@pytest.mark.parametrize("name", HEAVY)
def test_no_cross_product(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_push_loss_scans_once(spark, monkeypatch):
    """One cogroup in the plan that is written, none in the plan after it."""
    import __spark_entry__ as E
    frame = type(spark.range(0))
    plans, cut = [], frame.checkpoint

    def spy(self, eager=True):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return cut(self, eager)

    monkeypatch.setattr(frame, "checkpoint", spy)
    last = E.queries()["push_loss"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    cogroups = [p.count("FlatMapCoGroupsInPandas") for p in plans]
    assert sum(cogroups) == 1 and "FlatMapCoGroupsInPandas" not in last
    assert not any("CartesianProduct" in p for p in plans)
