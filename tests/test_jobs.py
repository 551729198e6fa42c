"""The three jobs end to end on text directories (the reference's formats)."""

from support import SF001
from nearmark.operators import training
from nearmark.plans import jobs
from nearmark.session import scratch_path
from nearmark.sources import fixtures, text


def test_pipeline_end_to_end(spark):
    log_dir = scratch_path(spark, "log")
    fixtures.log_lines(spark, SF001).write.mode("overwrite").text(log_dir)
    pairs_dir, cv_dir = scratch_path(spark, "pairs"), scratch_path(spark, "cv")
    stats = jobs.prepare_job(spark, log_dir, pairs_dir, cv_dir, seed=42, num_files=2)
    assert stats["raw"][2] == 6000 and stats["clean"] == (148, 200, 5368)
    assert stats["train"][2] + stats["valid"][2] == 5368
    # renumbered ids are dense from 0
    ids = text.read_pairs(spark, pairs_dir)
    assert ids.agg({"u": "max"}).first()[0] == 147 and ids.agg({"i": "max"}).first()[0] == 199

    emb_dir = scratch_path(spark, "sim")
    out = jobs.similarity_job(spark, f"{cv_dir}/train", emb_dir, "tfidf")
    assert text.read_scored_csv(spark, out).count() == stats["train"][2]

    pos_dir = scratch_path(spark, "pos")
    s = training.Settings(n_dim=8, neg_num=3, max_iter_times=1, batch_size=100, block_num=2,
                          batch_per_iter=2)
    rep = jobs.train_eval_job(spark, out, f"{cv_dir}/valid", pos_dir, s, seed=1)
    assert rep["distance_stats"]["count"] == stats["train"][2]
    assert [k for k, _, _ in rep["precision_recall"]] == [5, 10, 15, 20]
    assert 0 <= rep["gain"] <= 1 and len(rep["history"]) == 1
    assert text.read_positions(spark, f"{pos_dir}/user", "u", "w").count() == 148
