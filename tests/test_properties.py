"""Properties and edge cases on the driver's sf0.001 tables and handmade frames."""

import pytest
from pyspark.sql import functions as F

from support import SF001
from nearmark.operators import evaluate, prepare, similarity, training
from nearmark.operators.indexing import ordinal_within, sorted_index
from nearmark.sources import fixtures, text
from nearmark.session import scratch_path


@pytest.fixture(scope="module")
def kc(spark):
    return prepare.interaction_filter(fixtures.cust_part(spark, SF001)).checkpoint()


def test_split_is_disjoint_complete_and_sized(kc):
    sp = prepare.split_train_valid(kc, seed=42)
    per = sp.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("part") == "train", 1).otherwise(0)).alias("t"))
    rows = per.collect()
    assert all(r.t == int(r.n * 0.8) for r in rows)
    assert sp.select("u", "i").distinct().count() == sp.count()
    eligible = kc.groupBy("u").count().where("count >= 10").select("u")
    assert sp.count() == kc.join(eligible, "u", "left_semi").count()


def test_split_independent_of_partitioning(spark, kc):
    a = {tuple(r) for r in prepare.split_train_valid(kc.repartition(1), seed=42).collect()}
    b = {tuple(r) for r in prepare.split_train_valid(kc.repartition(7, "i"), seed=42).collect()}
    assert a == b


def test_sorted_index_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    idx = sorted_index(df, ["k"], num_partitions=5).collect()
    assert sorted(r.idx for r in idx) == list(range(1000))
    assert all(r.idx == r.k for r in idx)


def test_ordinal_within_hot_group(spark):
    # one group holds most rows: it is spread over several range partitions
    df = spark.range(0, 3000).select(F.when(F.col("id") < 2000, F.lit(1)).otherwise(F.col("id") % 5).alias("g"),
                                     F.col("id").alias("v"))
    o = ordinal_within(df, "g", ["v"], size_name="n").where("g = 1").orderBy("v").collect()
    assert [r.ord for r in o] == list(range(len(o)))
    assert o[0].n == len(o)


def test_filter_boundary(spark):
    rows = [(1, i) for i in range(9)] + [(2, i) for i in range(10)] + [(3, i) for i in range(11)]
    df = spark.createDataFrame(rows, "u bigint, i bigint")
    assert {r.u for r in prepare.filter_users(df, 10).collect()} == {2, 3}
    # min degree 2: every user passes; item 10 (one user) is dropped, so user 3
    # falls from 11 to 10 items and is kept as is (one pass, not a k-core)
    out = prepare.interaction_filter(df, 2)
    assert out.count() == 29
    assert out.where("i = 10").count() == 0
    # min degree 10: users 2 and 3 pass, then every item has < 10 users
    assert prepare.interaction_filter(df, 10).count() == 0


def test_jaccard_half_form_diagonal_and_range(kc):
    s = similarity.item_jaccard(kc)
    m = {(r.i, r.j): r.sij for r in s.collect()}
    assert all(i <= j for i, j in m)
    assert all(abs(v - 1.0) < 1e-12 for (i, j), v in m.items() if i == j)
    assert all(0 <= v <= 1 for v in m.values())


def test_salted_expansion_matches(kc):
    a = {(r.u, r.i): round(r.sui, 9) for r in similarity.jaccard_scores(kc).collect()}
    b = {(r.u, r.i): round(r.sui, 9) for r in similarity.jaccard_scores(kc, chunk=7).collect()}
    assert a == b


def test_tfidf_max_is_one_and_all_zero_is_nan(spark, kc):
    assert similarity.tfidf_scores(kc).agg(F.max("sui")).first()[0] == pytest.approx(1.0)
    full = spark.createDataFrame([(u, i) for u in range(3) for i in range(4)], "u bigint, i bigint")
    vals = [r.sui for r in similarity.tfidf_scores(full).collect()]
    assert all(v != v for v in vals)


def test_aa_alpha_zero_single_item_is_inf(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "u bigint, i bigint")
    w = {r.u: r.wu for r in similarity.user_aa_weight(df, 0.0).collect()}
    assert w[1] == float("inf")


def test_malformed_line_fails(spark):
    lines = spark.createDataFrame([("1|x",)], "value string")
    with pytest.raises(Exception):
        text.parse_pairs(lines).collect()
    extra = spark.createDataFrame([("t|1|2|junk",)], "value string")
    assert [tuple(r) for r in text.parse_log(extra).collect()] == [(1, 2)]


def test_text_roundtrips(spark, kc):
    p = scratch_path(spark, "t-pairs")
    text.write_pairs(kc, p, num_files=3)
    assert sorted(map(tuple, text.read_pairs(spark, p).collect())) == sorted(map(tuple, kc.collect()))
    pos = spark.createDataFrame([(1, [0.25, -1.5]), (2, [3.0, 0.1])], "id bigint, p array<double>")
    q = scratch_path(spark, "t-pos")
    text.write_positions(pos, q)
    assert sorted(map(tuple, text.read_positions(spark, q).collect())) == sorted(map(tuple, pos.collect()))


def test_clip_bounds_norm(spark):
    from nearmark.operators.vectors import clip_vectors
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.3, 0.4]), (3, [0.6, 0.8])], "id bigint, v array<double>")
    out = {r.id: r.v for r in clip_vectors(df, "v", 1.0).collect()}
    assert out[1] == pytest.approx([0.6, 0.8])
    assert out[2] == [0.3, 0.4]
    assert out[3] == [0.6, 0.8]  # norm equal to the radius: unchanged


def test_negatives_never_used(spark):
    kc = prepare.interaction_filter(fixtures.cust_supp(spark, SF001), 3)
    edges = prepare.score_to_distance(similarity.tfidf_scores(
        prepare.train_part(prepare.split_train_valid(kc, seed=42, min_degree=3))))
    items = edges.select("i").distinct()
    idx = training.build_sample_index(edges, items, 4)
    draws, negs = training.sample_batches(idx, 300, 4, 6, seed=1, rnd=0)
    with_u = negs.join(draws.select("b", "n", "u"), ["b", "n"])
    assert with_u.join(edges.select("u", F.col("i").alias("j")), ["u", "j"], "left_semi").count() == 0
    assert draws.count() == 1200
    # every draw's positive is one of its user's items
    assert draws.join(edges.select("u", "i"), ["u", "i"], "left_anti").count() == 0
    # users who use every item get no negatives but keep their draws
    per = with_u.groupBy("b", "n").count()
    assert per.where("count != 6").count() == 0


def test_empty_evaluation_is_null(spark):
    users = spark.createDataFrame([(1, [0.0])], "u bigint, w array<double>")
    items = spark.createDataFrame([(1, [1.0])], "i bigint, h array<double>")
    test = spark.createDataFrame([], "u bigint, part string, i bigint")
    m = evaluate.ranking_metrics(users, items, test).first()
    assert m["map"] is None


def test_user_with_every_item_has_no_candidates(spark):
    users = spark.createDataFrame([(1, [0.0]), (2, [0.0])], "u bigint, w array<double>")
    items = spark.createDataFrame([(10, [1.0]), (11, [2.0])], "i bigint, h array<double>")
    train = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "u bigint, i bigint")
    c = {(r.u, r.i) for r in evaluate.topk_unseen(users, items, train, k=5).collect()}
    assert c == {(2, 11)}


def test_prefix_sums_match_python(spark):
    import math
    pref = {r.n: (r.hn, r.idcg) for r in evaluate.prefix_sums(spark, 1000).collect()}
    assert pref[0] == (0.0, 0.0)
    h = g = 0.0
    for n in range(1, 1001):
        h += 1.0 / n
        g += math.log(2.0) / math.log(n + 1.0)
        assert abs(pref[n][0] - h) < 1e-12 and abs(pref[n][1] - g) < 1e-12


def test_scans_read_only_needed_columns(spark):
    """Column pruning reaches the parquet scans (ReadSchema)."""
    plan = prepare.interaction_filter(fixtures.cust_part(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]
    assert schemas, plan
    for sch in schemas:
        assert "l_extendedprice" not in sch and "o_totalprice" not in sch and "l_comment" not in sch
        assert sch.count(":") <= 2


def test_missing_input_fails_and_bad_csv_cell_fails(spark):
    with pytest.raises(Exception):
        text.read_pairs(spark, scratch_path(spark, "does-not-exist")).collect()
    p = scratch_path(spark, "badcsv")
    spark.createDataFrame([("1", "2", "0.5"), ("3", "x", "0.1")], "a string, b string, c string") \
        .write.option("sep", "|").csv(p)
    with pytest.raises(Exception):
        text.read_scored_csv(spark, p).collect()


def test_test_set_text_roundtrip(spark):
    rows = [(1, "used", 3), (1, "used", 2), (1, "target", 5), (2, "used", 7), (2, "target", 8)]
    p = scratch_path(spark, "testset")
    text.write_test_set(spark.createDataFrame(rows, "u bigint, part string, i bigint"), p, num_files=2)
    assert sorted(map(tuple, text.read_test_set(spark, p).collect())) == sorted(rows)


def test_overwrite_replaces_the_target(spark):
    p = scratch_path(spark, "twice")
    for rows in ([(1, 2), (3, 4)], [(5, 6)]):
        text.write_pairs(spark.createDataFrame(rows, "u bigint, i bigint"), p)
    assert [tuple(r) for r in text.read_pairs(spark, p).collect()] == [(5, 6)]


def test_checkpoint_folder_rule():
    """A temporary folder only where everything runs in one process."""
    from nearmark.session import single_machine
    assert all(map(single_machine, ("local", "local[4]", "local[*]", "local[2,3]")))
    assert not any(map(single_machine, ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]")))


def test_uniform_reaches_far_rows(spark):
    """52 bits: positions beyond 2**32 rows are drawn, without steps of several rows."""
    from nearmark.functions.hashing import uniform
    n = 1 << 40
    at = [r.p for r in spark.range(4000).select(F.floor(uniform(1, F.col("id")) * F.lit(float(n))).alias("p")).collect()]
    assert max(at) > 0.99 * n and len(set(at)) == 4000
    assert len({p % 256 for p in at}) == 256  # a 32-bit draw would leave only multiples of 256


def test_flagged_before_hot_group(spark):
    from nearmark.operators.indexing import flagged_before
    rows = [(1 if k % 3 else k % 5, k * 7 % 101, k, k % 4 == 0) for k in range(900)]
    df = spark.createDataFrame(rows, "g bigint, v bigint, x bigint, f boolean")
    got = {r.x: r.n for r in flagged_before(df, "g", ["v", "x"], "f", "n").collect()}
    want = {x: sum(1 for h, w, y, o in rows if o and h == g and (w, y) < (v, x)) for g, v, x, f in rows if not f}
    assert got == want
