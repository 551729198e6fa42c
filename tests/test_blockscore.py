"""The block scan gives the same answers however users, items and probes are blocked.

Tiny block sizes force many item blocks and, with probe_chunk = 1, one probe
sub-block per probe: the path a user with very many test items takes.
"""

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import SF001
from nearmark.functions.vectors import sqdist
from nearmark.operators import evaluate
from nearmark.operators.blockscore import block_scan, counts_in_block, exact_sqdist, layout, minima_in_block, nearest_in_block
from nearmark.plans import queries as Q

SMALL = dict(user_block=7, item_block=3, probe_chunk=1, row_chunk=2, item_tile=2)


@pytest.fixture(scope="module")
def inputs(spark):
    users, items, train, test = Q.eval_inputs(spark, SF001)
    it = items.select(F.col("i").alias("j"), "h")
    ex = train.select("u", F.col("i").alias("j"))
    probes = (test.where("part = 'target'").select("u", "i").join(users, "u").join(items, "i")
              .select("u", F.col("i").alias("key"), sqdist("w", "h").alias("thr"), F.col("i").alias("thr_id")))
    return users.select("u", "w"), it, ex, probes


def _rows(df):
    rows = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("mode,kw", [("counts", {}), ("topk", dict(k=4)), ("count", dict(strict=True)), ("count", {}), ("countmin", dict(offset=0.5))])
def test_blocking_does_not_change_results(inputs, mode, kw):
    users, items, ex, probes = inputs
    pr = None if mode == "topk" else probes
    a = block_scan(users, items, mode, excluded=ex, probes=pr, **kw)
    b = block_scan(users, items, mode, excluded=ex, probes=pr, **kw, **SMALL)
    assert _rows(a) == _rows(b)
    assert len(_rows(a)) > 0


@pytest.mark.parametrize("values", [[0.0, 0.5, 1.0], [0.1, 0.2, 0.3], None])
def test_kernel_equals_the_fold_with_many_ties(values):
    """Few distinct coordinates make most distances equal, and thresholds are distances themselves."""
    rng = np.random.default_rng(5)
    make = (lambda n: rng.normal(size=(n, 7))) if values is None else (lambda n: rng.choice(values, (n, 7)))
    W, H, J = make(30), make(200), rng.permutation(200)
    fold = np.zeros((30, 200))
    for k in range(7):
        fold += (W[:, k][:, None] - H[:, k][None, :]) ** 2
    assert (exact_sqdist(np.repeat(W, 200, axis=0), np.tile(H, (30, 1))).reshape(30, 200) == fold).all()
    gone = rng.random((30, 200)) < 0.2
    masked = np.where(gone, np.inf, fold)
    r, c, d = nearest_in_block(W, H, J, *np.nonzero(gone), 9)
    for u in range(30):
        want = sorted((masked[u, i], J[i]) for i in range(200))[:9]
        assert [(x, J[y]) for x, y in zip(d[r == u], c[r == u])] == want
    assert (minima_in_block(W, H, *np.nonzero(gone), 0.5) == (masked - 0.5).min(axis=1)).all()
    rows, cols = rng.integers(30, size=300), rng.integers(200, size=300)
    thr, tid = fold[rows, cols], J[cols]
    strict = [(((fold[u] < t) | ((fold[u] == t) & (J < i))).sum()) for u, t, i in zip(rows, thr, tid)]
    assert counts_in_block(W, H, J, rows, thr, tid, 0.0, True).tolist() == strict
    loose = [((fold[u] - 0.5) <= t).sum() for u, t in zip(rows, thr)]
    assert counts_in_block(W, H, J, rows, thr, tid, 0.5, False).tolist() == loose


def test_layout_follows_the_sizes_alone():
    assert layout(10, 10) == (1, 1)
    for n_users, n_items in ((16_000, 1_000), (10**8, 10**6), (10**6, 10**8), (3, 10**9)):
        ub, ib = layout(n_users, n_items)
        assert ub * 16384 >= n_users and ib * 16384 >= n_items
    assert layout(16_000, 1_000)[0] > layout(16_000, 1_000)[1]


def test_joint_evaluation_scans_once(spark, monkeypatch):
    """The metrics of one scan are those of a scan each, and one cogroup is planned for all."""
    users, items, _, test = Q.eval_inputs(spark, SF001)
    frame = type(spark.range(0))
    plans, cut = [], frame.checkpoint

    def spy(self, eager=True):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return cut(self, eager)

    monkeypatch.setattr(frame, "checkpoint", spy)
    out = evaluate.evaluation(users, items, test)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("FlatMapCoGroupsInPandas") for p in plans) == 1
    got = {(r.metric, r.k): r.value for r in out.collect()}
    want = {(m, r.k): r[m] for r in evaluate.precision_recall_at_k(users, items, test).collect() for m in ("precision", "recall")}
    want |= {(m, None): evaluate.ranking_metrics(users, items, test).first()[m] for m in ("map", "mrr", "ndcg")}
    want[("gain", None)] = evaluate.rank_gain(users, items, test).first().gain
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("kind", ["independent", "copies", "grid", "far", "huge", "nan"])
def test_the_nearest_over_tiles_are_the_nearest_of_all(kind):
    """Tile by tile with products in single precision: items, order and distances are those of one exact pass."""
    from nearmark.operators.blockscore import Nearest
    rng = np.random.default_rng(6)
    W, H = rng.normal(size=(40, 16)), rng.normal(size=(700, 16))
    if kind == "copies":
        H = H[rng.integers(0, 9, 700)]
    if kind == "grid":
        W, H = (rng.integers(0, 2, x.shape).astype(float) for x in (W, H))
    if kind == "far":  # single precision tells none of these apart
        W, H = W * 1e-6 + 1000, H * 1e-6 + 1000
    if kind == "huge":
        W, H = W * 1e25, H * 1e25
    if kind == "nan":
        W[3], W[4, 2] = np.nan, np.inf
    J = rng.permutation(700).astype(np.int64)
    gone = rng.random((40, 700)) < 0.1
    gone[0], gone[1, 4:] = True, True
    best = Nearest(W, 9)
    for lo in range(0, 700, 100):
        r, c = np.nonzero(gone[:, lo:lo + 100])
        best.meet(H[lo:lo + 100], J[lo:lo + 100], r, c)
    got = list(zip(*(x.tolist() for x in best.found()), strict=True))
    want = []
    for u in range(40):
        d = exact_sqdist(np.repeat(W[u:u + 1], 700, axis=0), H)
        some = [(u, int(J[c]), float(d[c])) for c in range(700) if not gone[u, c] and np.isfinite(d[c])]
        want += sorted(some, key=lambda x: (x[2], x[1]))[:9]
    assert got == want


def test_rows_repeated_for_each_block_are_not_broadcast(spark):
    """Spark takes the items' size for that of the rows that repeat them for each user block, and broadcast these."""
    vec = F.array(F.rand(1), F.rand(2))
    users = spark.range(3000).select(F.col("id").alias("u"), vec.alias("w")).checkpoint()
    items = spark.range(5).select(F.col("id").alias("j"), vec.alias("h")).checkpoint()
    probes = users.select("u", F.lit(1).cast("long").alias("key"), F.lit(0.5).alias("thr"), F.lit(1).cast("long").alias("thr_id"))
    out = block_scan(users, items, "count", probes=probes, user_block=50)
    assert out.count() == 3000

    def repeated(node, inside: bool) -> list[str]:
        name = node.nodeName()
        inside = inside or name.startswith("BroadcastExchange")
        own = [node.simpleString(100)] if inside and name == "Generate" else []
        children = node.children().iterator()
        below = []
        while children.hasNext():
            below.append(children.next())
        if name == "AdaptiveSparkPlan":
            below = [node.executedPlan()]
        elif "QueryStage" in name:
            below = [node.plan()]
        return own + [x for child in below for x in repeated(child, inside)]

    assert repeated(out._jdf.queryExecution().executedPlan(), False) == []


@pytest.mark.parametrize("mode,kw", [("counts", {}), ("count", dict(strict=True)), ("count", {}), ("countmin", dict(offset=0.5))])
@pytest.mark.parametrize("blocks", [{}, SMALL, dict(probe_chunk=2, item_block=3)])
def test_pairs_taken_off_are_those_of_brute_force(inputs, mode, kw, blocks, monkeypatch):
    """Beside the probes, and by the sort over the cluster for users whose probes are split."""
    from nearmark.operators import blockscore
    monkeypatch.setattr(blockscore, "PROBE_PAGE", 2)
    users, items, ex, probes = inputs
    few = probes.select("u").distinct().orderBy("u").limit(12)
    users, probes, ex = (df.join(few, "u", "left_semi").checkpoint() for df in (users, probes, ex))
    w, h = ({r[0]: np.array(r[1]) for r in df.collect()} for df in (users, items))
    own, off = {u: {r.j for r in ex.where(F.col("u") == u).collect()} for u in w}, kw.get("offset", 0.0)

    def dist(u, j):
        return float(exact_sqdist(w[u][None], h[j][None])[0]) - off

    def under(p, strict, skip):
        return sum(j not in skip and ((dist(p.u, j), j) < (p.thr, p.thr_id) if strict else dist(p.u, j) <= p.thr) for j in h)

    both = ex.unionByName(probes.select("u", F.col("key").alias("j"))).distinct().checkpoint()
    mine = {u: own[u] | {p.key for p in probes.collect() if p.u == u} for u in w}
    got = block_scan(users, items, mode, excluded=ex, minus=ex, minus_loose=both if mode == "counts" else None, probes=probes, **kw, **blocks)
    found = {(r.u, r.key): r for r in got.collect()}
    for p in probes.collect():
        r = found.pop((p.u, p.key))
        assert r.cnt == under(p, mode == "counts" or kw.get("strict", False), own[p.u])
        assert mode != "counts" or r.loose == under(p, False, mine[p.u])
    assert {k: r.dmin for k, r in found.items()} == ({(u, None): min(dist(u, j) for j in h if j not in own[u]) for u in w if len(own[u]) < len(h)}
                                                     if mode == "countmin" else {})


@pytest.mark.parametrize("values", [[0.0, 0.5, 1.0], [0.1, 0.2, 0.3], None, "far"])
def test_counts_from_single_precision_are_those_of_the_fold(values):
    from nearmark.operators.blockscore import Nearest, Tile, both_counts_of_product
    rng = np.random.default_rng(5)
    make = (lambda n: rng.choice(values, (n, 7))) if isinstance(values, list) else (lambda n: rng.normal(size=(n, 7)))
    W, H, J = make(30), make(200), rng.permutation(200)
    if values == "far":  # single precision tells none of these apart
        W, H = W * 1e-6 + 1000, H * 1e-6 + 1000
    fold = exact_sqdist(np.repeat(W, 200, axis=0), np.tile(H, (30, 1))).reshape(30, 200)
    rows, cols = rng.integers(30, size=600), rng.integers(200, size=600)
    thr, tid, tile = fold[rows, cols], J[cols], Tile(H)
    for offset in (0.0, 0.5):
        before, upto = both_counts_of_product(Nearest(W, 1).product(tile), W, H, J, rows, thr, tid, offset, tile.top)
        assert before.tolist() == [((fold[u] - offset < t) | ((fold[u] - offset == t) & (J < i))).sum() for u, t, i in zip(rows, thr, tid)]
        assert upto.tolist() == [(fold[u] - offset <= t).sum() for u, t in zip(rows, thr)]


def test_probes_travel_as_a_row_for_each_user(spark):
    """They were a row each for every item block, there and back."""
    vec = F.array(F.rand(1), F.rand(2))
    users = spark.range(50).select(F.col("id").alias("u"), vec.alias("w")).checkpoint()
    items = spark.range(40).select(F.col("id").alias("j"), vec.alias("h")).checkpoint()
    pairs = users.select("u").crossJoin(items.select("j")).checkpoint()
    probes = pairs.select("u", F.col("j").alias("key"), F.lit(0.3).alias("thr"), F.col("j").alias("thr_id")).checkpoint()
    out = block_scan(users, items, "counts", probes=probes, minus=pairs, item_block=10)
    assert out.count() == 2000
    frame = out.select("u", "key", "cnt", "loose")
    assert {tuple(r)[2:] for r in frame.where("cnt != 0").collect()} == set()
    final = frame._jdf.queryExecution().executedPlan()
    frame.collect()
    rows, todo = [], [final.finalPhysicalPlan()]
    while todo:
        p = todo.pop()
        todo += [p.children().apply(k) for k in range(p.children().size())]
        if p.nodeName() in ("ShuffleQueryStage", "TableCacheQueryStage"):
            todo.append(p.plan())
        elif p.nodeName() == "Exchange":
            rows.append(p.metrics().apply("shuffleRecordsWritten").value())
    assert rows and max(rows) <= 1000  # 50 users, 4 item blocks, 3 kinds of row
