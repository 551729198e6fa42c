"""A user holding a third of all rows: salted expansion against brute force."""

import contextlib
import io
import math
import random
import re
from collections import defaultdict

import pytest

from nearmark.operators import similarity


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(4)
    pairs = {(0, i) for i in range(60)}  # the hot user: 60 of ~180 rows
    while len(pairs) < 180:
        pairs.add((rnd.randrange(1, 40), rnd.randrange(0, 60)))
    return sorted(pairs)


def _brute_jaccard(pairs):
    items_of, users_of = defaultdict(set), defaultdict(set)
    for u, i in pairs:
        items_of[u].add(i)
        users_of[i].add(u)

    def sim(i, j):
        cn = len(users_of[i] & users_of[j])
        return cn / (len(users_of[i]) + len(users_of[j]) - cn)
    return {(u, i): sum(sim(i, j) for j in items_of[u]) / len(items_of[u]) for u, i in pairs}


@pytest.mark.parametrize("chunk", [4, 16, 1024])
def test_hot_user_jaccard_matches_brute_force(spark, skewed, chunk):
    df = spark.createDataFrame(skewed, "u bigint, i bigint")
    got = {(r.u, r.i): r.sui for r in similarity.jaccard_scores(df, chunk=chunk).collect()}
    want = _brute_jaccard(skewed)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def _brute_aa(pairs, alpha):
    items_of, users_of = defaultdict(set), defaultdict(set)
    for u, i in pairs:
        items_of[u].add(i)
        users_of[i].add(u)
    w = {u: 1 / (alpha + math.log(len(x))) for u, x in items_of.items()}
    total = {i: sum(w[u] for u in x) for i, x in users_of.items()}

    def sim(i, j):
        return sum(w[u] for u in users_of[i] & users_of[j]) / math.sqrt(total[i] * total[j])
    return {(u, i): sum(sim(i, j) for j in items_of[u]) / len(items_of[u]) for u, i in pairs}


@pytest.fixture(scope="module")
def common_pair(skewed):
    """A third of 300 users hold items 0 and 1, beside the hot user."""
    rnd = random.Random(8)
    pairs = set(skewed) | {(u, i) for u in range(100, 200) for i in (0, 1)} | {(u, rnd.randrange(60)) for u in range(100, 400) for _ in range(3)}
    return sorted(pairs)


@pytest.mark.parametrize("common", [0, 20, 1 << 18])
@pytest.mark.parametrize("chunk", [8])
def test_a_very_common_pair_is_scored_alike_on_both_ways(spark, common_pair, common, chunk):
    df = spark.createDataFrame(common_pair, "u bigint, i bigint")
    for got, want in ((similarity.jaccard_scores(df, chunk, common), _brute_jaccard(common_pair)),
                      (similarity.aa_scores(df, 1.0, chunk, common), _brute_aa(common_pair, 1.0))):
        got = got.collect()
        assert len(got) == len(want)
        assert all(abs(r.sui - want[r.u, r.i]) < 1e-12 for r in got)


@pytest.mark.parametrize("owner_users", [8, 1 << 12])
@pytest.mark.parametrize("common", [20, 1 << 18])
def test_item_pairs_match_brute_force_in_blocks_and_parts(spark, common_pair, common, owner_users, monkeypatch):
    monkeypatch.setattr(similarity, "OWNER_USERS", owner_users)
    monkeypatch.setattr(similarity, "TASK_PAIRS", 500)
    users_of = defaultdict(set)
    for u, i in common_pair:
        users_of[i].add(u)
    want = {(i, j): len(users_of[i] & users_of[j]) for i in users_of for j in users_of if i <= j and users_of[i] & users_of[j]}
    df = spark.createDataFrame(common_pair, "u bigint, i bigint")
    got = similarity.item_cooccurrence(df, 8, common).collect()
    assert len(got) == len(want) and {(r.i, r.j): r.cn for r in got} == want
    got = similarity.item_jaccard(df, 8, common).collect()
    assert len(got) == len(want)
    assert all(abs(r.sij - want[r.i, r.j] / (len(users_of[r.i] | users_of[r.j]))) < 1e-12 for r in got)
    got, want = similarity.jaccard_scores(df, 8, common).collect(), _brute_jaccard(common_pair)
    assert len(got) == len(want) and all(abs(r.sui - want[r.u, r.i]) < 1e-12 for r in got)


@pytest.mark.parametrize("name", ["item_cooccurrence", "item_jaccard", "item_aa", "jaccard_scores", "aa_scores"])
def test_no_exchange_has_a_row_per_pair(spark, name, monkeypatch):
    """60 users of 60 items are 109,800 pairs; what is exchanged is a row per (u, i) or, at the end, per (u, i) and part."""
    pairs = [(u, i) for u in range(60) for i in range(60)]
    df = getattr(similarity, name)(spark.createDataFrame(pairs, "u bigint, i bigint"))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    rows, todo = [], [final]
    while todo:
        p = todo.pop()
        todo += [p.children().apply(k) for k in range(p.children().size())]
        if p.nodeName() in ("ShuffleQueryStage", "TableCacheQueryStage"):
            todo.append(p.plan())
        elif p.nodeName() == "Exchange":
            rows.append(p.metrics().apply("shuffleRecordsWritten").value())
    assert rows and max(rows) <= 2 * len(pairs)


@pytest.mark.parametrize("method", ["jaccard", "aa"])
def test_pairs_are_expanded_once(spark, common_pair, method):
    """Without items over the limit the executed plan has one expansion."""
    df = similarity.score(spark.createDataFrame(common_pair, "u bigint, i bigint"), method)
    df.collect()
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    final = out.getvalue().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Join \[u#\d+L?, _a#\d+, _c#\d+\]", final)) == 1


@pytest.mark.parametrize("name", ["item_cooccurrence", "item_jaccard", "item_aa", "jaccard_scores", "aa_scores"])
def test_a_pair_travels_in_a_few_bytes(spark, name):
    """60 users of 60 items have 109,800 pairs; ids and totals in lists took 16 bytes for each and both ways (item pairs: 8 or 16, once)."""
    pairs = [(u, 10**6 + i) for u in range(60) for i in range(60)]
    df = getattr(similarity, name)(spark.createDataFrame(pairs, "u bigint, i bigint"))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    sizes, todo = [], [final]
    while todo:
        p = todo.pop()
        todo += [p.children().apply(k) for k in range(p.children().size())]
        if p.nodeName() == "ShuffleQueryStage":
            todo.append(p.plan())
        elif p.nodeName() == "Exchange":
            sizes.append(p.metrics().apply("dataSize").value())
    assert sum(sizes) / 109_800 < 8


def test_ids_of_any_size_and_sign(spark):
    """Ids travel as bytes above the smallest one, up to eight of them."""
    ids = [-(1 << 62), -5, 0, 3, 1 << 40, (1 << 62) + 9, (1 << 63) - 1]
    rnd = random.Random(3)
    pairs = sorted({(rnd.randrange(9), rnd.choice(ids)) for _ in range(60)})
    df = spark.createDataFrame(pairs, "u bigint, i bigint")
    for got, want in ((similarity.jaccard_scores(df), _brute_jaccard(pairs)), (similarity.aa_scores(df), _brute_aa(pairs, 1.0))):
        got = {(r.u, r.i): r.sui for r in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("owner_users", [3, 1 << 12])
def test_item_aa_matches_brute_force_in_blocks_and_parts(spark, common_pair, owner_users, monkeypatch):
    monkeypatch.setattr(similarity, "OWNER_USERS", owner_users)
    monkeypatch.setattr(similarity, "ENTRIES", 50)
    monkeypatch.setattr(similarity, "TASK_PAIRS", 500)
    items_of, users_of = defaultdict(set), defaultdict(set)
    for u, i in common_pair:
        items_of[u].add(i)
        users_of[i].add(u)
    w = {u: 1 / (1 + math.log(len(x))) for u, x in items_of.items()}
    total = {i: sum(w[u] for u in x) for i, x in users_of.items()}
    want = {(i, j): sum(w[u] for u in users_of[i] & users_of[j]) / math.sqrt(total[i] * total[j])
            for i in users_of for j in users_of if i <= j and users_of[i] & users_of[j]}
    for common in (20, 1 << 18):
        rows = similarity.item_aa(spark.createDataFrame(common_pair, "u bigint, i bigint"), 1.0, 8, common).collect()
        assert len(rows) == len(want) and all(abs(r.sij - want[r.i, r.j]) < 1e-12 for r in rows)
