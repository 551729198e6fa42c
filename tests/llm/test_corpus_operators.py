"""The operators that compare rows, against brute force: revisits, line dedup, near-duplicates, neighbours, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearmark.llm import linededup, neardup, registry, vptree, warc
from nearmark.llm.common import Steps
from nearmark.session import scratch_path
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    res = duck(SF).execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    ok, msg = compare(got, [tuple(r[names.index(c)] for c in cols) for r in res.fetchall()])
    assert ok, msg


# ---- revisits -------------------------------------------------------------------------------

def _record(kind, number, url, date, headers, body=b"", status="200 OK", extra=""):
    http = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + body
    return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{number}:0>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{extra}"
            f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_revisit_cases(spark):
    snm = "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified\r\n"
    day = "2024-01-0{}T00:00:00Z".format
    page = lambda n, d, h, body: _record("response", n, "http://a.org/x/?utm_source=f", day(d), h, body)
    again = lambda n, d, h, url="https://www.A.org:443/x#top", more="": _record("revisit", n, url, day(d), h, status="304 Not Modified", extra=snm + more)
    raw = [page(1, 1, {"ETag": '"a"', "Content-Type": "text/html", "Age": "1", "Content-Length": "3"}, b"old"),
           page(2, 3, {"ETag": '"b"', "Last-Modified": "then"}, b"new \xff"),
           _record("response", 3, "http://a.org/x", day(4), {"ETag": '"c"'}, b"gone", status="404 Not Found"),
           again(11, 2, {"ETag": 'W/"a"', "Content-Type": "no", "Age": "2"}), again(12, 5, {"ETag": '"b"'}), again(13, 5, {"ETag": '"a"'}),
           again(14, 1, {"ETag": '"a"'}), again(15, 3, {"ETag": '"a"'}), again(16, 5, {"Last-Modified": "then"}), again(17, 5, {}),
           again(18, 2, {"Last-Modified": "then"}), again(19, 5, {"ETag": '"a"'}, "http://b.org/x"), again(20, 2, {"ETag": '"a"'}, ""), b"junk", b"", None]
    out = warc.resolve(warc.parse(spark.createDataFrame([(bytearray(r) if r is not None else None, "x") for r in raw], "raw binary, id string")))
    got = {int(r.id.split(":")[2]): r for r in out.collect()}
    assert {n: r.status for n, r in got.items()} == {
        11: "resolved", 12: "resolved", 13: "validator_mismatch", 14: "no_response", 15: "resolved", 16: "resolved", 17: "no_validator",
        18: "no_validator", 19: "no_response", 20: "no_response"}
    assert dict(map(tuple, got[11].headers)) == {"etag": 'W/"a"', "content-type": "text/html", "age": "2", "content-length": "3"} and got[11].body == b"old"
    assert got[12].body == b"new \xff" and got[12].response_id == "<urn:page:2:0>" and got[15].response_id == "<urn:page:1:0>"
    assert got[13].body is None
    assert warc.resolve(warc.parse(spark.createDataFrame([], "raw binary"))).count() == 0


def test_repeated_fields_stay(spark):
    """All lines of a repeated field, replaced as a whole by those of the 304; a long body, an empty one and clashing columns."""
    raw = lambda kind, n, d, status, lines, body=b"": (
        lambda block: (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{n}:0>\r\nWARC-Target-URI: http://a.org/{n % 10}\r\nWARC-Date: 2024-01-0{d}T00:00:00Z\r\n"
                       f"WARC-Profile: x/server-not-modified\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block)(
        ("\r\n".join([f"HTTP/1.1 {status}", *lines]) + "\r\n\r\n").encode() + body)
    long = bytes(range(256)) * 20000
    then = ["ETag: 1", "Set-Cookie: a=1; Path=/", "Vary: Accept", "set-cookie: b=2", "Vary: Cookie", "ETag: 2"]
    records = [raw("response", 1, 1, "200 OK", then, long), raw("revisit", 11, 2, "304 Not Modified", ["ETag: 1", "VARY: Origin", "Vary: Range"]),
               raw("response", 2, 1, "200 OK", then), raw("revisit", 12, 2, "304 Not Modified", ["ETag: 1"]), raw("revisit", 22, 2, "304 Not Modified", ["ETag: 2"])]
    table = spark.createDataFrame([(bytearray(r), "x", 1, "y", True) for r in records], "raw binary, headers string, status int, key string, full boolean")
    got = {int(r.id.split(":")[2]): r for r in warc.resolve(warc.parse(table)).collect()}
    cookies = [("set-cookie", "a=1; Path=/"), ("set-cookie", "b=2")]
    assert list(map(tuple, got[11].headers)) == [*cookies, ("etag", "1"), ("vary", "Origin"), ("vary", "Range")] and got[11].body == long
    assert list(map(tuple, got[12].headers)) == [cookies[0], ("vary", "Accept"), cookies[1], ("vary", "Cookie"), ("etag", "1")] and got[12].body == b""
    assert got[22].status == "validator_mismatch" and got[22].headers is None


def test_hot_url_is_found_across_parts(spark):
    """One URL with most of all captures, spread over sorted parts; the last response may lie several parts back."""
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.8 else f"u{rnd.randrange(9)}", rnd.randrange(400), rnd.random() < 0.02, f"{k:05d}") for k in range(3000)]
    events = spark.createDataFrame(rows, "key string, ts bigint, full boolean, id string")
    got = {r.revisit_id: r.found for r in warc.last_response(events).collect()}
    for key, ts, full, name in rows:
        if not full:
            before = [(t, i) for k, t, f, i in rows if f and k == key and t < ts]
            assert got[name] == (max(before)[1] if before else None)


def test_captures_of_awkward_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.org", "x"), (2, "http://a.org/é", "<p>é"), (2, "http://a.org/é", "<p>é")],
                                  "page_id bigint, url string, html string")
    out = warc.digest(warc.resolve(warc.parse(warc.captures(pages)))).collect()
    assert Counter(r.page_id for r in out) == {1: 1, 2: 2}


# ---- line dedup -----------------------------------------------------------------------------

def _kept_lines(rows):
    """(doc_id, text) rows to the kept text of each row."""
    key = linededup.line_key
    holders = defaultdict(set)
    big = lambda d: linededup.NO_ID if d is None else d
    for doc, text in rows:
        for x in (text or "").split("\n"):
            holders[key(x)].add(big(doc))
    stays = lambda doc, x: len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == big(doc)
    return Counter((doc, "\n".join(x for x in (text or "").split("\n") if stays(doc, x))) for doc, text in rows)


def test_line_dedup(docs, rows, empty, odd):
    got = linededup.dedup_lines(docs, "lang").collect()
    assert Counter((r.doc_id, r.text) for r in got) == _kept_lines([(r[0], r[1]) for r in rows])
    assert sum(r.n_dropped for r in got) > 10
    assert linededup.dedup_lines(empty).count() == 0
    some = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter((r.doc_id, r.text) for r in linededup.dedup_lines(odd).collect()) == _kept_lines(some)


def test_line_store_is_reversible(spark, docs, rows):
    """Two insertions and a deletion leave what one insertion of the rest would have given."""
    store = linededup.LineStore(spark, scratch_path(spark, "lines-test"), shards=3)
    store.insert(docs.where("doc_id % 2 = 0")).insert(docs.where("doc_id % 2 = 1"))
    both = Counter((r.doc_id, r.text) for r in store.clean(docs).collect())
    assert both == _kept_lines([(r[0], r[1]) for r in rows])
    store.delete(docs.where("doc_id in (3, 5, 6, 20)"))
    rest = docs.where("doc_id not in (3, 5, 6, 20)")
    assert Counter((r.doc_id, r.text) for r in store.clean(rest).collect()) == _kept_lines([(r[0], r[1]) for r in rows if r[0] not in (3, 5, 6, 20)])
    store.insert(docs.where("doc_id in (3, 5, 6, 20)"))
    assert Counter((r.doc_id, r.text) for r in store.clean(docs).collect()) == both


def test_a_hot_line_is_one_row_of_its_shard(spark, monkeypatch):
    """A line that all documents hold, documents of thousands of lines, and several batches: each key comes to its shard once."""
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 2000)
    rows = [(d, "\n".join(["the line that all share", *(f"line {k} of document {d}" for k in range(10000 if d < 3 else 5)), "the line that all share"])) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)
    store = linededup.LineStore(spark, scratch_path(spark, "lines-hot")).insert(docs)
    assert store.shards == -(-(3 * 10000 + 197 * 5 + 1) // 2000)
    assert store.refs().count() > store.refs().select("key").distinct().count()  # the hot line has a row per batch
    assert store.seen().count() < 100
    out = {r.doc_id: r for r in store.clean(docs).collect()}
    assert all(r.n_dropped == (0 if d == 0 else 2) for d, r in out.items()) and len(out) == 200
    store.delete(docs.where("doc_id < 2"))
    assert {r.doc_id: r.n_dropped for r in store.clean(docs.where("doc_id >= 2")).collect()} == {d: 0 if d == 2 else 2 for d in range(2, 200)}


def test_removal_takes_no_other_key(spark):
    """Filters of several small tables: after removals every key that was not removed is still known."""
    rng = np.random.default_rng(3)
    f, keys = linededup.CuckooFilter(), rng.integers(0, 256, (40000, 16)).astype(np.uint8)
    keys[:, 8] &= 3  # few fingerprints, so that many keys share one
    keys[:, 9] = 0
    for lo in range(0, len(keys), 4000):
        part = keys[lo:lo + 4000]
        f.insert(np.ascontiguousarray(part))
    assert len(f.tables) > 1 and f.contains(keys).all()
    f.remove(keys[::3])
    assert f.contains(np.delete(keys, np.s_[::3], axis=0)).all()
    f = linededup.CuckooFilter()
    wide = rng.integers(0, 256, (5000, 16)).astype(np.uint8)
    f.insert(wide)
    f.remove(wide)
    assert sum(int((t != 0).sum()) for t in f.tables) < 10


def test_cuckoo_filter():
    keys = np.random.default_rng(3).integers(0, 256, (30_000, 16), dtype=np.uint8)
    f = linededup.CuckooFilter()
    for lo in range(0, 20_000, 4000):
        f.insert(keys[lo:lo + 4000])
    f = linededup.CuckooFilter.load(f.dump())
    assert f.contains(keys[:20_000]).all()
    assert f.contains(keys[20_000:]).mean() < 0.01
    f.remove(keys[:500])
    assert f.contains(keys[500:20_000]).all()
    assert f.contains(keys[:500]).mean() < 0.02
    full = linededup.CuckooFilter([np.zeros((16, 4), np.uint16)])
    full.insert(keys[:60])  # nearly full: kicking, then a further table
    full.insert(keys[60:200])
    assert full.contains(keys[:200]).all()


# ---- near-duplicates ------------------------------------------------------------------------

def _components(rows):
    sets = defaultdict(list)
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets[doc].append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    name = {d: d for d in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                name[max(p, q)] = min(p, q)
    return sets, {d: find(d) for d in sets}


def _near_rows(seed=2):
    """Chains and families of near copies, some just below the threshold."""
    rnd = random.Random(seed)
    make = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        base = make(rnd.randrange(60, 200))
        for _ in range(rnd.randrange(1, 9)):
            base = list(base)
            for _ in range(rnd.randrange(0, 5)):
                base[rnd.randrange(len(base))] = "x" + str(rnd.random())
            rows.append(" ".join(base))
    rows += ["", " ", "two words", "Two  WORDS", None, " ".join(make(4000))]
    rnd.shuffle(rows)
    return [(k * 3, t) for k, t in enumerate(rows)]


def test_near_duplicates(spark, docs, rows, empty, odd):
    for some in ([(r[0], r[1]) for r in rows], _near_rows(), _near_rows(9) + [(3, "another text of id three that differs")]):
        path = scratch_path(spark, "near-test")
        spark.createDataFrame(some, "doc_id bigint, text string").write.parquet(path)
        got = neardup.near_duplicates(spark.read.parquet(path)).collect()
        sets, comp = _components(some)
        assert Counter(r.doc_id for r in got) == Counter(d for d, _ in some)
        for r in got:
            assert r.component_id == comp[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert neardup.near_duplicates(empty).count() == 0
    assert all(r.kept for r in neardup.near_duplicates(odd).collect())
    assert neardup.keep_one(odd).columns == odd.columns


def test_tiles_lose_no_pair(spark, monkeypatch):
    """A bucket many times the size of a tile gives the pairs that comparing all would."""
    monkeypatch.setattr(neardup, "TILE", 8)
    monkeypatch.setattr(neardup, "GROUP_ROWS", 32)
    monkeypatch.setattr(neardup, "PAIRS", 50)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 16, neardup.HASHES).astype("<u2")
    sig = [np.where(rng.random(neardup.HASHES) < rng.choice([0.1, 0.5]), rng.integers(0, 1 << 16, neardup.HASHES), base).astype("<u2") for _ in range(60)]
    for s in sig:
        s[:4] = base[:4]  # all agree on the first band
    members = spark.createDataFrame([(1, 0, 60, k, k % 7, k % 3, bytearray(s.tobytes())) for k, s in enumerate(sig)],
                                    "bucket bigint, band int, n bigint, node bigint, component bigint, block bigint, signature binary")
    none, keep = spark.createDataFrame([], "bucket bigint, n bigint, a bigint, b bigint"), Steps(spark, "tiles")

    def all_pairs(rows, done=none):
        out = []
        for r in neardup.packed_pairs(rows, done, 75, keep).collect():
            assert r.x <= r.y and all({k % 3 for k in (r.nodes[a], r.nodes[b])} == {r.x, r.y} for a, b in zip(r.left, r.right))
            assert [k % 7 for k in r.nodes] == r.components
            out += [(r.nodes[a], r.nodes[b]) for a, b in zip(r.left, r.right)]
        assert len(out) == len(set(out))
        return set(out)

    def first_pairs(done=none):
        return [(r.a, r.b) for r in neardup.likeliest_pairs(members, done, 75, keep).collect()]

    all_sig, least = np.stack(sig), neardup.least_equal(0.75)
    likely = {(a, b): equal[0] for b in range(60) for a in range(b) if a % 7 != b % 7
              for go, equal in [neardup.survives(all_sig, np.array([a]), all_sig, np.array([b]), least)] if len(go)}
    assert all_pairs(members) == set(likely) and likely
    assert not all_pairs(members.withColumn("band", F.lit(1)))
    def likeliest(pairs):
        out = {}
        for p in pairs:
            for c in {p[0] % 7, p[1] % 7}:
                out[c] = min(out.get(c, (0, p)), (-likely[p], p))
        return {p for _, p in out.values()}

    first = first_pairs()
    assert set(first) == likeliest(likely) and len(first) <= 7
    done = spark.createDataFrame([(1, 60, a, b) for a, b in first], "bucket bigint, n bigint, a bigint, b bigint")
    assert all_pairs(members, done) == set(likely) - set(first)
    assert set(first_pairs(done)) == likeliest(set(likely) - set(first))


@pytest.mark.parametrize("size", [100, 200, 400])
def test_a_family_is_verified_in_proportion(spark, monkeypatch, size):
    """Copies of one text that differ from each other by about the threshold: the components of brute force, without all pairs verified."""
    rnd = random.Random(size)
    base = [f"w{rnd.randrange(4000)}" for _ in range(300)]
    rows = []
    for k in range(size):
        words = list(base)
        for _ in range(rnd.randrange(3, 9)):
            words[rnd.randrange(len(words))] = f"x{rnd.random()}"
        rows.append((k, " ".join(words)))
    asked, plain = [], neardup.verified

    def spy(pairs, *more):
        asked.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(neardup, "verified", spy)
    path = scratch_path(spark, "family")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.read.parquet(path)).collect()}
    assert got == _components(rows)[1]
    assert sum(asked) <= 4 * size, asked


@pytest.mark.parametrize("size", [0, 1, 7, 3000])
def test_bitmap_lets_wanted_rows_pass(spark, size):
    rows = spark.range(40_000).withColumn("text", F.lit("t"))
    wanted = spark.range(size).select((F.col("id") * 13).alias("id"))
    got = {r.id for r in neardup.maybe_among(rows, wanted, "id").collect()}
    assert got >= {13 * k for k in range(size)} and len(got) <= size + 40_000 / 10
    assert neardup.maybe_among(rows, wanted, "id").columns == ["id", "text"]


def test_rows_of_one_id_with_different_texts_stay(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text, "b"), (1, text, "a"), (1, "quite another text", "c"), (2, text + " x", "d"), (2, "some more words here", "e"), (None, text, "f"), (None, text, "f")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert Counter(map(tuple, got)) == Counter([rows[1], rows[2], rows[5], rows[6]])


def test_posterior_bound():
    """The tail is that of the Beta posterior, and no true pair at the threshold is dropped more often than stated."""
    grid = np.linspace(0, 1, 200_001)
    for m, n, t in ((10, 32, 0.75), (40, 64, 0.75), (70, 128, 0.6)):
        density = grid ** m * (1 - grid) ** (n - m)
        assert neardup.tail(m, n, t) == pytest.approx(density[grid >= t].sum() / density.sum(), rel=1e-3)
    least = neardup.least_equal(0.75)
    assert least == sorted(least) and all(0 < x < 0.75 * neardup.BATCH * (k + 1) for k, x in enumerate(least))


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, 500 + k) for k in range(1, 60)] + [(rnd.randrange(900, 990), rnd.randrange(900, 990)) for _ in range(50)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint"), Steps(spark, "edges")).collect()}
    name = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    assert got == name


def test_hashes_tell_words_apart():
    rnd = random.Random(0)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 200))) for _ in range(3000)}
    assert len(np.unique(neardup.word_hashes(" ".join(words).encode()))) == len(words)


# ---- neighbours -----------------------------------------------------------------------------

def _vectors():
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in rng.normal(size=8)]) for k in range(700)]
    same = rows[3][1]
    rows += [(1000 + k, same) for k in range(40)] + [(2000, [2 * v for v in same])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [float("nan")] * 8), (3004, [None] * 8), (3005, [float("inf")] * 8), (3006, [1.0] * 5),
             (3050, [1.0, 2.0]), (None, same), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("shard,block", [(64, 4), (10**6, 10**6)])
def test_exact_neighbours(spark, shard, block):
    rows = _vectors()
    df = vptree.valid(spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, shard string")).checkpoint()
    index = vptree.build_index(df, 5, leaf=8, shard_rows=shard).checkpoint()
    got = defaultdict(list)
    for r in vptree.search(index, df.where("vec_id % 50 = 0"), 5, query_block=block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    for q in [i for i in good if i % 50 == 0]:
        others = [(i, float(vptree.cosine(good[q][None], v[None])[0])) for i, v in good.items() if i != q and len(v) == len(good[q])]
        assert got.pop(q, []) == sorted(others, key=lambda x: (-x[1], x[0]))[:5]
    assert not got


@pytest.mark.parametrize("leaf", [8, 256])
def test_scaled_copies_are_ranked_by_exact_score(leaf):
    rng = np.random.default_rng(1)
    one = rng.normal(size=64)
    x = np.concatenate([one * rng.uniform(0.1, 10, (200, 1)), rng.normal(size=(300, 64))])[rng.permutation(500)]
    u = vptree.length_one(x)
    q, p, _ = vptree.VpTree(u, leaf=leaf).search(u, 6)
    for k in range(500):
        score = vptree.cosine(np.repeat(x[k][None], 500, axis=0), x)
        best = lambda some: sorted((i for i in some if i != k), key=lambda i: (-score[i], i))[:5]  # noqa: B023, E731
        assert best(p[q == k]) == best(range(500))


def test_relaxed_search_does_less_and_keeps_recall():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    points = vptree.length_one(centres[rng.integers(60, size=6000)] + 0.2 * rng.normal(size=(6000, 16)))
    queries = vptree.length_one(centres[rng.integers(60, size=100)] + 0.2 * rng.normal(size=(100, 16)))
    tree = vptree.VpTree(points, leaf=64)
    exact = [set(np.argsort(-(points @ q))[:5]) for q in queries]
    work, recall = {}, {}
    for factor in (1.0, 0.6):
        q, p, work[factor] = tree.search(queries, 5, factor)
        recall[factor] = np.mean([len(exact[k] & set(p[q == k])) / 5 for k in range(100)])
    assert recall[1.0] == 1.0 and recall[0.6] >= 0.9
    assert work[0.6] < work[1.0] < points.shape[0] * 100


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vptree.nearest(none, "vec_id % 50 = 0", 5).count() == 0


# ---- the pipeline ---------------------------------------------------------------------------

def test_pipeline(spark, docs, rows):
    """Each stage on what the one before kept, against brute force."""
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, kept, "unused").write.parquet(path)
        seen[name] = (kept, spark.read.parquet(path))
        kept = seen[name][1]
        if name != "packing":
            assert kept.columns == list(corpus_pipeline.COLUMNS)
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    texts = dict((r[0], r[1]) for r in rows)
    first = pairs(seen["quality_rules"][1])
    assert 30 < len(first) < len(rows) and all(texts[d] == t for d, t in first) and not {50, 51, 52} & {d for d, _ in first}
    assert Counter(pairs(seen["line_dedup"][1])) == _kept_lines(first)
    before = pairs(seen["near_dedup"][0])
    _, comp = _components(before)
    assert Counter(pairs(seen["near_dedup"][1])) == Counter({(d, t): 1 for d, t in set(before) if comp[d] == d})
    assert {d for d, _ in pairs(seen["secret_scan"][1])} == {d for d, _ in pairs(seen["near_dedup"][1])}
    pieces = seen["packing"][1].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in pairs(seen["secret_scan"][1])}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_pipeline_of_nothing_and_of_odd_tables(spark, empty, odd):
    """No stage fails on an empty table, null ids or columns with the names that the operators use."""
    for table in (empty, odd):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, f"odd-{name}")
            stage(spark, kept, "unused").write.parquet(path)
            kept = spark.read.parquet(path)
            if name != "packing":
                assert kept.columns == list(corpus_pipeline.COLUMNS)
        assert kept.count() == 0  # the odd table's texts are too short for the quality rules
        for name, stage in corpus_pipeline.STAGES[1:]:
            assert (stage(spark, table, "unused").count() > 0) == (table is odd)


def test_entry_lists_these_queries():
    import __spark_entry__ as E
    assert {"pipeline", *registry.QUERIES} <= set(E.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


def test_small_steps_write_few_files(spark):
    """A step of a few hundred rows isn't a file for each shuffle partition: check_h has 211 of these, and near-dedup dozens of steps."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(i, i + 1) for i in range(600) if i % 3 != 2]
        keep = Steps(spark, "few")
        comp = neardup.components(spark.createDataFrame(edges, "a bigint, b bigint"), keep)
        assert {r.node: r.component for r in comp.collect()} == {n: n // 3 * 3 for n in range(600)}
        files = [len(spark.read.parquet(f"{keep.base}-{k}").inputFiles()) for k in range(1, keep.n + 1)]
        assert keep.n > 2 and max(files[1:]) <= 8, files
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
