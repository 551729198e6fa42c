"""The per-text operators against plain Python: secrets, BPE, packing, quality rules, classifier, language model."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearmark.llm import bytecnn, divergence, katz, packing, registry, secrets, wordbpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS_FILE, BYTES_FILE = registry.vocabulary("word_bpe_49k.json"), registry.vocabulary("byte_bpe_50k.json")
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'.,!aAbBsStT019é<|>"))), max_size=60)


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer
    return {f: Tokenizer.from_file(f) for f in (WORDS_FILE, BYTES_FILE)}


# ---- secrets --------------------------------------------------------------------------------

def test_guess_cost_orders_values():
    cost = secrets.guess_cost
    assert cost("") == 0
    assert cost("password") < cost("passw0rd") < cost("Kq7Lw2Zp")
    assert max(map(cost, ("changeme", "2019-04-03", "aaaaaaaaaaaa", "qwertyuiop", "hunter2x"))) < secrets.MIN_LOG10
    assert cost("x9$Lq02vTz!") > secrets.MIN_LOG10
    assert cost("xq" * 50_000) < 10  # one repeat, however long


def _all_segmentations(v):
    """The cheapest segmentation, over all cuts into single characters and dictionary words."""
    best = [0.0] + [math.inf] * len(v)
    for j in range(1, len(v) + 1):
        best[j] = best[j - 1] + secrets._brute(v[j - 1])
        for i in range(j - 2):
            if v[i:j] in secrets.RANK:
                best[j] = min(best[j], best[i] + math.log10(secrets.RANK[v[i:j]]) + secrets.PIECE)
    return best[-1]


def test_guess_cost_is_the_minimum_over_words():
    for v in ("xkingmonkeyxzq", "sunshinegkv", "theandfor", "dragonmasterv"):
        assert secrets.guess_cost(v) == pytest.approx(_all_segmentations(v))


def test_secrets_query(docs, rows, empty, odd):
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(docs)).collect()}
    for doc, text, *_ in rows:
        text = text or ""
        base = [("assign", m.start(), m.end()) for m in re.finditer(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        base.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        r = got[doc]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in base) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("guess")] == [f"{k}:{a}:{b}" for k, a, b in base]
    last = got[max(got)]
    assert last.n_assign == 2 and "guess" in last.spans
    assert secrets.scan(empty).count() == 0 and secrets.scan(odd).count() == 3
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert "AKIA" not in clean[max(got)] and "x9$L" not in clean[max(got)] and clean[0] == rows[0][1]
    assert secrets.redact(odd).columns == odd.columns


@pytest.mark.parametrize("text,value", [
    ("Authorization: Bearer Zk3v9QpLm2XwT7", "Zk3v9QpLm2XwT7"), ('"Authorization": "Basic Zk3v9QpLm2XwT7"', "Zk3v9QpLm2XwT7"), ("sent bearer Zk3v9QpLm2XwT7.", "Zk3v9QpLm2XwT7"),
    ("x-api-key: Zk3v9QpLm2XwT7", "Zk3v9QpLm2XwT7"), ("client-secret-key: Zk3v9QpLm2XwT7, x", "Zk3v9QpLm2XwT7"), ("api key = Zk3v9QpLm2XwT7;", "Zk3v9QpLm2XwT7"),
    ('pwd: "aB3(xY9,kL7q"', "aB3(xY9,kL7q"), ("pwd: aB3$xY9(kL7q and", "aB3$xY9(kL7q"), ("pwd: 'aB3 xY9 kL7q', b", "aB3 xY9 kL7q"), ('pwd: "aB3(xY9,kL7q', "aB3(xY9,kL7q"),
    ('{"login":1,"pwd":"aB3$xY9kL7q","n":2}', "aB3$xY9kL7q"), ('pwd: aB3"xY9kL7q', 'aB3"xY9kL7q')])
def test_context_values_are_whole(text, value):
    lo = text.index(value)
    assert secrets.find_spans(text)[-1] == ("guess", lo, lo + len(value))
    assert secrets.redact_text(text, secrets.find_spans(text)).count("[SECRET]") == 1


def test_bearer_and_basic_as_words():
    assert not secrets.find_spans("the bearer certificate and basic understanding; token: none.")


def test_redaction_merges_overlaps():
    assert secrets.redact_text("ab cdef gh", [("assign", 0, 6), ("guess", 3, 7), ("hex", 8, 10)]) == "[SECRET] [SECRET]"


CLEAN = ("compass: northern", "bypass: disabled", "login: required", "auth: enabled", "the access key: mountain", "pwd: gardening", "credentials: provided separately")


def test_ordinary_words_and_word_starts(spark):
    """Words of the corpus are cheap, values in a context are not counted as words, however often they are repeated."""
    prose = "northern required enabled mountain gardening provided disabled"
    rows = [(i, t) for i, t in enumerate([prose] * 6 + list(CLEAN) + ["pwd: gkvqwzpx"] * 40 + ["the compass at pwd: gkvqwzpxy", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    ranks = secrets.corpus_ranks(docs)
    assert {"northern", "gardening"} <= set(ranks) and "gkvqwzpx" not in ranks
    assert len(secrets.corpus_ranks(docs, most=2)) <= 2 + len(secrets.RANK)
    got = {r.doc_id: [s["kind"] for s in r.spans] for r in secrets.scan(docs).collect()}
    assert [i for i, s in got.items() if s] and {i for i, s in got.items() if s == ["guess"]} == set(range(13, 54))
    assert all(not s for i, s in got.items() if i < 13)
    wide = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "n_chars": F.lit(1).cast("bigint"), "word": F.lit(1), "n": F.lit(2)})
    out = {r.doc_id: r for r in secrets.redact(wide).collect()}
    assert [out[6 + i].text for i in range(len(CLEAN))] == list(CLEAN) and out[13].text == "pwd: [SECRET]" and out[13].word == 1


def test_keys_in_names_and_private_keys():
    for text, value in (("dbPassword: x9Lq02vTz", "x9Lq02vTz"), ("client_secret=Zk3v9QpLm2", "Zk3v9QpLm2"), ("DB_PWD=aB3$xY9kL7q", "aB3$xY9kL7q")):
        lo = text.index(value)
        assert ("guess", lo, lo + len(value)) in secrets.find_spans(text)
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\nx9\n-----END RSA PRIVATE KEY-----"
    text = "-----BEGIN EC PRIVATE KEY----- cut off, then private key: " + key + " end"
    at = text.index(key)
    assert ("pem", at, at + len(key)) in secrets.find_spans(text) and secrets.redact_text(text, secrets.find_spans(text)).endswith("private key: [SECRET] end")
    assert not secrets.find_spans("-----BEGIN RSA PRIVATE KEY----- without end")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abqwe12", max_size=11))
def test_guess_cost_is_the_minimum_over_words_repeats_and_walks(v):
    """Against all segmentations, each piece priced by its definition."""

    def cheapest(s):
        best = [0.0] + [math.inf] * len(s)
        for j in range(1, len(s) + 1):
            best[j] = best[j - 1] + secrets._brute(s[j - 1])
            for i in range(j):
                piece, costs = s[i:j], []
                if len(piece) >= 3 and (r := secrets.RANK.get(piece) or secrets.RANK.get(piece.translate(secrets.LEET))):
                    costs.append(math.log10(r) + (piece not in secrets.RANK) * math.log10(4))
                if len(piece) >= 3 and all(x in secrets.NEXT for x in zip(piece, piece[1:])):
                    costs.append(math.log10(94) + math.log10(len(piece)))
                for p in range(1, len(piece) // 2 + 1):
                    times = len(piece) // p
                    # a repeat goes on as often as it can, and has the shortest unit that reaches as far
                    reach = [i + q * t for q in range(1, p) for t in [times_from(s, i, q)] if t >= (2 if q > 2 else 3)]
                    if times * p == len(piece) and piece[:p] * times == piece and times >= (2 if p > 2 else 3) and times_from(s, i, p) == times and max(reach, default=0) < j:
                        costs.append(cheapest(piece[:p]) + math.log10(times))
                best[j] = min([best[j], *(best[i] + c + secrets.PIECE for c in costs)])
        return best[-1]

    def times_from(s, i, p):
        t = 1
        while s[i + p * t:i + p * (t + 1)] == s[i:i + p]:
            t += 1
        return t

    assert secrets.guess_cost(v) == pytest.approx(cheapest(v))


# ---- BPE ------------------------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_bpe_equals_library(lib, text):
    own = wordbpe.loaded(WORDS_FILE)
    ids = lib[WORDS_FILE].encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == lib[WORDS_FILE].decode(ids, skip_special_tokens=False)


def test_word_bpe_every_code_point(lib):
    own, chars = wordbpe.loaded(WORDS_FILE), [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(chars), 64):
        text = " ".join(f"a{c}b 1{c}" for c in chars[lo:lo + 64])
        assert own.encode(text) == lib[WORDS_FILE].encode(text, add_special_tokens=False).ids, hex(ord(chars[lo]))


def test_word_bpe_query(docs, rows, empty, odd, lib):
    got = {r.doc_id: r for r in wordbpe.digest(docs, WORDS_FILE).collect()}
    full = {r.doc_id: r for r in wordbpe.encode(docs, WORDS_FILE).collect()}
    for doc, text, *_ in rows:
        ids = lib[WORDS_FILE].encode(text or "", add_special_tokens=False).ids
        back = lib[WORDS_FILE].decode(ids, skip_special_tokens=False)
        r = got[doc]
        assert (r.n_tokens, full[doc].ids, full[doc].decoded) == (len(ids), ids, back)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert wordbpe.digest(empty, WORDS_FILE).count() == 0 and wordbpe.digest(odd, WORDS_FILE).count() == 3


# ---- packing --------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_byte_ids_equal_library(lib, text):
    raw = packing.loaded(BYTES_FILE).of([text])[0]
    assert np.frombuffer(raw, "<u4").tolist() == lib[BYTES_FILE].encode(text, add_special_tokens=False).ids


def _cheapest(at, penalty, size):
    """The least cost over all cuts, by trying every window."""
    best = [0.0] + [math.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= size:
                cost = size - n
                if n & (n - 1) == 0 and 4 * n >= size:
                    cost = min(cost, (n < size) * packing.SHORT)
                best[j] = min(best[j], best[i] + cost + penalty[j])
    return best[-1]


def _cost(at, penalty, cuts, size):
    total, i = 0.0, 0
    for j in cuts:
        n = at[j] - at[i]
        cost = size - n
        if n & (n - 1) == 0 and 4 * n >= size:
            cost = min(cost, (n < size) * packing.SHORT)
        total, i = total + cost + penalty[j], j
    return total


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([0.0, 0.5, 6.0])), min_size=1, max_size=40), st.sampled_from([32, 64]))
def test_cuts_are_optimal(steps, size):
    at, penalty = [0, *np.cumsum([s for s, _ in steps]).tolist()], [0.0, *[p for _, p in steps]]
    cuts = packing.choose_cuts(at, penalty, size)
    assert cuts[-1] == len(at) - 1
    assert all(at[j] - at[i] <= size for i, j in zip([0, *cuts], cuts))
    assert _cost(at, penalty, cuts, size) == pytest.approx(_cheapest(at, penalty, size))


@pytest.mark.parametrize("order", [None, ["doc_id"]])
def test_packing_query(docs, rows, empty, odd, lib, order):
    out = packing.digest(packing.pack(docs, BYTES_FILE, order)).collect()
    raw = defaultdict(list)
    for r in packing.pack(docs, BYTES_FILE, order).collect():
        raw[(r.doc_id, r.start)].append(bytes(r.ids))
    ids = {doc: [*lib[BYTES_FILE].encode(text or "", add_special_tokens=False).ids, 0] for doc, text, *_ in rows}
    times = Counter(r[0] for r in rows)
    placed, sequences = defaultdict(Counter), defaultdict(list)
    for r in out:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        placed[r.doc_id].update(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, want in ids.items():
        assert placed[doc] == Counter({k: times[doc] for k in range(len(want))})
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SIZE
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
    assert padding < 3 * packing.SIZE + 0.02 * sum(map(len, ids.values()))  # the last window of each of three parts
    assert packing.pack(empty, BYTES_FILE).count() == 0
    assert packing.pack(odd, BYTES_FILE).count() >= 3


def test_stream_is_independent_of_the_horizon_in_what_it_places():
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(1, 9, rng.integers(0, 700)).astype("<u4").tobytes()) for k in range(60)]
    ends = np.zeros(10, bool)
    ends[3] = True
    for horizon in (128, 5000, 10**9):
        back = defaultdict(bytes)
        for row, start, raw, total, _, _ in packing.pack_stream(docs, ends, 64, 16, horizon):
            assert len(back[row]) == 4 * start and total * 4 == len(dict(docs)[row]) + 4
            back[row] += raw
        assert all(back[k] == raw + bytes(4) for k, raw in docs)


# ---- quality rules --------------------------------------------------------------------------

def _base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len({p for i, x in enumerate(windows) if n[x] > 1 for p in (i, i + 1, i + 2)}))


def _js(a, b):
    if not sum(a) or not sum(b):
        return None
    p, q = np.array(a) / sum(a), np.array(b) / sum(b)
    m = (p + q) / 2
    part = lambda x: sum(v * math.log2(v / y) for v, y in zip(x, m) if v > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def _classes(text):
    out = []
    for c in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:'\"()-]", r"[#*$%&|<>]", r"[^\x00-\x7F]"):
        out.append(len(re.findall(c, text)))
    return [*out, len(text) - sum(out)]


def test_quality_query(docs, rows, empty, odd):
    got = {r.doc_id: r for r in divergence.digest(docs).collect()}
    langs = defaultdict(list)
    for doc, text, lang, *_ in rows:
        langs[lang].append((doc, text or ""))
    count = Counter(w for _, t in langs["en"] for w in WORD.findall(t) if re.fullmatch(r"[a-z]{1,8}", w))
    common = sorted(w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:divergence.COMMON])

    def words(text):
        n = Counter(WORD.findall(text))
        return [*[n[w] for w in common], sum(n.values()) - sum(n[w] for w in common)]

    hist = {(doc, t): (_classes(t), words(t)) for doc, t in langs["en"]}
    keep = dict.fromkeys(hist, True)
    for _ in range(2):  # the references, and again without what stands apart
        use = [h for (doc, t), h in hist.items() if keep[doc, t] for _ in range(sum(1 for d, x in langs["en"] if (d, x) == (doc, t)))]
        ref = np.sum([h[0] for h in use], axis=0), np.sum([h[1] for h in use], axis=0)
        far = {k: (_js(h[0], ref[0]), _js(h[1], ref[1])) for k, h in hist.items()}
        for k in hist:
            n, chars = _base(k[1])[:2]
            keep[k] = not ((chars >= divergence.MIN_CHARS_JS and far[k][0] > divergence.MAX_CHARS_JS)
                           or (n >= divergence.MIN_WORDS_JS and far[k][1] > divergence.MAX_WORDS_JS))
    for doc, text, lang, *_ in rows:
        r, want = got[doc], _base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if lang == "en":
            k = (doc, text or "")
            assert r.kept == (keep[k] and not r.base_failed)
            for x, y in ((r.chars_js, far[k][0]), (r.words_js, far[k][1])):
                assert x == pytest.approx(y, abs=1e-9) if y is not None else x is None
        else:
            assert r.words_js is None
    assert got[0].kept
    assert divergence.digest(empty).count() == 0
    assert divergence.keep(odd).columns == odd.columns


def _scripts(langs, copies=12):
    """Clean documents of invented words in each language's letters, 120 words each."""
    out = []
    for lang, letters in langs:
        vocab = [letters[k % len(letters)] + letters[(3 * k + 1) % len(letters)] + letters[(7 * k + 2) % len(letters)] for k in range(30)]
        for k in range(copies):
            rng = np.random.default_rng(k)
            out.append((len(out), " ".join(vocab[i] for i in rng.permutation(np.arange(120) % 30)), lang, "s", 0))
    return out


def test_quality_of_scripts_without_case(spark):
    latin, arabic, thai = "etaoinshrdlu", "\u0627\u0628\u062a\u062b\u062c\u062d\u062e\u062f\u0630\u0631\u0632\u0633", "\u0e01\u0e02\u0e04\u0e07\u0e08\u0e09\u0e0a\u0e0b\u0e14\u0e15"
    rows = _scripts([("en", latin)], 30) + _scripts([("ar", arabic)], 6)
    rows += [(0, "".join(t.split()), "th", s, c) for _, t, _, s, c in _scripts([("th", thai)], 6)]  # no spaces, so no short words
    rows += [(0, t, None, s, c) for _, t, _, s, c in _scripts([("en", latin), ("ar", arabic)], 3)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    docs = _as_file(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = {r.doc_id: r for r in divergence.judge(docs).collect()}
    for k, _, lang, *_ in rows:
        r = got[k]
        assert r.kept == (lang != "th")  # one word in a Thai text here: fails the base rules only
        assert (r.words_js is not None) == (lang in ("en", "ar"))
        if lang is not None:
            assert r.chars_js < 0.05
    assert max(r.chars_js for k, r in got.items() if rows[k][2] is None) > divergence.MAX_CHARS_JS


def test_quality_of_many_languages(spark):
    arabic = "\u0627\u0628\u062a\u062b\u062c\u062d\u062e\u062f\u0630\u0631\u0632\u0633"
    rows = _scripts([("en", "etaoinshrdlu")], 40) + 2 * _scripts([(f"l{k:03}", "etaoinshrdlu") for k in range(260)], 1) + _scripts([("zz", arabic)], 1)
    docs = _as_file(spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4))
    got = sorted(divergence.judge(docs).collect())
    assert all(r.kept and r.chars_js < 0.05 and r.words_js < 0.05 for r in got)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more languages than can be broadcast
    try:
        assert sorted(divergence.judge(docs).collect()) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# ---- classifier -----------------------------------------------------------------------------

def test_cnn_gradients():
    net, rng = bytecnn.ByteCnn(), np.random.default_rng(0)
    net.weights[:] = rng.normal(0, 0.5, net.weights.shape)
    texts, y = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (700, 3, 0, 1500)], np.array([1, 0, 1, 0])

    def loss():
        z = net.features(texts)[0].astype(np.float64) @ net.weights + net.bias[0]
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    for p, g in zip(net.params(), net.gradients(texts, y)):
        i, h = np.unravel_index(np.argmax(abs(g)), g.shape), 1e-3
        old = p[i]
        p[i] = old + h
        up = loss()
        p[i] = old - h
        down = loss()
        p[i] = old
        assert g[i] == pytest.approx((up - down) / (2 * h), rel=0.02)


def test_cnn_features_cover_the_whole_text():
    net, size = bytecnn.ByteCnn(), 2 * bytecnn.HOP
    text = bytes(np.random.default_rng(2).integers(97, 123, 5000).astype(np.uint8))
    x = net.table[np.frombuffer(text.ljust(-(-len(text) // bytecnn.HOP) * bytecnn.HOP + bytecnn.WIDTH, b"\0"), np.uint8)]
    answers = {a: x[a:a + bytecnn.WIDTH].ravel() @ net.filters for a in range(0, -(-len(text) // bytecnn.HOP) * bytecnn.HOP, bytecnn.STRIDE)}
    chunks = [np.max([v for a, v in answers.items() if lo <= a < lo + size], axis=0) for lo in range(0, len(text), bytecnn.HOP)]
    want = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    assert net.features([text])[0][0] == pytest.approx(want, abs=1e-4)
    assert net.features([b"", text])[0][1] == pytest.approx(want, abs=1e-4)


def test_training_texts_are_whole(spark):
    texts = {k: "".join(chr(97 + (i * i + k * i // 7) % 26) for i in range(4000 + 997 * k)) + "\u00e9" for k in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id bigint, quality int")
    raw, y = bytecnn.training_rows(docs, labels)
    use = [k for k in texts if zlib.crc32(str(k).encode()) % 5]
    assert raw == [texts[k].encode() for k in use] and y == [k % 2 for k in use]
    more = docs.unionByName(docs.selectExpr("doc_id", "concat('zz', text) as text")).unionByName(docs.selectExpr("doc_id", "substring(text, 1, 2000) as text"))
    assert bytecnn.training_rows(more.repartition(5), labels)[0] == [texts[k][:2000].encode() for k in use]
    some, _ = bytecnn.training_rows(more, labels, bytes_per_class=5000)
    assert len(some) == 4 and set(some) <= {texts[k][:2000].encode() for k in use}


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in registry.op2_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for d, r in out.items())
    ranked = sorted((out[d].score, q) for d, q in labels.items() if out[d].held_out)
    n1 = sum(q for _, q in ranked)
    auc = (sum(k + 1 for k, (_, q) in enumerate(ranked) if q) - n1 * (n1 + 1) / 2) / (n1 * (len(ranked) - n1))
    assert auc > 0.95


def test_classifier_without_labels(spark, docs, empty, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in bytecnn.classify(docs, none).collect()} == {0.5}
    assert bytecnn.classify(empty, none).count() == 0
    some = spark.createDataFrame([(0, 1, 0), (50, 0, 0), (1, 1, 0), (51, 0, 0), (None, 0, 0), (2, None, 0), (3, 1, 0), (3, 0, 0)],
                                 "doc_id bigint, quality int, extra int")
    assert bytecnn.classify(odd, some).count() == 3


# ---- language model -------------------------------------------------------------------------

def _katz(texts):
    k = katz.K
    train = {d for d in texts if zlib.crc32(str(d).encode()) % 10}
    c1, c2, ch = Counter(), Counter(), Counter()
    for d in train:
        c1.update(texts[d])
        seq = ["<s>", *texts[d]]
        c2.update(zip(seq, seq[1:]))
        ch.update(seq[:-1])

    def discounts(counts):
        n = Counter(counts.values())
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        d = [1.0]
        for r in range(1, k + 1):
            good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
            d.append(good if 0 < good < 1 else (r - 0.5) / r)
        return lambda c: d[c] * c if c <= k else c

    d1, d2, total = discounts(c1), discounts(c2), sum(c1.values())
    one = {w: d1(c) / total for w, c in c1.items()}
    unknown = 1 - sum(one.values())
    followers = defaultdict(list)
    for (h, w), c in c2.items():
        followers[h].append((w, c))
    size = {h: ch[h] + all(c > k for _, c in f) for h, f in followers.items()}
    alpha = {h: (1 - sum(d2(c) for _, c in f) / size[h]) / (1 - sum(one[w] for w, _ in f)) for h, f in followers.items()}

    def p(h, w):
        c = c2.get((h, w))
        return d2(c) / size[h] if c else alpha.get(h, 1.0) * one.get(w, unknown)

    for h in ["<s>", "the", "never seen", *list(followers)[:5]]:
        assert sum(p(h, w) for w in one) + alpha.get(h, 1.0) * unknown == pytest.approx(1.0)
    base = lambda w: math.log10((c1[w] + 0.1) / (total + 0.1 * (len(c1) + 1)))
    return train, total, {d: (sum(c1[w] > 0 for w in t), sum(map(base, t)), sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t)))
                          for d, t in texts.items()}


@pytest.mark.parametrize("split", [1, 50, 10**6])
def test_katz_query(docs, rows, split):
    # a document that comes twice is counted twice
    out = katz.score(docs.dropDuplicates(["doc_id"]).orderBy("doc_id").transform(_as_file), docs_per_bucket=10, pairs_per_bucket=500, split=split)
    got = {r.doc_id: r for r in out.collect()}
    texts = {doc: [*WORD.findall((t or "").translate(LOW)), "</s>"] for doc, t, *_ in rows}
    train, total, want = _katz(texts)
    assert set(got) == set(texts)
    for doc, r in got.items():
        known, base, score = want[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (doc not in train, len(texts[doc]), known, total)
        assert (r.base_score, r.score) == (pytest.approx(base, abs=1e-8), pytest.approx(score, abs=1e-8))


def _as_file(df):
    from nearmark.session import scratch_path
    path = scratch_path(df.sparkSession, "katz-test")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_katz_awkward_tables(empty, odd, docs, rows):
    assert katz.score(empty).count() == 0
    assert katz.score(odd).count() == 3
    assert katz.score(docs).count() == len(rows)


def test_katz_beats_the_base_on_held_out_texts(spark):
    out = katz.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("held_out").toPandas()
    assert out["score"].sum() > 0.8 * out["base_score"].sum()


def test_pieces_are_encoded_when_asked_for_and_once():
    from nearmark.llm.packing import Known, pack_ids
    asked = []
    known = Known(lambda piece: asked.append(piece) or [len(piece), 7])
    assert b"".join(map(known.__getitem__, ["ab", "c", "ab"])) == pack_ids([2, 7, 1, 7, 2, 7])
    assert asked == ["ab", "c"] and len(known) == 2
