"""Spelling variants: near words, forms and roots against comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from nearmark.llm import variants as V


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plainly(table, factor=10):
    form, number = {}, {}
    for w, n in table.items():
        others = [(-table[x], x) for x in table if near(w, x)]
        number[w] = len(others)
        form[w] = min(others)[1] if others and -min(others)[0] >= factor * n else None
    out = {}
    for w in table:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, table[w], number[w], table.get(form[w]))
    return out


def vocabulary(seed, size, letters, lo, hi):
    rnd = random.Random(seed)
    out = {}
    while len(out) < size:
        out["".join(rnd.choice(letters) for _ in range(rnd.randrange(lo, hi)))] = int(10 ** (rnd.random() * 5)) + 2
    return out


TABLES = {
    "short and dense": vocabulary(1, 400, "ab", 1, 10),
    "usual": vocabulary(2, 400, "abc", 6, 9),
    "beyond Latin": vocabulary(3, 250, "aÿ漢😀", 1, 7),
    "long": vocabulary(4, 60, "ab", 20, 21) | {"x" * n: n + 2 for n in range(1, 60)},
    "chain and ties": {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaaabba": 200, "caaaaaa": 20},
    "none": {},
}


@pytest.mark.parametrize("tile,rows", [(1024, 16384), (3, 10)])
@pytest.mark.parametrize("name", TABLES)
def test_groups_equal_all_pairs(spark, monkeypatch, name, tile, rows):
    monkeypatch.setattr(V, "TILE", tile)
    monkeypatch.setattr(V, "ROWS", rows)
    table = spark.createDataFrame(list(TABLES[name].items()), "word string, n bigint")
    assert {r.word: tuple(r)[1:] for r in V.group(table).collect()} == plainly(TABLES[name])


def test_a_hot_bucket_is_dealt_into_tiles(spark):
    """3,000 words in one bucket: no tile holds more than about two parts of it, every pair of parts is a tile."""
    words = [f"same{chr(0x4e00 + k)}{chr(0x4e00 + j)}rest" for k in range(55) for j in range(55)]
    rows = V.tiles(V.keyed(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")))
    sizes = {(r.i, r.j): r["count"] for r in rows.where("len = 10 and seg = 2").groupBy("i", "j").count().collect()}
    assert set(sizes) == {(i, j) for i in range(3) for j in range(i, 3)} and max(sizes.values()) < 3 * V.TILE
    got = V.group(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint"))
    assert {r.n_near for r in got.collect()} == {54 + 54}


def test_bounds_cut_the_word_into_segments():
    for n in range(1, 400):
        cut = V.bounds(n)
        assert cut[0] == 0 and cut[-1] == n and (cut[1:] > cut[:-1]).all() and len(cut) - 1 <= V.SEGMENTS


def counted(rows):
    out = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def test_variants_query(spark, docs, rows, empty, odd, monkeypatch):
    more = [(100 + k, "Spelling of VARIANTES, variants; crème brûlées variants÷× " * (k + 1) + "varients spellings " + "z" * 30, None, None, None) for k in range(40)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    want = counted([*rows, *more])
    assert any(w not in re.findall(r"\w+", more[0][1].lower()) for w in want)  # the draw has changed some
    for held in (V.HELD, 5):
        monkeypatch.setattr(V, "HELD", held)
        assert {r.word: r.n for r in V.words(table).collect()} == want
    assert {r.word: tuple(r)[1:] for r in V.variants(table).collect()} == plainly(want)
    assert V.variants(empty).count() == 0
    got = V.variants(odd).collect()
    assert {r.word: r.n for r in got} == counted([(None, "a line of some length\nanother"), (None, None), (7, "a line of some length\nx")])
