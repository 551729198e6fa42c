"""License notices: every label against edit distances of all word-bounded substrings, base places against lists of words."""

import random

import pytest

from nearmark.llm import notices as N


def occurrences(pattern, text, most):
    """(start, end) of the substrings that begin and end at words and differ by ``most`` edits or fewer."""
    out = []
    for s in (i for i in range(len(text) + 1) if i == 0 or text[i - 1] == " "):
        row = list(range(len(pattern) + 1))
        for e in range(s, min(len(text), s + len(pattern) + most) + 1):
            if e > s:
                new = [e - s]
                for i, c in enumerate(pattern, 1):
                    new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (c != text[e - 1])))
                row = new
            if row[-1] <= most and (e == len(text) or text[e] == " "):
                out.append((s, e))
    return out


def changed(rnd, text, edits):
    t = list(text)
    for _ in range(edits):
        at, kind = rnd.randrange(len(t)), rnd.randrange(3)
        if kind == 0:
            t[at] = rnd.choice("abcx e")
        elif kind == 1:
            t.insert(at, rnd.choice("abz "))
        elif len(t) > 1:
            del t[at]
    return "".join(t)


@pytest.mark.parametrize("notice", N.NOTICES, ids=lambda x: f"{x.label}-{len(x.text)}")
def test_seeds_lose_no_occurrence(notice):
    rnd = random.Random(notice.text)
    search, i = N.searcher(N.NOTICES), N.NOTICES.index(notice)
    short = [k for k, y in enumerate(N.NOTICES) if len(y.text) <= 40]
    for _ in range(12):
        parts = [changed(rnd, notice.text, rnd.randrange(notice.errors + 3)) for _ in range(rnd.randrange(1, 3))]
        text = " ".join(N.words_of(rnd.choice(["", "foo ", "of the "]) + rnd.choice([" ", " public "]).join(parts) + rnd.choice(["", " bar", "s", " mit licence"])))
        found = search.find(text)
        for k in {i, *short}:
            y = N.NOTICES[k]
            want = [(a, b) for a, b in occurrences(y.text, text, y.errors) if not y.must or search.must[k].search(text[a:b])]
            got = [(a, b) for x, a, b, _ in found if x == k]
            assert bool(got) == bool(want) and set(got) <= set(want)


def test_pieces_make_up_the_notice():
    for x in N.NOTICES:
        parts = N.pieces(x)
        assert "".join(p for _, p in parts) == x.text and len(parts) == x.errors + N.intact(x) and min(len(p) for _, p in parts) >= 3
        assert x.text == " ".join(N.words_of(x.text))


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT Licence.", {"mit"}), ("under the mt license", set()), ("submit license forms", set()), ("MIT\n * License", {"mit"}),
    ("GNU Genral Public License", {"gpl"}), ("Apache Licence, Version 2.0", {"apache"}), ("Eclipse Public Licence - v 2.0", {"epl"}),
    ("a driving license is required by law", set()), ("the apache attacked; permission is granted", set()),
    ("Permission is hereby granted, free of charge, to any persons obtaining a copy of this\n# sofware and associated documentation files", {"mit"})])
def test_labels_of_phrases(text, labels):
    _, base, spans, score = N.scan_text(text)
    assert {s[0] for s in spans} == labels and (score > 0) == bool(labels or base) and 0 <= score < 1
    assert all(text[a:b].strip() == text[a:b] and a < b for _, a, b, _ in spans)


def test_spans_are_places_in_the_text():
    text = "Ünïc😀de —\tThe  MIT \n * Licence!"
    (label, a, b, errors), = N.scan_text(text)[2]
    assert (label, text[a:b], errors) == ("mit", "MIT \n * Licence", 1)


def test_licenses_query(spark, docs, rows, empty, odd):
    texts = [t for _, t, *_ in rows] + ["CC BY CC-BY; cc by-nc", "gnu general public license gnu general public license", "Mit License. apache LICENSE, mit licence", "cc  bye occ by"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in N.digest(N.scan(table)).collect()}
    for k, text in enumerate(texts):
        words = N.words_of(text or "")
        places = [(i, label) for phrase, label in N.BASE for i in range(len(words)) if words[i:i + len(p := phrase.split())] == p]
        r = got[k]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[len(texts) - 2].labels == "apache,mit" and got[0].labels == "" and got[0].score == 0
    assert N.digest(N.scan(empty)).count() == 0 and N.digest(N.scan(odd)).count() == 3
    assert N.digest(N.scan(docs)).count() == len(rows)


def test_very_long_text():
    text = "license public " * 60_000 + "mit licence " + "as is without " * 30_000
    n, _, spans, _ = N.scan_text(text)
    assert n == 210_002 and [s[0] for s in spans] == ["mit"]
