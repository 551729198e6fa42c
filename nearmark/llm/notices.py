"""Operator 12: fuzzy search for short license notices.

A text is brought to its words (runs of code points other than ASCII signs and control characters, A-Z lower-cased) with one
space between. In these, every notice of the list may stand with at most ``errors`` inserted, deleted or replaced characters:

1. The notice is cut into ``errors + 1`` pieces, a long one into ``errors + 2``. An occurrence with no more errors leaves one piece
   intact, in a long notice two, so an exact search for all pieces of all notices at once (Aho-Corasick) meets every occurrence.
2. A piece found says where its notice would begin, give or take ``errors``; where two are asked for, they must agree. Only these
   places are looked at.
3. In each window the regex library's matching with a bound of errors verifies the notice, which must begin and end with words
   and, where the notice names one, hold its ``must`` word unharmed ("mt license" isn't "mit license"). Found ones are reported with their
   place in the text (code points) and errors.

Besides, the exact places of the base phrases, word by word, are listed. A document's score is 1 - product of (1 - how well it is
found) over its labels: a label's best notice counts its share of unharmed characters, less for shorter ones.

Rows are independent: one pass, no shuffle. A null text is empty, has no words, no places and the score 0. Repeated rows give
repeated results, an empty table none. A null doc_id is returned as it is; other columns, whatever their names, are not read.
Windows are bounded by the longest notice, so a text of any length takes linear time for the pieces that it holds. Of several
equally good matches in one window the first counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.llm.common import slices, texts_of
from nearmark.llm.neardup import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The base phrases, (words, label).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # words with single spaces, lower case
    errors: int
    must: str = ""  # words that the match must hold as they are


#: Short notices and the names of licenses, with the errors allowed in each.
NOTICES = (
    Notice("agpl", "gnu affero general public license", 3, "affero"),
    Notice("all-rights-reserved", "all rights reserved", 2),
    Notice("apache", "apache license version 2 0", 2, "apache"),
    Notice("apache", "apache software license", 2, "apache"),
    Notice("apache", "licensed under the apache license", 3, "apache"),
    Notice("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 10),
    Notice("artistic", "artistic license", 1, "artistic"),
    Notice("boost", "boost software license", 2, "boost"),
    Notice("bsd", "bsd license", 1, "bsd"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Notice("cc-by", "creative commons attribution", 2, "commons"),
    Notice("cc-by", "licensed under cc by", 2, "cc by"),
    Notice("cc0", "creative commons zero", 2, "zero"),
    Notice("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", 8),
    Notice("epl", "eclipse public license", 2, "eclipse"),
    Notice("gfdl", "gnu free documentation license", 3, "gnu"),
    Notice("gpl", "gnu general public license", 2, "gnu"),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 10, "gnu"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 10),
    Notice("lgpl", "gnu lesser general public license", 3, "lesser"),
    Notice("lgpl", "gnu library general public license", 3, "library"),
    Notice("mit", "mit license", 1, "mit"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 10),
    Notice("mpl", "mozilla public license", 2, "mozilla"),
    Notice("mpl", "this source code form is subject to the terms of the mozilla public license", 6, "mozilla"),
    Notice("no-warranty", "the software is provided as is without warranty of any kind express or implied", 7),
    Notice("public-domain", "released into the public domain", 2, "public domain"),
    Notice("spdx", "spdx license identifier", 2, "spdx"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
)
FULL = 24  # characters from which a notice counts whole
LONG = 60  # characters from which two pieces of a notice must be found


def intact(notice: Notice) -> int:
    """How many pieces the errors leave at least."""
    return 2 if len(notice.text) >= LONG else 1


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(place in the notice, piece): pieces of about one length that make up the notice."""
    n, k = len(notice.text), notice.errors + intact(notice)
    cut = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Searcher:
    """The pieces' automaton and the verifying patterns of a list of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(x.text, special_only=True)}){{e<={x.errors}}}(?![^ ])") for x in notices]
        self.must = [re.compile(rf"(?<![^ ]){re.escape(x.must)}(?![^ ])") for x in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, x in enumerate(notices):
            if len(x.text) < x.errors + intact(x):
                raise ValueError(f"a notice must be longer than its errors: {x}")
            for at, piece in pieces(x):
                seeds.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.automaton.add_word(piece, (len(piece), of))
        if seeds:
            self.automaton.make_automaton()
        self.empty = not seeds

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) in a text of words with single spaces, by notice and place."""
        begins: dict[int, set[tuple[int, int]]] = {}
        if not self.empty:
            for last, (size, of) in self.automaton.iter(text):
                for i, at in of:
                    begins.setdefault(i, set()).add((last + 1 - size - at, at))
        out = []
        for i in sorted(begins):
            x, done = self.notices[i], 0
            for b in agreeing(sorted(begins[i]), x.errors) if intact(x) > 1 else sorted({b for b, _ in begins[i]}):
                done = self._verify(i, text, b, done, out)
        return out

    def _verify(self, i: int, text: str, begin: int, done: int, out: list) -> int:
        """Adds the best match that begins at ``begin``, give or take the errors, and after ``done``; the new ``done``."""
        x = self.notices[i]
        lo, hi = max(begin - x.errors, done, 0), begin + len(x.text) + 2 * x.errors
        while lo <= begin + x.errors and x.must in text[lo:hi]:
            m = self.patterns[i].search(text, lo, min(hi + 2, len(text)))  # two characters more, so that what follows is seen
            if m is None or m.start() > begin + x.errors:
                break
            if not x.must or self.must[i].search(m[0]):
                out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                return m.end()
            lo = m.start() + 1
        return done


def agreeing(found: list[tuple[int, int]], errors: int) -> list[int]:
    """The begins of sorted (begin, piece) that two different pieces give, up to ``errors`` apart."""
    out, lo, inside = set(), 0, {}
    for b, piece in found:
        inside[piece] = inside.get(piece, 0) + 1
        while found[lo][0] < b - errors:
            old = found[lo][1]
            inside[old] -= 1
            if not inside[old]:
                del inside[old]
            lo += 1
        if len(inside) > 1:
            out.add(b)
    return sorted(out)


@lru_cache(4)
def searcher(notices: tuple[Notice, ...]) -> Searcher:
    return Searcher(notices)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.encode("utf-8").translate(LOWER).decode("utf-8"))


def base_places(text: str) -> list[tuple[int, str]]:
    """(number of the word, label) of every place of a base phrase in words with single spaces."""
    out = []
    padded = f" {text} "
    for phrase, label in BASE:
        word, seen, at = 0, 0, padded.find(f" {phrase} ")
        while at >= 0:
            word += padded.count(" ", seen, at)
            seen = at
            out.append((word, label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(out)


def scan_text(text: str, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int]], float]:
    """(number of words, base places, spans (label, start, end, errors) in code points of the text, score)."""
    words = words_of(text)
    joined = " ".join(words)
    base, hits = base_places(joined), searcher(notices).find(joined)
    spans, fit = [], {}
    if hits:
        where = [m.span() for m in WORD.finditer(text.encode("utf-8").translate(LOWER).decode("utf-8"))]
        for i, lo, hi, errors in hits:
            first, last = joined.count(" ", 0, lo), joined.count(" ", 0, hi)
            spans.append((notices[i].label, where[first][0], where[last][1], errors))
            n = len(notices[i].text)
            fit.setdefault(notices[i].label, []).append((n - errors) / n * min(1.0, n / FULL))
    for _, label in base:
        n = next(len(p) for p, x in BASE if x == label)
        fit.setdefault(label, []).append(min(1.0, n / FULL))
    left = 1.0
    for label in sorted(fit):
        left *= 1.0 - 0.95 * max(fit[label])
    return len(words), base, sorted(set(spans), key=lambda s: (s[1], s[2], s[0])), 1.0 - left


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, base array<struct<word, label>>, spans array<struct<label, start, end, errors>>, score) for each row of docs."""

    def run(batches):
        places = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        found = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32())]))
        for b in slices(batches):
            n, base, spans, score = zip(*(scan_text(t, notices) for t in b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(n, pa.int64()),
                pa.array([[{"word": w, "label": x} for w, x in row] for row in base], places),
                pa.array([[{"label": x, "start": lo, "end": hi, "errors": e} for x, lo, hi, e in row] for row in spans], found),
                pa.array(score, pa.float64())], ["doc_id", "n_words", "base", "spans", "score"])

    d = texts_of(docs)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words bigint, base array<struct<word:bigint,label:string>>, "
                             "spans array<struct<label:string,start:bigint,end:bigint,errors:int>>, score double")


def digest(scanned: DataFrame) -> DataFrame:
    """Per document the number of words, the base places as numbers, and the labels of both kinds."""

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return scanned.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"),
                          F.array_max("base.word").alias("last_word"), joined(F.col("base.label")).alias("base_labels"),
                          joined(F.concat("base.label", "spans.label")).alias("labels"), "score")
