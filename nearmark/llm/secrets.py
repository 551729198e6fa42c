"""Operator 10: secret scan with password guess costs.

Three base patterns find assignments, access keys and long hex strings. On top
of them every value that stands in a credential context (``pwd: ...``,
``client_secret=...``) is priced: dynamic programming finds the cheapest way
to cut the value into dictionary words, dates, repeats, keyboard walks and
brute-force characters, and the value is reported (kind ``guess``) if even the
cheapest way needs at least ``10 ** min_log10`` guesses. So ``password:
changeme`` adds nothing and ``pwd: x9$Lq02vTz`` does. Private keys between
their BEGIN and END lines are reported whole (kind ``pem``).

The dictionary is counted over the texts first (``corpus_ranks``): the words in
most documents, by rank, without what stands in a credential context, so a
secret that thousands of copies hold is no word. ``login: required`` then costs
the rank of ``required``. A word in fewer than ``LEAST_DOCS`` documents is priced
as brute force, and reported if it is long enough.

A key must start a word (``compass:`` is no ``pass:``; ``client_secret`` and
``dbPassword`` are keys). A repeat has a unit of at most ``LONGEST_UNIT`` code
points and is taken as often as it goes on; walks are taken in any part.

Texts are scanned in one pass without shuffle; counting shuffles one row per
word and batch. A null text is empty and has no span; repeated rows give
repeated results; an empty table gives no rows; values of any length are priced
whole (the programme is linear in the length). ``scan`` reads doc_id and text
alone; ``redact`` hands on all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.llm.common import Steps, slices, texts_of
from nearmark.operators.indexing import sorted_index

KINDS = ("assign", "access", "hex", "guess", "pem")
MIN_LOG10 = 8.0
MOST_WORDS, LEAST_DOCS = 50_000, 5  # words that are counted into the dictionary, and documents that each must be in
SHORTEST_WORD, LONGEST_WORD = 3, 24
LONGEST_UNIT = 32

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# A quoted value goes to its closing quote, a bare one to white space or to a quote that does not follow a value's character.
QUOTED = r"""(?:"((?:\\.|[^"\\\x00-\x1f])*)"|'((?:\\.|[^'\\\x00-\x1f])*)'|`((?:\\.|[^`\\\x00-\x1f])*)`)"""
BARE = r"""((?:[^\x00-\x20"'`]|(?<![,:;=(){}\[\]\x00-\x20"'`])["'`])+)"""
CONTEXT = re.compile(
    # a key starts a word, or a part of a name in camel case
    r"""(?:(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass(?:[-_\x20]?(?:word|wd|phrase|code))?|pwd|secret(?:[-_\x20]?key)?|token|(?:api|access|private)[-_\x20]?key|auth(?:orization)?|credentials?"""
    r"""|bearer|login)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:["']?(?:bearer|basic)[\x20\t]+)?"""
    # without a key before it only what has a digit, since "bearer" and "basic" are words as well
    r"""|\b(?:bearer|basic)[\x20\t]+(?=[^\x00-\x20]*\d))(?:""" + QUOTED + r"""|["'`]?""" + BARE + ")", re.I | re.A)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(?:(?!-----BEGIN ).)*?-----END \1-----", re.S)
LETTERS = re.compile(r"[^\W\d_]+")
TRAILING = ".,;:()[]{}<>\"'`"
MIN_LENGTH = 6

# Common passwords, placeholders and words in them, most common first.
WORDS = """
password 123456 qwerty admin letmein welcome monkey dragon master login abc princess sunshine shadow football baseball
iloveyou trustno superman batman michael jordan hunter ranger buster soccer hockey george charlie andrew michelle
love jessica pepper daniel access joshua maggie starwars silver william dallas yankees ashley thunder freedom whatever
ginger summer winter spring autumn orange purple yellow green black white secret test testing guest root user default
changeme change example sample demo dummy placeholder your here enter insert none null empty hidden private public key
token value string pass passwd api client server service account system temp temporary hello world computer internet
database oracle mysql redis google amazon azure the and for you this that with from have not are was one two three
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september
october november december apple banana cookie cheese flower angel lovely happy lucky magic ninja mustang corvette
ferrari porsche harley cowboy tigger killer
""".split()
RANK = {w: i + 2 for i, w in reversed(list(enumerate(WORDS)))}
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
# Runs that a keyboard or the alphabet gives.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
LONGEST_WALK = max(map(len, WALKS))
NEXT = {(a, b): True for w in WALKS for x in (w, w[::-1]) for a, b in zip(x, x[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])"
                  r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.A)
PIECE = log10(5)  # which of the five kinds of piece comes next


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else log10(26) if c.isalpha() and c.isascii() else log10(33) if c.isascii() else 3.0


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, length of the unit) of repeats: at least two units of three code points or more, else three; from every start
    with the shortest unit, and as often as the unit goes on."""
    n, out, covered = len(value), [], [0] * len(value)
    for p in range(1, min(LONGEST_UNIT, n // 2) + 1):
        same = 0  # how many code points from i on are equal to the ones p further on
        for i in range(n - p - 1, -1, -1):
            same = same + 1 if value[i] == value[i + p] else 0
            times = 1 + same // p
            if times >= (2 if p > 2 else 3) and i + p * times > covered[i]:
                covered[i] = i + p * times
                out.append((i, i + p * times, p))
    return out


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs; 0 for an empty value."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    leet = low.translate(LEET)
    jumps: dict[int, list[tuple[int, float]]] = {}

    def jump(i: int, j: int, cost: float) -> None:
        jumps.setdefault(i, []).append((j, cost + PIECE))

    for i in range(n):
        for j in range(i + SHORTEST_WORD, min(n, i + LONGEST_WORD) + 1):
            if (r := ranks.get(low[i:j])) or (r := ranks.get(leet[i:j])):
                jump(i, j, log10(r) + (low[i:j] != value[i:j] or low[i:j] not in ranks) * log10(4))
    for i in range(n):
        if m := DATE.match(value, i):
            jump(i, m.end(), log10(365 * 120) if m.end() - i > 4 else log10(120))
    units: dict[str, float] = {}
    for i, j, p in repeats(low):
        if (unit := low[i:i + p]) not in units:
            units[unit] = guess_cost(unit, ranks)
        jump(i, j, units[unit] + log10((j - i) // p))
    for i in range(n):
        j = i + 1
        while j < n and j - i < LONGEST_WALK and (low[j - 1], low[j]) in NEXT:
            j += 1
            if j - i >= 3:
                jump(i, j, log10(2 * 47) + log10(j - i))
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        best[j] = float("inf")
    for i in range(n):
        here = best[i]
        if here + (b := _brute(value[i])) < best[i + 1]:
            best[i + 1] = here + b
        for j, cost in jumps.get(i, ()):
            if here + cost < best[j]:
                best[j] = here + cost
    return best[n]


def context_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in a credential context: quoted ones whole, bare ones without trailing punctuation."""
    out = []
    for m in CONTEXT.finditer(text):
        lo, hi = m.span(m.lastindex)
        if m.lastindex == 4:
            hi = lo + len(text[lo:hi].rstrip(TRAILING))
        if hi - lo >= MIN_LENGTH:
            out.append((lo, hi))
    return out


def find_spans(text: str, min_log10: float = MIN_LOG10, ranks: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in ``KINDS``."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("guess", lo, hi) for lo, hi in context_values(text) if guess_cost(text[lo:hi], ranks) >= min_log10]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [("pem", m.start(), m.end()) for m in PEM.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each group of overlapping spans replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, lo, hi in spans:
        if lo >= at:
            out += [text[at:lo], "[SECRET]"]
        at = max(at, hi)
    return "".join(out) + text[at:]


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words of SHORTEST_WORD to LONGEST_WORD letters, without the values in a credential context."""
    at, parts = 0, []
    for lo, hi in context_values(text):
        if lo >= at:
            parts.append(text[at:lo])
        at = max(at, hi)
    parts.append(text[at:])
    return {w for part in parts for w in LETTERS.findall(part.lower()) if SHORTEST_WORD <= len(w) <= LONGEST_WORD}


def corpus_ranks(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_DOCS) -> dict[str, int]:
    """The dictionary: the ``most`` words in most documents, of those in ``least`` at least, by rank (ties by word), with the fixed
    ones where these rank higher. All rows are counted; at most ``most`` words come to the driver and go to the tasks."""

    def run(batches):
        for b in slices(batches):
            n: Counter[str] = Counter()
            for t in b.column("text").to_pylist():
                n.update(words_of(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counts = texts_of(docs).select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # places over a sort of the cluster: a limit would send that many rows of every task to the driver
    often = Steps(docs.sparkSession, "words")(counts.where(F.col("n") >= least).select((-F.col("n")).alias("less"), "word"))
    top = sorted_index(often, ["less", "word"], name="place").where(F.col("place") < most).select("word", "place").collect()
    ranks = {r.word: r.place + 2 for r in top}
    return ranks | {w: min(r, ranks.get(w, r)) for w, r in RANK.items()}


def scan(docs: DataFrame, min_log10: float = MIN_LOG10, ranks: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>, redacted text) for each row of docs; ``ranks`` is the dictionary, by default
    that of docs."""
    ranks = corpus_ranks(docs) if ranks is None else ranks

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            found = [find_spans(t, min_log10, ranks) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"),
                pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], kind),
                pa.array([redact_text(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()),
            ], ["doc_id", "spans", "redacted"])

    d = texts_of(docs)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, "
                             "spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string")


def digest(scanned: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scanned.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                          F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, min_log10: float = MIN_LOG10, ranks: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with their columns (doc_id, text, lang, source, n_chars), secrets replaced in the text; ``ranks`` as for ``scan``."""
    ranks = corpus_ranks(docs) if ranks is None else ranks

    def run(batches):
        for b in slices(batches):
            texts = [redact_text(t, find_spans(t, min_log10, ranks)) if t else t for t in b.column("text").to_pylist()]
            cols = {c: b.column(c) for c in b.schema.names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
