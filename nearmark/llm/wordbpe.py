"""Operator 7: BPE encoding and decoding with a word-level vocabulary file.

The file is a ``tokenizers`` JSON with a word-end suffix, read on each worker
(its path is a parameter). A word becomes a doubly linked list of symbols; a
heap holds (merge rank, position) of neighbouring pairs; popped entries whose
pair has changed since are skipped. Decoding joins the vocabulary strings.

Every worker keeps the words it has met (``CACHE`` at most, then it starts
anew), so a common word is merged once. Rows are independent: no shuffle. A
null text is empty; an empty text has no tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from nearmark.llm.common import is_latin, slices, texts_of

CACHE = 600_000
# What the vocabulary's pre-tokenizer splits on, for text of the first 256 code points.
LATIN = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD_1 = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[{DIGIT}]|[^\t-\r\x20\x85\xa0{LATIN}{DIGIT}]+")


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value, as byte-level vocabularies spell it."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def merge_word(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Apply the merges of lowest rank first (leftmost among equals) to a list of symbol ids.

    ``merges`` maps ``left << 20 | right`` to ``rank << 20 | merged``.
    """
    n, get = len(ids), merges.get
    heap = []
    for i in range(n - 1):
        if (m := get(ids[i] << 20 | ids[i + 1])) is not None:
            heap.append(m >> 20 << 32 | i)
    if not heap:
        return ids
    heapq.heapify(heap)
    after, before, pop, push = list(range(1, n + 1)), list(range(-1, n - 1)), heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if j >= n or ids[i] < 0 or (m := get(ids[i] << 20 | ids[j])) is None or m >> 20 != top >> 32:
            continue  # stale: one of the two was merged meanwhile
        new = ids[i] = m & 0xFFFFF
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (m := get(new << 20 | ids[k])) is not None:
                push(heap, m >> 20 << 32 | i)
        h = before[i]
        if h >= 0 and (m := get(ids[h] << 20 | new)) is not None:
            push(heap, m >> 20 << 32 | h)
    return [s for s in ids if s >= 0]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: i << 20 | self.vocab[a + b] for i, (a, b) in enumerate(pairs)}
        table = byte_symbols()
        self.inner, self.last = [self.vocab[c] for c in table], [self.vocab[c + self.suffix] for c in table]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        whole = Tokenizer.from_str(json.dumps(spec | {"model": {**model, "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normal = whole.normalizer
        self.cut = Split(Regex(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self.known: dict[str, tuple[int, str, str]] = {}

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return merge_word(ids, self.merges)

    def words(self, text: str) -> list[str]:
        """Pieces of a text; a special string is a piece of its own, the rest is normalised."""
        parts = self.split.split(text) if self.split and "<|" in text else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif part.isascii():
                out += WORD_1.findall(part.lower())
            elif part:
                if is_latin(part):  # composed already
                    out += WORD_1.findall(part.lower())
                else:  # the library's own Unicode tables, which differ from Python's
                    out += [w for w, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def entry(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text) of a piece, remembered."""
        ids = [self.special[word]] if word in self.special else self.word_ids(word)
        found = self.known[word] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return found

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        if len(self.known) > CACHE:
            self.known.clear()
        get, make = self.known.get, self.entry
        return [e for w in self.words(text) if (e := get(w) or make(w))[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for each row of docs."""

    def run(batches):
        bpe = loaded(path)
        for b in slices(batches, 4 << 20):
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    d = texts_of(docs)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens and the digests of its ids and of its decoded text."""

    def run(batches):
        bpe = loaded(path)
        for b in slices(batches):
            rows = []
            for t in b.column("text").to_pylist():
                es = bpe.entries(t)
                rows.append((sum(e[0] for e in es), hashlib.sha256(" ".join([e[1] for e in es]).encode()).hexdigest(),
                             hashlib.sha256(" ".join([e[2] for e in es]).encode("utf-8")).hexdigest()))
            n, ids, text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = texts_of(docs)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
