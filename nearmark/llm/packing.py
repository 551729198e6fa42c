"""Operator 5: order-preserving packing by dynamic programming.

Documents are tokenised, each followed by id 0, and laid end to end in the
order of the input. A window cut is allowed at a document end, at a sentence
end, and, inside a stretch of more than ``stride`` ids without one, every
``stride`` ids. The programme chooses the cuts of least total cost

    padding of the window  +  penalty of the cut (none at a document end)

where a window of a power of two ids, a quarter of the size at least, needs no padding (a short one costs SHORT). With positions p and
best costs c, the padded transition is min over the last ``size`` ids of
c[i] + (size - (p[j] - p[i])), so a queue of candidates with rising c[i] +
p[i] gives it in constant time; the unpadded ones look up p[j] - 2**k.

Each task packs its own rows in their order, keeps about ``horizon`` ids in
memory and carries the last windows on, so nothing is shuffled and long
documents need no more memory than their text. ``order_by`` sorts the rows
over the cluster first. Null and empty texts are the single id 0; repeated rows
are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import json
import re
import struct
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearmark.llm.common import is_latin, slices, texts_of
from nearmark.llm.wordbpe import byte_symbols

SIZE = 1024
CACHE = 800_000
SENTENCE, INSIDE = 0.5, 6.0  # penalties, in ids of padding
SHORT = 30.0  # for each unpadded window below the full size, so that there are few of them
STRIDE = 16
HORIZON = 64 * SIZE
# How the byte-level vocabulary splits text of the first 256 code points.
LATIN = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r\x20\x85\xa0"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[{DIGIT}]+| ?[^{SPACE}{LATIN}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def ranked(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary by ranks, which is quicker for single pieces, where ids follow the order of the merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    byte = {c: b for b, c in enumerate(byte_symbols())}
    return tiktoken.Encoding("ranked", pat_str=r"[\s\S]+", mergeable_ranks={bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}, special_tokens={})


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Known(dict):
    """The ids of pieces met before; a new one is encoded when it is asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        self[piece] = raw = pack_ids(self.encode(piece))
        return raw


class Ids:
    """Token ids of texts as little-endian 32-bit bytes; pieces met before come from a bounded cache."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = ranked(path)
        self.known: dict[str, bytes] = Known(self.ranked.encode_ordinary) if self.ranked else {}
        ends = re.compile(r"[.!?]+$|Ċ")  # Ċ stands for a line end
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if ends.search(s)]] = True

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a text outside the plain alphabet goes to the tokenizer whole."""
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        plain = [is_latin(t) and not any(s in t for s in self.special) for t in texts]
        cut = [PIECE.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
        if not self.ranked:
            new = list(set().union(*filter(None, cut)).difference(known))
            for lo in range(0, len(new), 8192):
                some = new[lo:lo + 8192]
                known.update(zip(some, (pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        get = known.__getitem__
        return [b"".join(map(get, ws)) if ws is not None else
                pack_ids(self.tokenizer.encode(t, add_special_tokens=False).ids)
                for t, ws in zip(texts, cut, strict=True)]


@lru_cache(2)
def loaded(path: str) -> Ids:
    return Ids(path)


def choose_cuts(at: list[int], penalty: list[float], size: int = SIZE) -> list[int]:
    """Indices into ``at`` (rising cut positions, at[0] the start, the last one forced) of the cheapest cuts.

    Neighbouring positions must be at most ``size`` apart.
    """
    n = len(at)
    best, came = [0.0] * n, [0] * n
    powers = [p for p in (1 << k for k in range(size.bit_length())) if 4 * p >= size]
    index = {p: i for i, p in enumerate(at)}
    queue: deque[int] = deque([0])  # candidates i with rising best[i] + at[i]
    for j in range(1, n):
        p = at[j]
        while p - at[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        cost = best[i] + size - p + at[i]
        for w in powers:
            if (k := index.get(p - w)) is not None and best[k] + (w < size) * SHORT < cost:
                cost, i = best[k] + (w < size) * SHORT, k
        cost += penalty[j]
        best[j], came[j] = cost, i
        while queue and best[queue[-1]] + at[queue[-1]] > cost + p:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, stride: int) -> tuple[list[int], list[float]]:
    """Cut positions (in ids) of a stretch that ends with a document, and the penalty of each."""
    flags = ends[ids]
    cost = np.where(flags, SENTENCE, np.inf)
    cost[doc_ends - 1] = 0.0  # position p is a cut after id p - 1
    at = np.flatnonzero(cost < np.inf) + 1
    before = np.concatenate([[0], at[:-1]])
    more = (at - before - 1) // stride
    if more.any():
        start = np.repeat(before, more)
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        extra = start + nth * stride
        cost[extra - 1] = INSIDE
        at = np.sort(np.concatenate([at, extra]))
    return [0, *at.tolist()], [0.0, *cost[at - 1].tolist()]


def pack_stream(docs, ends: np.ndarray, size: int = SIZE, stride: int = STRIDE, horizon: int = HORIZON):
    """Pieces (row, start, ids bytes, doc tokens, sequence, offset) of (row, ids bytes) pairs, in order."""
    rows: list[tuple[object, int, int]] = []  # (row, ids of it placed before, all its ids) of the documents in the buffer
    buffer, sequence, held = [], 0, 0

    def flush(last: bool):
        nonlocal rows, buffer, sequence, held
        ids = np.frombuffer(b"".join(buffer), "<u4")
        left = np.array([total - done for _, done, total in rows])
        doc_ends = np.cumsum(left)
        at, penalty = candidates(ids, doc_ends, ends, stride)
        cuts = [at[c] for c in choose_cuts(at, penalty, size)]
        if not last:
            cuts = cuts[:max(1, len(cuts) - 2)]  # what follows may still change the last windows
        raw, lo, k = ids.tobytes(), 0, 0
        for hi in cuts:
            x = lo
            while x < hi:
                row, done, total = rows[k]
                begin = int(doc_ends[k] - left[k])
                y = min(hi, int(doc_ends[k]))
                yield row, done + x - begin, raw[4 * x:4 * y], total, sequence, x - lo
                if y == doc_ends[k]:
                    k += 1
                x = y
            sequence += 1
            lo = hi
        if k < len(rows) and lo > (begin := int(doc_ends[k] - left[k])):
            row, done, total = rows[k]
            rows[k] = (row, done + lo - begin, total)
        rows, buffer, held = rows[k:], [raw[4 * lo:]] if lo < len(ids) else [], len(ids) - lo

    for row, raw in docs:
        raw += b"\0\0\0\0"
        rows.append((row, 0, len(raw) // 4))
        buffer.append(raw)
        held += len(raw) // 4
        if held > horizon:
            yield from flush(False)
    if rows:
        yield from flush(True)


def pack(docs: DataFrame, path: str, order_by: list[str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (32-bit little-endian bytes), doc_tokens, sequence_id, offset."""

    def run(batches):
        ids_of = loaded(path)
        part = TaskContext.get().partitionId() << 32

        def stream():
            for b in slices(batches, 2 << 20):
                yield from zip(b.column("doc_id").to_pylist(), ids_of.of(b.column("text").to_pylist()), strict=True)

        def batch(rows):
            doc, start, raw, total, seq, offset = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array(doc, doc_type), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int64()),
                pa.array(raw, pa.binary()), pa.array(total, pa.int64()), pa.array([part + s for s in seq], pa.int64()),
                pa.array(offset, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        doc_type, held = pa.int64(), []
        if not doc_is_long:
            doc_type = pa.string()
        for piece in pack_stream(stream(), ids_of.ends):
            held.append(piece)
            if len(held) == 4096:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    d = texts_of(docs, *[c for c in order_by or [] if c not in ("doc_id", "text")])
    if order_by:
        d = d.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    d = d.select("doc_id", "text")
    doc_is_long = d.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    d = d.withColumn("doc_id", F.col("doc_id").cast("bigint" if doc_is_long else "string"))
    return d.mapInArrow(run, f"doc_id {'long' if doc_is_long else 'string'}, start long, length long, ids binary, doc_tokens long, "
                             "sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
