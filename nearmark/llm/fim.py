"""Operator 11: fill-in-middle transformation by displacement scatter.

A text is cut at two places into prefix, middle and suffix, and the pieces are put in another order between marks. A batch of
documents is one array of UTF-8 bytes: a scan finds the bytes at which the cuts fall, a difference array takes at the start of
each piece how much further its bytes move than the bytes before, the running sum gives every byte of the batch its shift, and
one scatter writes them. Back, the marks are found in the output bytes, and the running sum of the inverse shifts says for each
byte of the text where it is to be gathered.

The sums are taken over stretches of ``STEP`` bytes with the last shift carried on, so besides a batch's texts and outputs only
one stretch of shifts is held, also for a text of any length.

Rows are independent: one pass, no shuffle. A null text is empty; an empty text, one that holds a mark and one that the doc_id's
draw leaves out stays ``plain``, with null piece lengths. A null doc_id draws as an empty one. Repeated rows give repeated results, an empty table none;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.llm.common import slices, texts_of

MARKS = ("<P>", "<S>", "<M>")
SALT = "1:"
FIM_PERCENT, SPM_PERCENT = 90, 20
BATCH, STEP = 4 << 20, 1 << 20
P, S, M = (ord(m[1]) for m in MARKS)
#: The pieces of the text (0 prefix, 1 middle, 2 suffix) as an output has them, each after its mark.
ORDER = {"psm": ((P, 0), (S, 2), (M, 1)), "spm": ((S, 2), (P, 0), (M, 1))}
OUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws(doc_id) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document's id."""
    digest = hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts without nulls, and where each text starts and the last ends."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def to_texts(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])


def heads(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (raw & 0xC0) != 0x80


def ranks(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points begin before each of the sorted byte places ``at``."""
    out, before = np.zeros(len(at), np.int64), 0
    for lo in range(0, len(raw) + 1, STEP):
        a, b = np.searchsorted(at, [lo, lo + STEP])
        inside = np.concatenate([[0], np.cumsum(heads(raw[lo:lo + STEP]))])
        out[a:b] = before + inside[at[a:b] - lo]
        before += int(inside[-1])
    return out


def places(raw: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The byte at which the code points of the sorted numbers ``rank`` begin; the end for one past the last."""
    out, before = np.full(len(rank), len(raw), np.int64), 0
    for lo in range(0, len(raw), STEP):
        start = np.flatnonzero(heads(raw[lo:lo + STEP]))
        a, b = np.searchsorted(rank, [before, before + len(start)])
        out[a:b] = lo + start[rank[a:b] - before]
        before += len(start)
    return out


def marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, letter) of every mark in the bytes."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    mid = raw[1:-1]
    at = np.flatnonzero((raw[:-2] == ord("<")) & (raw[2:] == ord(">")) & ((mid == P) | (mid == S) | (mid == M)))
    return at, mid[at]


def moves(n: int, start: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, where the bytes lo:hi go) stretch by stretch, for pieces at sorted ``start`` that move by ``shift`` each."""
    delta, carry = np.diff(shift, prepend=0), 0
    for lo in range(0, n, STEP):
        hi = min(lo + STEP, n)
        a, b = np.searchsorted(start, [lo, hi])
        by = np.zeros(hi - lo, np.int64)
        np.add.at(by, start[a:b] - lo, delta[a:b])
        by[0] += carry
        to = np.cumsum(by)
        carry = int(to[-1])
        to += np.arange(lo, hi)
        yield lo, hi, to


def scattered(raw: np.ndarray, at: np.ndarray, cuts: np.ndarray, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Output bytes and their starts. ``cuts`` (documents, 2): the places of the two cuts; both the end of a plain text."""
    n = len(forms)
    kind = np.array([("plain", *ORDER).index(f) for f in forms], np.int64)
    bounds = np.column_stack([at[:-1], cuts, at[1:]])
    size = np.diff(bounds, axis=1)
    out_at = np.concatenate([[0], np.cumsum(np.diff(at) + np.where(kind > 0, 3 * len(MARKS), 0))])
    out = np.empty(out_at[-1], np.uint8)
    to = np.repeat(out_at[:-1, None], 3, axis=1)
    to[:, 1:] += np.cumsum(size[:, :2], axis=1)  # plain: as it stands
    for k, order in enumerate(ORDER.values(), 1):
        mine = np.flatnonzero(kind == k)
        here = out_at[mine]
        for letter, piece in order:
            for b, c in enumerate((ord("<"), letter, ord(">"))):
                out[here + b] = c
            to[mine, piece] = here + 3
            here = here + 3 + size[mine, piece]
    start = bounds[:, :3].reshape(3 * n)
    for lo, hi, where in moves(len(raw), start, to.reshape(3 * n) - start):
        out[where] = raw[lo:hi]
    return out, out_at


def gathered(raw: np.ndarray, at: np.ndarray, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs were made of, from the outputs' bytes and their forms."""
    n = len(forms)
    kind = np.array([("plain", *ORDER).index(f) for f in forms], np.int64)
    place, letter = marks(raw)
    doc = np.searchsorted(at, place, "right") - 1
    size = np.column_stack([np.diff(at), np.zeros((n, 2), np.int64)])  # plain: all of it is prefix
    source = np.column_stack([at[:-1], at[1:], at[1:]])
    for k, order in enumerate(ORDER.values(), 1):
        mine = np.flatnonzero(kind == k)
        begins = []
        for c, _ in order:
            found, first = np.unique(doc[letter == c], return_index=True)
            if not np.isin(mine, found).all():
                raise ValueError(f"an output of form {list(ORDER)[k - 1]} without its marks")
            begins.append(place[letter == c][first][np.searchsorted(found, mine)])
        for (_, piece), lo, hi in zip(order, begins, [*begins[1:], at[mine + 1]], strict=True):
            source[mine, piece] = lo + 3
            size[mine, piece] = hi - lo - 3
    text_at = np.concatenate([[0], np.cumsum(size.sum(axis=1))])
    start = text_at[:-1, None] + np.column_stack([np.zeros(n, np.int64), np.cumsum(size[:, :2], axis=1)])
    out = np.empty(text_at[-1], np.uint8)
    for lo, hi, where in moves(len(out), start.reshape(3 * n), (source - start).reshape(3 * n)):
        out[lo:hi] = raw[where]
    return out, text_at


def transform_batch(ids: list, texts: pa.Array, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> list[pa.Array]:
    """The columns of ``OUT`` for a batch of texts without nulls."""
    raw, at = buffers(texts)
    rank = ranks(raw, at)
    n = np.diff(rank)
    marked = np.zeros(len(n), bool)
    place, _ = marks(raw)
    doc = np.searchsorted(at, place, "right") - 1
    marked[doc[place + 3 <= at[doc + 1]]] = True  # not one that begins in a text and ends in the next
    h = np.array([draws(i) for i in ids], np.int64).reshape(-1, 4)
    plain = (n == 0) | marked | (h[:, 2] % 100 >= fim_percent)
    forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_percent, "spm", "psm")).tolist()
    cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cut[plain] = n[plain, None]
    out, out_at = scattered(raw, at, places(raw, (rank[:-1, None] + cut).reshape(-1)).reshape(-1, 2), forms)
    return [pa.array(n), pa.array(forms, pa.string()), pa.array(cut[:, 0], mask=plain), pa.array(cut[:, 1] - cut[:, 0], mask=plain), to_texts(out, out_at)]


def transform(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs."""

    def run(batches):
        for b in slices(batches, BATCH):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *transform_batch(b.column("doc_id").to_pylist(), b.column("text"), fim_percent, spm_percent)],
                                             ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    d = texts_of(docs)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {OUT}")


def restore(made: DataFrame) -> DataFrame:
    """``made`` (with form and output) and the column ``restored``: the text rebuilt from these two alone."""

    def run(batches):
        for b in slices(batches, BATCH, "output"):
            text = to_texts(*gathered(*buffers(b.column("output")), b.column("form").to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "restored"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(run, f"{kinds}, restored string")


def digest(made: DataFrame) -> DataFrame:
    """Per document the lengths and the form, and digests of the output and of the text rebuilt from it."""
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                F.sha2("restored", 256).alias("restored_sha256"))
