"""Operator 3: a Katz backoff bigram model, counted and evaluated in hash-partitioned tables.

Tokens are the lower-cased words of a text and one end. P(w | h) is the Good-Turing discounted share of (h, w) after h where
that pair was seen in training, else alpha(h) P(w); P(w) is the discounted share of w, and what is left belongs to all
unknown words as one. alpha(h) makes the sum over w exactly one. The first token's h is a start mark.

Nothing is held per key on the driver or in one task:

1. Blocks of documents send their distinct words to word buckets, which count them over the training documents, number them
   and answer (table ``words``, one row per block and bucket). Word counts of counts give the discounts of P(w).
2. Each block meets the answers, knows c(w) of all its words, and sends its distinct pairs with their counts, and the documents
   that hold them, to pair buckets. All pairs of h share a bucket, but a word with more than ``SPLIT`` occurrences has as many
   parts as that asks for. A bucket sums the pairs; for a seen pair it adds log10 of its share to the documents, up to
   the discount; for an unseen one it keeps with the document what alpha(h) needs: how many followers of h were seen 1 to K
   times, and the sum of their P (table ``sums``).
3. With the pairs' counts of counts known, discounts and alphas are filled in and each block's documents are summed up.

So shuffles carry distinct words and pairs per block, as compressed columns, never a row per token. Words are told apart by
64-bit hashes. Discounts outside (0, 1), as small tables give, are replaced by (r - 0.5) / r. An h whose followers were all
seen more than K times has one occurrence added to its count, so that something is left for the rest. Whether that is so of a
split word is known once its parts are summed up; its pairs, seen and unseen, travel on with the documents until then. So ``SPLIT`` says
how the work is dealt and changes no score.

The input must read the same rows in the same order when read again (files do): blocks are cut from its partitions twice, and
a block that differs raises. Null text: empty, one token (the end). Null doc_id: the text ''. Repeated rows are scored each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.llm.common import slices, texts_of
from nearmark.llm.neardup import LOWER, mix64, word_hashes
from nearmark.session import scratch_path

K = 5
BLOCK_BYTES = 8 << 20
DOCS_PER_BUCKET, PAIRS_PER_BUCKET, SPLIT = 8192, 2_000_000, 1_000_000
END, START = np.uint64(0xE5D0_0000_0000_0001), (1 << 40) - 1


def pack(*columns: np.ndarray) -> bytes:
    """Columns as compressed bytes, each in its smallest type."""
    parts = []
    for c in columns:
        if c.dtype.kind in "iu":
            c = c.astype(np.min_scalar_type(int(c.max())) if len(c) else np.uint8)
        parts += [np.array([len(c), ord(c.dtype.char)], np.int64).tobytes(), c.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, kind = np.frombuffer(raw, np.int64, 2, at)
        kind = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return [c.astype(np.int64) if c.dtype.kind == "u" else c for c in out]


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0 .. K from counts of counts n[r], r = 0 .. K + 1 (n[0] unused); d[0] is 1."""
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


class Unigrams:
    """P(w) from a word's training count."""

    def __init__(self, total: int, types: int, n: np.ndarray):
        self.total, self.types, self.d = total, types, discounts(n)
        gone = sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1))
        self.whole, self.unknown = (total, gone / total) if gone > 0 else (total + 1, 1 / (total + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, c * self.d[np.where(c <= K, c, 0)] / self.whole, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.types + 1)))


def in_training(doc_id, folds: int = 10) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds != 0


def blocks_of(batches, buckets: int):
    """(block, doc_ids, tokens per document, training flags, words by bucket, starts of the buckets, places of the tokens)."""
    part, seq = TaskContext.get().partitionId(), 0
    for b in slices(batches, BLOCK_BYTES):
        ids, hashed = b.column("doc_id").to_pylist(), []
        for t in b.column("text").to_pylist():
            hashed += [word_hashes(t.encode("utf-8").translate(LOWER)), np.array([END])]
        lens = np.array([len(h) + 1 for h in hashed[::2]])
        words, place = np.unique(np.concatenate(hashed), return_inverse=True)
        bucket = (words >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        yield (part << 24) + seq, ids, lens, np.array([in_training(i) for i in ids]), words[order], starts, at[place]
        seq += 1


def ask_words(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for block, _, lens, train, words, starts, place in blocks_of(batches, buckets):
            count = np.bincount(place[np.repeat(train, lens)], minlength=len(words))
            blobs = [pack(words[a:b], count[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * buckets, pa.int64()), pa.array(range(buckets), pa.int32()), pa.array(blobs, pa.binary())],
                                             ["block", "bucket", "data"])

    return docs.mapInArrow(run, "block bigint, bucket int, data binary")


def count_words(asks: DataFrame) -> DataFrame:
    """Answers (block, bucket, number and count of each word asked), and with block null the bucket's statistics."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(x) for x in group["data"]]
        words, place = np.unique(np.concatenate([w for w, _ in asked]), return_inverse=True)
        count = np.bincount(place, np.concatenate([c for _, c in asked]), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(words))  # common words get small numbers
        out, lo = [], 0
        for w, _ in asked:
            mine = place[lo:lo + len(w)]
            out.append(pack(rank[mine], count[mine]))
            lo += len(w)
        stats = pack(np.array([count.sum(), (count > 0).sum()]), np.bincount(np.minimum(count, K + 2), minlength=K + 3)[:K + 2])
        return pd.DataFrame({"block": pd.array([*group["block"], None], "Int64"), "bucket": int(group["bucket"].iloc[0]), "data": [*out, stats]})

    return asks.groupBy("bucket").applyInPandas(run, "block bigint, bucket int, data binary")


def token_rows(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for block, ids, lens, train, words, starts, place in blocks_of(batches, buckets):
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([[None if i is None else str(i) for i in ids]], pa.list_(pa.string())),
                pa.array([pack(lens, train.astype(np.uint8), np.diff(starts), place)], pa.binary())], ["home", "ids", "tokens"])

    return docs.mapInArrow(run, "home bigint, ids array<string>, tokens binary")


def ask_pairs(tokens: DataFrame, answers: DataFrame, uni: Unigrams, word_buckets: int, buckets: int, starts_seen: int, split: int) -> DataFrame:
    """(bucket, block, data): pairs for each pair bucket, and with bucket -1 - (a small number) each block's documents."""

    def run(home: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        lens, train, sizes, place = unpack(home["tokens"].iloc[0])
        block, ids = int(home["home"].iloc[0]), home["ids"].iloc[0]
        said = said.sort_values("bucket")
        got = [unpack(x) for x in said["data"]]
        if [len(r) for r, _ in got] != sizes.tolist():
            raise ValueError(f"block {block} was read with other rows than before; give the operator tables that read the same each time")
        number = np.concatenate([r * word_buckets + b for b, (r, _) in enumerate(got)])
        count = np.concatenate([c for _, c in got])
        doc = np.repeat(np.arange(len(lens)), lens)
        first = np.cumsum(lens) - lens
        c = count[place]
        base = np.bincount(doc, uni.base(c), len(lens)).astype(float)
        known = np.bincount(doc, c > 0, len(lens)).astype(np.int64)
        before = np.concatenate([[0], place[:-1]]) + 1
        before[first] = 0  # the start mark
        hist_count, hist_number = np.concatenate([[starts_seen], count]), np.concatenate([[START], number])
        alone = hist_count[before] == 0  # h unknown: P(w) at once
        fixed = np.bincount(doc[alone], np.log10(uni.p(c[alone])), len(lens)).astype(float)  # integers if there are none
        rest = ~alone
        pair, inverse = np.unique(before[rest] * len(number) + place[rest], return_inverse=True)
        h, w = pair // len(number), pair % len(number)
        seen = np.bincount(inverse, np.repeat(train, lens)[rest], len(pair)).astype(np.int64)
        holds, times = np.unique(inverse * len(lens) + doc[rest], return_counts=True)
        owner, holder = holds // len(lens), holds % len(lens)
        ch, hn, wn = hist_count[h], hist_number[h], number[w]
        parts = -(-ch // split)
        sub = np.where(parts > 1, (mix64(wn.astype(np.uint64)) >> np.uint64(8)).astype(np.int64) % np.maximum(parts, 1), 0)
        to = (mix64((hn * 0x10001 + sub).astype(np.uint64)) >> np.uint64(8)).astype(np.int64) % buckets
        order = np.lexsort((wn, hn, to))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        ref = np.argsort(back[owner], kind="stable")
        refs = np.bincount(back[owner], minlength=len(order))
        ends = np.searchsorted(to[order], np.arange(buckets + 1))
        ref_ends = np.concatenate([[0], np.cumsum(refs)])[ends]
        blobs = []
        for a, b, x, y in zip(ends, ends[1:], ref_ends, ref_ends[1:], strict=False):
            mine = order[a:b]
            blobs.append(pack(np.array([len(lens)]), np.diff(hn[mine], prepend=0), wn[mine], count[w[mine]], ch[mine], seen[mine], refs[a:b],
                              holder[ref[x:y]], times[ref[x:y]]))
        info = pack(lens, train, known, base, fixed)
        return pd.DataFrame({"bucket": [*range(buckets), -1 - block % buckets], "block": block, "ids": [None] * buckets + [ids], "data": [*blobs, info]})

    return tokens.groupBy("home").cogroup(answers.groupBy("block")).applyInPandas(run, "bucket int, block bigint, ids array<string>, data binary")


def sum_pairs(asks: DataFrame, uni: Unigrams, split: int) -> DataFrame:
    """Rows of kinds: docs (as they came), stats (counts of counts), part (sums per document), tail and share (split words)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = ["kind", "word", "block", "ids", "data"]
        if group["bucket"].iloc[0] < 0:
            return pd.DataFrame({"kind": "docs", "word": -1, "block": group["block"], "ids": group["ids"], "data": group["data"]})[names]
        got = [unpack(x) for x in group["data"]]
        sizes = [len(g[1]) for g in got]
        h, w, cw, ch, seen = (np.concatenate([np.cumsum(g[1]) if k == 1 else g[k] for g in got]) for k in (1, 2, 3, 4, 5))
        words, hl = np.unique(h, return_inverse=True)
        key, place = np.unique(hl << 40 | w, return_inverse=True)
        total = np.bincount(place, seen, len(key)).astype(np.int64)
        some = np.zeros(len(key), np.int64)
        some[place] = cw
        of = key >> 40
        count = np.zeros(len(words), np.int64)
        count[hl] = ch
        low = (total > 0) & (total <= K)
        n = np.bincount(of[low] * (K + 1) + total[low], minlength=len(words) * (K + 1)).reshape(-1, K + 1)
        share = np.bincount(of, np.where(total > 0, uni.p(some), 0), len(words))
        is_split = count > split
        extra = (~is_split & (n.sum(axis=1) == 0)).astype(np.int64)  # of split words: not known yet
        r = total[place]
        worth = np.where(r > 0, np.log10(np.maximum(r, 1) / (count + extra)[hl]), np.log10(uni.p(cw)))
        rows = [("stats", -1, None, None, pack(np.bincount(np.minimum(total, K + 2), minlength=K + 3)[:K + 2]))]
        rows += [("tail", int(words[i]), None, None, pack(n[i], count[i:i + 1], share[i:i + 1])) for i in np.flatnonzero(is_split)]
        lo = 0
        for g, size, block in zip(got, sizes, group["block"], strict=True):
            mine = slice(lo, lo + size)
            lo += size
            if not size:
                continue
            docs, refs, holder, times = int(g[0][0]), g[6], g[7], g[8]
            entry = np.repeat(np.arange(size), refs)
            score = np.bincount(holder, worth[mine][entry] * times, docs).astype(float)
            rr = r[mine][entry]
            few = (rr > 0) & (rr <= K)
            by = np.bincount(holder[few] * (K + 1) + rr[few], times[few], docs * (K + 1)).astype(np.int64)
            un = rr == 0
            whose = hl[mine][entry][un]
            plain = ~is_split[whose]
            table, local = np.unique(whose[plain], return_inverse=True)
            rows.append(("part", -1, block, None, pack(score, by, holder[un][plain], times[un][plain], local, n[table].ravel(), count[table], extra[table], share[table])))
            late = np.flatnonzero(is_split[hl[mine][entry]])  # what waits for the split words' sums: unseen pairs, then seen ones
            for i in np.unique(hl[mine][entry][late]):
                at = late[hl[mine][entry][late] == i]
                no, yes = at[un[at]], at[~un[at]]
                rows.append(("share", int(words[i]), block, None, pack(holder[no], times[no], holder[yes], times[yes])))
        return pd.DataFrame(rows, columns=names).astype({"block": "Int64"})

    return asks.groupBy("bucket").applyInPandas(run, "kind string, word bigint, block bigint, ids array<string>, data binary")


def log_alpha(n: np.ndarray, count: np.ndarray, extra: np.ndarray, share: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 alpha(h) from the numbers of followers seen r = 0 .. K times, h's count, and the sum of the followers' P."""
    left = (((1 - d) * np.arange(K + 1) * n).sum(axis=1) + extra) / (count + extra)
    return np.log10(left / np.maximum(1 - share, 1e-300))


def finish(sums: DataFrame, d: np.ndarray) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score)"""

    def alphas(group: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(x) for x in group["data"]]
        n, count = sum(g[0] for g in got), got[0][1]
        extra = np.array([n.sum() == 0], np.int64)
        a = log_alpha(n[None], count, extra, sum(g[2] for g in got), d)
        return pd.DataFrame({"word": [group["word"].iloc[0]], "log_alpha": a, "log_size": np.log10(count / (count + extra))})

    tails = sums.where("kind = 'tail'").select("word", "data").groupBy("word").applyInPandas(alphas, "word bigint, log_alpha double, log_size double")
    shares = sums.where("kind = 'share'").select("kind", "word", "block", "ids", "data").join(tails, "word")
    rows = sums.where("kind in ('docs', 'part')").withColumn("log_alpha", F.lit(0.0)).withColumn("log_size", F.lit(0.0)).unionByName(shares)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["kind"] == "docs"].iloc[0]
        lens, train, known, base, score = unpack(own["data"])
        score = score.copy()
        logs = np.concatenate([[0], np.log10(d[1:])])
        for kind, data, a, size in zip(group["kind"], group["data"], group["log_alpha"], group["log_size"], strict=True):
            if kind == "part":
                part, by, holder, times, local, n, count, extra, share = unpack(data)
                score += part + by.reshape(-1, K + 1) @ logs
                if len(holder):
                    score += np.bincount(holder, log_alpha(n.reshape(-1, K + 1), count, extra, share, d)[local] * times, len(score))
            elif kind == "share":
                unseen, times, seen, often = unpack(data)
                score += np.bincount(unseen, times * a, len(score)) + np.bincount(seen, often * size, len(score))
        return pd.DataFrame({"doc_id": own["ids"], "held_out": train == 0, "n_tokens": lens, "n_known": known, "base_score": base, "score": score})

    return rows.select("kind", "block", "ids", "data", "log_alpha", "log_size").groupBy("block").applyInPandas(
        run, "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def score(docs: DataFrame, docs_per_bucket: int = DOCS_PER_BUCKET, pairs_per_bucket: int = PAIRS_PER_BUCKET, split: int = SPLIT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs."""
    spark = docs.sparkSession
    path = scratch_path(spark, "katz")
    d = texts_of(docs)
    kind = d.schema["doc_id"].dataType.simpleString()
    train_docs = docs.select(F.sum((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0).cast("long")),
                             F.count(F.lit(1))).first()
    word_buckets = max(4, train_docs[1] // docs_per_bucket)
    count_words(ask_words(d, word_buckets)).write.parquet(f"{path}-words")
    answers = spark.read.parquet(f"{path}-words")
    stats = [unpack(r["data"]) for r in answers.where("block is null").select("data").collect()]  # a row per bucket
    total, types = (int(x) for x in sum(s[0] for s in stats)) if stats else (0, 0)
    uni = Unigrams(max(total, 1), types, sum(s[1] for s in stats) if stats else np.zeros(K + 2))
    buckets = max(4, -(-total // pairs_per_bucket))
    asks = ask_pairs(token_rows(d, word_buckets), answers.where("block is not null"), uni, word_buckets, buckets, int(train_docs[0] or 0), split)
    sum_pairs(asks, uni, split).write.parquet(f"{path}-sums")
    sums = spark.read.parquet(f"{path}-sums")
    n = [unpack(r["data"])[0] for r in sums.where("kind = 'stats'").select("data").collect()]  # a row per bucket
    out = finish(sums, discounts(sum(n) if n else np.zeros(K + 2)))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
