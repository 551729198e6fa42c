"""Operator 8: MinHash near-duplicates with sequential Bayesian verification.

1. Each document becomes the set of its distinct 5-word shingles (64-bit hashes) and a signature of ``HASHES`` minima.
   Documents with equal sets are one class from here on, held by the smallest id.
2. Half the signature is cut into bands; classes that agree on a band are candidates. A bucket never emits all its pairs:
   first every class is paired with the smallest of its buckets. Then, in the buckets that still hold several components, the rows
   are dealt into tiles and pairs of different components are compared, inside a task, on signatures; each component gets its one
   likeliest pair, and components that these join are one from then on. So a round verifies no more pairs than there are components.
   After ``ROUNDS`` of them, or when one joins little, what the signatures leave between components that are still apart is verified:
   such pairs never become rows, but travel as numbers with the two blocks of classes that hold them.
3. A candidate pair is compared in batches of minima. With m of n equal the similarity has a Beta(m + 1, n - m + 1)
   posterior (uniform prior); the pair is dropped once the chance that it reaches the threshold is below ``MISS``.
   The bound m(n) is a small table made once.
4. Survivors are verified exactly on whole sets, made again from the text of the classes concerned; a set travels once to each block
   of pairs. Components come from rounds of smallest-neighbour hooking; later rounds hook the components of earlier ones.

With 32 bands of 4 minima a pair at similarity 0.75 is missed with chance 5e-6, and by the pruning with at most ``MISS`` per
batch. Lower-cased are A-Z only; words are runs without ASCII white space; a text of fewer words is one shingle; one
without words has an empty set, is linked with nothing and kept. Null text: empty. Rows with the same doc_id are judged as
one document with the union of the pairs they form; each row is returned. Null doc_ids are linked with nothing and kept. Of
equally likely pairs the one of smaller classes comes first. An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.llm.common import Steps, slices
from nearmark.operators.indexing import sorted_index

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = 2 * BANDS * ROWS  # the bands take the first half, verification all
BATCH = 64
MISS = 1e-5
ROUNDS, FEW = 8, 8  # rounds of likeliest pairs at most; they end when under one in FEW of a round's pairs is a link
TILE, GROUP_ROWS, PAIRS, BLOCK = 512, 8192, 1 << 17, 256
BITS_EACH, PIECE, MOST_BITS = 16, 1 << 15, 1 << 27
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.default_rng(7).integers(0, 1 << 32, size=(2, HASHES, 1), dtype=np.uint32) | np.uint32(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased UTF-8 text.

    A word's hash sums its bytes times odd random weights by place (the weights of places past 63 differ by a factor), then
    mixes the sum with the length.
    """
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(b)]])))
    value = (b.astype(np.uint64) + np.uint64(1)) * _MIX[0][place & 63]
    if (far := place > 63).any():
        value[far] = mix64(value[far] * (place[far] >> 6).astype(np.uint64) + _MIX[1][place[far] & 63])
    value[space] = 0
    sums = np.add.reduceat(value, start)
    return mix64(sums + (end - start).astype(np.uint64) * _MIX[1][0])


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text's UTF-8 bytes."""
    w = word_hashes(raw.translate(LOWER))
    if len(w) < SHINGLE:
        w = np.concatenate([w, np.zeros(SHINGLE - len(w), np.uint64)]) if len(w) else w
    if not len(w):
        return w
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[k:k + n])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima over a set; its values are hashed bits, so multiply-add on 32-bit halves is enough."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(shingles), 2048):
        x = low[None, lo:lo + 2048] * _SEEDS[0]
        x += high[None, lo:lo + 2048] * _SEEDS[1]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(best, x.min(axis=1), out=best)
    return best


def tail(m: int, n: int, t: float) -> float:
    """P(s >= t) for s ~ Beta(m + 1, n - m + 1): the chance of at most m successes in n + 1 trials at t."""
    return min(1.0, sum(exp(lgamma(n + 2) - lgamma(k + 1) - lgamma(n + 2 - k) + k * log(t) + (n + 1 - k) * log(1 - t)) for k in range(m + 1)))


def least_equal(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch end n the least number of equal minima with which a pair goes on."""
    return [next(m for m in range(n + 1) if tail(m, n, threshold) >= miss) for n in range(BATCH, HASHES + 1, BATCH)]


def survives(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows a[x[k]], b[y[k]] of signature matrices the posterior bounds leave, batch by batch, and how many of
    their minima are equal."""
    pairs, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, m in enumerate(least):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (a[x[pairs], cols] == b[y[pairs], cols]).sum(axis=1)
        go = equal >= m
        pairs, equal = pairs[go], equal[go]
    return pairs, equal


def linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _doc_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _digest(shingles: bytes) -> bytes | None:
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, signature) of the shingle set of each row of docs; both null for an empty set.

    A signature keeps 16 bits of each minimum.
    """

    def run(batches):
        for b in slices(batches, 8 << 20):
            found = [shingle_set(t.encode("utf-8")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(s) for s in found], pa.int64()),
                pa.array([_digest(s.tobytes()) for s in found], pa.binary()),
                pa.array([signature(s).astype("<u2").tobytes() if len(s) else None for s in found], pa.binary()),
            ], ["doc_id", "n_shingles", "digest", "signature"])

    return _doc_rows(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, band, node): a row for each band of each class. A bucket is a digest of the band's number and its minima."""

    def run(batches):
        for b in batches:
            nodes = b.column("node").to_numpy()
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), "<u2").reshape(-1, HASHES)[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.zeros(sig.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), len(nodes))),
                                              pa.array(np.repeat(nodes, BANDS))], ["bucket", "band", "node"])

    return classes.select("node", "signature").mapInArrow(run, "bucket bigint, band tinyint, node bigint")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b, ...) of nodes that the posterior bounds leave."""
    least = least_equal(percent / 100)
    names = pairs.columns

    def prune(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sa", "sb"))
            go = pa.array(survives(x, np.arange(len(x)), y, np.arange(len(x)), least)[0])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names], names).take(go)

    sig = classes.select("node", "signature")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select(*names, "sa", "sb")
    return both.mapInArrow(prune, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields))


def families(best: DataFrame) -> DataFrame:
    """(node, block): classes by the one that most bands agree with, in blocks of BLOCK at most on average, so that pairs of
    near copies meet in few blocks. ``best``: (a, b), b's likeliest partner a."""
    of = best.select(F.col("b").alias("node"), F.col("a").alias("family")).unionByName(best.select(F.col("a").alias("node"), F.col("a").alias("family")))
    of = of.groupBy("node").agg(F.min("family").alias("family"))
    sizes = of.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    return of.join(sizes, "family").select("node", F.xxhash64("family", F.pmod(F.xxhash64("node"), "k")).alias("block"))


def maybe_among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among those of ``wanted``: all that are and, of the others, about one in BITS_EACH.

    The keys' hashes are bits of a map that is broadcast in pieces; it has BITS_EACH bits for each key up to MOST_BITS (16 MB), beyond
    which more rows pass.
    """
    bits = min(MOST_BITS, PIECE << max(0, -(-wanted.count() * BITS_EACH // PIECE) - 1).bit_length())

    def at(df):
        h = F.pmod(F.xxhash64(key), F.lit(bits))
        return df.withColumn("_piece", F.floor(h / PIECE)).withColumn("_bit", (h % PIECE).cast("int"))

    pieces = at(wanted.select(key)).groupBy("_piece").agg(F.bitmap_construct_agg(F.col("_bit").cast("bigint")).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    passed = at(rows).join(F.broadcast(pieces), "_piece").where(F.getbit(byte, F.col("_bit") % 8) == 1)
    return passed.select(*rows.columns)


def made_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, keep: Steps, most: int | None = None) -> DataFrame:
    """(x, y, node, shingles) for the rows (x, y, node) of ``wanted``, the sets made again from the text of the document that holds the
    class. Documents that a bitmap of the wanted ids rules out aren't shuffled."""
    wanted = keep(wanted.distinct().join(classes.select("node", "digest", F.col("first").alias("doc_id")), "node"), most)
    rows = maybe_among(_doc_rows(docs), wanted, "doc_id")

    def make(batches):
        for b in slices(batches, 8 << 20):
            raw = [shingle_set(t.encode("utf-8")).tobytes() for t in b.column("text").to_pylist()]
            same = pa.array([_digest(r) == d for r, d in zip(raw, b.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("x", "y", "node")), pa.array(raw, pa.binary())],
                                             ["x", "y", "node", "shingles"]).filter(same)

    return rows.join(wanted, "doc_id").select("x", "y", "node", "digest", "text").mapInArrow(
        make, "x bigint, y bigint, node bigint, shingles binary")


def verified(pairs: DataFrame, n: int, blocks: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, keep: Steps) -> DataFrame:
    """The pairs (a, b), of ``n``, whose whole sets reach the similarity.

    Pairs are grouped by the blocks of their two classes (a class without one is its own), and the set of a class travels once
    to each of its groups, not with each pair.
    """
    pairs = pairs.join(blocks.toDF("a", "x"), "a", "left").join(blocks.toDF("b", "y"), "b", "left")
    pairs = pairs.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    pairs = keep(pairs.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), n)
    wanted = pairs.select("x", "y", F.col("a").alias("node")).unionByName(pairs.select("x", "y", F.col("b").alias("node")))

    def check(made: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(made["node"], made["shingles"], strict=True))
        ok = [a in held and b in held and linked(held[a], held[b], percent) for a, b in zip(asked["a"], asked["b"], strict=True)]
        return asked.loc[ok, ["a", "b"]]

    made = made_sets(wanted, docs, classes, keep, 2 * n)
    return keep(made.groupBy("x", "y").cogroup(pairs.toDF("a", "b", "px", "py").groupBy("px", "py")).applyInPandas(check, "a bigint, b bigint").distinct(), n)


def joining(packed: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, keep: Steps) -> DataFrame:
    """Links (a, b) enough to join all components that the pairs of ``packed`` (see ``packed_pairs``) link.

    A group holds the sets of two blocks and their pairs as numbers; pairs of components that it has joined already are passed over, so
    it gives fewer links than it has components.
    """

    def check(made: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(made["node"], made["shingles"], strict=True))
        name: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := name.get(c, c)) != c:
                name[c] = name.get(up, up)
                c = up
            return c

        out = []
        for nodes, comps, left, right in zip(*(asked[c] for c in ("nodes", "components", "left", "right")), strict=True):
            for x, y in zip(left, right, strict=True):
                p, q = find(comps[x]), find(comps[y])
                if p != q and (a := nodes[x]) in held and (b := nodes[y]) in held and linked(held[a], held[b], percent):
                    name[max(p, q)] = min(p, q)
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    made = made_sets(packed.select("x", "y", F.explode("nodes").alias("node")), docs, classes, keep)
    right = packed.withColumnsRenamed({"x": "px", "y": "py"}).groupBy("px", "py")
    return keep(made.groupBy("x", "y").cogroup(right).applyInPandas(check, "a bigint, b bigint"))


def components(edges: DataFrame, keep: Steps, most: int | None = None) -> DataFrame:
    """(node, component) of the nodes with an edge (a, b): component is the smallest node that can be reached. ``most``: twice the
    number of edges, if known.

    Every round hooks each node to the smallest label around it and then follows labels of labels; the rows stay as many as
    the nodes, and each round is written out.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), most)
    n = both.count()
    labels = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), n)
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("new"))
        # what is known of a node holds for the node that it was hooked to, too
        pull = new.groupBy("label").agg(F.min("new").alias("pulled")).withColumnRenamed("label", "node")
        new = new.join(pull, "node", "left").select("node", "label", F.least("new", F.coalesce("pulled", "new")).alias("new"))
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("next"))
        new = keep(new.join(jump, "new", "left").select("node", "label", F.coalesce("next", "new").alias("new")), n)
        changed = new.where("label <> new").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def joined(comp: DataFrame, found: DataFrame, keep: Steps) -> DataFrame:
    """``comp`` (node, component) with the components that the new edges ``found`` (a, b) join as one. Only the edges between
    components are hooked again, not those inside."""
    of = comp.select("node", "component")
    edges = found.join(of.toDF("a", "x"), "a", "left").join(of.toDF("b", "y"), "b", "left")
    edges = edges.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct()
    n = 2 * found.count()
    names = components(edges, keep, n)
    old = of.join(names.toDF("component", "name"), "component", "left").select("node", F.coalesce("name", "component").alias("component"))
    return keep(old.unionByName(names.join(of, "node", "left_anti")), comp.count() + n)


def tiled(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, n, node, ...) with k, the number of parts of the bucket, and part, that of the node."""
    k = F.ceil(F.col("n") / TILE).cast("int")
    return rows.withColumn("k", k).withColumn("part", F.pmod(F.xxhash64("node", "bucket"), k).cast("int"))


def compared(members: DataFrame, done: DataFrame, keep: Steps) -> DataFrame:
    """``members`` (bucket, band, n, node, component, block, signature) dealt into tiles and tasks, with the pairs of ``done``
    (bucket, n, a, b) in the tiles that would find them again, as rows of part -1.

    A bucket of n rows is dealt into k = ceil(n / TILE) parts and each pair of parts is a tile of at most about 2 * TILE rows,
    whatever the size of the bucket. A task has some GROUP_ROWS rows of tiles.
    """
    rows = tiled(members).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    rows = rows.select("bucket", "n", "i", "j", "part", F.col("band").cast("int").alias("band"), "node", "component", "block", "signature")
    at = tiled(done.select("bucket", "n", F.col("a").alias("node"), "b")).select("bucket", "n", F.col("node").alias("a"), F.col("b").alias("node"), F.col("part").alias("p"))
    at = tiled(at).select("bucket", "n", F.least("p", "part").alias("i"), F.greatest("p", "part").alias("j"), F.lit(-1).alias("part"), F.lit(-1).alias("band"),
                          F.col("a").alias("node"), F.col("node").alias("component"), F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("binary").alias("signature"))
    rows = keep(rows.unionByName(at.join(members.select("bucket").distinct(), "bucket", "left_semi")))
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    return rows.withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)))


def likely_in_tiles(group: pd.DataFrame, least: list[int], one: bool) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows of a task and (x, y, equal minima, component) for pairs of them from different components that the signatures
    leave and that weren't there before; x has the smaller node. PAIRS are compared at a time.

    A pair that meets in several buckets counts in its first band only. With ``one``, each component gets only its pair with most
    equal minima, else the component is that of x and the pairs come with most equal minima first.
    """
    pair = np.dtype([("a", np.int64), ("b", np.int64)])
    known = group[group["part"] < 0]
    known = np.array(list(zip(known["node"], known["component"], strict=True)), pair)
    group = group[group["part"] >= 0].sort_values(["bucket", "i", "j"])
    key = group[["bucket", "i", "j"]].to_numpy()
    last = np.append(np.any(key[1:] != key[:-1], axis=1), True)[:len(key)]
    tile = np.cumsum(last) - last
    end = (np.flatnonzero(last) + 1)[tile]
    node, comp, part, band = (group[c].to_numpy() for c in ("node", "component", "part", "band"))
    whole = key[:, 1] == key[:, 2]  # both parts are one: every pair of its rows, else only those across
    sig = np.frombuffer(b"".join(group["signature"]), "<u2").reshape(-1, HASHES)
    each = end - np.arange(len(end)) - 1
    chunk = (np.cumsum(each) - each) // PAIRS
    out = [np.zeros((4, 0), np.int64)]
    for c in np.unique(chunk):
        first = np.flatnonzero(chunk == c)
        x = np.repeat(first, each[first])
        y = np.arange(len(x)) - np.repeat(np.cumsum(each[first]) - each[first], each[first]) + x + 1
        go = (comp[x] != comp[y]) & (whole[x] | (part[x] != part[y]))
        x, y = x[go], y[go]
        go, equal = survives(sig, x, sig, y, least)
        x, y = x[go], y[go]
        same = (sig[x, :BANDS * ROWS] == sig[y, :BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2)
        go = same.argmax(axis=1) == band[x]
        x, y, equal = x[go], y[go], equal[go]
        flip = node[x] > node[y]
        x, y = np.where(flip, y, x), np.where(flip, x, y)
        if len(known):
            both = np.empty(len(x), pair)
            both["a"], both["b"] = node[x], node[y]
            go = ~np.isin(both, known)
            x, y, equal = x[go], y[go], equal[go]
        found = np.stack([x, y, equal, comp[x]])
        if one:  # of this chunk and those before, the likeliest of each component
            found = np.concatenate([out[0], found, np.stack([x, y, equal, comp[y]])], axis=1)
            found = found[:, np.lexsort((node[found[1]], node[found[0]], -found[2], found[3]))]
            out = [found[:, np.append(True, found[3, 1:] != found[3, :-1])[:found.shape[1]]]]
        else:
            out.append(found)
    found = np.concatenate(out, axis=1)
    return group, found if one else found[:, np.argsort(-found[2], kind="stable")]


def likeliest_pairs(members: DataFrame, done: DataFrame, percent: int, keep: Steps) -> DataFrame:
    """(bucket, n, a, b): for each component of ``members`` the pair with another that has most equal minima, none of ``done``.
    So there are no more pairs than components."""
    least = least_equal(percent / 100)

    def run(task: pd.DataFrame) -> pd.DataFrame:
        group, (x, y, equal, of) = likely_in_tiles(task, least, True)
        bucket, n, node = (group[c].to_numpy() for c in ("bucket", "n", "node"))
        return pd.DataFrame({"component": of, "equal": equal, "bucket": bucket[x], "n": n[x], "a": node[x], "b": node[y]})

    found = compared(members, done, keep).groupBy("task").applyInPandas(run, "component bigint, equal bigint, bucket bigint, n bigint, a bigint, b bigint")
    found = found.groupBy("component").agg(F.max_by(F.struct("bucket", "n", "a", "b"), F.struct("equal", -F.col("a"), -F.col("b"))).alias("p"))
    return found.select("p.*").distinct()


def packed_pairs(members: DataFrame, done: DataFrame, percent: int, keep: Steps) -> DataFrame:
    """(x, y, nodes, components, left, right): all pairs between components of ``members`` that the signatures leave, none of
    ``done``. A row has those of a task between two blocks x <= y: the nodes concerned and, likeliest first, the pairs as numbers of them."""
    least = least_equal(percent / 100)

    def run(task: pd.DataFrame) -> pd.DataFrame:
        group, (x, y, _, _) = likely_in_tiles(task, least, False)
        node, comp, block = (group[c].to_numpy() for c in ("node", "component", "block"))
        low, high = np.minimum(block[x], block[y]), np.maximum(block[x], block[y])
        order = np.lexsort((np.arange(len(x)), high, low))
        cut = np.flatnonzero(np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))[:len(x)])
        rows = []
        for mine in np.split(order, cut[1:]) if len(x) else []:
            nodes, first, at = np.unique(np.concatenate([node[x[mine]], node[y[mine]]]), return_index=True, return_inverse=True)
            comps = np.concatenate([comp[x[mine]], comp[y[mine]]])[first]
            rows.append((low[mine[0]], high[mine[0]], nodes, comps, at[:len(mine)], at[len(mine):]))
        return pd.DataFrame(rows, columns=["x", "y", "nodes", "components", "left", "right"])

    return compared(members, done, keep).groupBy("task").applyInPandas(
        run, "x bigint, y bigint, nodes array<bigint>, components array<bigint>, left array<int>, right array<int>")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    keep = Steps(docs.sparkSession, "neardup")
    all_sets = keep(sets(docs))
    # one class per set, numbered by its digest; rows of one doc_id with different sets are tied further down
    some = all_sets.where("digest is not null and doc_id is not null")
    classes = keep(some.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("signature").alias("signature")))
    classes = keep(classes.join(sorted_index(classes.select("digest"), ["digest"], name="node"), "digest"))

    # buckets with two classes or more, and the pair of each class with its bucket's smallest
    rows = bands(classes)
    sizes = keep(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1"))
    shared = keep(rows.join(sizes, "bucket"))
    star = shared.where("node <> least").groupBy(F.col("least").alias("a"), F.col("node").alias("b")).agg(
        F.count(F.lit(1)).alias("votes"), F.min(F.struct("band", "bucket", "n")).alias("at"))
    star = likely(star.select("a", "b", "votes", "at.bucket", "at.n"), classes, percent)

    # first the pair of each class on which most bands agree
    best = star.groupBy("b").agg(F.max_by(F.struct("a", "bucket", "n"), F.struct("votes", -F.col("a"))).alias("p"))
    best = keep(best.select("p.bucket", "p.n", "p.a", "b"))
    blocks = keep(families(best))
    tried = best.count()
    found = verified(best.select("a", "b"), tried, blocks, docs, classes, percent, keep)
    ids = keep(some.select("doc_id", "digest").distinct().join(classes.select("digest", "node"), "digest").select("doc_id", "node"))
    same_id = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    comp = components(found.unionByName(same_id.join(ids, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()), keep)

    # then, in the buckets that still hold several components, the likeliest pair of each, and at last all that is left
    done = best.select("bucket", "n", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = keep(shared.drop("least").join(blocks, "node", "left").withColumn("block", F.coalesce("block", "node")))
    n, turn, rest = members.count(), 0, False
    while True:
        label = members.select("bucket", "band", "n", "node", "block").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = label.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        members = keep(label.join(mixed, "bucket"), n)
        n = members.count()
        if not n:
            break
        signed = members.join(classes.select("node", "signature"), "node")
        if rest:
            comp = joined(comp, joining(keep(packed_pairs(signed, done, percent, keep)), docs, classes, percent, keep), keep)
            break
        more = keep(likeliest_pairs(signed, done, percent, keep), n)
        asked = more.count()
        if not asked:
            break
        found = verified(more.select("a", "b"), asked, blocks, docs, classes, percent, keep)
        tried += asked
        done, turn, links = keep(done.unionByName(more), tried), turn + 1, found.count()
        rest = turn == ROUNDS or links * FEW < asked
        if links:
            comp = joined(comp, found, keep)

    # a component's name is the smallest doc_id of its classes
    named = classes.select("node", "first").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = named.join(names, "component").select("node", "component_id")
    named = ids.join(by_node, "node").select("doc_id", "component_id").distinct()
    out = all_sets.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs of which no other document with a smaller id is a near-duplicate.

    Of several rows with one doc_id and one text the smallest by the other columns stays; rows with one doc_id and different texts
    all stay or all go. Rows without a doc_id stay, empty texts as well. The columns must be of kinds that can be compared.
    """
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    often = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    again = rest.join(often, "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("_text")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return rest.join(often, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select("_row.*"))
