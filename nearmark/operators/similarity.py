"""Job 2: bipartite-graph scores for each observed (u, i).

N(u) = items of u, N(i) = users of i (distinct).

* TF-IDF   s = ln(N/|N(u)|) * 1/|N(i)|, divided by the global max.
* Jaccard  sim(i, j) = cn / (ni + nj - cn); score(u, i) = mean over j in N(u).
* Adamic-Adar  wu = 1/(alpha + ln|N(u)|); sim(i, j) = sum of wu over common
  users / sqrt(si * sj); score(u, i) = mean over j in N(u).

A pair of items belongs to its *rarer* item (fewer users, ties by id), so an
item owns at most as many rows as it has users, and hot items own little. Each
user's items are gathered once in that order (a cell), and a pair travels as one
entry of the list that its owner gets (``_fans``): a partner's id, in as many
bytes as the range of ids needs. The lists are exchanged by the owner (and by a
hash of the partner where the owner has very many users), and are expanded only
behind the exchange, in arrays. Scores and Adamic-Adar need both items' totals,
which the cells know: the owner answers with a byte for each entry, the
statistic or a mark that it follows, and the cell sums. The number of tasks
follows from the number of pairs.

Users with more than ``chunk`` items are split into hash blocks of their items
and the pairs of blocks a <= c are formed under key (u, a, c), so a user
holding a third of all rows is spread over many tasks, each with at most
~chunk^2 pairs. Pairs of two items that both have more than ``common`` users
are expanded as rows (``half_pairs``) from those items alone; there the
statistic is partially aggregated, and AQE can split the join when one pair is
very common.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmark.operators.blockscore import spans
from nearmark.operators.prepare import user_degree
from nearmark.session import written

_cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR_CHUNK = 1024
COMMON_PAIR = 1 << 18
TASK_PAIRS = 1 << 21   # expanded pairs a task gets, on average
ENTRIES = 1 << 20      # entries of lists made at a time
OWNER_USERS = 1 << 12  # an item with more users has its partners dealt into parts
METHODS = ("jaccard", "aa", "tfidf")


def _nan():
    return F.lit(float("nan"))


def _distinct(df: DataFrame) -> DataFrame:
    return df.select("u", "i").distinct()


def _door(df: DataFrame, materialize: bool, distinct: bool = False) -> DataFrame:
    """Distinct pairs, written once to the checkpoint folder. ``distinct`` says that no pair of ``df`` is repeated.

    Every score reads its input several times (degrees, both sides of the
    expansion); column pruning makes those branches differ, so Spark would
    recompute the input for each. One written table replaces that (the
    reference persists its input for the same reason).
    """
    d = df.select("u", "i") if distinct else _distinct(df)
    return written(d, "door") if materialize else d


def _counts(d: DataFrame, key: str, name: str) -> DataFrame:
    """Degree on already-distinct pairs (no second distinct)."""
    return d.groupBy(key).agg(F.count(F.lit(1)).alias(name))


# ---- weights ---------------------------------------------------------------------

def user_aa_weight(df: DataFrame, alpha: float = 1.0, distinct: bool = False) -> DataFrame:
    """wu = 1 / (alpha + ln nu); +inf when the denominator is 0 (guarded under ANSI)."""
    den = F.lit(float(alpha)) + F.log(F.col("nu").cast("double"))
    w = F.when(den == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / den)
    nu = _counts(df, "u", "nu") if distinct else user_degree(df)
    return nu.select("u", w.alias("wu"))


def tfidf_scores(df: DataFrame, materialize: bool = True, distinct: bool = False) -> DataFrame:
    """G1: one row per distinct (u, i); NaN everywhere if every score is 0 (0/0).

    ``distinct`` says that ``df`` has no repeated pairs and is written. The scores are written before their maximum is taken."""
    d = df.select("u", "i") if distinct else _door(df, materialize)
    ni = _counts(d, "i", "ni")
    n_items = ni.agg(F.count(F.lit(1))).scalar()
    wu = _counts(d, "u", "nu").select("u", F.log(n_items.cast("double") / F.col("nu")).alias("wu"))
    wi = ni.select("i", (F.lit(1.0) / F.col("ni")).alias("wi"))
    s = d.join(wu.hint("shuffle_hash"), "u").join(wi.hint("shuffle_hash"), "i").select("u", "i", (F.col("wu") * F.col("wi")).alias("s"))
    s = written(s, "scores") if materialize else s
    mx = s.agg(F.max("s")).scalar()
    sui = F.when(mx == 0, _nan()).otherwise(F.col("s") / mx)
    return s.select("u", "i", sui.alias("sui"))


# ---- the half expansion ---------------------------------------------------------------

def half_pairs(df: DataFrame, weights: DataFrame | None = None, chunk: int = PAIR_CHUNK,
               distinct: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """J3 (half): (u, a, b[, wu]) for each unordered pair a <= b of items of u.

    Each pair of distinct items appears once, each diagonal pair (i, i) once.
    Columns of items named in ``carry`` come as <name>_1 and <name>_2, in
    either order.
    """
    d = df.select("u", "i", *carry) if distinct else _distinct(df)
    deg = d.groupBy("u").agg(F.count(F.lit(1)).alias("_du"))
    base = d.join(deg, "u")
    if weights is not None:
        base = base.join(weights, "u")
    nb = F.greatest(F.lit(1), F.ceil(F.col("_du") / F.lit(chunk)).cast("int"))
    base = base.withColumn("_nb", nb).withColumn("_blk", F.pmod(F.xxhash64("i"), F.col("_nb")).cast("int"))
    extra = ["wu"] if weights is not None else []
    # left row: its own block a, repeated for every partner block c >= a
    left = base.select("u", F.col("i").alias("_li"), F.col("_blk").alias("_a"),
                       F.explode(F.sequence(F.col("_blk"), F.col("_nb") - 1)).alias("_c"), *extra,
                       *[F.col(x).alias(f"{x}_1") for x in carry])
    # right row: its own block c, repeated for every partner block a <= c
    right = base.select("u", F.col("i").alias("_rj"), F.col("_blk").alias("_c"),
                        F.explode(F.sequence(F.lit(0), F.col("_blk"))).alias("_a"),
                        *[F.col(x).alias(f"{x}_2") for x in carry])
    j = left.join(right, ["u", "_a", "_c"])
    j = j.where((F.col("_a") < F.col("_c")) | (F.col("_li") <= F.col("_rj")))
    return j.select("u", F.least("_li", "_rj").alias("a"), F.greatest("_li", "_rj").alias("b"), *extra,
                    *[f"{x}_{k}" for x in carry for k in (1, 2)])


def _cells(d: DataFrame, items: DataFrame, weights: DataFrame | None, chunk: int) -> tuple[DataFrame, int]:
    """(u, _a, _c, i, ni, blk[, t, wu]): the sorted items of each user as arrays, in blocks where there are many, and how many pairs
    all half cells hold.

    A cell (a, a) stands for all pairs inside block a, a cell (a, c) for those between the two; ``blk`` tells them apart there and is null else.
    """
    deg = _counts(d, "u", "_du")
    pairs, most = deg.agg(F.sum(F.col("_du").cast("double") * F.col("_du")), F.max("_du")).first()
    deg = deg.select("u", F.greatest(F.lit(1), F.ceil(F.col("_du") / F.lit(chunk)).cast("int")).alias("_nb"))
    base = d.join(items, "i").join(deg if weights is None else deg.join(weights, "u"), "u")
    extra, total = (["wu"], ["t"]) if weights is not None else ([], [])
    base = base.withColumn("_blk", F.pmod(F.xxhash64("i"), F.col("_nb")).cast("int")).select("u", "_nb", "_blk", "ni", "i", *total, *extra)
    if (most or 0) > chunk:  # by blocks, not by users, so that a user with very many items is spread
        base = base.repartition("u", "_blk")
    lists = base.groupBy("u", "_nb", "_blk").agg(F.sort_array(F.collect_list(F.struct("ni", "i", F.col("_blk").alias("blk"), *total))).alias("l"),
                                                 *[F.first(x).alias(x) for x in extra])
    if (most or 0) > chunk:
        left = lists.select("u", F.col("_blk").alias("_a"), F.explode(F.sequence(F.col("_blk"), F.col("_nb") - 1)).alias("_c"), F.col("l").alias("_left"), *extra)
        right = lists.select("u", F.col("_blk").alias("_c"), "l", F.explode(F.sequence(F.lit(0), F.col("_blk"))).alias("_a"))
        right = right.select("u", "_a", "_c", F.when(F.col("_a") < F.col("_c"), F.col("l")).alias("_right"))
        both = F.when(F.col("_a") == F.col("_c"), F.col("_left")).otherwise(F.sort_array(F.concat("_left", "_right")))
        cells = left.join(right, ["u", "_a", "_c"]).select("u", "_a", "_c", both.alias("l"), *extra)
    else:
        cells = lists.select("u", F.lit(0).alias("_a"), F.lit(0).alias("_c"), "l", *extra)
    ids = F.transform("l.i", lambda x: x.cast("long"))
    return cells.select(F.col("u").cast("long").alias("u"), "_a", "_c", ids.alias("i"), F.col("l.ni").alias("ni"), *[F.col(f"l.{x}").alias(x) for x in total],
                        F.when(F.col("_a") != F.col("_c"), F.col("l.blk")).alias("blk"), *extra), int(pairs or 0)


def _tasks(pairs: float) -> int:
    return int(max(1, pairs // TASK_PAIRS + 1))


# ---- the lists of an owner, in NumPy ---------------------------------------------------------

def _lengths(col) -> np.ndarray:
    return np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)


def _numbers(col, kind) -> np.ndarray:
    return np.asarray(col.flatten()).astype(kind, copy=False)


def _binary(data: np.ndarray, sizes: np.ndarray):
    """Rows of ``sizes`` bytes each of ``data``."""
    import pyarrow as pa
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def _bytes_of(col) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and how many each row has."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], np.diff(at)


def packed(x: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of each number."""
    return np.ascontiguousarray(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :width])


def unpacked(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view("<i8").ravel()


def width_of(largest: int) -> int:
    return max(1, (int(largest).bit_length() + 7) // 8) if largest < 1 << 56 else 8


def _batches(batches, entries: int = ENTRIES):
    """Arrow batches of cells, cut to about ``entries`` entries of lists."""
    for b in batches:
        n = _lengths(b.column("i"))
        size = np.cumsum(n * (n + 1) // 2)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + entries, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


class Entries:
    """The pairs of some cells in the order of their owners' lists: the places ``own`` and ``q`` of both ends in the cells' flat items,
    and the list (``fan``) of each; list k is part ``part[k]`` of the item at place ``at[k]``. A pair belongs to its rarer item (``_fans``)."""

    def __init__(self, b, common: int, owner_users: int):
        n = _lengths(b.column("i"))
        self.cell = np.repeat(np.arange(len(n)), n)
        first, self.i, self.ni = np.cumsum(n) - n, _numbers(b.column("i"), np.int64), _numbers(b.column("ni"), np.int64)
        self.place = np.arange(len(self.i)) - first[self.cell]
        owners = np.flatnonzero(self.ni <= common)
        own, q = spans(owners, (first + n)[self.cell[owners]])
        own = owners[own]
        a, c = np.asarray(b.column("_a")), np.asarray(b.column("_c"))
        if (a != c).any():  # in a cell of two blocks only the pairs between them; its two ends share a block only in their own cell
            cross, blk = (a != c)[self.cell], np.full(len(self.i), -1)
            blk[cross] = _numbers(b.column("blk"), np.int64)
            keep = ~cross[own] | (blk[own] != blk[q])
            own, q = own[keep], q[keep]
        parts = -(-self.ni // owner_users)
        part = np.zeros(len(own), np.int64)
        many = parts[own] > 1
        if many.any():  # the partners of an item of very many users are dealt by a hash
            mixed = self.i[q[many]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part[many] = ((mixed >> np.uint64(32)) % parts[own[many]].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, own))
            own, q, part = own[order], q[order], part[order]
        starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (part[1:] != part[:-1])]) if len(own) else np.zeros(0, np.int64)
        self.own, self.q, self.at, self.part, self.sizes = own, q, own[starts], part[starts], np.diff(np.r_[starts, len(own)])


def _fans(cells: DataFrame, common: int, tasks: int, low: int, width: int, totals: int, back: bool) -> DataFrame:
    """A row for each list of an owner (i, part): the ids of its partners in ``width`` bytes each above ``low`` (js), exchanged by the owner.

    Half: each pair once, under its rarer item, itself included. Pairs of two items with more than ``common`` users are left out. ``part`` is 0
    but for items of over ``OWNER_USERS`` users, whose partners are dealt by their hash. With ``totals`` the numbers of users of the
    partners come along in so many bytes each, with ``back`` where the list stands: its cell and place; and wu if the cells have it.
    """
    owner_users, weighted = OWNER_USERS, "wu" in cells.columns
    schema = "i long, part int, js binary" + (", ni long, ns binary" if totals else "") + (", u long, _a int, _c int, p int" if back else "") + (", wu double" if weighted else "")

    def lists(batches):
        import pyarrow as pa
        for b in _batches(batches):
            e = Entries(b, common, owner_users)
            cell = e.cell[e.at]
            cols = {"i": pa.array(e.i[e.at]), "part": pa.array(e.part.astype(np.int32)), "js": _binary(packed(e.i[e.q] - low, width), e.sizes * width)}
            if totals:
                cols |= {"ni": pa.array(e.ni[e.at]), "ns": _binary(packed(e.ni[e.q], totals), e.sizes * totals)}
            if back:
                cols |= {k: pa.array(np.asarray(b.column(k))[cell]) for k in ("u", "_a", "_c")} | {"p": pa.array(e.place[e.at].astype(np.int32))}
            if weighted:
                cols["wu"] = pa.array(np.asarray(b.column("wu"))[cell])
            yield pa.RecordBatch.from_pydict(cols)

    return cells.mapInArrow(lists, schema).repartition(tasks, "i", "part")


class Owned:
    """The lists of a task: row, partner (above low) and group of each entry; groups are the pairs, each with the entries of its common users."""

    def __init__(self, batches, width: int):
        import pyarrow as pa
        self.rows = pa.Table.from_batches(batches).combine_chunks()
        js = [_bytes_of(c) for c in self.rows.column("js").chunks]
        self.j = unpacked(np.concatenate([x for x, _ in js]), width)
        self.sizes = np.concatenate([n for _, n in js]) // width
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        owner = np.unique(self.numbers("i"), return_inverse=True)[1].astype(np.int64)[self.row]
        j, n = self.j, int(self.j.max(initial=0)) + 1
        if (int(owner.max(initial=0)) + 1) * n >= 1 << 62:
            j = np.unique(self.j, return_inverse=True)[1]
            n = int(j.max(initial=0)) + 1
        key = owner * n + j
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.cn = np.diff(np.r_[self.starts, len(key)])

    def numbers(self, name: str) -> np.ndarray:
        return np.asarray(self.rows.column(name))

    def sums(self) -> np.ndarray:
        """The sum of wu over each group."""
        w = self.numbers("wu")[self.row][self.order]
        return np.add.reduceat(w, self.starts) if len(w) else w


def _span(items: DataFrame) -> tuple[int, int, int]:
    """The smallest id, the bytes of the widest id above it, and those of the largest number of users."""
    low, high, ni = items.agg(F.min(F.col("i").cast("long")), F.max(F.col("i").cast("long")), F.max("ni")).first()
    return low or 0, width_of((high or 0) - (low or 0)), width_of(ni or 0)


def _returned(cells: DataFrame, fan: DataFrame, width: int, every: bool, counted: bool) -> DataFrame:
    """The cells with what the owners say of their pairs: ``codes`` has a byte for each entry of each list, in the order of ``Entries``.

    It is the number of common users, 255 at most, and 0 for a pair that another cell tells (with ``every`` none is). Numbers from 255 on stand in
    ``more`` if ``counted``. Of weights a single user's own is known to its cell; the sums of several stand in ``sums``.
    """
    weighted = "wu" in cells.columns
    kinds = ["codes", *["more"] * counted, *["sums"] * weighted]
    schema = "u long, _a int, _c int, p int, part int" + "".join(f", {k} binary" for k in kinds)

    def answers(batches):
        import pyarrow as pa
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        o = Owned(got, width)
        at, n = (o.order, o.cn) if every else (o.order[o.starts], 1)
        codes = np.zeros(len(o.j), np.uint8)
        codes[at] = np.repeat(np.minimum(o.cn, 255).astype(np.uint8), n)
        said = [_binary(codes, o.sizes)]
        for wanted, there, value in ((counted, codes == 255, lambda: o.cn.astype(np.float64)), (weighted, codes > 1, o.sums)):
            if wanted:
                x = np.zeros(len(o.j))
                x[at] = np.repeat(value(), n)
                said.append(_binary(x[there], 8 * np.bincount(o.row[there], minlength=len(o.sizes))))
        yield pa.RecordBatch.from_arrays([*[o.rows.column(c).combine_chunks() for c in ("u", "_a", "_c", "p", "part")], *said], [x.split()[0] for x in schema.split(", ")])

    said = fan.mapInArrow(answers, schema).groupBy("u", "_a", "_c").agg(F.sort_array(F.collect_list(F.struct("p", "part", *kinds))).alias("r"))
    return cells.join(said, ["u", "_a", "_c"]).select(*cells.columns, *[F.col(f"r.{k}").alias(k) for k in kinds])


def _told(b, owner_users: int, common: int) -> tuple[Entries, np.ndarray, np.ndarray | None]:
    """The entries of some cells with their numbers of common users and the sums of their weights."""
    e = Entries(b, common, owner_users)
    codes = _bytes_of(b.column("codes").flatten())[0]
    if len(codes) != len(e.own):
        raise ValueError(f"{len(codes)} answers for {len(e.own)} pairs")
    cn, sums = codes.astype(np.float64), None
    if "more" in b.schema.names:
        cn[codes == 255] = np.ascontiguousarray(_bytes_of(b.column("more").flatten())[0]).view(np.float64)
    if "sums" in b.schema.names:
        sums = np.asarray(b.column("wu"))[e.cell[e.own]]
        sums[codes > 1] = np.ascontiguousarray(_bytes_of(b.column("sums").flatten())[0]).view(np.float64)
    return e, cn, sums


def _half(df: DataFrame, items: Callable[[DataFrame], DataFrame], stat: Column, weights: Callable[[DataFrame], DataFrame] | None,
          sim: Callable, chunk: int, common: int, distinct: bool, totals: bool, name: str, kind: str) -> DataFrame:
    """(i, j, name) with i <= j: ``sim`` of the statistic and both ends' totals, for every pair of items with a common user, from one half expansion.

    Numbers of users travel with the partners, so that the owner's task tells its pairs. Totals of weights are wide: there the
    statistic goes back to the cell of one of the users instead, which knows the totals.
    """
    d = _door(df, True, distinct)
    wu = written(weights(d), "weights") if weights else None
    per_item = written(items(d, wu), "items")
    cells, pairs = _cells(d, per_item, wu, chunk)
    low, width, wide = _span(per_item)
    owner_users, tasks, schema = OWNER_USERS, _tasks(pairs / 2), f"i long, j long, {name} {kind}"

    def rows(a, b, value):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(value)], ["i", "j", name])

    def by_owner(batches):
        got = list(batches)
        if sum(b.num_rows for b in got):
            o = Owned(got, width)
            one = o.order[o.starts]
            i, j = o.numbers("i")[o.row[one]], o.j[one] + low
            ns = [_bytes_of(c)[0] for c in o.rows.column("ns").chunks] if totals else []
            value = sim(o.cn, o.numbers("ni")[o.row[one]], unpacked(np.concatenate(ns), wide)[one]) if totals else o.cn
            for lo in range(0, len(one), ENTRIES):
                yield rows(i[lo:lo + ENTRIES], j[lo:lo + ENTRIES], value[lo:lo + ENTRIES])

    def by_cell(batches):
        for b in _batches(batches):
            e, cn, s = _told(b, owner_users, common)
            mine = cn > 0
            t, own, q = _numbers(b.column("t"), np.float64), e.own[mine], e.q[mine]
            yield rows(e.i[own], e.i[q], sim(s[mine], t[own], t[q]))

    if weights:
        cells = written(cells, "cells")
        few = _returned(cells, _fans(cells, common, tasks, low, width, 0, True), width, False, False).mapInArrow(by_cell, schema)
    else:
        few = _fans(cells, common, tasks, low, width, wide if totals else 0, False).mapInArrow(by_owner, schema)
    hot = d.join(per_item.where(F.col("ni") > common), "i")
    many = half_pairs(hot, wu, chunk, distinct=True).groupBy("a", "b").agg(stat.alias("_stat"))
    ends = F.lit(None), F.lit(None)
    if totals:
        ta, tb = (per_item.select(F.col("i").alias(e), F.col("t" if weights else "ni").alias(n)) for e, n in (("a", "t_1"), ("b", "t_2")))
        many, ends = many.join(ta, "a").join(tb, "b"), (F.col("t_1"), F.col("t_2"))
    of = d.schema["i"].dataType
    few = few.select(F.col("i").cast(of).alias("i"), F.col("j").cast(of).alias("j"), name)
    return few.unionByName(many.select(F.col("a").alias("i"), F.col("b").alias("j"), sim(F.col("_stat"), *ends).alias(name)))


def _scores(df: DataFrame, names: tuple[str, ...], alpha: float, chunk: int, common: int, distinct: bool) -> DataFrame:
    """(u, i, a column for each of the names) = mean over j in N(u) of sim(i, j), j = i included.

    Each pair goes to its rarer item once, whose task tells every cell of its users the statistic in a byte or two; the cell has the
    totals and sums for both ends of its pairs.
    """
    d = _door(df, True, distinct)
    wu = written(user_aa_weight(d, alpha, distinct=True), "weights") if "aa" in names else None
    per_item = written(_aa_items(d, wu) if "aa" in names else _item_users(d), "items")
    cells, pairs = _cells(d, per_item, wu, chunk)
    cells = written(cells, "cells")
    low, width, _ = _span(per_item)
    owner_users = OWNER_USERS

    def sums(batches):
        import pyarrow as pa
        for b in _batches(batches):
            e, cn, sab = _told(b, owner_users, common)
            two = e.own != e.q

            def both(w):
                return np.bincount(e.own, w, len(e.i)) + np.bincount(e.q[two], None if w is None else w[two], len(e.i))

            n = both(None)
            some, out = n > 0, []
            for x in names:
                t, stat, sim = (_numbers(b.column("t"), np.float64), sab, _aa) if x == "aa" else (e.ni, cn, _jaccard)
                out.append(both(sim(stat, t[e.own], t[e.q])))
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.asarray(b.column("u"))[e.cell], e.i, n, *out)], ["u", "i", "n", *names])

    fan = _fans(cells, common, _tasks(pairs / 2), low, width, 0, True)
    few = _returned(cells, fan, width, True, "jaccard" in names).mapInArrow(sums, "u long, i long, n long" + "".join(f", {x} double" for x in names))
    many = half_pairs(d.join(per_item.where(F.col("ni") > common), "i"), wu, chunk, distinct=True, carry=("ni",) if wu is None else ("ni", "t"))
    stats = {"jaccard": (F.count(F.lit(1)).alias("_cn"), lambda: _jaccard(F.col("_cn"), F.col("ni_1"), F.col("ni_2"))),
             "aa": (F.sum("wu").alias("_sab"), lambda: _aa(F.col("_sab"), F.col("t_1"), F.col("t_2")))}
    many = many.join(many.groupBy("a", "b").agg(*[stats[x][0] for x in names]), ["a", "b"])
    many = _spread(many.select("u", "a", "b", *[stats[x][1]().alias(x) for x in names]), *names)
    few = few.select(*[F.col(c).cast(d.schema[c].dataType).alias(c) for c in ("u", "i")], "n", *names)
    return few.unionByName(many.withColumn("n", F.lit(1).cast("long"))).groupBy("u", "i").agg(*[(F.sum(x) / F.sum("n")).alias(x) for x in names])


def _spread(pairs_scored: DataFrame, *val: str) -> DataFrame:
    """Turn (u, a, b, val) half rows into one (u, i, val) row per j in N(u)."""
    both = F.when(F.col("a") == F.col("b"), F.array(F.col("a"))).otherwise(F.array(F.col("a"), F.col("b")))
    return pairs_scored.select("u", F.explode(both).alias("i"), *val)


# ---- Jaccard -----------------------------------------------------------------------------

def _jaccard(cn, na, nb):
    if isinstance(cn, np.ndarray):
        return np.where(na + nb == 0, 0.0, cn / np.where(na + nb == 0, 1, na + nb - cn))
    return F.when(na + nb == 0, F.lit(0.0)).otherwise(cn / (na + nb - cn))


def _item_users(d: DataFrame, wu: DataFrame | None = None) -> DataFrame:
    """(i, ni): the users of each item."""
    return _counts(d, "i", "ni")


def item_cooccurrence(df: DataFrame, chunk: int = PAIR_CHUNK, common: int = COMMON_PAIR, distinct: bool = False) -> DataFrame:
    """(i, j, cn) for every pair i <= j with a common user, i = j included. Here and below ``distinct`` says that no pair (u, i) is repeated."""
    return _half(df, _item_users, F.count(F.lit(1)), None, lambda cn, na, nb: cn, chunk, common, distinct, False, "cn", "long")


def item_jaccard(df: DataFrame, chunk: int = PAIR_CHUNK, common: int = COMMON_PAIR, distinct: bool = False) -> DataFrame:
    """(i, j, sij) for every co-occurring pair i <= j."""
    return _half(df, _item_users, F.count(F.lit(1)), None, _jaccard, chunk, common, distinct, True, "sij", "double")


def jaccard_scores(df: DataFrame, chunk: int = PAIR_CHUNK, common: int = COMMON_PAIR, distinct: bool = False) -> DataFrame:
    """(u, i, sui) = mean over j in N(u) of sim(i, j), j = i included."""
    return _scores(df, ("jaccard",), 1.0, chunk, common, distinct).withColumnRenamed("jaccard", "sui")


# ---- Adamic-Adar --------------------------------------------------------------------------

def _aa(sab, sa, sb):
    if isinstance(sab, np.ndarray):
        with np.errstate(all="ignore"):  # an infinite weight makes NaN, as it does in Spark
            return np.where(sa * sb == 0, 0.0, sab / np.sqrt(sa * sb))
    return F.when(sa * sb == 0, F.lit(0.0)).otherwise(sab / F.sqrt(sa * sb))


def _aa_items(d: DataFrame, wu: DataFrame) -> DataFrame:
    """(i, ni, t = sum of wu) of distinct pairs."""
    return d.join(wu, "u").groupBy("i").agg(F.count(F.lit(1)).alias("ni"), F.sum("wu").alias("t"))


def item_aa(df: DataFrame, alpha: float = 1.0, chunk: int = PAIR_CHUNK, common: int = COMMON_PAIR, distinct: bool = False) -> DataFrame:
    """(i, j, sij) cosine-normalised Adamic-Adar, every co-occurring pair i <= j."""
    return _half(df, _aa_items, F.sum("wu"), lambda d: user_aa_weight(d, alpha, distinct=True), _aa, chunk, common, distinct, True, "sij", "double")


def aa_scores(df: DataFrame, alpha: float = 1.0, chunk: int = PAIR_CHUNK, common: int = COMMON_PAIR, distinct: bool = False) -> DataFrame:
    """(u, i, sui) = mean over j in N(u) of the AA similarity, j = i included."""
    return _scores(df, ("aa",), alpha, chunk, common, distinct).withColumnRenamed("aa", "sui")


def both_scores(df: DataFrame, alpha: float = 1.0, chunk: int = PAIR_CHUNK, common: int = COMMON_PAIR, distinct: bool = False) -> DataFrame:
    """(u, i, jaccard, aa) from one expansion, written once. Give it to ``score`` as ``both``, and the two methods share it."""
    return written(_scores(df, ("jaccard", "aa"), alpha, chunk, common, distinct), "both")


# ---- dispatch -------------------------------------------------------------------------------

def score(df: DataFrame, method: str, alpha: float | None = None, both: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """Pick the method by name; alpha is used by 'aa' only (default 1.0). ``both`` are the ``both_scores`` of df at that alpha."""
    if both is not None and method in ("jaccard", "aa"):
        return both.select("u", "i", F.col(method).alias("sui"))
    if method == "jaccard":
        return jaccard_scores(df, distinct=distinct)
    if method == "aa":
        return aa_scores(df, 1.0 if alpha is None else alpha, distinct=distinct)
    if method == "tfidf":
        return tfidf_scores(df, distinct=distinct)
    raise ValueError(f"unknown similarity method {method!r}; expected one of {METHODS}")
