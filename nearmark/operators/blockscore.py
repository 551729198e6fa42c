"""Exact user x item scoring in bounded blocks (the nested loop of J11, distributed).

Users are hashed into ``UB`` blocks and items into ``IB`` blocks; each (user block, item block) pair is one cogroup key, so a
task holds at most ~user_block users x ~item_block items. Both numbers follow from how many users, items and probes there are (see
``layout``), not from a session setting. User rows travel to every item block and item rows to every user block: blocks are large, so that these
copies are few, and their vectors are met tile by tile. Nothing is a cross join and no group grows with the data. The probes of one user
(thresholds to rank against, e.g. that user's test items) travel as one row with arrays, and come back as such; a user with more than
``PROBE_PAGE`` has several, and one with more than ``probe_chunk`` has them split over sub-blocks. A user's excluded items of a block are a row with an
array as well, for the first sub-block only.

Inside a group distances come from a matrix product in single precision (double for vectors that are not finite or very large),
``row_chunk`` users by ``item_tile`` items at a time. A product distance is off by less than a known bound, so it only selects: what lies within the bound of a threshold (or of the k-th distance) is
folded again over the dimensions, bit for bit as ``functions.vectors.sqdist`` does, and decides ties exactly. Modes:

* ``topk``   each user's k nearest candidates (ties by item id); the global merge is a ``row_number() <= k`` window that Spark
             plans as a partial ``WindowGroupLimit`` before the shuffle. Candidates of u = items minus the pairs in ``excluded``;
* ``count``  per probe (u, key, thr, thr_id) how many of all items have ``d - offset <= thr`` (or, with ``strict``,
             ``(d, j) < (thr, thr_id)``). Excluded pairs count too, those of ``minus`` (u, j) don't;
* ``counts`` both numbers of ``count`` from one scan: cnt strict, loose not and without the pairs of ``minus_loose``;
* ``countmin`` as ``count``, and with key null the smallest ``d - offset`` over each user's candidates.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearmark.operators.indexing import tasks_for

# Ship this module's functions to the Python workers by value, so executors
# need NumPy and pandas but not this package on their path.
from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])

USER_BLOCK = 16384
ITEM_BLOCK = 16384
SCAN_USERS, SCAN_ITEMS = 1 << 16, 1 << 17  # of a scan's blocks
PROBE_CHUNK = 65536
PROBE_PAGE, BLOCK_PROBES = 4096, 1 << 22
SCAN_TASKS = 48  # of small scans
ITEM_TILE = 2048
TASK_PAIRS, FEW_TASKS = 1 << 20, 256

_OUT = {"topk": "u long, j long, d double"}
_COUNTED = "u long, page int, key array<long>, cnt array<long>, loose array<long>, dmin double"
MODES = ("topk", "count", "counts", "countmin")

VECTOR, EXCLUDED, PROBE, MINUS, MINUS_LOOSE = range(5)


def layout(n_users: int, n_items: int, user_block: int = USER_BLOCK, item_block: int = ITEM_BLOCK, few: int = FEW_TASKS) -> tuple[int, int]:
    """(UB, IB) with the least copying, items x UB + users x IB, for the wanted number of tasks.

    Small inputs get a task per TASK_PAIRS pairs, ``few`` at most; large ones as many as the block sizes ask for.
    """
    least_u, least_i = max(1, math.ceil(n_users / user_block)), max(1, math.ceil(n_items / item_block))
    tasks = max(least_u * least_i, min(few, math.ceil(n_users * n_items / TASK_PAIRS)), 1)
    ub = max(least_u, min(round(math.sqrt(tasks * max(n_users, 1) / max(n_items, 1))), math.ceil(tasks / least_i)), 1)
    return ub, max(least_i, math.ceil(tasks / ub))


def exact_sqdist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, folded from the first dimension to the last."""
    if not len(a):
        return np.zeros(0)
    x = a - b
    return np.add.accumulate(x * x, axis=1)[:, -1]


def product_sqdist(w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by matrix product, and per row a bound on their error and the fold's together."""
    ww, hh = (w * w).sum(axis=1), (h * h).sum(axis=1)
    d = ww[:, None] + hh[None, :] - 2 * (w @ h.T)
    return d, (ww + hh.max(initial=0.0)) * (4 * (w.shape[1] + 8) * np.finfo(float).eps)


def position(rows: np.ndarray, which: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many values of the sorted ``rows[which]`` are below x, all searches at once."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), rows.shape[1], np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        below = (lo < hi) & (rows[which, np.minimum(mid, rows.shape[1] - 1)] < x)
        lo, hi = np.where(below, mid + 1, lo), np.where(below | (lo >= hi), hi, mid)
    return lo


def sorted_rows(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The rows of d (0 where it is less) sorted, their columns, and the share of its size by which a value may now be too small.

    A value gives its lowest bits to the number of its column, so that one sort of whole numbers (which order as the values do)
    carries both along, at a fraction of the time of an ``argsort``. NaN comes last.
    """
    bits = max(1, (d.shape[1] - 1).bit_length())
    low = (1 << bits) - 1
    key = np.ascontiguousarray(np.maximum(d, 0.0)).view(np.int64)
    key &= np.int64(0x7FFFFFFFFFFFFFFF ^ low)
    key |= np.arange(d.shape[1], dtype=np.int64)
    key.sort(axis=1)
    return (key & ~np.int64(low)).view(np.float64), key & np.int64(low), 2.0 ** (bits - 52)


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range lo[k]:hi[k] its number k, and its members, one after the other."""
    n = hi - lo
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + lo[k]


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])


class Tile:
    """Some items as the right side of a product in single precision: their vectors, and their squared norms as a last dimension."""

    def __init__(self, H: np.ndarray):
        hh = (H * H).sum(axis=1)
        self.top = float(hh.max(initial=0.0))
        self.small = self.top < 1e30  # False for NaN
        self.right = np.concatenate([H, hh[:, None]], axis=1).astype(np.float32).T if self.small else None


def nearest_in_block(W, H, J, ex_r, ex_c, k):
    """(row, column, exact distance) of each row's k nearest columns that aren't excluded."""
    d, err = product_sqdist(W, H)
    d[ex_r, ex_c] = np.inf
    k = min(k, d.shape[1])
    last = np.partition(d, k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero((d <= (last + 2 * err)[:, None]) & np.isfinite(d))
    exact = exact_sqdist(W[r], H[c])
    order = np.lexsort((J[c], exact, r))
    r, c, exact = r[order], c[order], exact[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
    keep = rank < k
    return r[keep], c[keep], exact[keep]


class Nearest:
    """The k nearest items of each row of W, met tile by tile.

    A tile's distances come from a product in single precision with a known bound on its error. Of the first tile it keeps the k
    smallest and all within the bound of them, of the others what may be as near as the k-th found before; these are few, and their
    distances are folded exactly. Vectors that are not finite or very large go through ``nearest_in_block``.
    """

    def __init__(self, W: np.ndarray, k: int):
        self.W, self.k = W, k
        self.ww = (W * W).sum(axis=1)
        self.small = bool(len(W)) and bool(np.isfinite(self.ww).all()) and float(self.ww.max()) < 1e30
        self.left = np.concatenate([-2 * W, np.ones((len(W), 1))], axis=1).astype(np.float32) if self.small else None
        self.bound = np.full(len(W), np.inf)
        self.r, self.j, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def product(self, tile: Tile, pick=slice(None)) -> np.ndarray | None:
        """The squared distances without those of the rows themselves (ww), None where single precision won't do."""
        return self.left[pick] @ tile.right if self.small and tile.small else None

    def meet(self, H: np.ndarray, J: np.ndarray, ex_r: np.ndarray, ex_c: np.ndarray, rows: np.ndarray | None = None,
             tile: Tile | None = None, product: np.ndarray | None = None) -> None:
        """All rows, or those given (rising), meet the items (J, H); excluded are the pairs (row, place in the tile). ``tile`` and, for
        all rows, ``product`` can be given if they are known."""
        if rows is not None and len(rows) == len(self.W):
            rows = None
        if rows is not None:
            at = np.searchsorted(rows, ex_r)
            ok = rows[np.minimum(at, len(rows) - 1)] == ex_r
            ex_r, ex_c = at[ok], ex_c[ok]
        pick = slice(None) if rows is None else rows
        tile = tile or Tile(H)
        a = self.product(tile, pick) if product is None else product
        if a is not None:
            r, c = self._near(pick, a, H.shape[1], tile.top, ex_r, ex_c)
            if not len(r):
                return
            exact = exact_sqdist(self.W[pick][r], H[c])
        else:
            r, c, exact = nearest_in_block(self.W[pick], H, J, ex_r, ex_c, self.k)
        self._merge(r if rows is None else rows[r], J[c], exact)

    def _near(self, pick, a, dims, top, ex_r, ex_c):
        ww, bound = self.ww[pick], self.bound[pick]
        kept = a[ex_r, ex_c]
        a[ex_r, ex_c] = np.inf
        err = (ww + top) * (4 * (dims + 8) * float(np.finfo(np.float32).eps)) + dims * 1e-36
        cut = bound - ww + err
        open_ = np.flatnonzero(np.isinf(bound))
        if len(open_):
            if a.shape[1] > self.k:
                last = np.partition(a[open_] if len(open_) < len(a) else a, self.k - 1, axis=1)[:, self.k - 1]
                cut[open_] = last + 2 * err[open_]
            cut[np.isinf(cut)] = np.finfo(np.float32).max
        flat = np.flatnonzero(a <= cut.astype(np.float32)[:, None])
        a[ex_r, ex_c] = kept
        return np.divmod(flat, a.shape[1])

    def _merge(self, r, j, d):
        if len(self.r):
            r, j, d = np.concatenate([self.r, r]), np.concatenate([self.j, j]), np.concatenate([self.d, d])
        order = np.lexsort((j, d, r))
        r, j, d = r[order], j[order], d[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
        keep = rank < self.k
        self.r, self.j, self.d = r[keep], j[keep], d[keep]
        full = rank == self.k - 1
        self.bound[r[full]] = d[full]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, exact distance), by row and from the nearest."""
        return self.r, self.j, self.d


def both_counts_in_block(W, H, J, rows, thr, tid, offset):
    """For each probe (row of W, threshold, item id) the numbers of columns strictly before it, ties by id, and not above it."""
    d, err = product_sqdist(W, H)
    d, order, cut = sorted_rows(d)
    slack = err[rows] + (4 * np.finfo(float).eps + 2 * cut) * (np.abs(thr) + abs(offset))
    lo, hi = position(d, rows, thr + offset - slack), position(d, rows, thr + offset + slack)
    probe, at = spans(lo, hi)
    col = order[rows[probe], at]
    exact = exact_sqdist(W[rows[probe]], H[col])
    if offset:
        exact = exact - offset
    t = thr[probe]
    before, upto = (exact < t) | ((exact == t) & (J[col] < tid[probe])), exact <= t
    return tuple(lo + np.bincount(probe[under], minlength=len(rows)) for under in (before, upto))


def both_counts_of_product(a, W, H, J, rows, thr, tid, offset, top):
    """``both_counts_in_block`` from a product in single precision (``Nearest.product``), which is overwritten by nothing.

    The product of dims + 1 terms, its rounded factors and the rounded threshold are off by less than ``err``. Values below a threshold by more
    are counted in the sorted row; for the few probes with a value within ``err`` those are folded exactly."""
    ww = (W * W).sum(axis=1)[rows]
    c = thr + offset - ww
    err = (ww + 2 * top) * ((W.shape[1] + 16) * 2.0 ** -24) + (np.abs(c) + np.abs(thr) + abs(offset)) * 2.0 ** -22 + W.shape[1] * 1e-36
    low, high = (c - err).astype(np.float32), (c + err).astype(np.float32)
    s = np.sort(a, axis=1)
    lo = position(s, rows, low)
    before, upto = lo.copy(), lo.copy()
    near = np.flatnonzero((lo < s.shape[1]) & (s[rows, np.minimum(lo, s.shape[1] - 1)] <= high))
    for at in range(0, len(near), 256):
        some = near[at:at + 256]
        part = a[rows[some]]
        k, col = np.nonzero((part >= low[some, None]) & (part <= high[some, None]))
        probe = some[k]
        exact = exact_sqdist(W[rows[probe]], H[col])
        if offset:
            exact = exact - offset
        t = thr[probe]
        upto += np.bincount(probe[exact <= t], minlength=len(rows))
        before += np.bincount(probe[(exact < t) | ((exact == t) & (J[col] < tid[probe]))], minlength=len(rows))
    return before, upto


def own_under(own_row, val, ids, rows, thr, tid, strict):
    """Per probe (row, thr, tid) how many of the row's own values (row, val, id) are not above it, or with ``strict`` before it, ties by id."""
    flag = np.r_[np.ones(len(own_row), np.int64), np.zeros(len(rows), np.int64)]
    row, v = np.r_[own_row, rows], np.r_[val, thr]
    order = np.lexsort((flag, np.r_[ids, tid], v, row) if strict else (1 - flag, v, row))
    before = np.empty(len(flag), np.int64)
    before[order] = np.cumsum(flag[order])
    return before[len(own_row):] - np.searchsorted(np.sort(own_row), rows, "left")


def folded(W, H, r, c, size: int = 1 << 16) -> np.ndarray:
    """``exact_sqdist`` of the rows r of W and c of H, some at a time."""
    return np.concatenate([exact_sqdist(W[r[x:x + size]], H[c[x:x + size]]) for x in range(0, len(r), size)] or [np.zeros(0)])


def counts_in_block(W, H, J, rows, thr, tid, offset, strict):
    """One of ``both_counts_in_block``."""
    return both_counts_in_block(W, H, J, rows, thr, tid, offset)[0 if strict else 1]


def minima_in_block(W, H, ex_r, ex_c, offset):
    """Each row's smallest exact distance minus offset over the columns that aren't excluded, inf without one."""
    d, err = product_sqdist(W, H)
    d[ex_r, ex_c] = np.inf
    r, c = np.nonzero((d <= (d.min(axis=1) + 2 * err)[:, None]) & np.isfinite(d))
    exact = exact_sqdist(W[r], H[c])
    out = np.full(len(W), np.inf)
    np.minimum.at(out, r, exact - offset if offset else exact)
    return out


def _make_block_fn(mode: str, k: int, offset: float, strict: bool, chunk: int, tile: int, minus_excluded: bool = False):

    def arrays(col: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """The values of a column of arrays, and how many each row has."""
        n = np.array([len(x) for x in col], np.int64)
        return (np.concatenate(list(col)) if n.sum() else np.zeros(0)), n

    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        vec = left[left["kind"] == VECTOR]
        empty = pd.DataFrame({c.split()[0]: [] for c in _OUT.get(mode, _COUNTED).split(", ")})
        if vec.empty or right.empty:
            return empty
        J = right["j"].to_numpy(dtype=np.int64)
        H = _stack(right["h"])
        U = vec["u"].to_numpy(dtype=np.int64)
        W = _stack(vec["w"])
        urow = pd.Series(np.arange(len(U)), index=U)

        def rows_of(kind: int) -> tuple[pd.DataFrame, np.ndarray]:
            part = left[left["kind"] == kind]
            at = urow.reindex(part["u"].to_numpy()).to_numpy()
            return part[~np.isnan(at)], at[~np.isnan(at)].astype(np.int64)

        jcol = pd.Series(np.arange(len(J)), index=J)

        def pairs_of(part: pd.DataFrame, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            js, n = arrays(part["keys"])
            at = jcol.reindex(js).to_numpy()
            r, c = np.repeat(row, n)[~np.isnan(at)], at[~np.isnan(at)].astype(np.int64)
            order = np.argsort(r, kind="stable")
            return r[order], c[order]

        gone, gone_row = rows_of(EXCLUDED)
        ex_r, ex_c = pairs_of(gone, gone_row)
        asked, asked_row = rows_of(PROBE)
        asked, asked_row = asked.iloc[np.argsort(asked_row, kind="stable")], np.sort(asked_row)
        thr, n_probes = arrays(asked["thr"])
        tid = arrays(asked["ids"])[0].astype(np.int64) if strict or mode == "counts" else np.zeros(len(thr), np.int64)
        pr_row = np.repeat(asked_row, n_probes)
        cnt, loose = np.zeros((2, len(thr)), np.int64)
        least = mode == "countmin" and left["tb"].iloc[0] == 0
        tiles = [(c0, H[c0:c0 + tile], J[c0:c0 + tile], Tile(H[c0:c0 + tile])) for c0 in range(0, len(J), tile)]
        near = []
        for lo in range(0, len(U), chunk):
            w = W[lo:lo + chunk]
            mine = slice(*np.searchsorted(pr_row, [lo, lo + chunk]))
            out = slice(*np.searchsorted(ex_r, [lo, lo + chunk]))
            own, row = np.unique(pr_row[mine] - lo, return_inverse=True)
            best = Nearest(w, k if mode == "topk" else 1)
            for c0, h, j, ready in tiles:
                here = (ex_c[out] >= c0) & (ex_c[out] < c0 + tile)
                hidden = ex_r[out][here] - lo, ex_c[out][here] - c0
                if mode == "topk":
                    best.meet(h, j, *hidden, tile=ready)
                    continue
                product = best.product(ready)
                if least:
                    best.meet(h, j, *hidden, tile=ready, product=product)
                if len(own):  # only the rows with a probe are sorted
                    all_own = len(own) == len(w)
                    if product is None:
                        before, upto = both_counts_in_block(w[own], h, j, row, thr[mine], tid[mine], offset)
                    else:
                        before, upto = both_counts_of_product(product if all_own else product[own], w if all_own else w[own], h, j, row, thr[mine], tid[mine], offset, ready.top)
                    cnt[mine] += before if strict or mode == "counts" else upto
                    loose[mine] += upto
            if mode == "topk" or least:
                r, j, d = best.found()
                near.append((r + lo, j, d))
        if mode == "topk":
            r, j, d = (np.concatenate(x) for x in zip(*near, strict=True))
            return pd.DataFrame({"u": U[r], "j": j, "d": d})
        for kind, counted, under in ((MINUS, cnt, strict or mode == "counts"), (MINUS_LOOSE, loose, False)):
            part, at = rows_of(kind)
            if kind == MINUS and minus_excluded:
                part, at = gone[gone["page"] == 0], gone_row[gone["page"].to_numpy() == 0]
            if len(part) and len(thr):
                r, c = pairs_of(part, at)
                d = folded(W, H, r, c)
                counted -= own_under(r, d - offset if offset else d, J[c], pr_row, thr, tid, under)
        cuts = np.cumsum(n_probes)[:-1]
        none = [None] * len(asked)
        found = [pd.DataFrame({"u": asked["u"].to_numpy(np.int64), "page": asked["tb"].to_numpy(), "key": asked["keys"].to_list(),
                               "cnt": np.split(cnt, cuts) if len(asked) else [], "loose": np.split(loose, cuts) if mode == "counts" and len(asked) else none,
                               "dmin": none})]
        found[0]["page"] = asked["page"].to_numpy()
        if least:
            r, _, d = (np.concatenate(x) for x in zip(*near, strict=True))
            none = [None] * len(r)
            found.append(pd.DataFrame({"u": U[r], "page": -1, "key": none, "cnt": none, "loose": none, "dmin": d - offset if offset else d}))
        found = [x for x in found if len(x)]
        return pd.concat([x.astype({"key": object, "cnt": object, "loose": object, "dmin": "float64", "page": "int32"}) for x in found], ignore_index=True) if found else empty

    return fn


def block_scan(users: DataFrame, items: DataFrame, mode: str, *, excluded: DataFrame | None = None,
               probes: DataFrame | None = None, minus: DataFrame | None = None, minus_loose: DataFrame | None = None, k: int = 10, offset: float = 0.0, strict: bool = False,
               user_block: int = SCAN_USERS, item_block: int = SCAN_ITEMS,
               probe_chunk: int = PROBE_CHUNK, row_chunk: int = 256, item_tile: int = ITEM_TILE) -> DataFrame:
    """Run one scan. ``users`` (u, w), ``items`` (j, h), ``excluded``, ``minus`` and ``minus_loose`` (u, j),
    ``probes`` (u, key, thr, thr_id), read several times. See the module doc for the modes.

    A user's pairs to take off are counted beside the probes, in the same task. For a user whose probes are split over sub-blocks they are
    counted by one sort over the cluster (``evaluate.own_before``) instead, so that they are copied to none."""
    if mode not in MODES:
        raise ValueError(f"unknown block_scan mode {mode!r}")
    if mode != "topk" and probes is None:
        raise ValueError("count mode needs probes")
    # Block counts come from scalar counts; the data never visits the driver.
    n_users, n_items = users.count(), items.count()
    ub_n, ib_n = layout(n_users, n_items, user_block, item_block, SCAN_TASKS)
    most, n_probes, per_user, heavy = 0, 0, None, None
    if probes is not None:
        of_user = probes.groupBy("u").agg(F.count(F.lit(1)).alias("_n"))
        most, n_probes = (int(x or 0) for x in of_user.agg(F.max("_n"), F.sum("_n")).first())
        # probes are copied to every item block, as the users are
        ib_n = max(1, math.ceil(n_items / item_block))
        ub_n = max(1, math.ceil(n_users / user_block), math.ceil(n_probes / BLOCK_PROBES), min(SCAN_TASKS, math.ceil(n_users * n_items / TASK_PAIRS)))
        if most > min(PROBE_PAGE, probe_chunk):
            subs = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(probe_chunk)).cast("int"))
            per_user = of_user.select("u", subs.alias("_tbn"), F.greatest(subs, F.ceil(F.col("_n") / F.lit(PROBE_PAGE)).cast("int")).alias("_pages")).checkpoint()
            heavy = per_user.where(F.col("_tbn") > 1).select("u").checkpoint() if most > probe_chunk else None

    ub = F.pmod(F.xxhash64("u"), F.lit(ub_n)).cast("int")
    ib_of_j = F.pmod(F.xxhash64("j"), F.lit(ib_n)).cast("int")
    all_ib = F.explode(F.sequence(F.lit(0), F.lit(ib_n - 1)))
    keys, zero = ["ub", "tb", "ib"], F.lit(0)

    def with_tbn(df: DataFrame) -> DataFrame:
        return df.join(per_user.select("u", "_tbn"), "u", "left").fillna(1, subset=["_tbn"])

    def side(df: DataFrame, kind: int, **columns) -> DataFrame:
        every = {"page": "int", "w": "array<double>", "keys": "array<long>", "thr": "array<double>", "ids": "array<long>"}
        return df.select(*keys, F.lit(kind).alias("kind"), "u", *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in every.items()])

    uvec = users.select("u", "w").withColumn("ub", ub)
    uvec = uvec.withColumn("tb", zero) if per_user is None else \
        with_tbn(uvec).withColumn("tb", F.explode(F.sequence(zero, F.col("_tbn") - 1)))
    left = side(uvec.withColumn("ib", all_ib), VECTOR, w=F.col("w"))
    shared = mode == "countmin" and minus is not None and minus is excluded  # one row with an array does for both
    for kind, pairs in ((EXCLUDED, excluded if mode in ("topk", "countmin") else None), (MINUS, minus), (MINUS_LOOSE, minus_loose)):
        if pairs is None or (kind == MINUS and shared):
            continue
        if kind != EXCLUDED and heavy is not None:
            pairs = pairs.join(F.broadcast(heavy), "u", "left_anti")
        ex = pairs.select("u", F.col("j").cast("long").alias("j")).withColumn("ub", ub).withColumn("ib", ib_of_j)
        ex = ex.groupBy("u", "ub", "ib").agg(F.collect_list("j").alias("_js")).withColumn("tb", zero)
        page = zero
        if heavy is not None and kind == EXCLUDED:
            ex, page = ex.join(F.broadcast(heavy.withColumn("_heavy", F.lit(1))), "u", "left"), F.coalesce("_heavy", zero)
        left = left.unionByName(side(ex, kind, keys=F.col("_js"), page=page))
    if probes is not None:
        pr = probes.select("u", "key", "thr", "thr_id").where(F.col("u").isNotNull())
        if per_user is None:
            pr = pr.withColumn("page", zero).withColumn("tb", zero)
        else:
            pr = pr.join(per_user, "u").withColumn("page", F.pmod(F.xxhash64("u", "key"), F.col("_pages")).cast("int"))
            pr = pr.withColumn("tb", F.pmod(F.col("page"), F.col("_tbn")))
        pr = pr.groupBy("u", "page", "tb").agg(F.collect_list(F.struct("key", "thr", "thr_id")).alias("_p")).withColumn("ub", ub).withColumn("ib", all_ib)
        ids = {"ids": F.col("_p.thr_id")} if strict or mode == "counts" else {}
        # the keys are wanted once, with the counts of the first item block
        left = left.unionByName(side(pr, PROBE, page=F.col("page"), thr=F.col("_p.thr"), keys=F.when(F.col("ib") == 0, F.col("_p.key")), **ids))

    # items go to every (user block, sub-block) that exists; ub_tb is one row per user block, and broadcast by a hint: Spark doesn't
    # count that items are repeated for each user block, and would send these rows, which grow with items x blocks, through the driver
    item_rows = items.select("j", "h").repartition(max(1, min(n_items, ub_n))).withColumn("ib", ib_of_j) \
        .withColumn("ub", F.explode(F.sequence(F.lit(0), F.lit(ub_n - 1))))
    if per_user is not None:
        ub_tb = with_tbn(users.select("u")).withColumn("ub", ub).groupBy("ub").agg(F.max("_tbn").alias("_ntb"))
        item_rows = item_rows.join(F.broadcast(ub_tb), "ub") \
            .withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("_ntb") - 1))).drop("_ntb")
    else:
        item_rows = item_rows.withColumn("tb", zero)

    fn = _make_block_fn(mode, k, float(offset), strict, row_chunk, item_tile, shared)
    n = min(4 * ub_n * ib_n, 1 << 14)  # few blocks share a task
    out = left.repartition(n, *keys).groupBy(*keys).cogroup(item_rows.select(*keys, "j", "h").repartition(n, *keys).groupBy(*keys)) \
        .applyInPandas(fn, schema=_OUT.get(mode, _COUNTED))

    if mode == "topk":
        w = Window.partitionBy("u").orderBy("d", "j")
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
            .select("u", "rank", "j", "d")
    wanted = ["cnt", *["loose"] * (mode == "counts")]
    tasks = tasks_for(users.sparkSession, n_probes + n_users)
    out = out.repartition(tasks, "u") if per_user is None else out.repartition(tasks, "u", "page")
    rows = out.groupBy("u", "page").agg(F.first("key", True).alias("key"), F.min("dmin").alias("dmin"), *[F.collect_list(c).alias(c) for c in wanted])
    total = [F.aggregate(F.col(c), F.transform("key", lambda x: F.lit(0).cast("long")), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(c) for c in wanted]
    rows = rows.select("u", "key", "dmin", *total).select("u", "dmin", F.explode_outer(F.arrays_zip("key", *wanted)).alias("_z"))
    # a probe may be there twice; key is null on the per-user minimum rows
    rows = rows.groupBy("u", F.col("_z.key").alias("key")).agg(*[F.sum(f"_z.{c}").alias(c) for c in wanted], *[F.min("dmin").alias("dmin")] * (mode == "countmin"))
    for c, pairs, under in (("cnt", minus, strict or mode == "counts"), ("loose", minus_loose, False)):
        if heavy is not None and pairs is not None:
            rows = _without_own(rows, c, users, items, pairs.join(F.broadcast(heavy), "u", "left_semi"), probes.join(F.broadcast(heavy), "u", "left_semi"), offset, under)
    return rows


def _without_own(rows: DataFrame, c: str, users: DataFrame, items: DataFrame, pairs: DataFrame, probes: DataFrame, offset: float, strict: bool) -> DataFrame:
    """``rows`` with the pairs of a few users taken off their counts ``c``, by one sort over the cluster."""
    from nearmark.operators.evaluate import _with_distance, own_before
    near = _with_distance(pairs.select("u", F.col("j").alias("i")).checkpoint(), users, items.select(F.col("j").alias("i"), "h"))
    own = own_before(near.withColumn("val", F.col("val") - F.lit(float(offset))), probes, strict).groupBy("u", "key").agg(F.sum("own").alias("_own"))
    return rows.join(own, ["u", "key"], "left").withColumn(c, F.col(c) - F.coalesce("_own", F.lit(0))).drop("_own")
