"""DuckDB oracle SQL for the registered queries (tables are pre-registered views).

Written from the definitions, not from our Spark plans: metrics are computed
on explicit ranked lists with windows, candidates by a cross join (fine for
an oracle on small data, never used by the library itself).
"""

from __future__ import annotations

from nearmark.plans import queries as Q


def sqd(a: str, b: str) -> str:
    """Squared distance as a left fold in index order (same order as Spark's)."""
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), lambda q_: ({a}[q_] - {b}[q_]) * ({a}[q_] - {b}[q_])),"
            f" lambda acc_, v_: acc_ + v_)")


def unif(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496e0)"


def key(*parts: str) -> str:
    return " || '|' || ".join(f"CAST({p} AS VARCHAR)" if not p.startswith("'") else p for p in parts)


def _pairs(x: str) -> str:
    col = {"part": "l_partkey", "supp": "l_suppkey"}[x]
    return f"pairs_{x} AS (SELECT DISTINCT o_custkey AS u, {col} AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _prep(x: str) -> list[str]:
    return [
        _pairs(x),
        f"uf_{x} AS (SELECT u, i FROM pairs_{x} WHERE u IN (SELECT u FROM pairs_{x} GROUP BY u HAVING count(*) >= 10))",
        f"kc_{x} AS (SELECT u, i FROM uf_{x} WHERE i IN (SELECT i FROM uf_{x} GROUP BY i HAVING count(*) >= 10))",
        f"sp_{x} AS (SELECT u, i, CASE WHEN rn <= floor(n * 0.8e0) THEN 'train' ELSE 'valid' END AS part FROM ("
        f"SELECT u, i, count(*) OVER (PARTITION BY u) AS n, row_number() OVER (PARTITION BY u ORDER BY "
        f"md5(CAST(u AS VARCHAR) || '|' || CAST(i AS VARCHAR) || '|{Q.SEED}'), i) AS rn FROM kc_{x}) WHERE n >= 10)",
        f"tr_{x} AS (SELECT u, i FROM sp_{x} WHERE part = 'train')",
        f"va_{x} AS (SELECT u, i FROM sp_{x} WHERE part = 'valid')",
        f"wt_{x} AS (SELECT u, i FROM va_{x} WHERE i IN (SELECT i FROM tr_{x}))",
        f"tu_{x} AS (SELECT DISTINCT u FROM wt_{x} WHERE u IN (SELECT u FROM tr_{x}))",
        f"tl_{x} AS (SELECT u, 'used' AS part, i FROM tr_{x} WHERE u IN (SELECT u FROM tu_{x}) "
        f"UNION ALL SELECT u, 'target' AS part, i FROM wt_{x} WHERE u IN (SELECT u FROM tu_{x}))",
    ]


VEC = [
    "nemb AS (SELECT count(*) AS n FROM embeddings)",
    "emb AS (SELECT vec_id, list_transform(embedding, lambda e_: CAST(e_ AS DOUBLE)) AS v FROM embeddings)",
]


def _upos(name: str, src: str) -> str:
    return (f"{name} AS (SELECT t.u, e.v AS w FROM (SELECT DISTINCT u FROM {src}) t "
            f"JOIN emb e ON e.vec_id = t.u % (SELECT n FROM nemb))")


def _ipos(name: str, src: str) -> str:
    return (f"{name} AS (SELECT t.i, e.v AS h FROM (SELECT DISTINCT i FROM {src}) t "
            f"JOIN emb e ON e.vec_id = t.i % (SELECT n FROM nemb))")


def _tfidf(src: str, name: str = "tf") -> list[str]:
    return [
        f"{name}_nu AS (SELECT u, count(*) AS nu FROM {src} GROUP BY u)",
        f"{name}_ni AS (SELECT i, count(*) AS ni FROM {src} GROUP BY i)",
        f"{name}_s AS (SELECT k.u, k.i, ln((SELECT count(DISTINCT i) FROM {src}) * 1e0 / a.nu) * (1e0 / b.ni) AS s "
        f"FROM {src} k JOIN {name}_nu a ON a.u = k.u JOIN {name}_ni b ON b.i = k.i)",
        f"{name} AS (SELECT u, i, CASE WHEN (SELECT max(s) FROM {name}_s) = 0 THEN 'NaN'::DOUBLE "
        f"ELSE s / (SELECT max(s) FROM {name}_s) END AS sui FROM {name}_s)",
    ]


def _dist(src_scores: str, name: str = "dd") -> list[str]:
    return [f"{name}_0 AS (SELECT u, i, 1e0 - sui AS d FROM {src_scores})",
            f"{name} AS (SELECT u, i, d - (SELECT min(d) FROM {name}_0) AS d FROM {name}_0)"]


def w(*ctes) -> str:
    flat = []
    for c in ctes:
        flat.extend(c if isinstance(c, list) else [c])
    return "WITH " + ",\n".join(flat) + "\n"


def _jaccard_sim() -> list[str]:
    return [
        "ni AS (SELECT i, count(*) AS ni FROM kc_part GROUP BY i)",
        "cn AS (SELECT x.i, y.i AS j, count(*) AS cn FROM kc_part x JOIN kc_part y ON x.u = y.u GROUP BY x.i, y.i)",
        "sim AS (SELECT cn.i, cn.j, cn.cn, CASE WHEN a.ni + b.ni = 0 THEN 0e0 ELSE cn.cn * 1e0 / (a.ni + b.ni - cn.cn) END AS sij "
        "FROM cn JOIN ni a ON a.i = cn.i JOIN ni b ON b.i = cn.j)",
    ]


def _aa_sim(alpha: float) -> list[str]:
    return [
        f"wu AS (SELECT u, 1e0 / ({alpha}e0 + ln(count(*))) AS wu FROM kc_part GROUP BY u)",
        "kw AS (SELECT k.u, k.i, wu.wu FROM kc_part k JOIN wu ON wu.u = k.u)",
        "si AS (SELECT i, sum(wu) AS si FROM kw GROUP BY i)",
        "sab AS (SELECT x.i, y.i AS j, sum(x.wu) AS sij FROM kw x JOIN kw y ON x.u = y.u GROUP BY x.i, y.i)",
        "sim AS (SELECT s.i, s.j, CASE WHEN a.si * b.si = 0 THEN 0e0 ELSE s.sij / sqrt(a.si * b.si) END AS sij "
        "FROM sab s JOIN si a ON a.i = s.i JOIN si b ON b.i = s.j)",
    ]


def _long(src: str, ids: str, vec: str, out: str = "x") -> str:
    return (f"SELECT {ids}, CAST(k AS INTEGER) AS k, round({out}, 6) AS {out} FROM ("
            f"SELECT {ids}, unnest(range(0, len({vec}))) AS k, unnest({vec}) AS {out} FROM {src})")


EVAL = [*_prep("supp"), *VEC, _upos("up", "tr_supp"), _ipos("ip", "tr_supp"),
        "tg AS (SELECT u, i FROM tl_supp WHERE part = 'target')",
        "ev AS (SELECT u, count(*) AS m FROM tg GROUP BY u)",
        f"cand AS (SELECT p.u, it.i, {sqd('p.w', 'it.h')} AS d FROM up p CROSS JOIN ip it "
        "WHERE NOT EXISTS (SELECT 1 FROM tr_supp t WHERE t.u = p.u AND t.i = it.i))",
        "rk AS (SELECT u, i, d, row_number() OVER (PARTITION BY u ORDER BY d, i) AS rn FROM cand WHERE u IN (SELECT u FROM ev))"]

LOSS = [*_prep("supp"), *VEC, *_tfidf("tr_supp"), *_dist("tf"), _upos("up", "dd"), _ipos("ip", "dd"),
        f"pos AS (SELECT e.u, e.i, e.d, {sqd('p.w', 'it.h')} AS dd FROM dd e JOIN up p ON p.u = e.u JOIN ip it ON it.i = e.i)",
        "pull AS (SELECT u, avg((d - dd) * (d - dd)) AS pull FROM pos GROUP BY u)",
        f"lab AS (SELECT p.u, it.i, {sqd('p.w', 'it.h')} AS dd, CASE WHEN EXISTS (SELECT 1 FROM dd e WHERE e.u = p.u AND e.i = it.i) "
        "THEN 1 ELSE 0 END AS tr FROM up p CROSS JOIN ip it)",
        f"kk AS (SELECT u, i, CASE WHEN tr = 1 THEN dd ELSE dd - {Q.MARGIN}e0 END AS kk, 1 - tr AS neg FROM lab)",
        "z AS (SELECT *, sum(neg) OVER (PARTITION BY u ORDER BY kk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk, "
        "min(CASE WHEN neg = 1 THEN kk END) OVER (PARTITION BY u) AS mn FROM kk)",
        "push AS (SELECT u, avg(CASE WHEN rk = 0 THEN 0e0 ELSE log2(rk + 2e0) * (kk - mn) END) AS push FROM z WHERE neg = 0 GROUP BY u)"]


def _sampling() -> list[str]:
    r = Q.ROUND
    bs, nb, nn, seed, rnd = r["batch_size"], r["block_num"], r["neg_num"], r["seed"], r["rnd"]
    n_items = "(SELECT count(*) FROM io)"
    return [*_prep("supp"), *VEC, *_tfidf("tr_supp"), *_dist("tf"), _upos("up", "dd"), _ipos("ip", "dd"),
            f"blk AS (SELECT u, u % {nb} AS b, row_number() OVER (PARTITION BY u % {nb} ORDER BY u) - 1 AS bord, "
            f"count(*) OVER (PARTITION BY u % {nb}) AS bsize FROM (SELECT DISTINCT u FROM dd))",
            "eo AS (SELECT u, i, d, row_number() OVER (PARTITION BY u ORDER BY i) - 1 AS ord, "
            "count(*) OVER (PARTITION BY u) AS du FROM dd)",
            "io AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS iord FROM (SELECT DISTINCT i FROM dd))",
            "gaps AS (SELECT eo.u, io.iord - eo.ord AS t FROM eo JOIN io ON io.i = eo.i)",
            f"dr AS (SELECT CAST(id // {bs} AS INTEGER) AS b, CAST(id % {bs} AS INTEGER) AS n FROM range(0, {nb * bs}) r(id))",
            f"d1 AS (SELECT dr.b, dr.n, floor({unif(key(str(seed), str(rnd), 'dr.b', 'dr.n', chr(39) + 'u' + chr(39)))} * bs.bsize) AS bord "
            "FROM dr JOIN (SELECT DISTINCT b, bsize FROM blk) bs ON bs.b = dr.b)",
            "d2 AS (SELECT d1.b, d1.n, blk.u FROM d1 JOIN blk ON blk.b = d1.b AND blk.bord = d1.bord)",
            f"d3 AS (SELECT d2.b, d2.n, d2.u, x.du, floor({unif(key(str(seed), str(rnd), 'd2.b', 'd2.n', chr(39) + 'i' + chr(39)))} * x.du) AS ord "
            "FROM d2 JOIN (SELECT DISTINCT u, du FROM eo) x ON x.u = d2.u)",
            "draws AS (SELECT d3.b, d3.n, d3.u, eo.i, eo.d, d3.du FROM d3 JOIN eo ON eo.u = d3.u AND eo.ord = d3.ord)",
            f"n0 AS (SELECT d.b, d.n, d.u, CAST(c.c AS INTEGER) AS c, floor({unif(key(str(seed), str(rnd), 'd.b', 'd.n', chr(39) + 'j' + chr(39), 'c.c'))} "
            f"* ({n_items} - d.du)) AS r FROM draws d CROSS JOIN range(0, {nn}) c(c) WHERE {n_items} - d.du > 0)",
            "n1 AS (SELECT n0.b, n0.n, n0.c, n0.r + (SELECT count(*) FROM gaps g WHERE g.u = n0.u AND g.t <= n0.r) AS iord FROM n0)",
            "negs AS (SELECT n1.b, n1.n, n1.c, io.i AS j FROM n1 JOIN io ON io.iord = n1.iord)",
            f"base AS (SELECT d.*, p.w, it.h, {sqd('p.w', 'it.h')} AS dui FROM draws d JOIN up p ON p.u = d.u JOIN ip it ON it.i = d.i)",
            f"nj AS (SELECT g.b, g.n, g.c, g.j, {Q.MARGIN}e0 + b.dui - {sqd('b.w', 'hj.h')} AS v FROM negs g "
            "JOIN base b ON b.b = g.b AND b.n = g.n JOIN ip hj ON hj.i = g.j)",
            "per AS (SELECT b, n, count(CASE WHEN v >= 0 THEN 1 END) AS nk FROM nj GROUP BY b, n)",
            "near AS (SELECT b, n, j AS j_near FROM (SELECT b, n, j, row_number() OVER (PARTITION BY b, n ORDER BY v DESC, c) AS q FROM nj) WHERE q = 1)",
            f"ranked AS (SELECT b.b, b.n, b.u, b.i, b.d, b.du, b.w, b.h, coalesce(p.nk, 0) AS nk, nr.j_near, "
            f"CAST(floor(({n_items} - b.du) * coalesce(p.nk, 0) / {float(nn)}) AS BIGINT) AS rank FROM base b "
            "LEFT JOIN per p ON p.b = b.b AND p.n = b.n LEFT JOIN near nr ON nr.b = b.b AND nr.n = b.n)",
            ]


def _dropped(vec: str, rate: float, part: str) -> str:
    """The vector with the components dropped whose uniform, keyed by the round, the draw and the part, is under the rate."""
    if rate <= 0:
        return vec
    r = Q.ROUND
    u = unif(key(str(r["seed"]), str(r["rnd"]), "b", "n", f"'{part}'", "q_ - 1"))
    return f"list_transform({vec}, lambda x_, q_: CASE WHEN {u} < {rate}e0 THEN 0e0 ELSE x_ END)"


def _gradients(s=Q.ROUND_SETTINGS) -> list[str]:
    alpha, bsz = s.loss_weight, float(s.batch_size)
    t = "list_transform(range(1, len(r.w) + 1), lambda p_: r.w[p_] * 1e0 + r.h[p_] * -1e0)"
    tj = "list_transform(range(1, len(w) + 1), lambda p_: w[p_] * 1e0 + hj[p_] * -1e0)"
    return [
        *_sampling(),
        "g0 AS (SELECT r.*, log2(r.rank + 2e0) AS rank_weight, hj.h AS hj, "
        f"{t} AS t0 FROM ranked r LEFT JOIN ip hj ON hj.i = r.j_near)",
        f"gt AS (SELECT *, {_dropped('t0', s.drop_rate, 'pull')} AS t, CASE WHEN nk > 0 THEN {tj} END AS tj0 FROM g0)",
        f"g1 AS (SELECT *, -4e0 * {alpha} * (d - list_reduce(list_transform(t, lambda z_: (z_ - 0e0) * (z_ - 0e0)), lambda acc_, v_: acc_ + v_)) / {bsz} AS pc, "
        f"CASE WHEN nk > 0 THEN {_dropped('tj0', s.drop_rate, 'push')} END AS tj, "
        f"CASE WHEN nk > 0 THEN -2e0 * (1e0 - {alpha}) * rank_weight / {bsz} END AS q FROM gt)",
        "gl AS ("
        "SELECT 'u' AS side, u AS id, k, t[k + 1] * pc AS g FROM g1, range(0, len(t)) r(k) "
        "UNION ALL SELECT 'u', u, k, (tj[k + 1] * 1e0 + t[k + 1] * -1e0) * q FROM g1, range(0, len(t)) r(k) WHERE nk > 0 "
        "UNION ALL SELECT 'i', i, k, t[k + 1] * -pc FROM g1, range(0, len(t)) r(k) "
        "UNION ALL SELECT 'i', i, k, t[k + 1] * q FROM g1, range(0, len(t)) r(k) WHERE nk > 0 "
        "UNION ALL SELECT 'i', j_near, k, tj[k + 1] * -q FROM g1, range(0, len(t)) r(k) WHERE nk > 0)",
        "gs AS (SELECT side, id, k, sum(g) AS g FROM gl GROUP BY side, id, k)",
    ]


SQL: dict[str, str] = {
    "scan_log": "SELECT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "scan_pairs": w(_pairs("part")) + "SELECT u, i FROM pairs_part",
    "scan_scores": "SELECT o_custkey AS u, l_partkey AS i, round(1e0 - l_discount, 6) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "pairs_roundtrip": w(_prep("part")) + "SELECT u, i FROM kc_part",
    "scores_roundtrip": w(_prep("part"), _tfidf("kc_part")) + "SELECT u, i, round(sui, 6) AS sui FROM tf",
    "positions_roundtrip": w(_pairs("supp"), VEC, _ipos("ip", "pairs_supp")) + _long("ip", "i", "h"),
    "test_set_roundtrip": w(_prep("supp")) + "SELECT u, part, i FROM tl_supp",
    "user_degree_filter": w(_prep("part")) + "SELECT u, i FROM uf_part",
    "interaction_filter": w(_prep("part")) + "SELECT u, i FROM kc_part",
    "interaction_stats": "SELECT count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items, count(*) AS n_rows FROM "
                         "(SELECT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "renumber_ids": w(_prep("part")) + (
        "SELECT k.u AS u_key, k.i AS i_key, ux.idx AS u, ix.idx AS i FROM kc_part k "
        "JOIN (SELECT u, row_number() OVER (ORDER BY u) - 1 AS idx FROM (SELECT DISTINCT u FROM kc_part)) ux ON ux.u = k.u "
        "JOIN (SELECT i, row_number() OVER (ORDER BY i) - 1 AS idx FROM (SELECT DISTINCT i FROM kc_part)) ix ON ix.i = k.i"),
    "split_train_valid": w(_prep("part")) + "SELECT u, i, part FROM sp_part",
    "warm_test_items": w(_prep("part")) + "SELECT u, i FROM va_part WHERE i IN (SELECT i FROM tr_part)",
    "score_to_distance": w(_prep("part"), _tfidf("kc_part"), _dist("tf")) + "SELECT u, i, round(d, 6) AS d FROM dd",
    "distance_stats": w(_prep("part"), _tfidf("kc_part"), _dist("tf")) + (
        "SELECT count(*) AS count, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS stdev, "
        "round(max(d), 6) AS max, round(min(d), 6) AS min FROM dd"),
    "user_degree": w(_prep("part")) + "SELECT u, count(*) AS nu FROM kc_part GROUP BY u",
    "item_degree": w(_prep("part")) + "SELECT i, count(*) AS ni FROM kc_part GROUP BY i",
    "user_aa_weight": w(_prep("part")) + f"SELECT u, round(1e0 / ({Q.ALPHA_AA}e0 + ln(count(*))), 6) AS wu FROM kc_part GROUP BY u",
    "tfidf_scores": w(_prep("part"), _tfidf("kc_part")) + "SELECT u, i, round(sui, 6) AS sui FROM tf",
    "item_cooccurrence": w(_prep("part")) + "SELECT x.i, y.i AS j, count(*) AS cn FROM kc_part x JOIN kc_part y ON x.u = y.u AND x.i <= y.i GROUP BY x.i, y.i",
    "item_jaccard": w(_prep("part"), _jaccard_sim()) + "SELECT i, j, round(sij, 6) AS sij FROM sim WHERE i <= j",
    "item_aa": w(_prep("part"), _aa_sim(Q.ALPHA_AA)) + "SELECT i, j, round(sij, 6) AS sij FROM sim WHERE i <= j",
    "jaccard_scores": w(_prep("part"), _jaccard_sim()) + (
        "SELECT x.u, x.i, round(avg(s.sij), 6) AS sui FROM kc_part x JOIN kc_part y ON x.u = y.u "
        "JOIN sim s ON s.i = x.i AND s.j = y.i GROUP BY x.u, x.i"),
    "aa_scores": w(_prep("part"), _aa_sim(Q.ALPHA_AA)) + (
        "SELECT x.u, x.i, round(avg(s.sij), 6) AS sui FROM kc_part x JOIN kc_part y ON x.u = y.u "
        "JOIN sim s ON s.i = x.i AND s.j = y.i GROUP BY x.u, x.i"),
    "score_methods": w(_prep("part"), _tfidf("kc_part"), [c.replace("sim AS (", "jsim AS (", 1) if c.startswith("sim AS") else c for c in _jaccard_sim()],
                       _aa_sim(Q.ALPHA_AA)) + "".join(
        f"SELECT '{name}' AS method, x.u, x.i, round(avg(s.sij), 6) AS sui FROM kc_part x JOIN kc_part y ON x.u = y.u "
        f"JOIN {sim} s ON s.i = x.i AND s.j = y.i GROUP BY x.u, x.i UNION ALL " for name, sim in (("jaccard", "jsim"), ("aa", "sim"))) + (
        "SELECT 'tfidf', u, i, round(sui, 6) FROM tf"),
    "used_items_union": w(_prep("part")) + "SELECT DISTINCT u, i FROM (SELECT u, i FROM tr_part UNION ALL SELECT u, i FROM va_part)",
    "test_with_used_items": w(_prep("supp")) + "SELECT u, part, i FROM tl_supp",
    "vector_arithmetic": w(_prep("supp"), VEC, _upos("up", "kc_supp"), _ipos("ip", "kc_supp"),
                           "vp AS (SELECT v.u, v.i, p.w, it.h FROM kc_supp v JOIN up p ON p.u = v.u JOIN ip it ON it.i = v.i)") + (
        "SELECT u, i, CAST(k AS INTEGER) AS k, round(w[k + 1] * 1e0 + h[k + 1] * -1e0, 6) AS diff, "
        "round(w[k + 1] * 0.5e0 + h[k + 1] * 2e0, 6) AS comb FROM vp, range(0, len(w)) r(k)"),
    "pairwise_distance": w(_prep("supp"), VEC, _upos("up", "kc_supp"), _ipos("ip", "kc_supp")) + (
        f"SELECT v.u, v.i, round({sqd('p.w', 'it.h')}, 6) AS d2, round(sqrt({sqd('p.w', 'it.h')}), 6) AS dist, "
        "round(list_reduce(list_transform(p.w, lambda z_: (z_ - 0e0) * (z_ - 0e0)), lambda acc_, v_: acc_ + v_), 6) AS w_norm2 "
        "FROM kc_supp v JOIN up p ON p.u = v.u JOIN ip it ON it.i = v.i"),
    "clip_vectors": w(_prep("supp"), VEC, _upos("up", "kc_supp"),
                      "nr AS (SELECT u, w, sqrt(list_reduce(list_transform(w, lambda z_: (z_ - 0e0) * (z_ - 0e0)), lambda acc_, v_: acc_ + v_)) AS nrm FROM up)",
                      f"cl AS (SELECT u, CASE WHEN nrm <= {Q.CLIP_RADIUS}e0 THEN w ELSE list_transform(w, lambda z_: z_ * ({Q.CLIP_RADIUS}e0 / nrm)) END AS w FROM nr)") + _long("cl", "u", "w"),
    "dropout_vectors": w(_prep("supp"), VEC, _upos("up", "kc_supp")) + (
        f"SELECT u, CAST(k AS INTEGER) AS k, round(CASE WHEN {unif(key(str(Q.DROP_SEED), 'u', 'k'))} < {Q.DROP_RATIO}e0 "
        "THEN 0e0 ELSE w[k + 1] END, 6) AS x FROM up, range(0, len(w)) r(k)"),
    "init_positions": w(_prep("supp"), "ids AS (SELECT DISTINCT 'u' AS side, u AS id FROM tr_supp UNION ALL SELECT DISTINCT 'i', i FROM tr_supp)") + (
        f"SELECT side, id, CAST(k AS INTEGER) AS k, round(sqrt(-2e0 * ln(1e0 - {unif(key(str(Q.INIT_SEED), 'side', 'id', 'k', chr(39) + 'a' + chr(39)))})) "
        f"* cos(6.283185307179586e0 * {unif(key(str(Q.INIT_SEED), 'side', 'id', 'k', chr(39) + 'b' + chr(39)))}) * 0.1e0 + 0e0, 6) AS x "
        f"FROM ids, range(0, {Q.INIT_DIM}) r(k)"),
    "vector_sum": w(_prep("supp"), VEC, _upos("up", "tr_supp")) + (
        "SELECT t.i, CAST(r.k AS INTEGER) AS k, round(sum(p.w[r.k + 1]), 6) AS x FROM tr_supp t JOIN up p ON p.u = t.u, "
        "range(0, 64) r(k) GROUP BY t.i, r.k"),
    "topk_unseen": w(EVAL) + f"SELECT u, CAST(rn AS INTEGER) AS rank, i, round(d, 6) AS d FROM rk WHERE rn <= {Q.TOP_K}",
    "precision_recall_at_k": w(EVAL) + (
        "SELECT k, round(avg(hits * 1e0 / k), 6) AS precision, round(avg(hits * 1e0 / m), 6) AS recall FROM ("
        "SELECT ev.u, CAST(ks.k AS INTEGER) AS k, ev.m, count(t.i) AS hits FROM ev CROSS JOIN (VALUES (5), (10), (15), (20)) ks(k) "
        "LEFT JOIN rk ON rk.u = ev.u AND rk.rn <= ks.k LEFT JOIN tg t ON t.u = rk.u AND t.i = rk.i "
        "GROUP BY ev.u, ks.k, ev.m) GROUP BY k"),
    "ranking_metrics": w(EVAL,
                         "hit AS (SELECT r.u, r.rn, ev.m, CASE WHEN t.i IS NULL THEN 0 ELSE 1 END AS y FROM rk r JOIN ev ON ev.u = r.u "
                         "LEFT JOIN tg t ON t.u = r.u AND t.i = r.i WHERE r.rn <= ev.m)",
                         "hc AS (SELECT u, m, rn, y, sum(y) OVER (PARTITION BY u ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM hit)",
                         "pu AS (SELECT u, CASE WHEN sum(y) = 0 THEN 0e0 ELSE sum(cum * 1e0 / rn) / sum(y) END AS ap, sum(y * 1e0 / rn) / max(m) AS mrr, "
                         "sum(y * ln(2e0) / ln(rn + 1e0)) / sum(ln(2e0) / ln(rn + 1e0)) AS ndcg FROM hc GROUP BY u)") + (
        "SELECT round(avg(ap), 6) AS map, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM pu"),
    "rank_gain": w(EVAL,
                   f"tgd AS (SELECT t.u, t.i, {sqd('p.w', 'it.h')} AS dt FROM tg t JOIN up p ON p.u = t.u JOIN ip it ON it.i = t.i)",
                   f"c2 AS (SELECT p.u, it.i, {sqd('p.w', 'it.h')} AS d FROM up p CROSS JOIN ip it "
                   "WHERE NOT EXISTS (SELECT 1 FROM tl_supp t WHERE t.u = p.u AND t.i = it.i))",
                   "cnt AS (SELECT g.u, g.i, count(c.i) AS rank FROM tgd g LEFT JOIN c2 c ON c.u = g.u AND c.d - g.dt <= 0 GROUP BY g.u, g.i)") + (
        "SELECT u, round(avg(1e0 / log2(rank + 2e0)), 6) AS gain FROM cnt GROUP BY u"),
    "pull_loss": w(LOSS) + "SELECT u, round(pull, 6) AS pull FROM pull",
    "push_loss": w(LOSS) + "SELECT u, round(push, 6) AS push FROM push",
    "train_objective": w(LOSS) + (
        f"SELECT round(avg({Q.LOSS_WEIGHT}e0 * pull + (1e0 - {Q.LOSS_WEIGHT}e0) * push), 6) AS objective FROM pull JOIN push USING (u)"),
    "sample_batches": w(_sampling()) + (
        "SELECT b, n, u, i, round(d, 6) AS d, -1 AS c, CAST(NULL AS BIGINT) AS j FROM draws "
        "UNION ALL SELECT g.b, g.n, d.u, d.i, round(d.d, 6), g.c, g.j FROM negs g JOIN draws d ON d.b = g.b AND d.n = g.n"),
    "approx_rank": w(_sampling()) + (
        "SELECT b, n, u, i, nk, j_near, rank, round(log2(rank + 2e0), 6) AS rank_weight FROM ranked"),
    "gradient_round_dropout": w(_gradients(Q.DROPOUT_SETTINGS)) + "SELECT side, id, CAST(k AS INTEGER) AS k, round(g, 6) AS g FROM gs",
    "gradient_round": w(_gradients()) + "SELECT side, id, CAST(k AS INTEGER) AS k, round(g, 6) AS g FROM gs",
}


def _adagrad() -> str:
    s = Q.ROUND_SETTINGS
    eta, r = s.learning_rate, s.clip
    return w(
        _gradients(),
        "gv AS (SELECT side, id, list(g ORDER BY k) AS g FROM gs GROUP BY side, id)",
        "st AS (SELECT 'u' AS side, u AS id, w AS p FROM up UNION ALL SELECT 'i', i, h FROM ip)",
        "j0 AS (SELECT st.side, st.id, st.p, gv.g, 0e0 + coalesce(list_reduce(list_transform(gv.g, lambda z_: (z_ - 0e0) * (z_ - 0e0)), "
        "lambda acc_, v_: acc_ + v_), 0e0) AS sg FROM st LEFT JOIN gv ON gv.side = st.side AND gv.id = st.id)",
        f"j1 AS (SELECT side, id, sg, CASE WHEN g IS NULL THEN p WHEN side = 'u' THEN "
        f"list_transform(range(1, len(p) + 1), lambda q_: p[q_] * 1e0 + (g[q_] * ({eta}e0 / (1e-8 + sqrt(sg)))) * -1e0) "
        f"ELSE list_transform(range(1, len(p) + 1), lambda q_: p[q_] * 1e0 + g[q_] * -({eta}e0 / (1e-8 + sqrt(sg)))) END AS p2, "
        "g IS NULL AS nog FROM j0)",
        "j2 AS (SELECT *, sqrt(list_reduce(list_transform(p2, lambda z_: (z_ - 0e0) * (z_ - 0e0)), lambda acc_, v_: acc_ + v_)) AS nrm FROM j1)",
        f"j3 AS (SELECT side, id, sg, CASE WHEN side = 'i' AND nog THEN p2 WHEN nrm <= {r}e0 THEN p2 "
        f"ELSE list_transform(p2, lambda z_: z_ * ({r}e0 / nrm)) END AS x FROM j2)",
    ) + "SELECT side, id, round(sg, 6) AS sg, CAST(k AS INTEGER) AS k, round(x[k + 1], 6) AS x FROM j3, range(0, len(x)) r(k)"


SQL["adagrad_round"] = _adagrad()
_EXACT_GAIN = SQL["rank_gain"].replace("round(avg(1e0 / log2(rank + 2e0)), 6)", "avg(1e0 / log2(rank + 2e0))")
SQL["evaluation"] = " UNION ALL ".join([
    *(f"SELECT '{m}' AS metric, k, {m} AS value FROM ({SQL['precision_recall_at_k']})" for m in ("precision", "recall")),
    *(f"SELECT '{m}', NULL, {m} FROM ({SQL['ranking_metrics']})" for m in ("map", "mrr", "ndcg")),
    f"SELECT 'gain', NULL, round(avg(gain), 6) FROM ({_EXACT_GAIN})"])
SQL["topk_unseen_near"] = SQL["topk_unseen"]
