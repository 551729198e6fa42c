"""The queries of the text operators, over the whole tables of a folder, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearmark.llm import bytecnn, divergence, fim, katz, linededup, neardup, notices, packing, secrets, variants, vptree, warc, wordbpe
from nearmark.llm.common import load


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.parse(warc.captures(load(spark, sf_dir, "pages")))))


def op2_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(load(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.digest(load(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(load(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digest(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(load(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(load(spark, sf_dir, "documents")))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(load(spark, sf_dir, "documents")))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.digest(notices.scan(load(spark, sf_dir, "documents")))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_revisits, op2_classifier, op3_katz, op4_quality, op5_pack, op6_lines, op7_bpe, op8_neardup, op9_neighbours, op10_secrets,
                                   op11_fim, op12_licenses, op13_variants)}

ORACLE_SQL = {
    "op1_revisits": r"""
WITH a AS (
  SELECT page_id AS n, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages WHERE page_id IS NOT NULL
), b AS (
  SELECT n, html, lower(regexp_extract(u, '^([^/?]*)', 1)) AS host, u FROM a
), c AS (
  SELECT n, html, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', ''), '^www[.]', '')
    || regexp_replace(regexp_replace(regexp_replace(substr(u, length(host) + 1), '([?&])((utm_[a-z]+|ref|fbclid|gclid)=[^&]*(&|$))+', '\1', 'g'), '[?&]+$', ''), '/+$', '') AS url
  FROM b
), d AS (
  SELECT n, html, url, md5(html) AS tag, n * 60 AS ts, n * 60 + CASE WHEN n % 11 = 0 THEN -30 ELSE 86400 END AS late,
         strftime(to_timestamp(1704067200 + n * 60) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day,
         n % 5 <> 0 AND n % 13 <> 0 AS has_tag, n % 13 <> 0 AS has_day FROM c
), m AS (
  SELECT r.n, r.url, r.has_tag, r.has_day, CASE WHEN r.n % 7 = 0 THEN '"other"' ELSE 'W/"' || r.tag || '"' END AS tag, r.day, max(f.n) AS found
  FROM d r LEFT JOIN d f ON r.url = f.url AND f.ts < r.late GROUP BY ALL
), v AS (
  SELECT m.*, f.html, f.tag AS then_tag, f.day AS then_day,
         CASE WHEN found IS NULL THEN 'no_response'
              WHEN m.has_tag THEN CASE WHEN replace(m.tag, 'W/', '') = '"' || f.tag || '"' THEN 'resolved' ELSE 'validator_mismatch' END
              WHEN m.has_day THEN CASE WHEN m.day = f.day THEN 'resolved' ELSE 'validator_mismatch' END
              ELSE 'no_validator' END AS status
  FROM m LEFT JOIN d f ON f.n = m.found
)
SELECT n AS page_id, url, status, coalesce(found, -1) AS response_page,
       CASE WHEN status = 'resolved' THEN sha256('cache-control=max-age=600;content-length=' || octet_length(encode(html)) || ';content-type=text/html; charset=utf-8;etag='
         || CASE WHEN has_tag THEN tag ELSE '"' || then_tag || '"' END || ';last-modified=' || CASE WHEN has_day THEN day ELSE then_day END || ';server=cache;set-cookie=a=' || found || ';set-cookie=b=1;vary='
         || CASE WHEN n % 3 = 0 THEN 'accept-language;vary=origin' ELSE 'accept-encoding;vary=cookie' END) END AS headers_sha256,
       CASE WHEN status = 'resolved' THEN sha256(html) END AS body_sha256
FROM v
""",
    "op9_neighbours": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM v
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""",
    "op6_lines": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped FROM lines
), low AS (
  SELECT doc_id, pos, line, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM keyed
), shared AS (
  SELECT k, min(doc_id) AS owner FROM low WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT low.doc_id, low.pos, low.line, shared.k IS NOT NULL AND shared.owner <> low.doc_id AS gone FROM low LEFT JOIN shared ON low.k = shared.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_fim": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 AS plain,
         ('0x' || h[25:32])::BIGINT % 100 < 20 AS spm
  FROM d
), p AS (
  SELECT doc_id, t, n, plain, spm, least(a, b) AS x, greatest(a, b) AS y FROM r
), c AS (
  SELECT *, substr(t, 1, x) AS prefix, substr(t, x + 1, y - x) AS middle, substr(t, y + 1) AS suffix FROM p
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN x END AS prefix_chars, CASE WHEN NOT plain THEN y - x END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
""",
}
