"""Operator 1: not-modified revisits of web archives, resolved by an as-of join.

``parse`` reads raw WARC records. ``resolve`` gives every server-not-modified revisit (a stored 304) the latest full response
(status 200) that is strictly earlier at the same canonical URL, checks the validators, and, where they agree, rebuilds the
page: the response's body, and its headers updated by those of the 304 that may change. Status of a revisit:

    resolved            the ETags agree (weak comparison), or without one in the 304 the Last-Modified dates, or without
                        either the payload digests
    validator_mismatch  they differ
    no_validator        the 304 has none of them, or the response lacks the one to compare
    no_response         nothing earlier at that URL

The join sorts both kinds of record together by (URL, time) over the cluster and carries the last response on inside each
sorted part and, by one row per part, across parts. So a URL with a third of all captures is spread like any other. Bodies
travel only in the last step, from each response used to its revisits, which are salted by the number of revisits.

Headers are lists of (name, value) in the record's order, names in lower case, so fields that come several times (Set-Cookie,
Vary, Link) keep all their lines; a name that the 304 has replaces all lines of that name. Of a repeated validator the first counts.

Responses at one URL and time: the one with the larger id counts. Null URL or time: no_response. A record that can't be
parsed has a null type and is passed over; repeated records are repeated revisits. Bodies may be empty or of any length. Extra
columns of the input are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmark.llm.common import slices

SALT_ROWS = 4096
# Header fields of a 304 that never replace those of the stored response.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type",
                 "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
NOT_MODIFIED = "server-not-modified"
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Without scheme, user, www., default port, fragment, tracking parameters and closing slash; host in lower case."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    rest = F.substring(u, F.length(host) + 1, F.length(u))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(rest, r"([?&])((utm_[a-z]+|ref|fbclid|gclid)=[^&]*(&|$))+", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/+$", "")
    return F.concat(host, rest)


def parse_record(raw: bytes | None):
    """(type, id, url, date, profile, digest, status, headers, body) of a record; None for what isn't there."""
    head, _, block = (raw or b"").partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return (None,) * 9
    named = {}
    for line in lines[1:]:
        k, _, v = line.partition(":")
        named.setdefault(k.strip().lower(), v.strip())
    size = named.get("content-length", "")
    block = block[:int(size)] if size.isdigit() else block
    status, headers, body = None, None, None
    if block.startswith(b"HTTP/"):
        top, _, body = block.partition(b"\r\n\r\n")
        top = top.decode("latin-1").split("\r\n")
        code = top[0].split(" ")[1:2]
        status = int(code[0]) if code and code[0].isdigit() else None
        headers = []
        for line in top[1:]:
            k, _, v = line.partition(":")
            headers.append((k.strip().lower(), v.strip()))
    return (named.get("warc-type"), named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-date"),
            named.get("warc-profile"), named.get("warc-payload-digest"), status, headers, body)


def parse(records: DataFrame, raw: str = "raw") -> DataFrame:
    """(type, id, url, date, profile, digest, status, headers, body) for each raw record."""

    def run(batches):
        fields = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        kinds = [pa.string()] * 6 + [pa.int32(), fields, pa.binary()]
        for b in slices(batches, column="raw"):
            rows = zip(*map(parse_record, b.column("raw").to_pylist()), strict=True)
            cols = [[[{"name": k, "value": v} for k, v in h] if isinstance(h, list) else h for h in c] for c in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["type", "id", "url", "date", "profile", "digest", "status", "headers", "body"])

    return records.select(F.col(raw).alias("raw")).mapInArrow(
        run, f"type string, id string, url string, date string, profile string, digest string, status int, headers {HEADERS}, body binary")


def last_response(events: DataFrame) -> DataFrame:
    """For each revisit of (key, ts, full, id) the id of the last full event of its key strictly before it, as ``found``."""
    order = ["key", "ts", "full", "id"]  # at one time revisits come first, so that its responses are no earlier ones
    tagged = events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("part", "key").orderBy("ts", "full", "id").rowsBetween(Window.unboundedPreceding, 0)
    full_id = F.when(F.col("full"), F.col("id"))
    carried = tagged.withColumn("found", F.last(full_id, ignorenulls=True).over(inside))
    # of each part the last key, and its last response there; then the same for the parts after it
    ends = tagged.groupBy("part").agg(F.max("key").alias("key"))
    tails = tagged.join(F.broadcast(ends), ["part", "key"]).groupBy("part", "key").agg(
        F.max(F.when(F.col("full"), F.struct("ts", "id"))).alias("tail"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("tail", F.last(F.col("tail")["id"], ignorenulls=True).over(before))
    # a key that fills a part and goes on: the tail of the part before is all that is needed
    tails = tails.select(F.lead("part").over(Window.orderBy("part")).alias("part"), "key", "tail").where("part is not null")
    out = carried.where(~F.col("full")).join(F.broadcast(tails), ["part", "key"], "left")
    return out.select(F.col("id").alias("revisit_id"), F.coalesce("found", "tail").alias("found"))


def validators(revisit: Column, response: Column, revisit_digest: Column, response_digest: Column) -> Column:
    def first(h, name):
        return F.get(F.filter(h, lambda x: x["name"] == name), 0)["value"]

    def strong(h):
        return F.regexp_replace(first(h, "etag"), "^W/", "")

    def verdict(a, b):
        return F.when(b.isNull(), "no_validator").when(a == b, "resolved").otherwise("validator_mismatch")

    return F.when(first(revisit, "etag").isNotNull(), verdict(strong(revisit), strong(response))) \
        .when(first(revisit, "last-modified").isNotNull(), verdict(first(revisit, "last-modified"), first(response, "last-modified"))) \
        .otherwise(F.when(revisit_digest.isNull(), "no_validator").otherwise(verdict(revisit_digest, response_digest)))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by those of the 304 that may change."""
    news = F.filter(revisit, lambda x: ~x["name"].isin(*FIXED_HEADERS))
    names = F.transform(news, lambda x: x["name"])
    return F.concat(F.filter(response, lambda x: ~F.array_contains(names, x["name"])), news)


def resolve(records: DataFrame) -> DataFrame:
    """(id, url, date, status, response_id, headers, body) of each not-modified revisit among parsed records."""
    r = records.where("type is not null and id is not null").withColumn("key", canonical_url(F.col("url"))) \
        .withColumn("ts", F.to_timestamp("date")).withColumn("full", (F.col("type") == "response") & (F.col("status") == 200))
    revisit = (F.col("type") == "revisit") & F.coalesce(F.col("profile").contains(NOT_MODIFIED), F.lit(False))
    events = r.where((F.col("full") | revisit) & F.col("key").isNotNull() & F.col("ts").isNotNull()).select("key", "ts", "full", "id")
    found = last_response(events.distinct()).where("found is not null").checkpoint()
    revisits = r.where(revisit).select("id", "url", "date", F.coalesce("headers", F.array().cast(HEADERS)).alias("now"), F.col("digest").alias("digest_now"))
    salts = found.groupBy("found").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    known = found.join(salts, "found").withColumn("salt", F.pmod(F.xxhash64("revisit_id"), "salts").cast("int")).drop("salts")
    responses = r.where("full").dropDuplicates(["id"]).join(salts, F.col("id") == F.col("found")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "found", "salt", F.coalesce("headers", F.array().cast(HEADERS)).alias("then"), F.col("digest").alias("digest_then"), "body")
    out = revisits.join(known, F.col("id") == F.col("revisit_id"), "left").join(responses, ["found", "salt"], "left")
    status = F.when(F.col("found").isNull(), "no_response").otherwise(
        validators(F.col("now"), F.col("then"), F.col("digest_now"), F.col("digest_then")))
    out = out.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return out.select("id", "url", "date", "status", F.col("found").alias("response_id"),
                      F.when(ok, merged_headers(F.col("then"), F.col("now"))).alias("headers"), F.when(ok, F.col("body")).alias("body"))


def captures(pages: DataFrame) -> DataFrame:
    """Raw WARC records made from pages: per page a full response and a later 304 at a variant of its URL.

    The 304 of every 11th page is older than its response, of every 7th has another ETag, of every 5th has only a date and of
    every 13th no validator at all. Responses have two Set-Cookie and two Vary lines, the 304 of every 3rd page two others of Vary.
    """
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")) \
        .where("page_id is not null").withColumn("tag", F.md5("html"))
    line = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts], F.lit("\r\n"))
    base = 1_704_067_200
    day = F.date_format(F.timestamp_seconds(base + F.col("page_id") * 60), "yyyy-MM-dd")
    iso = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def record(kind, number, url, seconds, extra, http):
        return F.concat(line("WARC/1.1"), line("WARC-Type: ", kind), line("WARC-Record-ID: <urn:page:", F.col("page_id").cast("string"), f":{number}>"),
                        line("WARC-Target-URI: ", url), line("WARC-Date: ", iso(seconds)), *extra,
                        line("Content-Length: ", F.octet_length(http).cast("string")), line(""), http, F.lit("\r\n\r\n"))

    full = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line('ETag: "', F.col("tag"), '"'), line("Last-Modified: ", day),
                    line("Cache-Control: max-age=60"), line("Vary: cookie"), line("Set-Cookie: a=", F.col("page_id").cast("string")), line("Vary: accept-encoding"),
                    line("Set-Cookie: b=1"), line("Content-Length: ", F.octet_length("html").cast("string")), line(""), F.col("html"))
    n = F.col("page_id")
    etag = F.when((n % 5 == 0) | (n % 13 == 0), "").when(n % 7 == 0, line('ETag: "other"')).otherwise(line('ETag: W/"', F.col("tag"), '"'))
    date = F.when(n % 13 == 0, "").otherwise(line("Last-Modified: ", day))
    vary = F.when(n % 3 == 0, F.concat(line("Vary: origin"), line("Vary: accept-language"))).otherwise("")
    short = F.concat(line("HTTP/1.1 304 Not Modified"), etag, date, vary, line("Cache-Control: max-age=600"), line("Content-Type: text/plain"), line("Server: cache"), line(""))
    again = F.concat(F.lit("https://www."), F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.)?", ""), "#.*$", ""), F.lit("#again"))
    late = F.when(n % 11 == 0, -30).otherwise(86400)
    profile = line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified")
    raw = F.array(record("response", 0, F.col("url"), base + n * 60, [], full), record("revisit", 1, again, base + n * 60 + late, [profile], short))
    return p.select(F.explode(raw).alias("raw")).select(F.col("raw").cast("binary"))


def digest(resolved: DataFrame) -> DataFrame:
    """Per revisit: its number and URL, the outcome, the response's number (-1 without one), and digests of what was rebuilt."""
    number = lambda c: F.regexp_extract(c, r"(\d+):\d+>$", 1).cast("bigint")
    heads = F.array_join(F.array_sort(F.transform("headers", lambda e: F.concat(e["name"], F.lit("="), e["value"]))), ";")
    return resolved.select(number(F.col("id")).alias("page_id"), canonical_url(F.col("url")).alias("url"), "status",
                           F.coalesce(number(F.col("response_id")), F.lit(-1)).alias("response_page"), F.sha2(heads, 256).alias("headers_sha256"),
                           F.sha2("body", 256).alias("body_sha256"))
