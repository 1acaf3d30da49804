"""Operator 7, WARC: resolution of not-modified revisits.

A revisit record (304 Not Modified) holds no body (a full response is one of status 200): it stands for the latest full response for the same canonical URL that was stored
earlier. That response is found by an as-of join, its validators are checked against the revisit's (ETag, compared weakly; else
Last-Modified), and the headers that a 304 may update replace the stored ones.

The as-of join is a window over (URL, block of time). Blocks hold about equal numbers of records, and each starts with the last full response of
earlier blocks, found from one row per URL and block, so that a URL with a third of all records spreads over many windows. Only times, ids and
validators go through the window; headers and bodies are joined back once, last.

Defined cases: a revisit with no earlier full response is 'no_response', one without a validator in common with it 'no_validator', one whose
validator differs 'mismatch', else it is 'resolved'; only resolved ones get headers and body. Earlier means at a smaller time; of full responses at
one time the greatest record id counts. A null URL or time never finds a response; null headers are none; header names compare in lower
case, the first of equal names wins. Records are told apart by all their columns, not by their id: equal rows are one record, different rows that
share an id, or have none, are different records. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BLOCKS = 256
#: Fields that a 304 doesn't change in a stored response (body framing and hop-by-hop fields), lower case.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Without scheme, 'www.', default port, fragment, tracking parameters and trailing '/', host in lower case."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&", "?")
    rest = F.regexp_replace(rest, r"[?&]$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1), r"/$", ""))


def _lower_names(headers: Column) -> Column:
    """Headers by lower-case name, the first of equal names."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(lowered, lambda e, i: ~F.exists(F.slice(lowered, 1, i), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(first)


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with those of the 304 that may update them."""
    permitted = F.map_filter(update, lambda k, v: ~k.isin(*NOT_UPDATED))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(permitted), k))
    return F.map_concat(kept, permitted)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """records (record_id, url, at long, kind 'response' or 'revisit', status int, headers map, body) -> one row per revisit:
    record_id, url (canonical), at, response_id, resolution, headers, body."""
    columns = [F.col(c) for c in ("record_id", "url", "at", "kind", "status")]
    whole = F.struct(*columns, F.map_entries("headers").alias("headers"), F.md5(F.col("body").cast("binary")).alias("body"))
    records = records.select(
        F.unhex(F.md5(F.to_json(whole, {"ignoreNullFields": "false"}).cast("binary"))).alias("key"),
        "record_id", canonical_url(F.col("url")).alias("url"), "at", "kind", "status", _lower_names(F.col("headers")).alias("headers"), "body",
    )
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200), F.lit(False))
    stored = F.when(full, F.struct("at", "record_id", "key", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified")))
    slim = records.filter(full | (F.col("kind") == "revisit")).select(
        "key", "record_id", "url", "at", "kind", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"), stored.alias("stored")
    ).dropDuplicates(["key"])
    slim = written(slim, "crawl-times")
    # Blocks of time with about as many records each; what a block holds doesn't change the result.
    marks = [i / BLOCKS for i in range(1, BLOCKS)]
    bounds = slim.agg(F.percentile_approx("at", marks)).first()[0] or []
    bounds = F.array(*[F.lit(x).cast("long") for x in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    slim = slim.withColumn("block", F.when(F.col("at").isNotNull(), F.size(F.filter(bounds, lambda x: x <= F.col("at")))))
    timed = slim.filter(F.col("url").isNotNull() & F.col("at").isNotNull())
    # The last full response of each block, carried into the next block of the URL that has any record.
    ends = timed.groupBy("url", "block").agg(F.max("stored").alias("end"))
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("stored", F.last("end", ignorenulls=True).over(before)).filter("stored IS NOT NULL").select("url", "block", "stored")
    rows = timed.unionByName(carried.withColumn("kind", F.lit("carried")).withColumn("at", F.col("stored.at")), allowMissingColumns=True)
    # At one time, revisits come first: an earlier response is one at a smaller time.
    order = Window.partitionBy("url", "block").orderBy("at", F.when(F.col("kind") == "revisit", 0).otherwise(1), F.col("stored.record_id"), F.col("stored.key"))
    found = rows.withColumn("found", F.last("stored", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    asked = found.filter("kind = 'revisit'").select("key", "record_id", "url", "at", "etag", "modified", "found")
    untimed = slim.filter((F.col("kind") == "revisit") & (F.col("url").isNull() | F.col("at").isNull()))
    asked = asked.unionByName(untimed.select("key", "record_id", "url", "at", "etag", "modified"), allowMissingColumns=True)
    by_etag = _weak(F.col("etag")) == _weak(F.col("found.etag"))
    by_date = F.col("modified") == F.col("found.modified")
    same = F.coalesce(by_etag, by_date)
    resolution = F.when(F.col("found").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    judged = asked.select(
        "key", "record_id", "url", "at", F.col("found.record_id").alias("response_id"), resolution.alias("resolution"),
        F.when(resolution == "resolved", F.col("found.key")).alias("stored_key"),
    )
    # Equal rows have one key: one of each. Grouped and joined by the same key, so that headers and bodies are shuffled once.
    own = records.filter("kind = 'revisit'").groupBy("key").agg(F.first("headers").alias("own"))
    bodies = records.filter(full).groupBy(F.col("key").alias("stored_key")).agg(F.first("headers").alias("stored_headers"), F.first("body").alias("body"))
    return judged.join(own, "key").join(bodies, "stored_key", "left").select(
        "record_id", "url", "at", "response_id", "resolution",
        F.when(F.col("stored_key").isNotNull(), merged_headers(F.col("stored_headers"), F.col("own"))).alias("headers"), "body",
    )


def crawl_log(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of pages: each page's full response, at its page_id in minutes, and a later conditional request for the
    same URL that was answered 304 with that page's ETag (every fifth one with a date only)."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), F.floor(F.col("page_id") / 7).cast("string"))
    response = pages.select(
        F.concat(F.lit("response-"), F.col("page_id")).alias("record_id"), "url", (F.col("page_id") * 60).alias("at"), F.lit("response").alias("kind"),
        F.lit(200).alias("status"),
        F.create_map(
            F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
        F.col("html").alias("body"),
    )
    by_date = F.create_map(F.lit("last-modified"), date, F.lit("Date"), F.col("page_id").cast("string"))
    by_tag = F.create_map(
        F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-type"), F.lit("text/plain")
    )
    revisit = pages.select(
        F.concat(F.lit("revisit-"), F.col("page_id")).alias("record_id"), "url",
        (F.col("page_id") * 60 + 30 + F.col("page_id") * 7919 % 600_000 - F.when(F.col("page_id") % 11 == 0, 60).otherwise(0)).alias("at"),
        F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.when(F.col("page_id") % 5 == 0, by_date).otherwise(by_tag).alias("headers"),
        F.lit(None).cast("string").alias("body"),
    )
    return response.unionByName(revisit)


ORACLE = r"""
WITH p AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS r0,
         '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id // 7)::VARCHAR AS modified
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(r0, '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'),
            '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]$', '') AS r1
  FROM p
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(r1, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(r1, '^[^/?]*(.*)$', 1), '/$', '') AS u
  FROM q
), revisit AS (
  SELECT page_id, u, page_id * 60 + 30 + page_id * 7919 % 600000 - CASE WHEN page_id % 11 = 0 THEN 60 ELSE 0 END AS at_time, tag, modified FROM c
), found AS (
  SELECT r.page_id, r.u, r.at_time, r.tag, r.modified, s.page_id AS s_id, s.tag AS s_tag, s.modified AS s_modified, s.html
  FROM revisit r ASOF LEFT JOIN (SELECT page_id, u, page_id * 60 AS s_time, tag, modified, html FROM c) s ON r.u = s.u AND r.at_time > s.s_time
), judged AS (
  SELECT *, CASE WHEN s_id IS NULL THEN 'no_response'
                 WHEN page_id % 5 = 0 AND modified = s_modified THEN 'resolved'
                 WHEN page_id % 5 <> 0 AND tag = s_tag THEN 'resolved' ELSE 'mismatch' END AS resolution
  FROM found
)
SELECT 'revisit-' || page_id::VARCHAR AS record_id, u AS url, at_time AS "at", 'response-' || s_id::VARCHAR AS response_id, resolution,
       CASE WHEN resolution <> 'resolved' THEN NULL
            WHEN page_id % 5 = 0 THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id::VARCHAR
                 || chr(10) || 'etag: ' || s_tag || chr(10) || 'last-modified: ' || modified
            ELSE 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/' || tag || chr(10)
                 || 'last-modified: ' || s_modified END AS headers,
       CASE WHEN resolution = 'resolved' THEN md5(html) END AS body_md5
FROM judged
"""
