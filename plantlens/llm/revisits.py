"""Resolution of not-modified revisits: as-of join to the latest earlier full response, validators, merged headers.

The join is a window over time slices: within a slice of a URL's captures the last full response is carried along, and the last one
of all earlier slices comes from a table with one row per URL and slice. A URL that holds a third of all captures is so
spread over its slices. Only keys and headers are moved, never payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantlens.llm.common import query, table

#: Headers that a not-modified answer may renew. Fixed values.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid)="
SLICE = 10_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without its last slash, parameters sorted and without tracking; no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ only in case the last one counts."""
    names = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    return F.aggregate(names, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(captures: DataFrame, slice_length: int = SLICE) -> DataFrame:
    """``captures``: capture_id, url, ts (long), kind ('response' or 'revisit'), headers (map), digest. One row per revisit.

    Returns capture_id, url_key, response_id, outcome and headers. The response is the latest one of the same canonical URL with an
    earlier (ts, capture_id). Outcomes: ``resolved`` (a validator is equal and none differs: entity tag, else date of
    last change, else payload digest), ``unverified`` (nothing to compare), ``mismatch`` and ``no_response``. Headers are the response's with
    the permitted ones of the revisit over them; for a mismatch or a missing response they are the revisit's own.
    A NULL or empty URL resolves nothing; NULL times count as before all others; repeated captures are kept, each with its own row;
    an empty table gives no rows; other columns are not read.
    """
    rows = captures.select("capture_id", canonical_url(F.col("url")).alias("url_key"), F.coalesce(F.col("ts"), F.lit(-(1 << 62))).alias("ts"), "kind", lower_names(F.col("headers")).alias("own"), "digest")
    rows = rows.withColumn("slice", F.floor(F.col("ts") / slice_length))
    full = F.when((F.col("kind") == "response") & (F.col("url_key") != ""), F.struct("ts", "capture_id", F.col("own").alias("headers"), "digest"))
    before = Window.partitionBy("url_key", "slice").orderBy("ts", "capture_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("full", full)
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    last = rows.where("full is not null").groupBy("url_key", "slice").agg(F.max_by("full", F.struct("ts", "capture_id")).alias("full"))
    # Slices that hold revisits ask for the last response of earlier slices; one row per URL and slice.
    asked = rows.where("kind = 'revisit'").select("url_key", "slice").distinct().withColumn("full", F.lit(None).cast(last.schema["full"].dataType))
    earlier = Window.partitionBy("url_key").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = asked.unionByName(last).groupBy("url_key", "slice").agg(F.first("full", ignorenulls=True).alias("full"))
    carried = carried.select("url_key", "slice", F.last("full", ignorenulls=True).over(earlier).alias("carried"))
    met = near.where("kind = 'revisit'").join(carried, ["url_key", "slice"], "left").withColumn("r", F.coalesce("near", "carried"))
    there = F.col("r.headers")
    tag, tag_there = strong(F.element_at("own", "etag")), strong(F.element_at(there, "etag"))
    day, day_there = F.element_at("own", "last-modified"), F.element_at(there, "last-modified")
    same = F.coalesce(tag == tag_there, day == day_there, F.col("digest") == F.col("r.digest"))
    outcome = F.when(F.col("r").isNull(), "no_response").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    allowed = F.array(*[F.lit(p) for p in PERMITTED])
    renewed = F.map_filter("own", lambda k, _: F.array_contains(allowed, k))
    merged = F.map_concat(F.map_filter(there, lambda k, _: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    joined = F.when(outcome.isin("resolved", "unverified"), merged).otherwise(F.col("own"))
    return met.select("capture_id", "url_key", F.col("r.capture_id").alias("response_id"), outcome.alias("outcome"), joined.alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl's capture log from pages: each page is fetched in full, then three times again as not modified.

    The second revisit of every fifth page carries another entity tag (the page had changed), the third has no tag but the date. Pages
    whose id is divisible by 7 were first met as a revisit, before any full response.
    """
    day = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    text = lambda s: F.lit(s).cast("string")
    fields = lambda *kv: F.map_filter(F.create_map(*kv), lambda _, v: v.isNotNull())
    full = fields(text("ETag"), tag, text("Last-Modified"), day, text("Content-Type"), text("text/html"), text("Date"), text("t0"))
    first = fields(text("etag"), F.concat(F.lit("W/"), tag), text("Date"), text("t1"), text("Set-Cookie"), text("s=1"))
    second = fields(text("ETag"), F.when(F.col("page_id") % 5 == 0, text('"changed"')).otherwise(tag), text("Expires"), text("t9"))
    third = fields(text("Last-Modified"), day, text("Cache-Control"), text("max-age=60"))
    shift = F.when(F.col("page_id") % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    steps = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit("revisit" if k else "response").alias("kind"), h.alias("headers"), F.when(F.lit(k == 0), shift * 2).otherwise(F.lit(k)).alias("at"))
        for k, h in enumerate((full, first, second, third))
    ])
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.explode(steps).alias("s"))
    return rows.select((F.col("page_id") * 4 + F.col("s.k")).alias("capture_id"), "url", (F.col("page_id") * 4 + F.col("s.at")).alias("ts"), "s.kind", "s.headers", "digest")


_SQL = r"""WITH c AS (SELECT page_id, md5(coalesce(html, '')) AS digest, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || (page_id % 365) AS day,
      regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
    u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
      regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
      list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)='))) AS ps FROM c),
    k AS (SELECT *, host || path || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url_key FROM u),
    f AS (SELECT page_id * 4 AS id, url_key, page_id * 4 + CASE WHEN page_id % 7 = 0 THEN 2 ELSE 0 END AS ts, tag, day, digest FROM k WHERE url_key <> ''),
    v AS (SELECT page_id * 4 + 1 AS id, url_key, page_id * 4 + 1 AS ts, tag AS tag, NULL AS day, digest, 'date=t1' AS add_, ['date=t1', 'etag=W/' || tag, 'set-cookie=s=1'] AS own, 1 AS n FROM k
      UNION ALL SELECT page_id * 4 + 2, url_key, page_id * 4 + 2, CASE WHEN page_id % 5 = 0 THEN '"changed"' ELSE tag END, NULL, digest, '', ['etag=' || CASE WHEN page_id % 5 = 0 THEN '"changed"' ELSE tag END, 'expires=t9'], 2 FROM k
      UNION ALL SELECT page_id * 4 + 3, url_key, page_id * 4 + 3, NULL, day, digest, '', ['cache-control=max-age=60', 'last-modified=' || day], 3 FROM k),
    j AS (SELECT v.*, f.id AS fid, f.tag AS ftag, f.day AS fday, f.digest AS fdigest,
      row_number() OVER (PARTITION BY v.id ORDER BY f.ts DESC, f.id DESC) AS nth FROM v LEFT JOIN f ON v.url_key = f.url_key AND (f.ts, f.id) < (v.ts, v.id)),
    o AS (SELECT *, CASE WHEN fid IS NULL THEN 'no_response' WHEN coalesce(tag = ftag, day = fday, digest = fdigest) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE nth = 1)
    SELECT id AS capture_id, url_key, fid AS response_id, outcome, array_to_string(list_sort(CASE WHEN outcome <> 'resolved' THEN own
      WHEN n = 1 THEN ['content-type=text/html', 'date=t1', 'etag=W/' || tag, 'last-modified=' || fday]
      WHEN n = 2 THEN ['content-type=text/html', 'date=t0', 'etag=' || tag, 'expires=t9', 'last-modified=' || fday]
      ELSE ['cache-control=max-age=60', 'content-type=text/html', 'date=t0', 'etag=' || ftag, 'last-modified=' || day] END), '|') AS headers FROM o"""


@query(_SQL)
def op5_revisits(spark, sf):
    found = resolve_revisits(captures_of(table(spark, sf, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.withColumn("headers", F.array_join(pairs, "|"))
