"""Not-modified revisits of a web archive, resolved to the full response they stand for.

A revisit is joined as of its time to the latest earlier full response of its canonical URL.
Its validators are checked against that response, and the headers that a 304 answer may
update are merged. Payloads are attached by id afterwards, so the as-of join moves no bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import durable, join_small

#: Query parameters that do not change what a URL names.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)"
#: Headers that a 304 answer must not change: they describe the connection or the stored body.
FIXED_HEADERS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
    "trailer", "transfer-encoding", "upgrade",
]
HEADERS = "array<struct<name:string,value:string>>"
URL = r"(?i)^\s*(https?)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)(?:\?([^#]*))?"
#: So many moments of one URL are put in order by one task, as far as MAX_SPANS allows.
SPAN_ROWS, MAX_SPANS = 50_000, 4096


def canonical_url(url: Column) -> Column:
    """host[:port]/path[?query]: scheme, user, fragment, default port, www. and tracking dropped,
    host in lower case, query parameters in order. What is not an http URL is only trimmed; null stays."""
    part = lambda i: F.regexp_extract(url, URL, i)
    host = F.regexp_replace(F.lower(part(2)), r"^www[0-9]*\.", "")
    port = F.when(part(3).isin("", ":", ":80", ":443"), "").otherwise(part(3))
    path = F.when(part(4) == "", "/").otherwise(part(4))
    params = F.array_sort(F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(url.rlike(URL), F.concat(host, port, path, query)).otherwise(F.trim(url))


def header(headers: Column, name: str) -> Column:
    """The first value of a header; names compare without case."""
    return F.get(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), 0)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(header(headers, "etag"), r"^W/", "")


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers, those that the fresh ones may replace replaced."""
    allowed = F.filter(fresh, lambda h: ~F.lower(h["name"]).isin(FIXED_HEADERS))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    kept = F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"])))
    return F.concat(F.coalesce(kept, F.array().cast(HEADERS)), F.coalesce(allowed, F.array().cast(HEADERS)))


def latest_before(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked(key, at), distinct; known(key, at, r), distinct in (key, at): asked with the r of the
    latest known moment strictly before. A hot key is split into spans of time at quantiles of its own
    moments, so that outliers and bursts make no span large: within a span rows are ordered by one
    task, and what a span knows last is carried over spans, at most MAX_SPANS a key.
    """
    both = durable(
        known.select("key", "at", "r", F.lit(1).alias("order")).unionByName(
            asked.select("key", "at", F.lit(0).alias("order")), allowMissingColumns=True),
        "asof-events",
    )
    hot = durable(both.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SPAN_ROWS), "asof-hot")
    most = hot.agg(F.max("n")).first()[0]
    span = F.lit(0)
    if most:
        spans = min(MAX_SPANS, most // SPAN_ROWS + 1)
        cuts = join_small(both.select("key", "at"), hot.select("key"), ["key"], "left_semi").groupBy("key").agg(
            F.percentile_approx("at", [k / spans for k in range(1, spans)], max(10_000, 10 * spans)).alias("cuts"))
        both = join_small(both, durable(cuts, "asof-cuts"), ["key"])
        span = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("at"))))
    both = both.withColumn("span", span).drop("cuts")
    here = Window.partitionBy("key", "span").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("r_near", F.last("r", ignorenulls=True).over(here)).where(F.col("order") == 0)
    last = both.groupBy("key", "span").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("at"))).alias("r_last"))
    past = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("key", "span", F.last("r_last", ignorenulls=True).over(past).alias("r_past"))
    return near.join(carried, ["key", "span"], "left").select("key", "at", F.coalesce("r_near", "r_past").alias("r"))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, at, response_id, outcome, headers, digest.

    ``records`` has record_id, kind ('response' or 'revisit'), url, at (long), headers (HEADERS),
    digest; other columns are ignored. outcome: 'merged'; 'no_response' (none is earlier, or the
    URL or time is null); 'changed' (entity tags differ, or else modification dates do);
    'unverified' (no validator in common). Only 'merged' rows get headers and digest; all but
    'no_response' name the response. Of responses of one URL and moment the largest record_id
    counts. Repeated revisits each get a row. An empty table gives no rows.
    """
    thin = records.select("record_id", "kind", canonical_url(F.col("url")).alias("key"), "at", "headers", "digest")
    known = (
        thin.where((F.col("kind") == "response") & F.col("key").isNotNull() & F.col("at").isNotNull())
        .groupBy("key", "at")
        .agg(F.max_by(F.struct("record_id", "headers", "digest"), "record_id").alias("r"))
    )
    visits = durable(thin.where("kind = 'revisit'"), "revisits")
    asked = visits.where("key IS NOT NULL AND at IS NOT NULL").select("key", "at").distinct()
    found = visits.join(latest_before(asked, known), ["key", "at"], "left")
    stored = F.col("r.headers")
    tags, dates = (_tag(F.col("headers")), _tag(stored)), (header(F.col("headers"), "last-modified"), header(stored, "last-modified"))
    outcome = (
        F.when(F.col("r.record_id").isNull(), "no_response")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], "merged").otherwise("changed"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], "merged").otherwise("changed"))
        .otherwise("unverified")
    )
    found = found.withColumn("outcome", outcome)
    good = F.col("outcome") == "merged"
    return found.select(
        "record_id", F.col("key").alias("url_key"), "at", F.col("r.record_id").alias("response_id"), "outcome",
        F.when(good, merged(stored, F.col("headers"))).alias("headers"), F.when(good, F.col("r.digest")).alias("digest"),
    )


def attach_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """Resolved rows with the body of their response; rows that are not 'merged' get null."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), payload)
    bodies = bodies.dropDuplicates(["response_id"])
    hit = resolved.withColumn("_to", F.when(F.col("outcome") == "merged", F.col("response_id")))
    return hit.join(bodies.withColumnRenamed("response_id", "_to"), "_to", "left").drop("_to")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Crawl records over raw pages: each page once as a full response and once, later, as a
    not-modified revisit under another spelling of its URL. Every seventh revisit has a stale
    entity tag; every fifth has a modification date only."""
    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    page = F.col("page_id")
    at = F.lit(1_700_000_000) + page * 60
    date = lambda t: F.concat(F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd HH:mm:ss"), F.lit(" GMT"))
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    again = at + 30 + (page * 7919) % 86400
    full = F.array(
        pair("Date", date(at)), pair("Last-Modified", date(at - 3600)), pair("ETag", tag), pair("Content-Type", F.lit("text/html")),
        pair("Content-Length", F.coalesce(F.octet_length("html"), F.lit(0))),
    )
    seen = F.when(page % 5 == 0, pair("last-modified", date(at - 3600))).when(page % 7 == 0, pair("etag", F.lit('"stale"'))).otherwise(
        pair("etag", F.concat(F.lit("W/"), tag)))
    brief = F.array(pair("date", date(again)), seen, pair("cache-control", F.concat(F.lit("max-age="), page % 600)), pair("content-length", F.lit(0)))
    row = lambda shift, kind, url, t, headers, body: F.struct(
        (page * 2 + shift).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), t.alias("at"), headers.cast(HEADERS).alias("headers"), body.alias("digest"))
    both = F.array(
        row(0, "response", F.col("url"), at, full, digest),
        row(1, "revisit", F.concat(F.upper(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)), F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1), F.lit("#again")), again, brief, F.lit(None).cast("string")),
    )
    return pages.select("page_id", F.inline(both))
