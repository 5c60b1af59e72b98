"""Query op10: not-modified revisits of all pages, resolved."""

from pyspark.sql import functions as F

from quillon.llm import revisits as R
from quillon.llm.common import table


def _flat(headers):
    return F.array_join(F.sort_array(F.transform(headers, lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"]))), "\n")


def op10_resolve_revisits(spark, sf_dir):
    records = R.records_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return R.resolve(records).select("record_id", "url_key", "at", "response_id", "outcome", _flat(F.col("headers")).alias("headers"), "digest")


_DATE = "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%d %H:%M:%S') || ' GMT'"
_AT = "(1700000000 + page_id * 60)"
_AGAIN = f"({_AT} + 30 + (page_id * 7919) % 86400)"
_FIXED = ", ".join(f"'{h}'" for h in R.FIXED_HEADERS)
SQL = {"op10_resolve_revisits": rf"""
WITH c AS (SELECT *, regexp_matches(url, '{R.URL}') AS web, regexp_replace(lower(regexp_extract(url, '{R.URL}', 2)), '^www[0-9]*\.', '') AS host,
    regexp_extract(url, '{R.URL}', 3) AS port, regexp_extract(url, '{R.URL}', 4) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '{R.URL}', 5), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{R.TRACKING}'))), '&') AS q,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, md5(coalesce(html, '')) AS body FROM pages),
k AS (SELECT *, CASE WHEN web THEN host || CASE WHEN port IN ('', ':', ':80', ':443') THEN '' ELSE port END || CASE WHEN path = '' THEN '/' ELSE path END
      || CASE WHEN q = '' THEN '' ELSE '?' || q END ELSE trim(url) END AS key FROM c),
full_ AS (SELECT key, {_AT} AS ts, page_id * 2 AS response_id, tag, {_DATE.format(_AT + ' - 3600')} AS modified, body,
      [{{'name': 'date', 'value': {_DATE.format(_AT)}}}, {{'name': 'last-modified', 'value': {_DATE.format(_AT + ' - 3600')}}}, {{'name': 'etag', 'value': tag}},
       {{'name': 'content-type', 'value': 'text/html'}}, {{'name': 'content-length', 'value': CAST(strlen(coalesce(html, '')) AS VARCHAR)}}] AS stored
      FROM k WHERE key IS NOT NULL),
one AS (SELECT * FROM full_ QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY response_id DESC) = 1),
v AS (SELECT page_id * 2 + 1 AS record_id, key, {_AGAIN} AS ts, page_id,
      CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"stale"' ELSE tag END AS seen, {_DATE.format(_AT + ' - 3600')} AS since FROM k),
j AS (SELECT v.*, one.response_id, one.tag, one.modified, one.stored, one.body FROM v ASOF LEFT JOIN one ON v.key = one.key AND v.ts > one.ts),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN seen IS NOT NULL THEN CASE WHEN seen = tag THEN 'merged' ELSE 'changed' END
      WHEN since = modified THEN 'merged' ELSE 'changed' END AS outcome,
      list_filter([{{'name': 'date', 'value': {_DATE.format('ts')}}}, CASE WHEN page_id % 5 = 0 THEN {{'name': 'last-modified', 'value': since}}
        WHEN page_id % 7 = 0 THEN {{'name': 'etag', 'value': '"stale"'}} ELSE {{'name': 'etag', 'value': 'W/' || seen}} END,
        {{'name': 'cache-control', 'value': 'max-age=' || (page_id % 600)}}, {{'name': 'content-length', 'value': '0'}}], lambda h: h.name NOT IN ({_FIXED})) AS fresh FROM j)
SELECT record_id, key AS url_key, ts AS "at", response_id, outcome, CASE WHEN outcome = 'merged' THEN array_to_string(list_sort(list_transform(
    list_concat(list_filter(stored, lambda s: NOT list_contains(list_transform(fresh, lambda f: f.name), s.name)), fresh), lambda h: h.name || ': ' || h.value)), chr(10)) END AS headers,
  CASE WHEN outcome = 'merged' THEN body END AS digest FROM o"""}
QUERIES = {"op10_resolve_revisits": op10_resolve_revisits}
