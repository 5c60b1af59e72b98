"""Queries over the catalogue view of the driver's tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators import duplicates, overlay, search, stats, tree, usage
from quillon.operators.query import Clock
from quillon.sources import catalog as C
from quillon.sources import snapshots
from quillon.streaming import journal

CLOCK = Clock(1_702_000_000)
ROOT = "D:\\corpus\\en"
SHOWN = ["id", "path", "is_dir", "size", "allocated", "mtime", "ctime", "flags", "frn"]

#: The catalogue in SQL: files, then their directories.
FILES = r"""
files AS (SELECT doc_id AS id, 'D:\corpus\' || lang || '\' || source || '\Doc' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'rs' WHEN 3 THEN 'log' ELSE 'TXT' END AS path,
  false AS is_dir, n_chars AS size, CASE WHEN n_chars <= 700 THEN 0 ELSE ((n_chars + 4095) // 4096) * 4096 END AS allocated,
  1700000000 + (doc_id * 7919) % 2592000 AS mtime, 1700000000 + (doc_id * 7919) % 2592000 - doc_id % 86400 AS ctime,
  CAST((doc_id % 7 = 0)::INT * 1 + (doc_id % 11 = 0)::INT * 2 + (doc_id % 13 = 0)::INT * 4 + (doc_id % 17 = 0)::INT * 8 AS INTEGER) AS flags,
  1 + min(doc_id) OVER (PARTITION BY text) AS frn FROM documents)"""
DIRS = r"""
parts AS (SELECT DISTINCT string_split(path, '\') AS p FROM files), dirpaths AS (SELECT DISTINCT array_to_string(p[1:k], '\') AS path FROM (SELECT p, unnest(range(1, len(p))) AS k FROM parts)),
catalog AS (SELECT * FROM files UNION ALL SELECT 1000000000 + row_number() OVER (ORDER BY path), path, true, 0, 0, 0, 0, 0, NULL FROM dirpaths),
c AS (SELECT *, lower(regexp_extract(path, '[^\\/]*$')) AS name_l, lower(path) AS path_ci FROM catalog)"""
WITH = f"WITH {FILES}, {DIRS}"
COLS = ", ".join(SHOWN[:-1]) + ", coalesce(frn, 0) AS frn"


def shown(df: DataFrame, *more: str) -> DataFrame:
    """The columns of an entry; no record number shows as 0."""
    return df.select(*SHOWN[:-1], F.coalesce("frn", F.lit(0).cast("long")).alias("frn"), *more)


def catalog_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored snapshot of the catalogue, made by the first query that asks."""
    return snapshots.stored(spark, f"{sf_dir}/documents.parquet", lambda: C.of_documents(spark, sf_dir))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_of(spark, sf_dir).where(~F.col("is_dir"))


_FOUND: dict[str, tuple[str, str]] = {
    "name_contains": ("doc1", "contains(name_l, 'doc1')"),
    "path_contains": (r"en\src1", r"contains(path_ci, 'en\src1')"),
    "suffix": ("*7.rs", "name_l LIKE '%7.rs'"),
    "ext_list": ("ext:rs,.md", "name_l LIKE '%.rs' OR name_l LIKE '%.md'"),
    "glob_qmark": ("doc?5.*", r"regexp_matches(name_l, 'doc.5\..*') AND name_l LIKE 'doc%'"),
    "glob_prefix2": ("do*9*", "name_l LIKE 'do%9%'"),
    "glob_prefix1_contains": ("o*6.md", "name_l LIKE '%o%6.md'"),
    "glob_path": (r"*\en\src?\*.rs", r"regexp_matches(path_ci, '\\en\\src.\\.*\.rs$')"),
    "glob_star_all": ("**", "true"),
    "size_gt": ("size:>2kb", "size >= 2048"),
    "size_lt": ("size:<1kb", "size < 1024"),
    "size_range": ("size:1kb-4kb", "size >= 1024 AND size < 4096"),
    "size_exact": ("size:0", "size = 0"),
    "size_reversed": ("size:4kb-1kb", "false"),
    "mtime_after": ("dm:>2023-11-25", "mtime >= 1700870400"),
    "mtime_before": ("dm:<2023-11-25", "mtime < 1700870400"),
    "mtime_range": ("dm:2023-11-20..2023-11-25", "mtime >= 1700438400 AND mtime < 1700956800"),
    "mtime_day": ("dm:2023-11-25", "mtime >= 1700870400 AND mtime < 1700956800"),
    "mtime_today": ("dm:today", "mtime >= 1701993600 AND mtime < 1702080000"),
    "mtime_yesterday": ("dm:yesterday", "mtime >= 1701907200 AND mtime < 1701993600"),
    "mtime_thisweek": ("dm:thisweek", "mtime >= 1702000000 - 604800"),
    "mtime_thismonth": ("dm:thismonth", "mtime >= 1702000000 - 2592000"),
    "ctime_range": ("dc:2023-11-20..2023-11-25", "ctime >= 1700438400 AND ctime < 1700956800"),
    "type_dir": ("type:dir", "is_dir"),
    "type_file": ("type:f", "NOT is_dir"),
    "flag_hidden": ("hidden:true", "flags & 1 <> 0"),
    "flag_not_system": ("system:no", "flags & 2 = 0"),
    "flag_readonly": ("readonly:1", "flags & 4 <> 0"),
    "flag_reparse": ("reparse:yes", "flags & 8 <> 0"),
    "path_prefix_naive": (r"parent:D:\corpus\en\src1", r"starts_with(path_ci, 'd:\corpus\en\src1')"),
    "skip_component": ("skip:src1,fr", r"NOT regexp_matches(path_ci, '(^|[\\/])(src1|fr)([\\/]|$)')"),
    "regex_name": ("regex:^doc[0-9]{2}\\.", r"regexp_matches(name_l, '^doc[0-9]{2}\.')"),
    "negation": ("!ext:rs !type:dir", "NOT name_l LIKE '%.rs' AND NOT is_dir"),
    "multi_term_and": ("ext:rs size:>1kb !hidden:true", "name_l LIKE '%.rs' AND size >= 1024 AND flags & 1 = 0"),
    "empty_query": ("", "true"),
}


def _found(text: str) -> Callable:
    return lambda spark, d: shown(search.matching(catalog_of(spark, d), text, CLOCK))


_PAGES: dict[str, tuple[str, str | None, bool, int, str]] = {
    "topn_size_desc": ("type:file", "size", True, 20, "size DESC, path"),
    "topn_name_asc": ("type:file", "name", False, 20, "name_l, path"),
    "topn_path": ("", "path", True, 20, "path_ci DESC, path"),
    "topn_mtime": ("ext:md", "mtime", True, 15, "mtime DESC, path"),
    "topn_ctime": ("", "ctime", False, 15, "ctime, path"),
    "topn_allocated": ("", "allocated", True, 25, "allocated DESC, path"),
    "default_order_page": ("ext:log", None, False, 10, "id"),
}
_WHERE = {"type:file": "NOT is_dir", "": "true", "ext:md": "name_l LIKE '%.md'", "ext:log": "name_l LIKE '%.log'"}


def _page(text: str, sort: str | None, desc: bool, limit: int) -> Callable:
    return lambda spark, d: shown(search.page(search.matching(catalog_of(spark, d), text, CLOCK), limit, sort, desc))


def _total(spark, d):
    return search.matching(catalog_of(spark, d), "ext:rs size:>1kb", CLOCK).agg(F.count("*").alias("total"))


def _subtree(spark, d):
    return shown(usage.subtree(catalog_of(spark, d), ROOT + "\\src1\\"))


def _du_total(spark, d):
    return usage.totals(catalog_of(spark, d), ROOT)


def _du_children(spark, d):
    return usage.directories(catalog_of(spark, d), "D:\\")


def _du_top(spark, d):
    return usage.largest(usage.directories(catalog_of(spark, d), "D:\\corpus"), depth=2, top=7)


def _du_allocated(spark, d):
    return usage.largest(usage.directories(catalog_of(spark, d), "D:\\corpus"), top=9, by_allocated=True)


def _du_dedup(spark, d):
    return usage.unique_files(usage.subtree(catalog_of(spark, d), "D:\\")).select("id", "path", "size", "allocated")


def page_catalog(spark: SparkSession, d: str) -> DataFrame:
    """URLs as a hierarchy: hosts and path components are directories."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    clean = F.regexp_replace(F.col("url"), "[?#].*$", "")
    path = F.concat(F.regexp_replace(clean, "^[a-z]+://", ""), F.lit("/page"), F.col("page_id").cast("string"))
    files = C.normalise(pages.select(F.col("page_id").alias("id"), path.alias("path"), F.length("html").cast("long").alias("size")))
    dirs = files.select(F.explode(paths.ancestors("path")).alias("path")).distinct()
    return files.unionByName(C.normalise(C.numbered(dirs, ["path"], 1_000_000_001).select("id", "path", F.lit(True).alias("is_dir"))))


def _du_pages(spark, d):
    c = page_catalog(spark, d)
    sums = usage.unique_files(search.with_derived(c)).groupBy(paths.dirname("path").alias("parent")).agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    up = F.explode(F.array_append(paths.ancestors("parent"), F.col("parent")))
    return sums.select(up.alias("path"), "size", "files").groupBy("path").agg(F.sum("size").alias("size"), F.sum("files").alias("files"))


def _contents(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return files_of(spark, d).select("id", "path").join(docs, "id").select("path", "content")


def _dupe_groups(spark, d):
    return duplicates.groups(files_of(spark, d), _contents(spark, d), 100).select("path", "size")


def _dupe_ranked(spark, d):
    return duplicates.ranked(duplicates.groups(files_of(spark, d), _contents(spark, d), 100), 10).drop("digest")


def _dupe_summary(spark, d):
    return duplicates.summary(files_of(spark, d), _contents(spark, d), 100)


def tree_records(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as records that name their parents; every seventh supplier's is missing,
    every fifth supplier has a link of the same name in another nation."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    region = read("region").select((F.col("r_regionkey") + 100).cast("long").alias("frn"), F.lit(5).cast("long").alias("parent_frn"), F.col("r_name").alias("name"), F.lit(True).alias("is_dir"))
    nation = read("nation").select((F.col("n_nationkey") + 1000).cast("long"), (F.col("n_regionkey") + 100).cast("long"), F.col("n_name"), F.lit(True))
    parent = F.when(F.col("s_suppkey") % 7 == 0, F.lit(99)).otherwise(F.col("s_nationkey") + 1000).cast("long")
    supplier = read("supplier").select((F.col("s_suppkey") + 100_000).cast("long"), parent, F.col("s_name"), F.lit(False))
    linked = read("supplier").where("s_suppkey % 5 = 0").select((F.col("s_suppkey") + 100_000).cast("long"), ((F.col("s_nationkey") + 1) % 25 + 1000).cast("long"), F.col("s_name"), F.lit(False))
    return region.union(nation).union(supplier).union(linked)


TREE_SQL = r"""WITH RECURSIVE recs AS (SELECT CAST(r_regionkey + 100 AS BIGINT) AS frn, CAST(5 AS BIGINT) AS parent_frn, r_name AS name, true AS is_dir FROM region
UNION ALL SELECT n_nationkey + 1000, n_regionkey + 100, n_name, true FROM nation
UNION ALL SELECT s_suppkey + 100000, CASE WHEN s_suppkey % 7 = 0 THEN 99 ELSE s_nationkey + 1000 END, s_name, false FROM supplier
UNION ALL SELECT s_suppkey + 100000, (s_nationkey + 1) % 25 + 1000, s_name, false FROM supplier WHERE s_suppkey % 5 = 0),
t AS (SELECT frn, is_dir, 'D:\' || name AS path FROM recs WHERE parent_frn = 5 UNION ALL SELECT r.frn, r.is_dir, t.path || '\' || r.name FROM t JOIN recs r ON r.parent_frn = t.frn WHERE t.is_dir) """


def _overlay(spark, d):
    base = catalog_of(spark, d)
    removed = base.where(F.col("id") % 5 == 1).select(F.upper("path").alias("path"))
    delta = base.where((F.col("id") % 10 == 1) & ~F.col("is_dir")).withColumn("size", F.col("size") + 7).withColumn("id", F.col("id") + 2_000_000_000)
    return base, overlay.Overlay(removed, delta)


OVERLAY = f"""{WITH}, delta AS (SELECT id + 2000000000 AS id, path, is_dir, size + 7 AS size, allocated, mtime, ctime, flags, frn, 0 AS side FROM catalog WHERE id % 10 = 1 AND NOT is_dir),
live AS (SELECT * FROM delta UNION ALL SELECT {', '.join(SHOWN)}, 1 FROM catalog WHERE id % 5 <> 1) """


def _trigram_postings(spark, d):
    return stats.trigram_rows(files_of(spark, d)).groupBy("trigram").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _attribute_lists(spark, d):
    return stats.attribute_lists(catalog_of(spark, d)).groupBy("attribute").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum("id").alias("id_sum"))


def _spilled(spark, d):
    c = files_of(spark, d)
    base = c.select(F.col("id").alias("frn"), "path", "size", "mtime")
    ext = c.where(F.col("id") % 3 == 0).select(F.col("id").alias("frn"), (F.col("size") * 2).alias("size"), F.when(F.col("id") % 2 == 0, F.col("ctime")).alias("mtime"))
    return tree.spilled_metadata(base, ext, ["size", "mtime"])


def _scalars(spark, d):
    c = files_of(spark, d)
    return c.select(
        "id", paths.basename("path").alias("name"), paths.dirname("path").alias("dir"), paths.lower_reversed(paths.basename("path")).alias("rev"),
        paths.filetime_to_unix((F.col("mtime") + paths.FILETIME_EPOCH) * 10_000_000 + 5).alias("unix"), paths.masked_frn(F.col("frn") + F.lit(1 << 50)).alias("frn"),
        F.coalesce(paths.rewrite_prefix(F.col("path"), "d:\\CORPUS\\en", "E:\\moved"), F.lit("-")).alias("moved"), paths.depth_below(F.col("path"), "D:").cast("int").alias("depth"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.matching(catalog_of(spark, sf_dir), "ext:rs size:>1kb !hidden:true", CLOCK)
    return search.page(found, 10, "size", True).select("id", *C.HIT)


_EVENTS = r"""e AS (SELECT event_id AS usn, user_id AS frn, event_type, CASE event_type WHEN 'signup' THEN 256 WHEN 'error' THEN 512 WHEN 'purchase' THEN 8192 WHEN 'click' THEN 32768 ELSE 2 END AS reason FROM events)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"flagship": flagship}
    out |= {k: _found(text) for k, (text, _) in _FOUND.items()}
    out |= {k: _page(*spec[:4]) for k, spec in _PAGES.items()}
    return out | {
        "total_count": _total, "subtree_boundary": _subtree,
        "path_lookup": lambda s, d: shown(search.find_path(catalog_of(s, d), r"d:\CORPUS\en")),
        "frn_lookup": lambda s, d: shown(search.find_frn(catalog_of(s, d), 8, "d")),
        "du_total": _du_total, "du_children": _du_children, "du_depth2_top": _du_top, "du_by_allocated": _du_allocated, "du_hardlink_dedup": _du_dedup, "du_pages": _du_pages,
        "dupes_groups": _dupe_groups, "dupes_ranked": _dupe_ranked, "dupes_summary": _dupe_summary,
        "tree_paths": lambda s, d: tree.build(tree_records(s, d)).select("frn", "path"),
        "resolve_path": lambda s, d: tree.resolve(tree_records(s, d), tree_records(s, d).where("frn % 3 = 0")).select("frn", "path"),
        "tree_orphans": lambda s, d: tree.orphans(tree_records(s, d), tree.build(tree_records(s, d))).select("frn", "name"),
        "overlay_union": lambda s, d: shown(overlay.live(*_overlay(s, d)), "side"),
        "overlay_topn": lambda s, d: shown(overlay.page(*_overlay(s, d), "type:file", 25, "size", True)[1]),
        "overlay_page": lambda s, d: shown(overlay.page(*_overlay(s, d), "ext:md", 12)[1]),
        "overlay_total": lambda s, d: overlay.page(*_overlay(s, d), "ext:md", 1)[0].agg(F.count("*").alias("total")),
        "journal_mask": lambda s, d: journal.masked(journal.of_events(s, d), journal.REFRESH).select("usn", "frn", "reason"),
        "journal_latest_per_frn": lambda s, d: journal.latest(journal.of_events(s, d), ["frn"]).select("frn", "usn", "reason"),
        "journal_refresh_once": lambda s, d: journal.refresh_once(journal.of_events(s, d)).select("frn", "usn"),
        "rename_subtree": lambda s, d: journal.moved_subtree(catalog_of(s, d), "D:\\corpus\\en\\src1", "D:\\moved").select("id", "path"),
        "trigram_postings": _trigram_postings, "stats": lambda s, d: stats.counts(catalog_of(s, d)), "attr_lists": _attribute_lists, "spilled_meta_join": _spilled,
        "scalar_functions": _scalars,
    }


def _ancestor_sql(source: str, root: str) -> str:
    return f"""up AS (SELECT array_to_string(p[1:k], '\\') AS path, size, allocated FROM (SELECT string_split(path, '\\') AS p, size, allocated, unnest(range(1, len(string_split(path, '\\')))) AS k FROM {source})),
    kids AS (SELECT path, CAST(sum(size) AS BIGINT) AS size, CAST(sum(allocated) AS BIGINT) AS allocated, count(*) AS files,
      CAST(length(path) - length(replace(path, '\\', '')) - {root.count(chr(92))} AS INTEGER) AS depth FROM up WHERE starts_with(path, '{root}' || '\\') GROUP BY path)"""


def oracle_sql() -> dict[str, str]:
    rs = "name_l LIKE '%.rs' AND size >= 1024"
    unique = r"uniq AS (SELECT id, path, size, allocated FROM (SELECT *, row_number() OVER (PARTITION BY frn ORDER BY id) AS r FROM catalog WHERE NOT is_dir AND starts_with(path, '{}' || '\')) WHERE r = 1)"
    at = lambda root: unique.format(root)
    out = {"flagship": f"{WITH} SELECT id, path, is_dir, size, allocated, mtime, ctime, flags FROM c WHERE {rs} AND flags & 1 = 0 ORDER BY size DESC, path LIMIT 10"}
    out |= {k: f"{WITH} SELECT {COLS} FROM c WHERE {where}" for k, (_, where) in _FOUND.items()}
    out |= {k: f"{WITH} SELECT {COLS} FROM c WHERE {_WHERE[q]} ORDER BY {by} LIMIT {n}" for k, (q, _, _, n, by) in _PAGES.items()}
    twins = "twin AS (SELECT n_chars AS size, md5(text) AS h, count(*) AS n, min(path) AS first_path FROM documents JOIN files ON id = doc_id WHERE n_chars >= 100 GROUP BY 1, 2 HAVING count(*) > 1)"
    return out | {
        "total_count": f"{WITH} SELECT count(*) AS total FROM c WHERE {rs}",
        "subtree_boundary": rf"{WITH} SELECT {COLS} FROM c WHERE path_ci = 'd:\corpus\en\src1' OR starts_with(path_ci, 'd:\corpus\en\src1\')",
        "path_lookup": rf"{WITH} SELECT {COLS} FROM c WHERE path_ci = 'd:\corpus\en'",
        "frn_lookup": f"{WITH} SELECT {COLS} FROM c WHERE frn = 8",
        "du_total": rf"""{WITH}, {at(ROOT)} SELECT CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(allocated) AS BIGINT) AS total_allocated, count(*) AS files,
            (SELECT count(*) FROM c WHERE is_dir AND starts_with(path, '{ROOT}\')) AS dirs, (SELECT count(*) FROM c WHERE path = '{ROOT}' OR starts_with(path, '{ROOT}\')) AS entries FROM uniq""",
        "du_children": f"{WITH}, {at('D:')}, {_ancestor_sql('uniq', 'D:')} SELECT * FROM kids",
        "du_depth2_top": f"{WITH}, {at('D:' + chr(92) + 'corpus')}, {_ancestor_sql('uniq', 'D:' + chr(92) + 'corpus')} SELECT * FROM kids WHERE depth <= 2 ORDER BY size DESC, path LIMIT 7",
        "du_by_allocated": f"{WITH}, {at('D:' + chr(92) + 'corpus')}, {_ancestor_sql('uniq', 'D:' + chr(92) + 'corpus')} SELECT * FROM kids ORDER BY allocated DESC, path LIMIT 9",
        "du_hardlink_dedup": f"{WITH}, {at('D:')} SELECT * FROM uniq",
        "du_pages": r"""WITH f AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') || '/page' || page_id AS path, length(html) AS size FROM pages),
            up AS (SELECT array_to_string(p[1:k], '/') AS path, size FROM (SELECT string_split(path, '/') AS p, size, unnest(range(1, len(string_split(path, '/')))) AS k FROM f))
            SELECT path, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM up GROUP BY path""",
        "dupes_groups": f"WITH {FILES}, {twins} SELECT path, files.size FROM files JOIN documents ON id = doc_id JOIN twin ON n_chars = twin.size AND md5(text) = h",
        "dupes_ranked": f"WITH {FILES}, {twins} SELECT size, n AS files, first_path, size * (n - 1) AS wasted FROM twin ORDER BY wasted DESC, size DESC, first_path LIMIT 10",
        "dupes_summary": f"""WITH {FILES}, {twins} SELECT count(*) AS groups, CAST(sum(size * (n - 1)) AS BIGINT) AS wasted_bytes,
            (SELECT CAST(sum(m) AS BIGINT) FROM (SELECT count(*) AS m FROM files WHERE size >= 100 GROUP BY size HAVING count(*) > 1)) AS files_hashed, CAST(0 AS BIGINT) AS skipped FROM twin""",
        "tree_paths": TREE_SQL + "SELECT frn, path FROM t",
        "resolve_path": TREE_SQL + "SELECT frn, path FROM t WHERE frn % 3 = 0",
        "tree_orphans": TREE_SQL + "SELECT frn, name FROM recs WHERE frn NOT IN (SELECT frn FROM t)",
        "overlay_union": OVERLAY + f"SELECT {COLS}, side FROM live",
        "overlay_topn": OVERLAY + f"SELECT {COLS} FROM live WHERE NOT is_dir ORDER BY size DESC, path LIMIT 25",
        "overlay_page": OVERLAY + f"SELECT {COLS} FROM live WHERE lower(path) LIKE '%.md' ORDER BY side, id LIMIT 12",
        "overlay_total": OVERLAY + "SELECT count(*) AS total FROM live WHERE lower(path) LIKE '%.md'",
        "journal_mask": f"WITH {_EVENTS} SELECT usn, frn, CAST(reason AS BIGINT) AS reason FROM e WHERE event_type IN ('click', 'view')",
        "journal_latest_per_frn": f"WITH {_EVENTS} SELECT frn, max(usn) AS usn, CAST(max_by(reason, usn) AS BIGINT) AS reason FROM e GROUP BY frn",
        "journal_refresh_once": f"WITH {_EVENTS} SELECT frn, min(usn) AS usn FROM e WHERE event_type IN ('click', 'view') GROUP BY frn",
        "rename_subtree": rf"{WITH} SELECT id, 'D:\moved' || substr(path, 18) AS path FROM c WHERE starts_with(path_ci, 'd:\corpus\en\src1\')",
        "trigram_postings": r"""WITH f AS (SELECT doc_id AS id, 'doc' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'rs' WHEN 3 THEN 'log' ELSE 'txt' END AS n FROM documents),
            t AS (SELECT DISTINCT id, substr(n, k, 3) AS trigram FROM (SELECT id, n, unnest(range(1, length(n) - 1)) AS k FROM f)) SELECT trigram, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM t GROUP BY trigram""",
        "stats": f"""{WITH} SELECT count(*) AS entries, count(*) FILTER (is_dir) AS dirs, count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (flags & 1 <> 0) AS hidden, count(*) FILTER (flags & 2 <> 0) AS system,
            count(*) FILTER (flags & 4 <> 0) AS readonly, count(*) FILTER (flags & 8 <> 0) AS reparse FROM c""",
        "attr_lists": f"""{WITH}, l AS (SELECT id, unnest([CASE WHEN is_dir THEN 'dir' ELSE 'file' END, CASE WHEN flags & 1 <> 0 THEN 'hidden' END, CASE WHEN flags & 2 <> 0 THEN 'system' END,
            CASE WHEN flags & 4 <> 0 THEN 'readonly' END, CASE WHEN flags & 8 <> 0 THEN 'reparse' END]) AS attribute FROM c)
            SELECT attribute, count(*) AS n, min(id) AS first_id, CAST(sum(id) AS BIGINT) AS id_sum FROM l WHERE attribute IS NOT NULL GROUP BY attribute""",
        "spilled_meta_join": f"""WITH {FILES} SELECT id AS frn, path, CASE WHEN id % 3 = 0 THEN size * 2 ELSE size END AS size, CASE WHEN id % 6 = 0 THEN ctime ELSE mtime END AS mtime FROM files""",
        "scalar_functions": rf"""WITH {FILES} SELECT id, regexp_extract(path, '[^\\/]*$') AS name, regexp_replace(path, '[\\/][^\\/]*$', '') AS dir, reverse(lower(regexp_extract(path, '[^\\/]*$'))) AS rev,
            mtime AS unix, frn,
            CASE WHEN starts_with(path, 'D:\corpus\en\') THEN 'E:\moved' || substr(path, 13) ELSE '-' END AS moved, CAST(length(path) - length(replace(path, '\', '')) AS INTEGER) AS depth FROM files""",
    }
