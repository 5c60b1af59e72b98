import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quillon.functions import globs
from quillon.operators.query import Clock, QueryError, parse, parse_bytes, parse_date, parse_size
from quillon.operators.search import matching, page, parse_flag, parse_sort
from quillon.sources.catalog import normalise

NOW = 1_700_000_000
CLOCK = Clock(NOW)
MB = 1 << 20


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (0, r"D:\docs\年度报告.md", 100, NOW, 0, None, False), (1, r"D:\docs\readme.txt", 500, NOW - 10_000_000, 0, None, False),
        (2, r"D:\proj\src\main.rs", 2 * MB, NOW, 0, 42, False), (3, r"D:\proj\src\lib.rs", 3 * MB, NOW - 100, 1, None, False),
        (4, r"D:\media\rs.jpg", 9 * MB, NOW, 0, None, False), (5, r"D:\media\sub", 0, NOW, 0, None, True),
    ]
    df = spark.createDataFrame(rows, "id long, path string, size long, mtime long, flags int, frn long, is_dir boolean")
    return normalise(df.withColumn("ctime", F.lit(NOW))).cache()


def ids(df, q):
    return sorted(r.id for r in matching(df, q, CLOCK).select("id").collect())


@pytest.mark.parametrize(("q", "want"), [
    ("", [0, 1, 2, 3, 4, 5]), ("lib.rs", [3]), (r"regex:^main\.rs$", [2]), (r"regex:^.*\.rs$", [2, 3]), ("ext:rs !regex:lib", [2]),
    ("报告", [0]), ("*.rs", [2, 3]), ("rs", [2, 3, 4]), ("size:>1mb", [2, 3, 4]), ("size:<1kb", [0, 1, 5]), ("size:2mb-4mb", [2, 3]), ("size:500", [1]),
    ("hidden:true", [3]), ("!hidden:1", [0, 1, 2, 4, 5]), ("type:folder", [5]), (r"parent:d:\pro", [2, 3]), ("skip:src", [0, 1, 4, 5]), (r"!skip:proj\src", [0, 1, 4, 5]),
    ("skip:sr", [0, 1, 2, 3, 4, 5]), ("dm:today", [0, 2, 3, 4, 5]), ("dm:thisweek", [0, 2, 3, 4, 5]), (r"src\ma", [2]), (r"d:\*\m?in.rs", [2]), ("ma*.rs", [2]),
    ("报???", []), ("报??????.md", []), ("年度???报???.md", []), ("年???报???.md", []), ("年???报?????????", []), ("size:4mb-2mb", []), ("RS ext:JPG", [4]), ("! ext:md", [0]),
])
def test_filters(table, q, want):
    got = ids(table, q)
    if "?" in q and "报" in q or "年" in q:  # byte-wise ?: compare with the definition
        names = {0: "年度报告.md", 1: "readme.txt", 2: "main.rs", 3: "lib.rs", 4: "rs.jpg", 5: "sub"}
        want = [k for k, n in names.items() if by_definition(q, n)]
    assert got == want


def by_definition(pattern: str, name: str) -> bool:
    p, s = ("*" + pattern).encode(), name.encode()

    @lru_cache(None)
    def go(i, j):
        if i == len(p):
            return j == len(s)
        if p[i : i + 1] == b"*":
            return go(i + 1, j) or (j < len(s) and go(i, j + 1))
        return j < len(s) and (p[i : i + 1] == b"?" or p[i] == s[j]) and go(i + 1, j + 1)

    head = pattern.replace("?", "*").split("*")[0].encode()
    return go(0, 0) and (len(head) < 2 or s.startswith(head))


def test_globs_against_definition(spark):
    r = random.Random(5)
    hays = sorted({"".join(r.choice("ab") for _ in range(r.randrange(14))) for _ in range(300)} | {"é", "aé", "éb", "报告"})
    patterns = {"".join(r.choice("ab?*") for _ in range(r.randrange(1, 9))) for _ in range(150)} | {"é?", "?é", "??", "报???", "报?", "*é*b"}
    patterns = sorted(p for p in patterns if globs.has_wildcards(p))
    df = spark.createDataFrame([(h,) for h in hays], "h string")
    got = df.select("h", *[globs.matches(F.col("h"), p, True).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for row in got:
        for k, p in enumerate(patterns):
            assert row[f"p{k}"] == by_definition(p, row.h), (p, row.h)


def test_anchoring_of_long_beginnings(spark):
    df = normalise(spark.createDataFrame([(k, "D:\\p\\" + n) for k, n in enumerate(["foo_bar.rs", "bar_foo.txt", "xabc", "axc", "abc.txt"])], "id long, path string"))
    for q, want in {"*foo*bar*": [0], "a?c": [2, 3], "a*": [0, 1, 2, 3, 4], "ax*": [3], "x*": [1, 2, 3, 4], "*": [0, 1, 2, 3, 4]}.items():
        assert ids(df, q) == want, q


@pytest.mark.parametrize("bad", ["bogus:x", "skip:", "skip:,", "regex:[", "dm:garbage", "size:x", "type:thing", "hidden:maybe", "ext:.", "dm:2026-02-30"])
def test_rejected(bad):
    with pytest.raises(QueryError):
        parse(bad, CLOCK)


def test_sizes_and_dates():
    assert (parse_bytes("1kb"), parse_bytes("1MB"), parse_bytes("2gb"), parse_bytes("7")) == (1024, MB, 2 << 30, 7)
    assert parse_bytes("99999999999999999999") == (1 << 63) - 1
    assert parse_size(">1mb") == (MB, None) and parse_size("1kb-2kb") == (1024, 2048) and parse_size("5") == (5, 6)
    day = 86_400
    assert parse_date("2026-01-01..2026-01-31", CLOCK) == (1_767_225_600, 1_767_225_600 + 31 * day)
    assert parse_date(">2026-01-01", CLOCK) == (1_767_225_600, None) and parse_date("<2026-01-01", CLOCK) == (None, 1_767_225_600)
    assert parse_date("thismonth", CLOCK) == (NOW - 30 * day, None)
    tokyo = Clock(NOW, "Asia/Tokyo")
    assert tokyo.midnight(tokyo.today()) % day == 15 * 3600
    assert Clock(NOW, "America/Sao_Paulo").midnight(__import__("datetime").date(2018, 11, 4)) == 0  # no such midnight


def test_parsing_rules():
    q = parse("!!x skip:a,b ! foo", CLOCK)
    assert [t.value for t in q.include] == ["foo"] and [(t.kind, t.value) for t in q.exclude] == [("name", "!x"), ("skip", ("a", "b"))]
    assert parse(r"D:\x", CLOCK).include[0].kind == "path" and parse(r"name:a\b", CLOCK).include[0].kind == "path"


def test_order(spark):
    rows = [(0, r"D:\docs\readme.txt", 500, 30, False), (1, r"D:\docs\annual.md", 500, 10, False), (2, r"D:\proj\main.rs", 900, 20, False), (3, r"D:\proj\src", 0, 99, True),
            (4, r"D:\media\zz.bin", 900, 5, False), (5, r"D:\a.txt", 100, 40, False), (6, r"D:\media\sub", 0, 1, True)]
    df = normalise(spark.createDataFrame(rows, "id long, path string, size long, mtime long, is_dir boolean"))
    found = matching(df, "", CLOCK)
    for key in ("name", "path", "size", "allocated", "mtime", "ctime"):
        get = {"name": lambda r: r[1].rsplit("\\", 1)[1].lower(), "path": lambda r: r[1].lower(), "size": lambda r: r[2], "allocated": lambda r: r[2], "mtime": lambda r: r[3], "ctime": lambda r: 0}[key]
        for desc in (False, True):
            by_path = sorted(rows, key=lambda r: r[1])
            want = [r[0] for r in sorted(by_path, key=get, reverse=desc)]
            if desc:  # a stable sort in reverse keeps the order of equals
                want = [r[0] for r in sorted(by_path, key=get, reverse=True)]
            for n in (0, 1, 3, 7, 50):
                assert [r.id for r in page(found, n, key, desc).collect()] == want[:n]
    assert [r.id for r in page(found, 3).collect()] == [0, 1, 2]
    assert parse_sort(" SIZE ") == "size" and parse_sort("") is None and parse_flag("on") and not parse_flag(None)
    for bad in ("sizes", "id"):
        with pytest.raises(QueryError):
            parse_sort(bad)
    with pytest.raises(QueryError):
        parse_flag("TRUE")
