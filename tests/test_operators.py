import pytest
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators import duplicates, overlay, stats, tree, usage
from quillon.operators.query import QueryError
from quillon.sources.catalog import normalise, numbered, of_documents


@pytest.fixture(scope="module")
def small(spark):
    rows = [(r"D:\proj", True, 0, None), (r"D:\proj\src", True, 0, None), (r"D:\proj\src\main.rs", False, 100, 1), (r"D:\proj\src\lib.rs", False, 50, 2),
            (r"D:\proj\alias.rs", False, 100, 1), (r"D:\proj2", True, 0, None), (r"D:\proj2\x.txt", False, 999, 3), (r"D:\proj\sub", True, 0, None)]
    return normalise(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, path string, is_dir boolean, size long, frn long"))


def test_usage(small):
    u = usage.usage(small, "d:\\PROJ\\")
    assert (u.total_bytes, u.files, u.entries, u.dirs, u.truncated) == (150, 2, 6, 2, False)
    assert [(r.path, r.size, r.depth) for r in u.children.collect()] == [(r"D:\proj\src", 150, 1)]
    u = usage.usage(small, "D:\\")
    assert (u.total_bytes, u.files, u.entries, u.dirs) == (1149, 3, 8, 4)
    assert [(r.path, r.size, r.depth) for r in u.children.collect()] == [(r"D:\proj2", 999, 1), (r"D:\proj", 150, 1), (r"D:\proj\src", 150, 2)]
    u = usage.usage(small, "D:\\", depth=1, top=2)
    assert u.truncated and u.children.count() == 2
    u = usage.usage(small, "D:\\", depth=0)
    assert u.children.count() == 0 and not u.truncated
    u = usage.usage(small, r"D:\proj\src\main.rs")
    assert (u.total_bytes, u.files, u.entries) == (100, 1, 1)
    u = usage.usage(small, r"D:\none")
    assert (u.total_bytes, u.files, u.entries, u.dirs) == (0, 0, 0, 0)
    with pytest.raises(QueryError):
        usage.usage(small, " \\")


def test_duplicates(spark):
    data = {"a": b"\7" * 4096, "b": b"\7" * 4096, "c": b"\t" * 4096, "d": b"\7" * 8192}
    c = normalise(spark.createDataFrame([(k, n, len(b)) for k, (n, b) in enumerate(data.items())], "id long, path string, size long"))
    contents = spark.createDataFrame([(n, bytearray(b)) for n, b in data.items()], "path string, content binary")
    assert {r.path for r in duplicates.groups(c, contents).collect()} == {"a", "b"}
    assert duplicates.summary(c, contents).first().asDict() == {"groups": 1, "wasted_bytes": 4096, "files_hashed": 3, "skipped": 0}
    some = contents.where("path <> 'a'")
    assert duplicates.summary(c, some).first().asDict() == {"groups": 0, "wasted_bytes": 0, "files_hashed": 3, "skipped": 1}
    assert duplicates.groups(c, contents, name="A").count() == 0
    assert [r.wasted for r in duplicates.ranked(duplicates.groups(c, contents), 5).collect()] == [4096]


def test_tree(spark):
    rows = [(5, 5, "", True), (10, 5, "dev", True), (11, 10, "main.rs", False), (12, 10, "lib.rs", False), (99, 666, "orphan.bin", False), (21, 22, "a", True), (22, 21, "b", True), (30, 11, "x", False)]
    r = spark.createDataFrame(rows, "frn long, parent_frn long, name string, is_dir boolean")
    built = tree.build(r)
    assert {x.path for x in built.collect()} == {r"D:\dev", r"D:\dev\main.rs", r"D:\dev\lib.rs"}
    assert {x.frn for x in tree.orphans(r, built).collect()} == {99, 21, 22, 30}


def test_a_chain_of_directories_takes_rounds_by_its_logarithm(spark, monkeypatch):
    rounds, write = [], tree.durable
    monkeypatch.setattr(tree, "durable", lambda df, name: rounds.append(name) or write(df, name))
    n = 4000
    chain = spark.range(n).select((F.col("id") + 10).alias("frn"), F.when(F.col("id") == 0, 5).otherwise(F.col("id") + 9).alias("parent_frn"), F.concat(F.lit("d"), "id").alias("name"), F.lit(True).alias("is_dir"))
    loops = spark.createDataFrame([(9001, 9002, "a", True), (9002, 9003, "b", True), (9003, 9001, "c", True), (9004, 9003, "f", False), (9005, 7_777_777, "g", True), (8000, 4009, "deep", False)], "frn long, parent_frn long, name string, is_dir boolean")
    # two ways to a directory: the shorter counts
    twice = spark.createDataFrame([(9100, 10, "z", True), (9100, 11, "a", True), (9101, 9100, "in", False)], loops.schema)
    got = {r.frn: r.path for r in tree.build(chain.union(loops).union(twice).where("frn <> 9100 OR name = 'z'")).collect()}
    deep = "D:" + "".join(f"\\d{k}" for k in range(n))
    assert len(rounds) <= 14 and got[8000] == deep + "\\deep" and got[4009] == deep and len(got) == n + 3 and got[9101] == "D:\\d0\\z\\in"
    every = chain.union(loops).union(twice)
    one = tree.resolve(every, every.where("frn = 9101")).collect()
    assert [r.path for r in one] == ["D:\\d0\\z\\in"]


def test_documents_without_text_stay(spark, tmp_path):
    rows = [(1, "a", 1), (2, None, None), (3, "a", 1), (4, None, None), (5, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'en' AS lang", "'src1' AS source")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.frn for r in of_documents(spark, str(tmp_path), directories=False).collect()}
    assert got == {1: 2, 2: 3, 3: 2, 4: 3, 5: 6}


def test_overlay(spark, small):
    removed = spark.createDataFrame([(r"d:\proj2\X.TXT",), (r"D:\proj\alias.rs",)], "path string")
    delta = spark.createDataFrame([(100, r"D:\proj\alias.rs", 7), (101, r"D:\new.txt", 3)], "id long, path string, size long")
    o = overlay.Overlay(removed, delta)
    found, page = overlay.page(small, o, "type:file", 3)
    assert found.count() == 4 and [r.id for r in page.collect()] == [100, 101, 2]
    _, page = overlay.page(small, o, "type:file", 2, "size", True)
    assert [r.id for r in page.collect()] == [2, 3]
    assert not o.saturated()


def test_trigrams_and_stats(spark):
    names = ["aaaa", "abababa", "abcabc", "x", "bca"]
    c = normalise(spark.createDataFrame([(k, "D:\\" + n) for k, n in enumerate(names)], "id long, path string"))
    assert sorted(tuple(r) for r in stats.trigram_rows(c).collect()) == sorted({(n[i : i + 3], k) for k, n in enumerate(names) for i in range(len(n) - 2)})
    assert stats.counts(c).first().asDict() == {"entries": 5, "dirs": 0, "files": 5, "hidden": 0, "system": 0, "readonly": 0, "reparse": 0}


def test_columns_over_paths(spark):
    df = spark.createDataFrame([("D:\\a/b\\C.txt",), ("plain",), ("",)], "p string")
    r = df.select(paths.basename("p").alias("b"), paths.dirname("p").alias("d"), paths.ancestors("p").alias("a"), paths.rewrite_prefix(F.col("p"), "d:\\A", "E:\\x").alias("m")).collect()
    assert [tuple(x) for x in r] == [("C.txt", "D:\\a/b", ["D:", "D:\\a", "D:\\a/b"], "E:\\x/b\\C.txt"), ("plain", "", [], None), ("", "", [], None)]
    one = spark.range(1).select(
        *[paths.format_bytes(F.lit(n).cast("long")) for n in (0, 1023, 1536, 5 << 30)], paths.filetime_to_unix(F.lit(116444736000000000 + 10_000_000)), paths.filetime_to_unix(F.lit(5).cast("long")),
        paths.masked_frn(F.lit((7 << 48) + 9)), paths.masked_frn(F.lit(7 << 48)), paths.flags_of_attributes(F.lit(0x407))).first()
    assert tuple(one) == ("0 B", "1023 B", "1.50 KB", "5.00 GB", 1, 0, 9, None, 15)


def test_numbered_is_dense(spark):
    df = numbered(spark.range(100).select((F.col("id") * 37 % 101).alias("x")), ["x"], 10)
    assert [r.id for r in df.orderBy("x").collect()] == list(range(10, 110))


def test_spilled_metadata_by_attribute_lists(spark):
    base = spark.createDataFrame([(1, 10, 1), (2, 20, 2), (3, 30, 3)], "frn long, size long, mtime long")
    ext = spark.createDataFrame([(1, 11, None), (50, 99, 7), (60, 98, 8)], "frn long, size long, mtime long")
    lists = spark.createDataFrame([(1, 50), (2, 60), (3, 70)], "frn long, owner long")
    got = tree.spilled_metadata(base, ext, ["size", "mtime"], lists)
    assert sorted(tuple(r) for r in got.select("frn", "size", "mtime").collect()) == [(1, 11, 7), (2, 98, 8), (3, 30, 3)]
