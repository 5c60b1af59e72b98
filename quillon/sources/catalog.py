"""The catalogue: one row per file-system entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import paths
from quillon.sources.scratch import durable

SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("path", T.StringType(), False), T.StructField("is_dir", T.BooleanType(), False),
    T.StructField("size", T.LongType(), False), T.StructField("allocated", T.LongType(), False), T.StructField("mtime", T.LongType(), False),
    T.StructField("ctime", T.LongType(), False), T.StructField("flags", T.IntegerType(), False), T.StructField("frn", T.LongType(), True),
])
COLUMNS = SCHEMA.names
HIT = ["path", "is_dir", "size", "allocated", "mtime", "ctime", "flags"]


def normalise(df: DataFrame) -> DataFrame:
    """The nine columns with their defaults: sizes and times 0, no flags, a file, no record number.

    A missing allocated size is the logical size; a record number of 0 is none.
    """
    have = set(df.columns)
    default = {"is_dir": F.lit(False), "size": F.lit(0), "mtime": F.lit(0), "ctime": F.lit(0), "flags": F.lit(0), "frn": F.lit(None)}
    out = []
    for f in SCHEMA.fields:
        if f.name == "allocated":
            c = F.coalesce(F.col("allocated"), F.col("size") if "size" in have else F.lit(0)) if "allocated" in have else (F.col("size") if "size" in have else F.lit(0))
        else:
            c = F.col(f.name) if f.name in have else default[f.name]
            c = c if f.name in ("id", "path", "frn") else F.coalesce(c, default[f.name])
        c = F.nullif(c.cast("long"), F.lit(0).cast("long")) if f.name == "frn" else c
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def with_derived(df: DataFrame) -> DataFrame:
    """Add name_l and path_ci unless they are stored."""
    if "name_l" not in df.columns:
        df = df.withColumn("name_l", paths.fold_name(paths.basename("path")))
    return df if "path_ci" in df.columns else df.withColumn("path_ci", paths.fold_path("path"))


def numbered(df: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Dense ids from ``start`` in this order, counted per partition first: no task gets all rows.

    The ranges are written before they are counted, so that both readings see the same ones."""
    ranged = df.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = durable(ranged.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    from pyspark.sql.window import Window

    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + start).alias("_add"))
    return ranged.join(F.broadcast(offsets), "_p").withColumn("id", F.col("_m") + F.col("_add")).drop("_p", "_m", "_add")


def of_documents(spark: SparkSession, sf_dir: str, directories: bool = True) -> DataFrame:
    """A catalogue view of the table of documents: copies of a text are hard links of one file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    d, n = F.col("doc_id"), F.col("n_chars")
    # documents without text are one group, as nulls are in SQL; no hash is empty
    docs = docs.withColumn("_text", F.coalesce(F.sha2("text", 256), F.lit(""))).drop("text")
    links = docs.groupBy("_text").agg((F.min("doc_id") + 1).alias("frn"))
    ext = F.element_at(F.array(*map(F.lit, ["txt", "md", "rs", "log", "TXT"])), (d % 5 + 1).cast("int"))
    path = F.concat(F.lit("D:\\corpus\\"), "lang", F.lit("\\"), "source", F.lit("\\Doc"), d.cast("string"), F.lit("."), ext)
    flags = sum([F.when(d % p == 0, bit).otherwise(0) for p, bit in ((11, 2), (13, 4), (17, 8))], F.when(d % 7 == 0, 1).otherwise(0))
    mtime = F.lit(1_700_000_000) + (d * 7919) % 2_592_000
    files = docs.join(links, "_text").select(
        d.alias("id"), path.alias("path"), F.lit(False).alias("is_dir"), n.alias("size"),
        F.when(n <= 700, F.lit(0)).otherwise(F.floor((n + 4095) / 4096) * 4096).cast("long").alias("allocated"),
        mtime.alias("mtime"), (mtime - d % 86_400).alias("ctime"), flags.cast("int").alias("flags"), "frn",
    )
    if not directories:
        return normalise(files)
    dirs = files.select(F.explode(paths.ancestors("path")).alias("path")).distinct()
    dirs = numbered(dirs, ["path"], 1_000_000_001).select("id", "path", F.lit(True).alias("is_dir"))
    return normalise(files).unionByName(normalise(dirs))
