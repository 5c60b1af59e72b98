"""Journal batches over the given tables, with SQL.

Nations are directories, their suppliers files in them. The batch creates a file for each customer,
deletes every tenth supplier and, in between, hands each nation's name on to the next by way of a
third name, so that every name in the catalogue is used again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.catalog import normalise
from quillon.streaming import journal as J

#: First record numbers of directories, suppliers and customers; first usn of the two renames and of what follows.
DIR, SUPPLIER, CUSTOMER = 1000, 100_000, 10_000_000
AWAY, ON, LATER = 1_000_000_000, 2_000_000_000, 3_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event(df: DataFrame, frn, parent, name, is_dir: bool, usn, reason: int) -> DataFrame:
    return df.select(F.lit("D").alias("drive"), frn.cast("long").alias("frn"), parent.cast("long").alias("parent_frn"), name.alias("name"), F.lit(is_dir).alias("is_dir"), usn.cast("long").alias("usn"), F.lit(reason).cast("long").alias("reason"))


def batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue before the batch, its events and the state of the file system after it."""
    nation, supplier, customer = (_table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    n, s, c = F.col("n_nationkey"), F.col("s_suppkey"), F.col("c_custkey")
    name, inside = lambda k: F.concat(F.lit("n"), k.cast("string")), lambda k, x, i: F.concat(F.lit("D:\\n"), k.cast("string"), F.lit("\\" + x), i.cast("string"))
    following = lambda k: (k + 1) % 25
    entry = lambda df, i, path, is_dir, size, frn: df.select(i.cast("long").alias("id"), path.alias("path"), F.lit(is_dir).alias("is_dir"), size.cast("long").alias("size"), frn.cast("long").alias("frn"))
    live = normalise(entry(nation, n, F.concat(F.lit("D:\\"), name(n)), True, F.lit(0), n + DIR).union(entry(supplier, s + 25, inside(F.col("s_nationkey"), "s", s), False, s, s + SUPPLIER)))
    root, own, third = F.lit(5), n + DIR, F.concat(F.lit("t"), n.cast("string"))
    parent, file = F.col("c_nationkey") + DIR, F.concat(F.lit("c"), c.cast("string"))
    events = [
        _event(customer, c + CUSTOMER, parent, file, False, c + F.when(c % 2 == 0, 0).otherwise(LATER), J.FILE_CREATE),
        _event(nation, own, root, name(n), True, n * 4 + AWAY, J.RENAME_OLD), _event(nation, own, root, third, True, n * 4 + AWAY + 1, J.RENAME_NEW),
        _event(nation, own, root, third, True, n * 4 + ON, J.RENAME_OLD), _event(nation, own, root, name(following(n)), True, n * 4 + ON + 1, J.RENAME_NEW),
        _event(supplier.where(s % 10 == 0), s + SUPPLIER, F.col("s_nationkey") + DIR, F.concat(F.lit("s"), s.cast("string")), False, s + 2 * LATER, J.FILE_DELETE),
    ]
    every = events[0]
    for e in events[1:]:
        every = every.union(e)
    there = lambda df, path, size: df.select(path.alias("path"), F.lit("ok").alias("status"), size.cast("long").alias("size"), size.cast("long").alias("allocated"), F.lit(1).cast("long").alias("mtime"), F.lit(1).cast("long").alias("ctime"), F.lit(0).alias("flags"))
    state = there(nation, F.concat(F.lit("D:\\"), name(n)), F.lit(0)).union(there(supplier.where(s % 10 != 0), inside(following(F.col("s_nationkey")), "s", s), s)).union(
        there(customer.where(c % 7 != 0), inside(following(F.col("c_nationkey")), "c", c), c))
    return live, every, state


def apply_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after the batch."""
    live, events, state = batch(spark, sf_dir)
    return J.apply(live, events, state, spark.createDataFrame([], "drive string, frn long, old string")).live.select("path", "is_dir", "size", "frn")


def name_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From where to where each name of the batch stood; -1: to the end."""
    return J.names(batch(spark, sf_dir)[1]).drop("reason").withColumn("to_usn", F.coalesce("to_usn", F.lit(-1).cast("long")))


def paths_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each event's name stood at that moment."""
    live, events, _ = batch(spark, sf_dir)
    return J.as_of(events, J.names(events), J.directories(live)).select("usn", "frn", "path_then")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"journal_apply_rotation": apply_rotation, "journal_name_spans": name_spans, "journal_paths_as_of": paths_as_of}


def oracle_sql() -> dict[str, str]:
    on = lambda t, k: rf"'D:\n' || ((t.{t}_nationkey + 1) % 25) || '\{t}' || t.{k}"
    return {
        "journal_apply_rotation": rf"""SELECT 'D:\n' || ((n_nationkey + 1) % 25) AS path, true AS is_dir, CAST(0 AS BIGINT) AS size, CAST(n_nationkey + {DIR} AS BIGINT) AS frn FROM nation
            UNION ALL SELECT {on("s", "s_suppkey")}, false, CAST(s_suppkey AS BIGINT), CAST(s_suppkey + {SUPPLIER} AS BIGINT) FROM supplier t WHERE s_suppkey % 10 <> 0
            UNION ALL SELECT {on("c", "c_custkey")}, false, CAST(c_custkey AS BIGINT), CAST(c_custkey + {CUSTOMER} AS BIGINT) FROM customer t WHERE c_custkey % 7 <> 0""",
        "journal_name_spans": f"""SELECT 'D' AS drive, CAST(c_custkey + {CUSTOMER} AS BIGINT) AS frn, CAST(c_nationkey + {DIR} AS BIGINT) AS parent_frn, 'c' || c_custkey AS name, false AS is_dir,
              CAST(c_custkey + (c_custkey % 2) * {LATER} AS BIGINT) AS from_usn, CAST(-1 AS BIGINT) AS to_usn FROM customer
            UNION ALL SELECT 'D', n_nationkey + {DIR}, 5, 't' || n_nationkey, true, n_nationkey * 4 + {AWAY + 1}, n_nationkey * 4 + {ON} FROM nation
            UNION ALL SELECT 'D', n_nationkey + {DIR}, 5, 'n' || ((n_nationkey + 1) % 25), true, n_nationkey * 4 + {ON + 1}, -1 FROM nation""",
        "journal_paths_as_of": rf"""SELECT CAST(c_custkey + (c_custkey % 2) * {LATER} AS BIGINT) AS usn, CAST(c_custkey + {CUSTOMER} AS BIGINT) AS frn,
              'D:\n' || ((c_nationkey + c_custkey % 2) % 25) || '\c' || c_custkey AS path_then FROM customer
            UNION ALL SELECT CAST(s_suppkey + {2 * LATER} AS BIGINT), s_suppkey + {SUPPLIER}, {on("s", "s_suppkey")} FROM supplier t WHERE s_suppkey % 10 = 0
            UNION ALL SELECT CAST(n_nationkey * 4 + x AS BIGINT), n_nationkey + {DIR}, 'D:\' || CASE x WHEN {AWAY} THEN 'n' || n_nationkey WHEN {ON + 1} THEN 'n' || ((n_nationkey + 1) % 25) ELSE 't' || n_nationkey END
              FROM nation, (VALUES ({AWAY}), ({AWAY + 1}), ({ON}), ({ON + 1})) v(x)""",
    }
