"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson number of times. The mean is its source's target rate; the
number comes from inverting that distribution at a hash of seed and id, so any machine that
computes it again gets the same. Copies are then spread by a hash of id and copy number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, join_small, keeps_names, public

#: A larger mean is drawn as a sum of equal means of at most this (a sum of Poisson draws is Poisson).
MAX_MEAN = 32
#: Terms of a distribution function; for means to MAX_MEAN the rest is below 2**-53.
TERMS = 128
#: Weight of a source: its share of the corpus to this power, so that small sources gain.
POWER = 0.7
NO_SOURCE = "\u0000"


def power_weights(units: DataFrame, power: float = POWER) -> DataFrame:
    """(source, units) -> (source, units, weight): units ** power, for sources that have any."""
    return units.withColumn("weight", F.when(F.col("units") > 0, F.pow("units", F.lit(power))).otherwise(0.0))


def _source(source: str) -> Column:
    return F.coalesce(F.col(source), F.lit(NO_SOURCE))


def rates(df: DataFrame, size: Column, source: str, weights: dict | None = None, total: float | None = None) -> DataFrame:
    """Per _source: _mean, the target rate, with _parts and _cdf to draw from it.

    The rate is total * weight / units: the expected units of a source are its share of
    ``total`` (default: what the corpus has). Sources that ``weights`` does not name get none.
    """
    units = durable(df.groupBy(_source(source).alias("_source")).agg(F.sum(size).cast("double").alias("units")), "mix-units")
    if weights is None:
        weighed = power_weights(units)
    else:
        given = [(NO_SOURCE if k is None else k, float(v)) for k, v in weights.items()]
        spark = df.sparkSession
        weighed = units.join(spark.createDataFrame(given, "_source string, weight double"), "_source")
    sums = weighed.agg(F.sum("units"), F.sum("weight")).first()
    total = float(sums[0] or 0) if total is None else float(total)
    all_weight = float(sums[1] or 0)
    mean = F.when((F.col("units") > 0) & (F.col("weight") > 0), F.lit(total) * F.col("weight") / F.lit(all_weight or 1.0) / F.col("units")).otherwise(0.0)
    out = weighed.select("_source", mean.alias("_mean"))
    out = out.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_mean") / MAX_MEAN)).cast("int"))
    part = F.col("_mean") / F.col("_parts")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("c")),
        lambda s, k: F.struct((s["p"] * part / k).alias("p"), F.array_append(s["c"], F.element_at(s["c"], -1) + s["p"] * part / k).alias("c")),
    )
    return durable(out.withColumn("_cdf", steps["c"]), "mix-rates")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the parts."""
    return (hash52(*parts).cast("double") + 0.5) / float(1 << 52)


def hash52(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


@keeps_names
def mix(df: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: dict | None = None,
        total: float | None = None, seed: int = 17) -> DataFrame:
    """All columns of ``df`` with copy (1..n) and mix_key, n Poisson; partitions are a random split.

    A null source is a source of its own; a null key hashes as such. Rows that share a key share
    their count and places. A source with no units or weight gives no rows, and neither does a
    document whose count is 0. An empty table gives no rows. Columns copy and mix_key are replaced.
    """
    df = public(df, "copy", "mix_key")
    drawn = join_small(df.withColumn("_source", _source(source)), rates(df, size, source, weights, total), ["_source"])
    # the array of one hash binds it once for all comparisons
    draw = lambda i: F.get(F.transform(F.array(uniform(F.lit(seed), i, F.col(key))), lambda u: F.size(F.filter("_cdf", lambda c: c < u))), 0)
    count = F.when(F.col("_parts") == 1, draw(F.lit(1))).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda s, i: s + draw(i)))
    some = drawn.withColumn("_count", count).where("_count > 0").drop("_source", "_mean", "_parts", "_cdf")
    copies = some.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count")))).drop("_count")
    keyed = copies.withColumn("mix_key", hash52(F.lit(seed), F.lit("order"), F.col(key), F.col("copy")))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "mix_key").sortWithinPartitions("mix_key", key, "copy")
