"""Query op4: documents mixed so that a source's weight is its characters to the power 0.7."""

from pyspark.sql import functions as F

from quillon.llm import mixing as M
from quillon.llm.common import table


def op4_poisson_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return M.mix(docs.withColumn("units", size), F.col("units")).select("doc_id", "source", "copy", "mix_key")


def _hash(parts: str) -> str:
    return f"CAST('0x' || substr(md5({parts}), 1, 13) AS BIGINT)"


_KEY = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
SQL = {"op4_poisson_mix": f"""
WITH RECURSIVE d AS (SELECT *, coalesce(source, chr(1)) AS s FROM documents),
u AS (SELECT s, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS units FROM d GROUP BY s),
w AS (SELECT s, units, CASE WHEN units > 0 THEN pow(units, {M.POWER}) ELSE 0.0 END AS weight FROM u),
r AS (SELECT s, CASE WHEN units > 0 THEN (SELECT sum(units) FROM w) * weight / (SELECT sum(weight) FROM w) / units ELSE 0.0 END AS m FROM w),
n AS (SELECT s, greatest(1, ceil(m / {M.MAX_MEAN})) AS parts, m / greatest(1, ceil(m / {M.MAX_MEAN})) AS c FROM r),
t AS (SELECT s, c, 0 AS k, exp(-c) AS p, exp(-c) AS f FROM n
      UNION ALL SELECT s, c, k + 1, p * c / (k + 1), f + p * c / (k + 1) FROM t WHERE k < {M.TERMS}),
x AS (SELECT doc_id, s, source, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS i, row_number() OVER () AS rid FROM d JOIN n USING (s)),
y AS (SELECT rid, any_value(x.doc_id) AS doc_id, any_value(x.source) AS source, count(t.k) AS m FROM x
      LEFT JOIN t ON t.s = x.s AND t.f < ({_hash(f"'17|' || i || '|' || {_KEY}")} + 0.5) / 4503599627370496 GROUP BY rid),
z AS (SELECT doc_id, source, CAST(unnest(range(1, m + 1)) AS INTEGER) AS copy FROM y)
SELECT doc_id, source, copy, {_hash(f"'17|order|' || {_KEY} || '|' || copy")} AS mix_key FROM z"""}
QUERIES = {"op4_poisson_mix": op4_poisson_mix}
