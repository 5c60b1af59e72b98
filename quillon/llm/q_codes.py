"""Query op11: product codes of all embeddings, with the same in SQL."""

from pyspark.sql import functions as F

from quillon.llm import codes
from quillon.llm.common import durable, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2


def op11_heap_lloyd(spark, sf_dir):
    rows, books = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), parts=PARTS, entries=ENTRIES, rounds=ROUNDS)
    out = codes.with_label_errors(durable(rows, "codes-rows"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps, book = [], "b0"
    for k in range(ROUNDS + 1):
        steps.append(f"""m{k} AS (SELECT r, q, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + e) AS m FROM p JOIN {book} b USING (q) GROUP BY r, q),
a{k} AS (SELECT r, q, CAST(m % {ENTRIES} AS BIGINT) AS e, CAST(m // {ENTRIES} AS BIGINT) AS d FROM m{k})""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT q, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT q, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM p JOIN a{k} USING (r, q)) GROUP BY q, e, i),
u{k} AS (SELECT q, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY q, e),
b{k + 1} AS (SELECT o.q, o.e, coalesce(u.x, o.x) AS x FROM {book} o LEFT JOIN u{k} u ON u.q = o.q AND u.e = o.e)""")
            book = f"b{k + 1}"
    return f"""
WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, q, list_slice(c, q * (len(c) // {PARTS}) + 1, (q + 1) * (len(c) // {PARTS})) AS x FROM v, range({PARTS}) t(q)),
b0 AS (SELECT q, r AS e, x FROM p WHERE r < {ENTRIES}),
{",".join(steps)},
o AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY q) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY q, e, i)) AS digest FROM (SELECT q, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM {book}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM v JOIN o USING (r), h"""


QUERIES = {"op11_heap_lloyd": op11_heap_lloyd}
SQL = {"op11_heap_lloyd": _sql()}
