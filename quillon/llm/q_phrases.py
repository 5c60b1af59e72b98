"""Query op12: collocations of all documents by language, with the same in SQL."""

from quillon.llm import phrases
from quillon.llm.common import table


def op12_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


_RUNS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM piece)" for k in range(1, phrases.LONGEST + 1))
SQL = {"op12_collocations": rf"""
WITH d AS (SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({_RUNS}) GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {phrases.LEAST}),
covered AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN (SELECT lang, a, m, unnest(range(1, k - m + 2)) AS i, w FROM c, range(2, {phrases.LONGEST}) t(m) WHERE m < k) o
            ON s.lang = o.lang AND s.phrase = array_to_string(list_slice(o.w, o.i, o.i + o.m - 1), ' ') AND 100 * o.a >= 100 * s.a),
cut AS (SELECT c.*, n, x FROM c JOIN n USING (lang), range(1, {phrases.LONGEST}) t(x) WHERE x < k AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM covered)),
s AS (SELECT cut.lang, cut.phrase, a, n, x, l.f AS l, r.f AS r, (1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score FROM cut
      JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(list_slice(w, 1, x), ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(list_slice(w, x + 1, cut.k), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= {phrases.TOP}"""}
QUERIES = {"op12_collocations": op12_collocations}
