"""Query op8: quality rules over all documents, with the same in SQL."""

from quillon.llm import quality as Q
from quillon.llm.common import table


def op8_divergence_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return Q.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _side(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"


def _sql() -> str:
    space, k = r"[^\x20\x09-\x0D]", Q.N_CLASSES
    counts = [f"CAST(length(t) - length(regexp_replace(t, '[{c.replace(chr(39), chr(39) * 2)}]+', '', 'g')) AS BIGINT)" for c in Q.CLASSES.values()]
    cs = ", ".join(f"{c} AS c{i}" for i, c in enumerate(counts))
    blank, rest = (f"c{k - i}" for i in (2, 1))
    few = " - ".join(f"c{i}" for i in range(k - 2))
    others = f"length(t) - wc AS {blank}, wc - {few} AS {rest}"
    size = "length(t)"
    total = " + ".join(f"sum(c{i})" for i in range(k))
    shares = ", ".join(f"sum(c{i}) / ({total}) AS q{i}" for i in range(k))
    char_sum = " + ".join(
        f"({_side(f'(c{i} / {size})', f'q{i}')}) + ({_side(f'q{i}', f'(c{i} / {size})')})" for i in range(k)
    )
    return rf"""
WITH a AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS g,
      regexp_extract_all(coalesce(text, ''), '{space}+') AS words FROM documents),
b AS (SELECT *, {cs}, CAST(length(array_to_string(words, '')) AS BIGINT) AS wc FROM a), c AS (SELECT *, {others}, len(words) AS n FROM b),
tok AS (SELECT rid, g, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM a),
win AS (SELECT rid, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS x FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS m FROM win WHERE x IS NOT NULL) WHERE m > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n_rep FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
lin AS (SELECT rid, count(*) - count(DISTINCT x) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM a)
        WHERE regexp_matches(x, '{space}') GROUP BY rid),
ref AS (SELECT g, sum(n) AS ref_n, {shares} FROM c GROUP BY g),
cnt AS (SELECT g, w, count(*) AS m FROM tok WHERE regexp_matches(w, '{Q.COMMON}') GROUP BY g, w),
top AS (SELECT g, w, m FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m DESC, w) AS r FROM cnt) WHERE r <= {Q.N_COMMON}),
pq AS (SELECT c.rid, c.n, top.w, top.m / ref_n AS q, coalesce(h.k, 0) / c.n AS p, top.m AS m, coalesce(h.k, 0) AS k, ref_n
       FROM c JOIN ref USING (g) JOIN top USING (g)
       LEFT JOIN (SELECT rid, w, count(*) AS k FROM tok GROUP BY rid, w) h ON h.rid = c.rid AND h.w = top.w WHERE c.n > 0),
pw AS (SELECT rid, sum({_side('p', 'q')} + {_side('q', 'p')}) AS s, (any_value(n) - sum(k)) / any_value(n) AS po,
       (any_value(ref_n) - sum(m)) / any_value(ref_n) AS qo FROM pq GROUP BY rid),
d AS (SELECT c.*, n_rep, dup, ref_n, sqrt(greatest(0.0, (s + {_side('po', 'qo')} + {_side('qo', 'po')}) / 2)) AS dw,
      CASE WHEN length(t) > 0 THEN sqrt(greatest(0.0, ({char_sum}) / 2)) END AS dc
      FROM c JOIN ref USING (g) LEFT JOIN cov USING (rid) LEFT JOIN lin USING (rid) LEFT JOIN pw USING (rid)),
e AS (SELECT doc_id, CAST(n AS BIGINT) AS n_words, wc AS word_chars,
      c{list(Q.CLASSES).index('symbol')} AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, dw, dc, ref_n FROM d),
f AS (SELECT *, n_words < {Q.BASE_WORDS} OR 100 * n_repeat_words > {Q.BASE_REPEAT_PERCENT} * n_words AS base_failed FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {Q.MIN_WORDS} AND ref_n >= {Q.MIN_REFERENCE} AND
  (coalesce(dc, 0) > {Q.MAX_CHARS} + {Q.CHARS_SLACK} / sqrt(greatest(n_words, 1)) OR coalesce(dw, 0) > {Q.MAX_WORDS} + {Q.WORDS_SLACK} / sqrt(greatest(n_words, 1)))) AS kept
FROM f"""


QUERIES = {"op8_divergence_rules": op8_divergence_rules}
SQL = {"op8_divergence_rules": _sql()}
