"""DuckDB SQL for the opN queries that SQL can express on whole tables."""

from __future__ import annotations

_FOLD = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = """
WITH e AS (SELECT DISTINCT vec_id, cast(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, max(list_dot_product(a.v, b.v) / (b.n * a.n)) AS score
      FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format(t="text")}, []) AS ws FROM documents),
b AS (SELECT coalesce(cast(item_id AS VARCHAR), '') AS item, {_WORDS.format(t="text")} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least(len(ws), 13) AS n, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) AS k FROM b WHERE len(ws) > 0),
dw AS (SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n),
h AS (SELECT rid, i, dw.n, item FROM dw JOIN w ON w.n = dw.n AND w.k = array_to_string(ws[i:i + dw.n - 1], ' ')),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o,
                  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT rid, o, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT rid, o, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
g AS (SELECT rid, i FROM w QUALIFY min(o) OVER (PARTITION BY k) < o),
x AS (SELECT rid, list(DISTINCT p) AS gone FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM g) GROUP BY rid),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) LEFT JOIN (SELECT rid, unnest(gone) AS p, true AS out FROM x) USING (rid, p) WHERE out IS NULL GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN x USING (rid) LEFT JOIN kept USING (rid)
"""

OP5 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
g AS (SELECT rid, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
r AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM g)),
s AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY rid, run),
t AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY rid),
p AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT rid, max(b), 1000000000 FROM s GROUP BY rid),
q AS (SELECT rid, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, len(h) // 2 AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN q USING (rid)
"""


def _op2() -> str:
    """Licence rules in DuckDB, whose regexes cannot look around: words stand two
    spaces apart here, so that each match takes a space of its own at either end."""
    from chorale.llm.license_rules import rules

    q = lambda x: "'" + x.replace("'", "''") + "'"
    wide = lambda r: r.removeprefix("(?<= )").removesuffix("(?= )").replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?")
    values = ", ".join(f"({p}, {q(l)}, {c!r}::DOUBLE, {q(k)}, {q(' ' + wide(r) + ' ')})" for p, l, c, k, r in rules())
    return f"""
WITH rules(p, l, c, k, r) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format(t="text")}, []) AS ws FROM documents),
t AS (SELECT rid, ' ' || array_to_string(ws, ' ') || ' ' AS norm, '  ' || array_to_string(ws, '  ') || '  ' AS far FROM d),
b AS (SELECT rid, i - 1 AS i, CASE WHEN ws[i] = 'mit' AND ws[i + 1] = 'license' THEN 'mit' WHEN ws[i] = 'apache' AND ws[i + 1] = 'license' THEN 'apache' WHEN ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license' THEN 'gpl' END AS label FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM b WHERE label IS NOT NULL GROUP BY rid),
m AS (SELECT rid, p, l, c, regexp_extract_all(far, r) AS hits, string_split_regex(far, r) AS gaps FROM t JOIN rules ON contains(norm, k)),
f AS (SELECT rid, p, l, c, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS s, len(hits[i]) AS n FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
g AS (SELECT rid, p, l, c, s, s + n AS e, row_number() OVER (PARTITION BY rid ORDER BY s, s + n DESC, p, l, c) AS k FROM f),
kept AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g AS y WHERE y.rid = g.rid AND y.k < g.k AND y.e >= g.e AND y.p <= g.p)),
own AS (SELECT rid, count(*) AS n, list(DISTINCT l) AS labels, 1.0::DOUBLE - list_reduce(list_prepend(1.0::DOUBLE, list(1.0::DOUBLE - c ORDER BY k)), lambda a, x: a * x) AS score FROM kept GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, own.labels))), ','), '') AS labels, coalesce(own.score, 0.0) AS score, coalesce(own.n, 0) AS n_detections
FROM d LEFT JOIN base USING (rid) LEFT JOIN own USING (rid)
"""


OP2 = _op2()
