"""Common table expressions of the oracles, written for DuckDB alone."""

SAMPLES = """
names AS (SELECT event_type, cast(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS chan FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
origin AS (SELECT epoch_us(date_trunc('day', min(ts))) AS a, epoch_us(max(ts)) AS b FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
span AS (SELECT a, cast(ceil((b - a + 1) / (120 * 21600000000.0)) AS BIGINT) * 21600000000 AS w FROM origin),
bins AS (SELECT event_type, (epoch_us(ts) - a) // w AS t, cast(sum(cast(round(value * 100) AS BIGINT)) AS DOUBLE) / 1e2 / count(value) AS m FROM events, span WHERE value IS NOT NULL GROUP BY ALL),
samples AS (SELECT n.chan, g.t, coalesce(b.m, 0.0) AS x FROM names n CROSS JOIN (SELECT unnest(range(120)) AS t) g LEFT JOIN bins b ON b.event_type = n.event_type AND b.t = g.t)"""

DAYS = """
days AS (SELECT user_id AS chan, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000 AS block_id, value AS x FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)"""

FIELD = """
field AS (SELECT c_nationkey AS site, year(o_orderdate) * 4 + quarter(o_orderdate) AS sample, cast(sum(cast(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 / count(o_totalprice) / 1e3 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""

SITES = """
sites AS (SELECT n_nationkey AS site, n_nationkey // 5 AS "row", n_nationkey % 5 AS col, cast(n_nationkey % 5 AS DOUBLE) AS x, cast(n_nationkey // 5 AS DOUBLE) AS y FROM nation)"""

CLOUD = """
cloud AS (SELECT vec_id AS i, cast(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def box(source: str, value: str, by: str, k: float) -> str:
    """Quartiles and fence of ``source``, as CTE q."""
    return f"q AS (SELECT {by}, quantile_cont({value}, 0.25) q1, quantile_cont({value}, 0.5) med, quantile_cont({value}, 0.75) q3, q1 - {k} * (q3 - q1) AS f_lo, q3 + {k} * (q3 - q1) AS f_hi FROM {source} GROUP BY {by})"
