"""Queries on neighbourhood graphs of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions.columns import rounded
from chorale.operators import graph
from chorale.plans.base import query
from chorale.plans.duck import CLOUD
from chorale.sources import tables

R = rounded
K = 5
_KNN = CLOUD + ", dd AS (SELECT a.i, b.i AS j, list_distance(a.v, b.v) AS dist FROM cloud a JOIN cloud b ON a.i <> b.i), e AS (SELECT i, cast(row_number() OVER (PARTITION BY i ORDER BY dist, j) AS INTEGER) AS rank, j, dist FROM dd QUALIFY rank <= 5)"
_UN = _KNN + ", u AS (SELECT i, j, min(dist) AS dist FROM (SELECT i, j, dist FROM e UNION ALL SELECT j, i, dist FROM e) GROUP BY ALL), g AS (SELECT i, j, exp(-dist * dist / 2) AS w FROM u), dg AS (SELECT i, sum(w) AS d FROM g GROUP BY i)"


def _edges(s, d):
    return graph.knn(tables.cloud(s, d), K)


def _graph(s, d):
    return graph.knn_graph(_edges(s, d))


def _out(e):
    return e.select("i", "j", R("w").alias("w"))


@query(f"WITH {_KNN} SELECT i, j, round(exp(-dist * dist / (2 * 0.25)), 6) + 0.0 AS w FROM e")
def affinity(s, d):
    return _edges(s, d).select("i", "j", R(graph.affinity(F.col("dist") * F.col("dist"), 0.25)).alias("w"))


@query(f"WITH {_KNN} SELECT i, rank, j, round(dist, 6) + 0.0 AS dist FROM e")
def knn_edges(s, d):
    return _edges(s, d).select("i", "rank", "j", R("dist").alias("dist"))


@query(f"WITH {_UN} SELECT i, j, round(w, 6) + 0.0 AS w FROM g")
def knn_graph(s, d):
    return _out(_graph(s, d))


@query(f"WITH {_KNN} SELECT a.i, a.j, round(exp(-a.dist * a.dist / 2), 6) + 0.0 AS w FROM e a JOIN e b ON a.i = b.j AND a.j = b.i")
def knn_mutual(s, d):
    return _out(graph.knn_graph(_edges(s, d), mutual=True))


@query(f"WITH {_UN} SELECT i, j, round(w, 6) + 0.0 AS w FROM g UNION ALL SELECT DISTINCT i, i, 1.0 FROM g")
def knn_self(s, d):
    return _out(graph.knn_graph(_edges(s, d), self_loops=True))


@query(f"WITH {_UN}, s AS (SELECT i, dist AS s FROM e WHERE rank = 5) SELECT u.i, u.j, round(exp(-dist * dist / (2 * a.s * b.s)), 6) + 0.0 AS w FROM u JOIN s a ON a.i = u.i JOIN s b ON b.i = u.j")
def knn_autoscale(s, d):
    return _out(graph.knn_graph(_edges(s, d), auto_scale=K))


@query(f"WITH {_KNN} SELECT i, j, round(exp(-dist * dist / (2 * 0.5)), 6) + 0.0 AS w FROM dd WHERE dist < 1.15")
def eps_graph(s, d):
    return _out(graph.eps_edges(tables.cloud(s, d), 1.15, 0.5))


@query(f"WITH {_UN} SELECT i, round(d, 6) + 0.0 AS d FROM dg")
def degree(s, d):
    return graph.degrees(_graph(s, d)).select("i", R("d").alias("d"))


@query(f"WITH {_UN} SELECT i, j, round(-w, 6) + 0.0 AS w FROM g UNION ALL SELECT i, i, round(d, 6) + 0.0 FROM dg")
def laplacian(s, d):
    return _out(graph.laplacian(_graph(s, d)))


@query(f"WITH {_UN} SELECT i, j, round(w / d, 6) + 0.0 AS w FROM g JOIN dg USING (i)")
def markov(s, d):
    return _out(graph.markov(_graph(s, d)))


@query(f"WITH {_UN} SELECT i, j, round(-w / d, 6) + 0.0 AS w FROM g JOIN dg USING (i) UNION ALL SELECT i, i, 1.0 FROM dg")
def norm_laplacian(s, d):
    return _out(graph.normalized_laplacian(_graph(s, d)))


@query(f"WITH {_UN} SELECT g.i, g.j, round(w / sqrt(a.d * b.d), 6) + 0.0 AS w FROM g JOIN dg a ON a.i = g.i JOIN dg b ON b.i = g.j")
def bimarkov(s, d):
    return _out(graph.bimarkov(_graph(s, d)))


@query(f"WITH {_UN}, cs AS (SELECT j, sum(w) AS d FROM g GROUP BY j) SELECT g.i, g.j, round(w / power(a.d * b.d, 0.5), 6) + 0.0 AS w FROM g JOIN cs a ON a.j = g.i JOIN cs b ON b.j = g.j")
def anisotropic(s, d):
    return _out(graph.anisotropic(_graph(s, d)))
