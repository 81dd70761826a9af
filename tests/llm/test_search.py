import numpy as np
import pytest

from chorale.llm import vantage


def brute(rows, k=5, every=50):
    ok = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i, tuple(v)] = np.array(v, dtype=float)
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        best = {}
        for (qi, _), a in ok.items():
            if qi != q:
                continue
            for (i, _), b in ok.items():
                if i != q and len(a) == len(b):
                    s = float(np.cumsum(a * b)[-1] / (np.sqrt(np.cumsum(b * b)[-1]) * np.sqrt(np.cumsum(a * a)[-1])))
                    best[i] = max(best.get(i, -2), s)
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(400)] + [(0, rows[3][1]), (100, rows[100][1])]
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] * 8), (None, rows[0][1]), (2200, [1.0, 2.0]), (2201, [1.0, 2.5]), (2250, []), (2300, [float("inf")] * 8), (2350, rows[50][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("shard", [100_000, 200])
def test_exact_search(spark, shard):
    rows, df = vectors(spark)
    got = [tuple(r) for r in vantage.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=shard).orderBy("query_id", "rank").collect()]
    assert got == brute(rows)


def test_relaxed_search_recalls(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {(r.query_id, r.vec_id) for r in vantage.nearest(df, df.where("vec_id % 50 = 0")).collect()}
    loose = {(r.query_id, r.vec_id) for r in vantage.nearest(df, df.where("vec_id % 50 = 0"), factor=1.5).collect()}
    assert len(exact & loose) >= 0.9 * len(exact)


def test_empty(spark):
    df = vectors(spark)[1].where("false")
    assert vantage.nearest(df, df).count() == 0
