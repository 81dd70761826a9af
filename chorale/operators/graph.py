"""Neighbourhood graphs as edge tables (i, j, w), and their normalisations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.arrow import map_arrow
from chorale.functions.shared import settled

#: Points of a block; a cell's side has at most SIDE blocks, about. There are PARTS parts of the points at least (a third more
#: where each pair of parts is one cell), unless a part would be below a block.
BLOCK, SIDE, PARTS = 4096, 16, 6
#: Tasks of a search at most.
TASKS = 1024


def affinity(d2: Column, sigma2: Column | float) -> Column:
    return F.exp(-d2 / (2 * sigma2))


def _cells(points: DataFrame, ordered: bool) -> DataFrame:
    """cell, side, ids, dims, narrow, vs: packed blocks of the points that each cell compares, side 0 with side 1.

    Points are dealt into parts by their ids, and every pair of parts (``ordered``: in both orders) is
    a cell, so that what a task holds is bounded; cells lie in partitions of their own.
    """
    count, block = points.count(), BLOCK
    parts = max(1, -(-count // (SIDE * block)), min(-(-count // block), PARTS if ordered else PARTS * 4 // 3))
    pairs = {pair: n for n, pair in enumerate((r, c) for r in range(parts) for c in range(parts) if ordered or r <= c)}
    tasks = min(len(pairs), TASKS)
    keys = {r.p: r.id for r in points.sparkSession.range(0, 16 * tasks, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SIDE * block:
                yield from packed(held)
                held, rows = [], 0
        yield from packed(held)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks() if held else None
        if not t or not t.num_rows:
            return
        column = t["v"].chunk(0)
        if len(set(np.unique(np.diff(column.offsets.to_numpy())))) > 1:
            raise ValueError("points have different numbers of coordinates")
        v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        i, part = t["i"].to_numpy(), t["part"].to_numpy()
        sound = np.flatnonzero(np.isfinite(v).all(axis=1))
        sound = sound[np.argsort(part[sound], kind="stable")]
        for g in np.unique(part[sound]).tolist():
            mine = sound[part[sound] == g]
            to = [(pairs.get((g, other)), 0) for other in range(parts)] + [(pairs.get((other, g)), 1) for other in range(parts)]
            to = [{"key": keys.get(cell % tasks, cell), "cell": cell, "side": side} for cell, side in to if cell is not None]
            for n in range(0, len(mine), block):
                at = mine[n : n + block]
                with np.errstate(over="ignore"):
                    small = v[at].astype(np.float32)
                narrow = bool((small == v[at]).all())
                row = {"ids": i[at].tobytes(), "dims": v.shape[1], "narrow": narrow, "vs": (small if narrow else v[at]).tobytes(), "to": to}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema(fields))

    fields = [("ids", pa.binary()), ("dims", pa.int64()), ("narrow", pa.bool_()), ("vs", pa.binary()), ("to", pa.list_(pa.struct([("key", pa.int64()), ("cell", pa.int64()), ("side", pa.int64())])))]
    given = points.where("i is not null and v is not null").select(F.col("i").cast("long").alias("i"), F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("i"), F.lit(parts)).alias("part"))
    b = map_arrow(given, run, "ids binary, dims long, narrow boolean, vs binary, to array<struct<key: long, cell: long, side: long>>")
    b = b.select("*", F.explode("to").alias("at")).select(F.col("at.key").alias("key"), F.col("at.cell").alias("cell"), F.col("at.side").alias("side"), "ids", "dims", "narrow", "vs")
    return b.repartition(tasks, "key").sortWithinPartitions("cell").drop("key")


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """ids and coordinates of a side."""
    if len({r["dims"] for r in rows}) > 1:
        raise ValueError("points have different numbers of coordinates")
    ids = np.concatenate([np.frombuffer(r["ids"], dtype=np.int64) for r in rows])
    vs = [np.frombuffer(r["vs"], dtype=np.float32 if r["narrow"] else float).reshape(-1, r["dims"]) for r in rows]
    return ids, np.concatenate(vs, dtype=float)


def _rarer(ids: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Places of the points without those that have ``most`` equal points of smaller id."""
    words = np.ascontiguousarray(v).view(np.uint64)
    odd = np.random.default_rng(0).integers(1, 1 << 63, size=v.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (words * odd).sum(axis=1, dtype=np.uint64)
    counts = np.unique(h, return_counts=True)[1]
    if counts.max() <= most:
        return np.arange(len(ids))
    order = np.lexsort((ids, h))
    ends = np.cumsum(counts)
    first = np.repeat(ends - counts, counts)
    late = np.arange(len(ids)) - first >= most
    kept = [order[~late]]
    for start in np.unique(first[late]).tolist():
        run = order[start : ends[np.searchsorted(ends, start, side="right")]]
        if not (words[run] == words[run[0]]).all():
            kept.append(run[most:])
    return np.concatenate(kept)


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a mask with few places set is true, by words of 8."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


def _merged(best: tuple[np.ndarray, np.ndarray], r: np.ndarray, dist: np.ndarray, j: np.ndarray) -> None:
    """Take rows' new distances and ids into their best ones, which are in order of distance and id."""
    bd, bj = best
    k = bd.shape[1]
    rows = np.unique(r)
    all_r, all_d, all_j = np.concatenate([np.repeat(rows, k), r]), np.concatenate([bd[rows].reshape(-1), dist]), np.concatenate([bj[rows].reshape(-1), j])
    order = np.lexsort((all_j, all_d, all_r))
    all_r = all_r[order]
    place = np.arange(len(order)) - np.searchsorted(all_r, all_r)
    kept = place < k
    bd[all_r[kept], place[kept]], bj[all_r[kept], place[kept]] = all_d[order[kept]], all_j[order[kept]]


#: Rows and columns of a matrix product, and pairs whose distances are computed at once.
_ROWS, _COLUMNS, _PAIRS = 1024, 2048, 1 << 14


def _slack(dims: int, kind: type) -> float:
    """Over twice the rounding of a product of a row of :func:`_sides` with one of the other side, over their half squares."""
    return 2 * (dims + 8) * float(np.finfo(kind).eps)


def _sides(v: np.ndarray, scale: float, kind: type, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scaled coordinates and one more, whose products with the other side are a * b - |b|^2 / 2, and half squares.

    Half squares are lessened by more than the rounding of such a product, so that no pair seems farther apart than it is.
    """
    v = v * scale
    half = (v * v).sum(axis=1) / 2 * (1 - _slack(v.shape[1], kind))
    return np.column_stack([v, np.ones(len(v)) if left else -half]).astype(kind), half


def _under(s: np.ndarray, half: np.ndarray, room: np.ndarray, limit: np.ndarray, most: int, mask: np.ndarray) -> np.ndarray:
    """Places of products whose pairs may be within a row's limit, or without one yet (infinite) among its ``most`` nearest."""
    kind = np.finfo(s.dtype)
    with np.errstate(over="ignore"):
        t = half - limit**2 / 2 * (1 + 1e-12)
    new = np.flatnonzero(np.isinf(t))
    if len(new) and 0 < most < s.shape[1]:
        t[new] = np.partition(s[new], s.shape[1] - most, axis=1)[:, s.shape[1] - most] - room[new]
    t -= kind.tiny * 1e8
    np.greater_equal(s, np.nextafter(t.astype(s.dtype), s.dtype.type(-np.inf))[:, None], out=mask)
    return _places(mask)


def _compare(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray, k: int | None, eps: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, dist of the cell's pairs: for each of its left points the k nearest, or all under ``eps``.

    Single-precision products, with slack for their rounding, tell which pairs can
    count; double-precision ones do where that leaves many.  Distances are
    then computed from differences, coordinate by coordinate.
    """
    if k:
        # a point itself, as often as an id is repeated, does not count among its nearest
        most = k + int(np.unique(j, return_counts=True)[1].max())
        rare = _rarer(j, b, most)
        j, b = j[rare], b[rare]
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    scale = 2.0 ** -min(max(np.frexp(top)[1], -1000), 1000)
    right, far = _sides(b, scale, np.float32, False)
    right, far = right.T.copy(), far.max()
    bt = b.T.copy()
    product, mask = np.empty(_ROWS * _COLUMNS, np.float32), np.empty(_ROWS * _COLUMNS, bool)
    for start in range(0, len(a), _ROWS):
        part, own = a[start : start + _ROWS], i[start : start + _ROWS]
        at, (left, half) = part.T.copy(), _sides(part, scale, np.float32, True)
        best = np.full((len(part), k or 0), np.inf), np.full((len(part), k or 0), np.iinfo(np.int64).max)
        lo, width = 0, max(_COLUMNS // 4, 8 * most) if k else _COLUMNS
        while lo < len(b):
            hi = min(lo + min(width, len(product) // len(part)), len(b))
            shape = len(part), hi - lo
            m = mask[: shape[0] * shape[1]].reshape(shape)
            s = np.matmul(left, right[:, lo:hi], out=product[: m.size].reshape(shape))
            limit = best[0][:, -1] if k else np.full(len(part), eps)
            hits = _under(s, half, 4 * _slack(len(bt), np.float32) * (half + far), limit * scale, most if k else 0, m)
            if len(hits) > m.size // 32:
                fine, half64 = _sides(part, scale, np.float64, True)
                s = fine @ _sides(b[lo:hi], scale, np.float64, False)[0].T
                hits = _under(s, half64, 4 * _slack(len(bt), np.float64) * (half64 + far), limit * scale, most if k else 0, m)
            for n in range(0, len(hits), _PAIRS):
                r, c = np.divmod(hits[n : n + _PAIRS], shape[1])
                c += lo
                d = at.take(r, axis=1)
                d -= bt.take(c, axis=1)
                with np.errstate(over="ignore"):
                    d *= d
                dist = np.sqrt(d.sum(axis=0))
                keep = (own[r] != j[c]) & np.isfinite(dist) & ((dist <= best[0][r, -1]) if k else (dist < eps))
                r, c, dist = r[keep], c[keep], dist[keep]
                if k:
                    _merged(best, r, dist, j[c])
                else:
                    yield own[r], j[c], dist
            lo, width = hi, 2 * width
        if k:
            r, c = np.nonzero(np.isfinite(best[0]))
            yield own[r], best[1][r, c], best[0][r, c]


def _near(points: DataFrame, k: int | None, eps: float | None) -> DataFrame:
    """i, j, dist of each cell's k nearest, or of all under ``eps``; a point with a NULL or non-finite coordinate has none.

    Pairs under ``eps`` count in both orders, and are found in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["cell"] != cell:
                    yield from searched(rows)
                    cell, rows = row["cell"], []
                rows.append(row)
        yield from searched(rows)

    def searched(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in rows if r["side"] == side] for side in (0, 1)]
        if not all(sides):
            return
        (i, a), (j, b) = (_unpacked(side) for side in sides)
        rows.clear()
        if a.shape[1] != b.shape[1]:
            raise ValueError("points have different numbers of coordinates")
        both = not k and not np.isin(i[0], j)  # an id is in one part
        for one in _compare(i, a, j, b, k, eps):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in one], names=["i", "j", "dist"])
            if both:
                yield pa.RecordBatch.from_arrays([pa.array(one[n]) for n in (1, 0, 2)], names=["i", "j", "dist"])

    return map_arrow(_cells(points, bool(k)), run, "i long, j long, dist double")


def knn(points: DataFrame, k: int) -> DataFrame:
    """i, rank, j, dist: the k nearest other points, ties to the smaller id.

    It is searched at once, and kept in the checkpoint folder, as a graph takes its edges several times.
    """
    order = F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))
    return settled(_near(points, k, None).withColumn("rank", order).where(F.col("rank") <= k).select("i", "rank", "j", "dist"))


def eps_edges(points: DataFrame, eps: float, sigma2: float) -> DataFrame:
    """i, j, w of pairs nearer than ``eps``; Gaussian weights, or 1 if ``sigma2`` is 0."""
    d = _near(points, None, eps)
    w = affinity(F.col("dist") * F.col("dist"), sigma2) if sigma2 else F.lit(1.0)
    return d.select("i", "j", w.alias("w"))


def knn_graph(edges: DataFrame, sigma2: float | None = 1.0, mutual: bool = False, self_loops: bool = False, auto_scale: int | None = None) -> DataFrame:
    """i, j, w: union (or, ``mutual``, intersection) of neighbour relations.

    Weights are Gaussian of ``sigma2``, or of the product of both ends'
    distances to their ``auto_scale``-th neighbour, or 1 without either.
    """
    e = edges.select("i", "j", "dist")
    back = e.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")
    # the two directions' distances can differ in the last bit
    g = e.join(back.select("i", "j"), ["i", "j"], "left_semi") if mutual else e.unionByName(back).groupBy("i", "j").agg(F.min("dist").alias("dist"))
    d2 = F.col("dist") * F.col("dist")
    if auto_scale is not None:
        s = edges.where(F.col("rank") == auto_scale).select("i", F.col("dist").alias("s"))
        g = g.join(s.withColumnRenamed("s", "si"), "i").join(s.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j")
        w = affinity(d2, F.col("si") * F.col("sj"))
    else:
        w = affinity(d2, sigma2) if sigma2 else F.lit(1.0)
    out = g.select("i", "j", w.alias("w"))
    if self_loops:
        ids = out.select("i").distinct()
        out = out.unionByName(ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))
    return out


def degrees(edges: DataFrame, p: float = 1.0) -> DataFrame:
    """i, d: row sums to a power."""
    return edges.groupBy("i").agg(F.sum("w").alias("d")).select("i", (F.col("d") if p == 1 else F.pow("d", F.lit(float(p)))).alias("d"))


def _minus(diagonal: DataFrame, off: DataFrame) -> DataFrame:
    rows = diagonal.unionByName(off.select("i", "j", (-F.col("w")).alias("w")))
    return rows.groupBy("i", "j").agg(F.sum("w").alias("w"))


def laplacian(edges: DataFrame) -> DataFrame:
    """D - W."""
    return _minus(degrees(edges).select("i", F.col("i").alias("j"), F.col("d").alias("w")), edges)


def markov(edges: DataFrame) -> DataFrame:
    """W with rows of sum 1."""
    return edges.join(degrees(edges), "i").select("i", "j", (F.col("w") / F.col("d")).alias("w"))


def normalized_laplacian(edges: DataFrame) -> DataFrame:
    """I less the Markov form."""
    return _minus(degrees(edges).select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")), markov(edges))


def _both_ends(edges: DataFrame, d: DataFrame) -> DataFrame:
    return edges.join(d.withColumnRenamed("d", "di"), "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")


def bimarkov(edges: DataFrame) -> DataFrame:
    """Weights over the root of both degrees."""
    return _both_ends(edges, degrees(edges)).select("i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))


def anisotropic(edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Weights over a power of the product of column sums; the Markov form for 0."""
    if abs(alpha) < 1e-8:
        return markov(edges)
    cols = edges.groupBy(F.col("j").alias("i")).agg(F.sum("w").alias("d"))
    return _both_ends(edges, cols).select("i", "j", (F.col("w") / F.pow(F.col("di") * F.col("dj"), F.lit(alpha))).alias("w"))
