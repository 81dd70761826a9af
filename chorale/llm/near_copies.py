"""Near-copies by exact Jaccard similarity of word shingles.

Candidates come from SimHash fingerprints, by anchor-point covering, and for
what lies too far apart for fingerprints from an exact prefix-filtered join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import cut, map_arrow, slices
from chorale.llm.components import components
from chorale.llm.simhash import _shingle_hashes, fold, linked_pairs

#: Words of a shingle.  Two texts link where 5 * shared >= 4 * all, similarity 0.8.
WORDS = 5
#: Differing bits of fingerprints that make a candidate.  Up to simhash.THRESHOLD none is missed; beyond, those that
#: share an anchor's key are met.  Wider, chance would chain unlike texts of a large corpus.
REACH = 8
#: Texts, about, from which common shingles are learned.  They only order shingles; no result depends on them.
SAMPLE = 4_000
#: Shingles held to be common at most.
COMMON = 200_000
#: Texts and shingles of a part; of larger groups every two parts are compared in a task of their own.
PART_TEXTS = 2_048
PART_SHINGLES = 2 << 20


def shingle_set(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased text's shingles; fewer than ``n`` words are one shingle."""
    words = text.lower().split()
    return np.unique(_shingle_hashes(words, n)) if words else np.empty(0, np.uint64)


def _node(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(s.tobytes(), 7)).astype(np.int64))


def prefix(s: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one: the first |s| - ceil(0.8 |s|) + 1, rare ones first."""
    n = len(s) - (4 * len(s) + 4) // 5 + 1
    if not len(common):
        return s[:n]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.lexsort((s, np.where(common[at] == s, count[at], 0)))[:n]]


def bins(s: np.ndarray) -> np.ndarray:
    """Counts (255 at most) of a set's hashes in 64 to 65,536 ranges, about eight to a range.

    Two such rows differ by no more than their sets do, and still after pairs
    of neighbouring ranges are added up, so no similar pair is held apart.
    """
    level = min(16, max(6, (len(s) // 8).bit_length()))
    count = np.bincount((s >> np.uint64(64 - level)).astype(np.int64), minlength=1 << level)
    return np.minimum(count, 255).astype(np.uint8)


def maybe_similar(rows: list[np.ndarray], size: np.ndarray, side: np.ndarray | None = None):
    """Which of ``rest`` may be similar to ``a``: symmetric difference up to a ninth of both sizes.

    With ``side``, only those of another side than ``a`` count.
    """
    level = np.array([len(r).bit_length() - 1 for r in rows])
    place = np.zeros((18, len(rows)), dtype=np.int64)
    at_level: dict[int, np.ndarray] = {}
    for k in set(level.tolist()):
        # similar sets are at most one level apart
        own = np.flatnonzero((level == k) | (level == k + 1))
        place[k, own] = np.arange(len(own))
        at_level[k] = np.stack([(r if len(r) == 1 << k else r[::2].astype(np.int16) + r[1::2]).astype(np.int16) for r in (rows[i] for i in own.tolist())])

    def near(a: int, rest: np.ndarray) -> np.ndarray:
        hit = 5 * np.minimum(size[rest], size[a]) >= 4 * np.maximum(size[rest], size[a])
        if side is not None:
            hit &= side[rest] != side[a]
        for k in (int(level[a]) - 1, int(level[a])):
            some = np.flatnonzero(hit & ((level[rest] == k) if k < level[a] else (level[rest] >= k)))
            if len(some):
                m = at_level[k]
                for part in np.array_split(some, len(some) * m.shape[1] // (1 << 22) + 1):
                    apart = np.abs(m[place[k, rest[part]]] - m[place[k, a]]).sum(axis=1, dtype=np.int64)
                    hit[part] = 9 * apart <= size[rest[part]] + size[a]
        return hit

    return near


def _span(near, n: int) -> list[tuple[int, int]]:
    """Pairs that span the groups of 0..n-1, where ``near(a, rest)`` says which of ``rest`` link to ``a``."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            hit = near(a, rest)
            got = rest[hit].tolist()
            out += [(a, b) for b in got]
            queue += got
            rest = rest[~hit]
    return out


def similar(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that span all links between sets; with ``side``, only links of unequal sides count."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]

    def near(a: int, rest: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(tokens, sets[a], "left"), np.searchsorted(tokens, sets[a], "right")
        length = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum()) if len(lo) else np.empty(0, np.int64)
        shared = np.bincount(owner[at], minlength=len(sets))[rest]
        hit = 9 * shared >= 4 * (size[rest] + size[a])
        return hit if side is None else hit & (side[rest] != side[a])

    return _span(near, len(sets))


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, of batches that stand sorted by ``by``."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            key = tuple(k[a] for k in keys)
            if key != at and held:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _common(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more sampled texts, sorted, and of how many."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in slices(batches):
            sets = [shingle_set(t, n) for t in part]
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(sets).view(np.int64))})

    some = texts.where(F.pmod("digest", F.lit(max(1, texts.count() // SAMPLE))) == 0).select("text")
    found = map_arrow(some, shingles, "key long").groupBy("key").count().where("count >= 3").orderBy(F.desc("count"), "key").limit(COMMON).collect()
    key = np.array([r[0] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.array([r[1] for r in found], dtype=np.int64)[order]


def _fingerprinted(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and near, its group by fingerprints within :data:`REACH`, and pairs (a, b) that span these groups."""
    near = cut(components(linked_pairs(cut(nodes.select("fp").distinct()), most=REACH)).withColumnRenamed("node", "fp"))
    grouped = cut(nodes.select("node", "fp").join(near, "fp", "left").select("node", F.coalesce("component", "fp").alias("near")))
    # a group may hold many nodes: both sides of the join are plain exchanges, whose skewed parts are split
    low = grouped.groupBy("near").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("near", "a").repartition("near", "a")
    return grouped, grouped.select("near", F.col("node").alias("b")).join(low, "near").where("a != b").select("a", "b")


def _candidates(texts: DataFrame, nodes: DataFrame, grouped: DataFrame, n: int) -> DataFrame:
    """Pairs of nodes (a, b) of unlike near groups that, with these groups, hold all similar pairs."""
    common, count = _common(texts, n)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, part in slices(batches):
            at, got = [], []
            for t in part:
                s = shingle_set(t, n)
                if (k := _node(s)) not in seen and len(s):
                    seen.add(k)
                    got.append(prefix(s, common, count))
                    at.append(np.full(len(got[-1]), k, dtype=np.int64))
            if got:
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(got).view(np.int64)), "node": pa.array(np.concatenate(at))})

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group is named by its members: keys of the same texts are one group
        from xxhash import xxh64_intdigest

        def shared() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held_k, held_n = np.empty(0, np.int64), np.empty(0, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                k, m = np.r_[held_k, batch.column("key").to_numpy()], np.r_[held_n, batch.column("node").to_numpy()]
                last = int(np.searchsorted(k, k[-1]))
                held_k, held_n = k[last:], m[last:]
                if last:
                    yield k[:last], m[:last]
            if len(held_k):
                yield held_k, held_n

        for k, m in shared():
            cuts = np.flatnonzero(np.diff(k)) + 1
            begin, end = np.r_[0, cuts], np.r_[cuts, len(k)]
            many = end - begin > 1
            gid, node = [], []
            for a, b in zip(begin[many].tolist(), end[many].tolist(), strict=True):
                own = np.unique(m[a:b])
                if len(own) > 1:
                    gid.append(np.full(len(own), np.uint64(xxh64_intdigest(own.tobytes(), 3)).astype(np.int64)))
                    node.append(own)
            if gid:
                yield pa.RecordBatch.from_pydict({"gid": pa.array(np.concatenate(gid)), "node": pa.array(np.concatenate(node))})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _runs(batches, ["gid"]):
            node, size, side = (group.column(c).to_numpy() for c in ("node", "size", "near"))
            if (side == side[0]).all():
                continue
            rows = [np.frombuffer(x, np.uint8) for x in group.column("bins").to_pylist()]
            out += [(int(node[a]), int(node[b])) for a, b in _span(maybe_similar(rows, size, side), len(node))]
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    dealt = map_arrow(texts.select("text"), keys, "key long, node long").repartition("key").sortWithinPartitions("key")
    met = cut(map_arrow(dealt, groups, "gid long, node long").distinct())
    full = met.join(nodes.select("node", "size", "bins"), "node").join(grouped, "node").repartition("gid").sortWithinPartitions("gid")
    return map_arrow(full, search, "a long, b long").distinct()


def _verified(texts: DataFrame, nodes: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Pairs of nodes (a, b) that span the similar ones of each candidate group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["component", "i", "j"]):
            got = {k: (shingle_set(t.encode(), n), p) for k, p, t in zip(*(group.column(c).to_pylist() for c in ("node", "part", "text")), strict=True)}
            node = list(got)
            crossed = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            found = similar([got[k][0] for k in node], np.array([got[k][1] for k in node]) if crossed else None)
            yield _pairs([(node[a], node[b]) for a, b in found])

    sized = nodes.join(groups, "node")
    parts = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / PART_TEXTS), F.ceil(F.sum("size") / PART_SHINGLES)).alias("n_parts"))
    placed = sized.join(parts, "component").select("node", "component", "n_parts", F.pmod(F.xxhash64("node"), F.col("n_parts")).alias("part"), F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
    held = texts.join(placed, texts["doc_id"].eqNullSafe(placed["first_id"]) & (texts["digest"] == placed["first_digest"]))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    held = held.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "text")
    return map_arrow(held.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j"), compare, "a long, b long")


def keep_first(docs: DataFrame, n: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-copies, that of the smallest id.

    Two texts link where the Jaccard similarity of their sets of lower-cased
    ``n``-word shingles is 0.8 or more, and groups are the components of the
    links.  SimHash fingerprints of the sets, dealt out by anchors, name most
    near-copies as candidates; the others, of unlike fingerprints, come from a
    join that is exact up to clashes of 64-bit hashes: sets that similar
    share a shingle among the first fifth of each in any common order, and what
    meets so goes on if counts of shingles by range allow it.  Whole sets
    of candidates are compared; no fingerprint decides.  Null and empty texts are copies of each other.  All columns
    are kept.  A row is known by its id and text: rows with one id and unlike
    texts are different documents, rows equal in both are copies.  Rows without
    an id take part and come last in their group.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    first = _firsts(docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")), n).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__first"))
    rows = docs.withColumn("__digest", F.xxhash64(body))
    kept = rows.join(first, rows[doc_id].eqNullSafe(first["__id"]) & (rows["__digest"] == first["__first"]), "left_semi")
    return kept.dropDuplicates([doc_id, "__digest"]).drop("__digest")


def _firsts(texts: DataFrame, n: int) -> DataFrame:
    """doc_id and digest of the first of each group: the smallest id, null last, then the smallest digest."""
    texts = texts.withColumn("digest", F.xxhash64("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in slices(batches):
            found = [shingle_set(t, n) for t in part]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "node": pa.array([_node(s) for s in found], pa.int64()),
                "size": pa.array([len(s) for s in found], pa.int64()), "fp": pa.array(np.array([fold(s) for s in found], dtype=np.uint64).view(np.int64)), "bins": pa.array([bins(s).tobytes() for s in found], pa.binary()),
            })

    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    rows = map_arrow(texts.select("doc_id", "digest", "text"), sets, f"doc_id {kind}, digest long, node long, size long, fp long, bins binary")
    nodes = cut(rows.groupBy("node").agg(F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("size", "fp", "bins")]))
    grouped, near = _fingerprinted(nodes)
    groups = components(near.unionByName(_candidates(texts, nodes, grouped, n)))
    linked = components(_verified(texts, nodes, groups, n))
    named = nodes.join(linked, "node", "left").select(F.coalesce("component", "node").alias("component"), "first")
    return named.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
