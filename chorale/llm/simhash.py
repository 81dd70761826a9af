"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import cut, keeps, keyed_texts, map_arrow, slices
from chorale.llm.components import components

#: Differing bits that still link.  The blocks and codes below are for this number.
THRESHOLD = 4
#: Entries of an anchor that one task compares; larger groups are dealt out in pairs of parts.
GROUP = 8_192
#: Parts by which a component's members get its id.
SALTS = 16


def _shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    spans = zip(at[: len(words) - n + 1].tolist(), (at[n:] - 1).tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)


def fingerprint(text: bytes, n: int = 4) -> int:
    """The 64-bit SimHash of a text's ``n``-word shingles, repeats included."""
    words = text.lower().split()
    return fold(_shingle_hashes(words, n)) if words else 0


def fold(h: np.ndarray) -> int:
    """The 64-bit fingerprint of hashes: a bit is set if it is in over half of them."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(bits), 255):
        total += bits[a : a + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row.

    A null or empty text has fingerprint 0; one of fewer than ``n`` words is
    one shingle.  One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            fps = np.array([fingerprint(t, n) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    rows = keyed_texts(docs, doc_id, text)
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, list[np.ndarray]]:
    """The [15, 11] Hamming code with one free bit: a covering code of 16 bits.

    Its 4,096 anchors lie within distance 1 of every 16-bit value.  Returns
    each value's own anchor, and the anchors within distance 2 of it.
    """
    values = np.arange(1 << 16)
    syndrome = np.zeros(1 << 16, dtype=np.int64)
    for bit in range(15):
        syndrome ^= ((values >> bit) & 1) * (bit + 1)
    anchor = values.copy()
    wrong = syndrome > 0
    anchor[wrong] ^= 1 << (syndrome[wrong] - 1)
    is_anchor = syndrome == 0
    flips = [0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i in range(16) for j in range(i))]
    near = []
    for part in np.split(values, 16):
        rows = part[:, None] ^ np.array(flips)
        near += [row[h] for row, h in zip(rows, is_anchor[rows], strict=True)]
    return anchor, near


keeps(__name__, _code.cache_clear)

#: Parts of the 48 bits outside a block (low bit, width): 4 for three differing bits at most, 5 for four.
_FOUR = [(0, 12), (12, 12), (24, 12), (36, 12)]
_FIVE = [(0, 10), (10, 10), (20, 10), (30, 9), (39, 9)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every fingerprint's keys, as two arrays: its row and the key.

    Of two fingerprints that differ in 4 bits or fewer, either some 16-bit
    block is equal, or every block differs in exactly one bit.  For an equal
    block the threshold is 0 and both have the same anchor of the covering
    code within its radius 1.  For the other case block 0 has threshold 1: both
    are sent to every anchor within radius plus threshold, 2, and so both are
    at the anchor that is within 1 of either.  An anchor's entries are
    told apart by a part of the other 48 bits, one of which must be equal: 5
    parts for the up to 4 bits that differ there, 4 parts in the second case,
    which has 3.  A key so is about 22 bits (24 for the second case).
    """
    own, near = _code()
    rows, keys = [], []
    index = np.arange(len(fps))
    u = fps.astype(np.uint64)
    for block in range(4):
        value = ((u >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
        low = u & np.uint64((1 << (16 * block)) - 1)
        rest = low | ((u >> np.uint64(16 * block + 16)) << np.uint64(16 * block) if block < 3 else np.uint64(0))
        part = lambda at, width: ((rest >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)  # noqa: B023, E731
        for k, (at, width) in enumerate(_FIVE):
            rows.append(index)
            keys.append(((block * 8 + k) << 32) | (own[value] << 16) | part(at, width))
        if block == 0:
            sizes = np.array([len(near[v]) for v in value.tolist()], dtype=np.int64)
            every = np.concatenate([near[v] for v in value.tolist()]) if len(u) else np.empty(0, np.int64)
            rep = np.repeat(index, sizes)
            for k, (at, width) in enumerate(_FOUR):
                rows.append(rep)
                keys.append(((64 + k) << 32) | (every << 16) | part(at, width)[rep])
    return np.concatenate(rows), np.concatenate(keys)


def links(left: np.ndarray, right: np.ndarray | None = None, most: int = THRESHOLD) -> list[tuple[int, int]]:
    """Pairs that join what is within ``most`` bits, one fewer than each cluster has.

    With ``right``, only pairs of a left and a right fingerprint count.  A
    search from one fingerprint takes whatever it reaches out of the rest, so
    a dense group costs one comparison per entry.
    """
    n = len(left)
    u = (left if right is None else np.concatenate([left, right])).astype(np.uint64)
    side = np.zeros(len(u), dtype=bool)
    side[n:] = right is not None
    rest = np.arange(len(u))
    out: list[tuple[int, int]] = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            near = np.bitwise_count(u[rest] ^ u[a]) <= most
            if right is not None:
                near &= side[rest] != side[a]
            if near.any():
                got = rest[near].tolist()
                out += [(a, b) for b in got]
                queue += got
                rest = rest[~near]
    return [(int(u[a].astype(np.int64)), int(u[b].astype(np.int64))) for a, b in out]


def linked_pairs(distinct: DataFrame, group: int = GROUP, most: int = THRESHOLD) -> DataFrame:
    """Pairs a, b of fingerprints (column fp, distinct) that span all links.

    With ``most`` above :data:`THRESHOLD`, links of more bits than that are
    found as well where both fingerprints have an anchor's key in common.

    Every fingerprint goes to its anchors' keys; sorted by key, each anchor's
    group is compared in one task without pairing up a cluster's members.  A
    group of more than ``group`` entries is passed on in parts instead, and
    every two of its parts are compared in a task of their own.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column("fp").slice(at, 20_000).to_numpy()
                rows, keys = anchors(fps.view(np.uint64))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "fp": pa.array(fps[rows])})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at, size, part = None, 0, 0
        pairs: list[tuple[int, int, int, int]] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("key", "part", "a", "b"))})

        def pass_on() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, part
            fps = np.concatenate(held)
            yield pa.RecordBatch.from_pydict({"key": pa.array([at] * len(fps), pa.int64()), "part": pa.array([part] * len(fps), pa.int64()), "a": pa.array(fps), "b": pa.nulls(len(fps), pa.int64())})
            held, size, part = [], 0, part + 1

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, part, pairs
            if part and size:
                yield from pass_on()
            elif size > 1:
                pairs += [(-1, -1, a, b) for a, b in links(np.unique(np.concatenate(held)).view(np.uint64), most=most)]
            held, size, part = [], 0, 0
            if len(pairs) > 10_000:
                yield out(pairs)
                pairs = []

        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            begins, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            # groups inside the batch with one entry are done
            alone = (ends - begins == 1) & (begins > 0) & (ends < len(keys))
            for a, b in zip(begins[~alone].tolist(), ends[~alone].tolist(), strict=True):
                if a == b:
                    continue
                if keys[a] != at:
                    yield from finish()
                    at = keys[a]
                for c in range(a, b, group):
                    chunk = fps[c : min(b, c + group)]
                    if size + len(chunk) > group:
                        yield from pass_on()
                    held.append(chunk)
                    size += len(chunk)
        yield from finish()
        yield out(pairs)

    dealt = map_arrow(distinct.select("fp"), spread, "key long, fp long").repartition("key").sortWithinPartitions("key")
    first = cut(map_arrow(dealt, compare, "key long, part long, a long, b long"))
    parts = first.where("part >= 0")
    small = first.where("part < 0").select("a", "b")
    if parts.isEmpty():
        return small
    last = parts.groupBy("key").agg(F.max("part").alias("last"))
    # entry of part p meets parts p..last as the left one and 0..p-1 as the right one
    pairs = parts.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", F.col("a").alias("fp"))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: dict[int, list[int]] = {}

        def done() -> Iterator[pa.RecordBatch]:
            if at:
                left = np.unique(np.array(held.get(at[1], []), dtype=np.int64)).view(np.uint64)
                right = np.unique(np.array(held.get(at[2], []), dtype=np.int64)).view(np.uint64)
                got = links(left, most=most) if at[1] == at[2] else links(left, right, most)
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

        for batch in batches:
            for key, i, j, p, fp in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "part", "fp")), strict=True):
                if (key, i, j) != at:
                    yield from done()
                    at, held = (key, i, j), {}
                held.setdefault(p, []).append(fp)
        yield from done()

    large = map_arrow(pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), crossed, "a long, b long")
    return small.unionByName(large)


def near_duplicates(docs: DataFrame, n: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints link at :data:`THRESHOLD` differing bits or fewer; a
    component's id is the smallest doc_id in it.  Equal fingerprints are one
    node, so exact copies cost nothing further.  Null and empty texts have
    fingerprint zero, linked like any other; rows with a null doc_id belong to
    a component but never name it (its id is null if all of its ids are).
    Rows come back one for one.
    """
    rows = cut(fingerprints(docs, n, doc_id, text))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    groups = cut(components(linked_pairs(distinct)).withColumnRenamed("node", "fp"))
    linked = distinct.join(groups, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    # a component may hold most fingerprints: its least id is found, and handed back, by salted parts
    first = linked.groupBy("component", "salt").agg(F.min("low").alias("low")).groupBy("component").agg(F.min("low").alias("component_id"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = linked.join(first, ["component", "salt"]).select("fp", "component_id").unionByName(distinct.join(groups, "fp", "left_anti").select("fp", F.col("low").alias("component_id")))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, n: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id.

    Of rows with equal ids one stays; rows without an id are left alone.  All
    columns are kept.
    """
    groups = near_duplicates(docs.where(F.col(doc_id).isNotNull()), n, doc_id, text)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(first, docs[doc_id] == first["__id"], "left_semi")
    return kept.dropDuplicates([doc_id]).unionByName(docs.where(F.col(doc_id).isNull()))
