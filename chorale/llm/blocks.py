"""Blocks of texts, and questions that blocks ask of all the others.

Exact substring operators have to learn, for millions of hashed places in each
text, whether something equal stands elsewhere.  Texts are packed into blocks
of a few megabytes, compressed and written once.  A block then sends its
distinct hashes to buckets (ranges of the hash), a bucket answers each block
in the order it asked, and the answers are joined to the blocks.  A hash goes
out at most once per block, however many texts share it, so a passage that
stands in a third of all documents is no hot key.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import cut, keyed_texts, map_arrow, named, slices

#: Bytes of text of a block, unless one text is longer; up to :data:`LARGE` of text.
BLOCK_BYTES = 2 << 20
#: Bytes of text from which blocks and buckets grow, both with the root of the
#: total, up to :data:`GROWTH` times.  So blocks times buckets grows with the
#: total, not with its square; messages never outnumber the hashes they hold.
LARGE, GROWTH = 64 << 30, 8


def growth(total: int) -> float:
    """How many times their usual size blocks and buckets have for ``total`` bytes of text."""
    return min(GROWTH, max(1.0, (total / LARGE) ** 0.5))


@dataclass
class Block:
    """The texts of a block, end to end, with where each ends and its id."""

    ids: np.ndarray
    named: np.ndarray  # whether the id is not null
    ends: np.ndarray
    text: bytes

    def texts(self) -> list[bytes]:
        return [self.text[a:b] for a, b in zip([0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=True)]

    def id_list(self) -> list[int | None]:
        return [i if n else None for i, n in zip(self.ids.tolist(), self.named.tolist(), strict=True)]


def unpack(payload: bytes) -> Block:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<q", raw)
    ids = np.frombuffer(raw, "<i8", n, 8)
    sizes = np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    named = np.frombuffer(raw, "?", n, 8 + 16 * n)
    return Block(ids, named, np.cumsum(sizes), raw[8 + 17 * n :])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> tuple[DataFrame, int]:
    """block_id, n_docs, n_bytes and payload, in the checkpoint folder, and the bytes of all text.

    With ``carry``, all columns of ``docs`` but the text go along in ``rest``,
    and whether a text was null.
    """
    rows = keyed_texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    if carry:
        rest = F.struct(*[named(c) for c in docs.columns if c != text])
        rows = docs.select(named(doc_id).cast("long").alias("doc_id"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"), rest.alias("rest"), named(text).isNull().alias("missing"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    most = int(BLOCK_BYTES * growth(total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=6)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.RecordBatch, list[bytes]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids = [i for batch, _ in held for i in batch.column("doc_id").to_pylist()]
            texts = [t for _, part in held for t in part]
            raw = b"".join([
                struct.pack("<q", len(ids)), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(list(map(len, texts)), "<i8").tobytes(),
                np.array([i is not None for i in ids], "?").tobytes(), *texts,
            ])
            number += 1
            out = {"block_id": pa.array([number], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "payload": pa.array([press.compress(raw)], pa.binary())}
            if carry:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0][0].schema.remove(1)) as to:
                    for batch, _ in held:
                        to.write_batch(batch.drop_columns(["text"]))
                out["rest"] = pa.array([press.compress(sink.getvalue().to_pybytes())], pa.binary())
            return pa.RecordBatch.from_pydict(out)

        for batch, part in slices(batches, most=most):
            more = sum(map(len, part))
            if held and size + more > most:
                yield flush()
                held, size = [], 0
            held.append((batch, part))
            size += more
        if held:
            yield flush()

    return cut(map_arrow(rows, run, "block_id long, n_docs long, n_bytes long, payload binary" + ", rest binary" * carry)), total


def carried(rest: bytes) -> tuple[pa.Table, list[bool]]:
    """The columns that went along with a block, and whether each text was null, in order of its texts."""
    import zstandard

    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)).read_all()
    return pa.Table.from_struct_array(table.column("rest")), table.column("missing").to_pylist()


class Buckets:
    """Ranges of 64-bit hashes; sorted hashes fall into them as slices."""

    def __init__(self, n: int):
        self.edges = np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)

    def slices(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, start, end) of every bucket that ``keys``, sorted, have part in."""
        at = np.r_[0, np.searchsorted(keys, self.edges), len(keys)]
        full = np.flatnonzero(np.diff(at))
        return [(int(k), int(at[k]), int(at[k + 1])) for k in full]


def ask(blocks: DataFrame, emit: Callable[[dict], Iterator[tuple[int, bytes]]], settle: Callable[[list[bytes]], list[bytes]], columns: list[str]) -> DataFrame:
    """block_id and answers, an array of (bucket, answer, note) in order of bucket.

    ``emit`` gets a row of ``blocks`` (its ``columns``) and gives bucket and
    payload; ``settle`` gets all payloads of a bucket and answers each.  What
    it gives with None for a bucket is a note to the block itself, which goes
    along with one of its questions, of which there must be one, and comes back.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                got = list(emit(row))
                notes, got = [g[1] for g in got if g[0] is None], [g for g in got if g[0] is not None]
                if got:
                    notes = [notes[0] if notes and k == row["block_id"] % len(got) else None for k in range(len(got))]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([g[0] for g in got], pa.int64()), "block_id": pa.array([row["block_id"]] * len(got), pa.int64()), "asked": pa.array([g[1] for g in got], pa.binary()), "note": pa.array(notes, pa.binary())})

    asked = map_arrow(blocks.select(*columns), out, "bucket long, block_id long, asked binary, note binary")
    return grouped(answered(asked.repartition("bucket").sortWithinPartitions("bucket", "block_id"), settle))


def answered(dealt: DataFrame, settle: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """block_id, bucket and answer, from rows that stand sorted by bucket; a note stays as it is."""
    with_notes = "note" in dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held, notes = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                out = {"block_id": pa.array(ids, pa.int64()), "bucket": pa.array([at] * len(ids), pa.int64()), "answer": pa.array(settle(held), pa.binary())}
                yield pa.RecordBatch.from_pydict(out | ({"note": pa.array(notes, pa.binary())} if with_notes else {}))

        for batch in batches:
            buckets = batch.column("bucket").to_pylist()
            own = batch.column("note").to_pylist() if with_notes else [None] * len(buckets)
            for bucket, block, asked, its in zip(buckets, batch.column("block_id").to_pylist(), batch.column("asked").to_pylist(), own, strict=True):
                if bucket != at:
                    yield from done()
                    at, ids, held, notes = bucket, [], [], []
                ids.append(block)
                held.append(asked)
                notes.append(its)
        yield from done()

    return map_arrow(dealt, run, "block_id long, bucket long, answer binary" + ", note binary" * with_notes)


def grouped(answers: DataFrame) -> DataFrame:
    """block_id and its answers in order of bucket."""
    return answers.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("bucket", "answer", "note") if c in answers.columns]))).alias("answers"))


def bits(answers: list[dict] | None, n: int, per_key: int = 1) -> np.ndarray:
    """The answers' bits, in the order in which the block's sorted keys went out."""
    if not answers:
        return np.zeros((n, per_key), dtype=bool)
    parts = []
    for a in answers:
        (size,) = struct.unpack_from("<q", a["answer"])
        parts.append(np.unpackbits(np.frombuffer(a["answer"], np.uint8, offset=8), count=size * per_key))
    return np.concatenate(parts).astype(bool).reshape(-1, per_key)


def planes(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes; the upper ones hardly change and compress well."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, n: int, offset: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, offset).reshape(8, n).T).view("<u8").ravel()


def note(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2^31 for the block itself, small ones in few bytes."""
    import zstandard

    parts = [np.ascontiguousarray(a.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<q{len(arrays)}q", len(arrays), *map(len, arrays)) + b"".join(parts))


def noted(answers: list[dict] | None) -> list[np.ndarray] | None:
    """The arrays of the :func:`note` that came back with ``answers``, or None."""
    import zstandard

    for a in answers or []:
        if a["note"] is not None:
            raw = zstandard.ZstdDecompressor().decompress(a["note"])
            (k,) = struct.unpack_from("<q", raw)
            sizes = struct.unpack_from(f"<{k}q", raw, 8)
            starts = 8 + 8 * k + 4 * np.r_[0, np.cumsum(sizes)]
            return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<i4").ravel().astype(np.int64) for n, at in zip(sizes, starts[:-1].tolist(), strict=True)]
    return None


def edges(flags: np.ndarray) -> np.ndarray:
    """Where ``flags`` change, each after the one before; none is set before the first."""
    return np.diff(np.flatnonzero(np.diff(flags, prepend=False)), prepend=0)


def between(steps: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` flags of which ``steps`` are the :func:`edges`."""
    flags = np.zeros(n, dtype=np.uint8)
    flags[np.cumsum(steps)] = 1
    return np.bitwise_xor.accumulate(flags).astype(bool)


def digests(text: bytes, first: np.ndarray, stop: np.ndarray, salt: bytes) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of ``text`` between each ``first`` and ``stop``, as two halves.

    They are BLAKE2b under a salt that each run draws anew, so that no text can
    have been made to clash: of 10^12 strings two are confused with a chance
    below 10^-14.
    """
    from hashlib import blake2b

    fresh = blake2b(digest_size=16, salt=salt).copy
    got = []
    for a, b in zip(first.tolist(), stop.tolist(), strict=True):
        h = fresh()
        h.update(text[a:b])
        got.append(h.digest())
    halves = np.frombuffer(b"".join(got), "<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, the first foremost, and where each run of equal ones starts in it."""
    by = np.lexsort(keys[::-1])
    new = np.zeros(len(by), dtype=bool)
    new[:1] = True
    for k in keys:
        k = k[by]
        new[1:] |= k[1:] != k[:-1]
    return by, np.flatnonzero(new)


def ranges(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the ranges, ends included."""
    mark = np.bincount(first, minlength=n + 1)
    mark -= np.bincount(last + 1, minlength=n + 1)
    return np.cumsum(mark[:-1], out=mark[:-1]) > 0


def as_bits(flags: np.ndarray) -> bytes:
    """A row of flags for each key, packed, after their number."""
    return struct.pack("<q", len(flags)) + np.packbits(flags).tobytes()


def split(flags: np.ndarray, sizes: list[int]) -> list[bytes]:
    """``flags`` of several askers end to end, packed for each."""
    ends = np.cumsum(sizes)
    return [as_bits(flags[e - s : e]) for s, e in zip(sizes, ends.tolist(), strict=True)]
