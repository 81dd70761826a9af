"""Byte-level substring dedup by bucket-pointer refinement.

Each 200-byte string holds a minimiser, the 64-byte gram with the least hash,
at the same offset wherever the string stands.  In a first round blocks ask,
for the whole stretch of strings that share a minimiser, whether that stretch
stands elsewhere, and whether the minimiser has stretches of other kinds; most
text is settled so.  Strings of the stretches that remain are named inside
their block by bucket-pointer refinement: the first buckets are those of equal
8 bytes, sorted; a bucket with several positions is refined by sorting on the
buckets that the positions 8 bytes on are in, its new pointers serve to refine
to 32 bytes, and so on.  One string of each last bucket stands for it in a
second round, in which blocks compare digests of whole strings.

A block's grams, stretches and buckets are made once.  What a later round needs
of them, places and orders, goes along as a note of the block to itself.

Hashes of grams only say what to compare.  What counts as equal is decided by
pointers, which are sorted bytes, and across blocks by 128-bit digests under a
salt of the run's own.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chorale.llm.blocks import Block, Buckets, ask, between, bits, digests, edges, from_planes, growth, note, noted, pack, planes, ranges, runs, split, unpack
from chorale.llm.common import map_arrow

#: Bytes of a string that counts, and of the grams of which it has a least one.
LENGTH, Q = 200, 64
#: Hashes of a bucket, on average, before it grows with the total.
BUCKET_KEYS = 500_000
#: Starts that are looked at at once, so that the numbers stay in a core's cache;
#: 2^24 at most.  Ties go to the leftmost gram; results do not depend on it.
CHUNK = 1 << 16
_PLACE = np.uint64(24)


def words_of(text: bytes, n: int) -> np.ndarray:
    """The 8 bytes from each position as a number; zeros follow the end."""
    padded = text + bytes(8)
    out = np.empty(n, dtype=np.uint64)
    for k in range(min(8, n)):
        out[k::8] = np.frombuffer(padded, "<u8", (n - k + 7) // 8, k)
    return out


def _paired(a: np.ndarray, step: int) -> np.ndarray:
    """Hashes of twice the depth, of those ``step`` apart."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h[: max(0, len(a) - step)] += a[step:]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def refined(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bucket of each start: two are the same if their ``length`` bytes are equal.

    ``length`` is 8 or more.  Pointers of every depth are exact: they number
    sorted 8-byte words first, then sorted pairs of pointers of half the depth.
    Positions that are alone in their bucket are not sorted again.
    """
    inside = ranges(starts, starts + length - 1, len(text))
    place = np.cumsum(inside) - 1
    starts = place[starts]
    n = int(place[-1]) + 1 if len(place) else 0
    # positions near a stretch's end read on into the next; no start depends on them
    _, pointer = np.unique(words_of(text[inside].tobytes(), n), return_inverse=True)
    depth = 8
    while depth < length and n:
        step = min(depth, length - depth)
        count = np.bincount(pointer)
        several = np.flatnonzero(count[pointer] > 1)
        if not len(several):
            break
        # as one number, which sorts faster than two; pointers are below 2^32, and 0 stands beyond the end
        pair = pointer[several].astype(np.uint64) << np.uint64(32)
        pair |= np.r_[pointer + 1, np.zeros(step, dtype=np.int64)][several + step].astype(np.uint64)
        by = np.argsort(pair)
        first = np.flatnonzero(np.diff(pair[by], prepend=~pair[by[:1]]))
        rank = np.empty(len(several), dtype=np.int64)
        rank[by] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(several)]))
        fresh = np.arange(len(first), len(first) + n)
        fresh[several] = rank
        pointer, depth = fresh, depth + step
    return np.unique(pointer[starts], return_inverse=True)[1]


class Grams:
    """A block's bytes and the hash of the :data:`Q` bytes from each position.

    Values near a document's end reach into the next; callers leave them out.
    """

    def __init__(self, block: Block):
        self.bytes = block.text
        self.text = np.frombuffer(block.text, dtype=np.uint8)
        self.n = len(self.text)
        self.ends = block.ends.astype(np.int64)
        self.sizes = np.diff(np.r_[0, self.ends])
        words = words_of(block.text, self.n)
        self.hash = np.empty_like(words)
        for a in range(0, self.n, CHUNK):
            h, depth = words[a : a + CHUNK + Q - 8], 8
            while depth < Q:
                h = _paired(h, depth)
                depth *= 2
            self.hash[a : a + CHUNK] = h[:CHUNK]

    def minimisers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least grams of strings, leftmost among equals, and the first and last string of each.

        The strings that have a position as their minimiser start one after
        another, so each string is accounted for once.  The choice depends on a
        string's own bytes only: upper hash bits, then the place in the string.
        """
        long = self.sizes >= LENGTH
        ok = ranges((self.ends - self.sizes)[long], self.ends[long] - LENGTH, self.n)
        span = LENGTH - Q + 1
        least = []
        for a in range(0, max(0, self.n - LENGTH + 1), CHUNK):
            h = self.hash[a : a + CHUNK + span - 1]
            h = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
            have = 1
            while have < span:
                step = min(have, span - have)
                h = np.minimum(h[:-step], h[step:])
                have += step
            least.append((h[:CHUNK] & np.uint64((1 << 24) - 1)).astype(np.int64) + a)
        starts = np.flatnonzero(ok)
        if not len(starts):
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        at = np.concatenate(least)[starts]
        new = np.flatnonzero(np.r_[True, np.diff(at) != 0])
        return at[new], starts[new], starts[np.r_[new[1:] - 1, len(at) - 1]]


class Stretches:
    """A block's stretches, and the distinct (minimiser, stretch) entries that it asks about."""

    def __init__(self, grams: Grams, salt: bytes):
        self.at, self.first, self.last = grams.minimisers()
        high, low = digests(grams.bytes, self.first, self.last + LENGTH, salt)
        key = grams.hash[self.at]
        by, new = runs(key, high, low)
        self.key, self.high, self.low = key[by][new], high[by][new], low[by][new]
        self.counts = np.diff(np.r_[new, len(by)])
        self.place = np.empty(len(by), dtype=np.int64)
        self.place[by] = np.repeat(np.arange(len(new)), self.counts)

    def note(self) -> bytes:
        """Where the stretches are, and the entry of each."""
        return note(np.diff(self.first, prepend=0), self.last - self.first, self.place)


def _emit_stretches(buckets: int, salt: bytes) -> Callable[[dict], Iterator[tuple[int, bytes]]]:
    dealt = Buckets(buckets)

    def emit(row: dict) -> Iterator[tuple[int, bytes]]:
        s = Stretches(Grams(unpack(row["payload"])), salt)
        if len(s.key):
            yield None, s.note()
        for k, a, b in dealt.slices(s.key):
            yield k, struct.pack("<q", b - a) + s.key[a:b].astype("<u4").tobytes() + s.high[a:b].tobytes() + s.low[a:b].tobytes() + np.packbits(s.counts[a:b] > 1).tobytes()

    return emit


def _flags(data: bytes, n: int, offset: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=offset), count=n).astype(bool)


def _settle_stretches(asked: list[bytes]) -> list[bytes]:
    """Two bits for each entry: is its stretch elsewhere; are its strings to be asked for.

    They are if the minimiser has stretches of several kinds, by one entry of
    each kind: that one stands for the others, which are settled already.
    """
    sizes = [struct.unpack_from("<q", a)[0] for a in asked]
    key, high, low = (np.concatenate([np.frombuffer(a, t, n, 8 + at * n) for a, n in zip(asked, sizes, strict=True)]) for t, at in (("<u4", 0), ("<u8", 4), ("<u8", 12)))
    many = np.concatenate([_flags(a, n, 8 + 20 * n) for a, n in zip(asked, sizes, strict=True)])
    by, kind = runs(key, high, low)
    count = np.diff(np.r_[kind, len(by)])
    sure = np.empty(len(by), dtype=bool)
    sure[by] = np.repeat((count > 1) | np.logical_or.reduceat(many[by], kind), count)
    of = key[by][kind]
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    kinds = np.diff(np.r_[start, len(of)])
    ask_for = np.zeros(len(by), dtype=bool)
    ask_for[by[kind]] = np.repeat(kinds > 1, kinds)
    return split(np.stack([sure, ask_for], axis=1), sizes)


def _settle_strings(asked: list[bytes]) -> list[bytes]:
    """A bit for each string: does it stand elsewhere?"""
    sizes = [struct.unpack_from("<q", a)[0] for a in asked]
    high = np.concatenate([from_planes(a, n, 8) for a, n in zip(asked, sizes, strict=True)])
    low = np.concatenate([np.frombuffer(a, "<u8", n, 8 + 8 * n) for a, n in zip(asked, sizes, strict=True)])
    many = np.concatenate([_flags(a, n, 8 + 16 * n) for a, n in zip(asked, sizes, strict=True)])
    by, new = runs(high, low)
    count = np.diff(np.r_[new, len(by)])
    out = np.empty(len(by), dtype=bool)
    out[by] = np.repeat((count > 1) | np.logical_or.reduceat(many[by], new), count)
    return split(out, sizes)


class Strings:
    """What the first round left of a block: starts that are settled, and buckets of the others.

    Some starts are both: what the same stretch elsewhere settles counts on them.
    """

    def __init__(self, data: bytes, answers: list[dict] | None, salt: bytes):
        text = np.frombuffer(data, dtype=np.uint8)
        self.sure = self.ask_for = np.zeros(len(text), dtype=bool)
        self.high = self.low = np.empty(0, dtype=np.uint64)
        self.counts = self.bucket = self.rank = np.empty(0, dtype=np.int64)
        if not answers:
            return
        steps, more, place = noted(answers)
        first = np.cumsum(steps)
        last = first + more
        got = bits(answers, int(place.max()) + 1, 2)[place]
        self.sure = ranges(first[got[:, 0]], last[got[:, 0]], len(text))
        self.ask_for = ranges(first[got[:, 1]], last[got[:, 1]], len(text))
        starts = np.flatnonzero(self.ask_for)
        if not len(starts):
            return
        _, one, bucket, counts = np.unique(refined(text, starts), return_index=True, return_inverse=True, return_counts=True)
        # numbered as they come in the text, so that most differ by one from the one before
        by = np.argsort(one)
        one, counts = one[by], counts[by]
        order = np.empty(len(by), dtype=np.int64)
        order[by] = np.arange(len(by))
        self.bucket = order[bucket]
        high, low = digests(data, starts[one], starts[one] + LENGTH, salt)
        by = np.lexsort((low, high))
        self.high, self.low, self.counts = high[by], low[by], counts[by]
        self.rank = np.empty(len(by), dtype=np.int64)
        self.rank[by] = np.arange(len(by))

    def note(self) -> bytes:
        """The settled starts, those asked for, the bucket of each of these, and the place of each bucket's digest."""
        return note(edges(self.sure), edges(self.ask_for), np.diff(self.bucket, prepend=0), self.rank)


def _emit_strings(buckets: int, salt: bytes) -> Callable[[dict], Iterator[tuple[int, bytes]]]:
    dealt = Buckets(buckets)

    def emit(row: dict) -> Iterator[tuple[int, bytes]]:
        s = Strings(unpack(row["payload"]).text, row["answers"], salt)
        if not (s.sure.any() or len(s.high)):
            return
        yield None, s.note()
        # a block all of whose starts are settled asks for nothing, so that its note comes back
        for k, a, b in dealt.slices(s.high) or [(row["block_id"] % buckets, 0, 0)]:
            yield k, struct.pack("<q", b - a) + planes(s.high[a:b]) + s.low[a:b].tobytes() + np.packbits(s.counts[a:b] > 1).tobytes()

    return emit


def _covered(n: int, answers: list[dict] | None) -> np.ndarray:
    """Which of a block's bytes lie in a string that also stands elsewhere, by what the second round says."""
    if not answers:
        return np.zeros(n, dtype=bool)
    sure, ask_for, steps, rank = noted(answers)
    sure, starts = between(sure, n), np.flatnonzero(between(ask_for, n))
    sure[starts[bits(answers, len(rank))[:, 0][rank][np.cumsum(steps)]]] = True
    starts = np.flatnonzero(sure)
    return ranges(starts, starts + LENGTH - 1, n)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    Removed is each byte of a ``LENGTH``-byte string that also starts at any
    other place, of the same document or another; strings do not cross
    documents and are judged on the input.  Every copy goes, the first too;
    equal rows are places of their own.  ``with_bytes`` adds the remaining
    bytes as kept.  A null text is empty; ids are integers or null; other
    columns, whatever their names, are not read; an empty table gives no rows;
    rows come back one for one.

    Minimisers go out as 32 bits beside their bucket, which may lead to more
    questions and never loses a match.  A stretch or string leaves a block once
    however often the block has it, and buckets are ranges of a hash or digest,
    so that a passage or gram that all documents share is no hot key.
    """
    salt = os.urandom(16)
    blocks, total = pack(docs, doc_id, text)
    buckets = max(1, -(-total // int(40 * BUCKET_KEYS * growth(total))))
    shared = ask(blocks, _emit_stretches(buckets, salt), _settle_stretches, ["block_id", "payload"])
    asking = blocks.select("block_id", "payload").join(shared, "block_id", "left")
    strings = ask(asking, _emit_strings(buckets, salt), _settle_strings, ["block_id", "payload", "answers"])
    whole = blocks.select("block_id", "payload").join(strings, "block_id", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = unpack(row["payload"])
                text = np.frombuffer(block.text, dtype=np.uint8)
                sizes = np.diff(block.ends, prepend=0)
                gone = _covered(len(text), row["answers"])
                kept, removed, spans = [], [], []
                for e, size in zip(block.ends.tolist(), sizes.tolist(), strict=True):
                    g = gone[e - size : e]
                    removed.append(int(g.sum()))
                    spans.append(int(np.count_nonzero(g & ~np.r_[False, g[:-1]])) if size else 0)
                    kept.append(block.text[e - size : e] if not removed[-1] else text[e - size : e][~g].tobytes())
                out = {
                    "doc_id": pa.array(block.id_list(), pa.int64()),
                    "n_bytes": pa.array(sizes, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                }
                if with_bytes:
                    out["kept"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return map_arrow(whole.select("payload", "answers"), finish, schema)
