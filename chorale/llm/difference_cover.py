"""Substring dedup on words, with difference-cover anchors.

Runs of 20 words are hashed at cover positions only.  Hashes that several
documents share are the anchors; each is extended to the whole windows that
hold it, and windows are compared by 128-bit digests of their words.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chorale.llm.blocks import Block, Buckets, ask, bits, carried, digests, from_planes, growth, pack, planes, runs, split, unpack
from chorale.llm.common import cut, keeps, map_arrow

#: A perfect difference set: every difference modulo 31 is one of two of its members.
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31
#: Words of the windows that count.
WINDOW = 50
#: Bytes of text whose words are hashed at a time.
SLICE = 128 << 10
#: Hashes of a bucket, on average.
BUCKET_KEYS = 500_000

_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.random.default_rng(5).integers(1, 1 << 63, size=256, dtype=np.uint64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        m = -(-n // (1 << 16)) << 16
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.r_[np.uint64(1), np.cumprod(np.full(m, np.uint64(x)))] for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _forget() -> None:
    _POWERS[:] = [p[:1].copy() for p in _POWERS]


keeps(__name__, _forget)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _rolling(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which a run's polynomial hash is one difference."""
    with np.errstate(over="ignore"):
        out = np.empty(len(codes) + 1, dtype=np.uint64)
        out[0] = 0
        np.multiply(codes, _powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
        np.cumsum(out[1:], dtype=np.uint64, out=out[1:])
    return out


class Words:
    """The words of a block: their hashes, and where each document's lie.

    All of it is array arithmetic on the block's bytes, hashed a slice of
    words at a time; no word becomes an object of its own.
    """

    def __init__(self, block: Block):
        text = np.frombuffer(block.text, dtype=np.uint8)
        bytes_of = np.diff(np.r_[0, block.ends])
        edge = np.zeros(len(text) + 1, dtype=bool)
        edge[block.ends] = edge[0] = True
        word = ~_SPACE[text]
        first = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
        stop = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
        self.doc = np.searchsorted(block.ends, first, side="right")
        self.block, self.lengths = block, stop - first
        self.n = len(first)
        self.sizes = np.bincount(self.doc, minlength=len(bytes_of)).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        # documents without an id come after all that have one
        self.order = np.where(block.named, block.ids, np.iinfo(np.int64).max)
        codes = np.empty(self.n, dtype=np.uint64)
        a = 0
        while a < self.n:
            b = max(a + 1, int(np.searchsorted(stop, first[a] + SLICE, side="right")))
            base = first[a]
            prefix = _rolling(_CODE[text[base : stop[b - 1]]])
            with np.errstate(over="ignore"):
                codes[a:b] = (prefix[stop[a:b] - base] - prefix[first[a:b] - base]) * _powers(len(prefix))[1][first[a:b] - base] + (stop[a:b] - first[a:b]).astype(np.uint64)
            a = b
        self.prefix = _rolling(_mixed(codes))
        self.undo = _powers(self.n + 1)[1]

    def runs_of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the ``length`` words from each of ``at``; unlike runs may have one hash."""
        with np.errstate(over="ignore"):
            return _mixed((self.prefix[at + length] - self.prefix[at]) * self.undo[at])

    def windows(self, at: np.ndarray, length: int, salt: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Digests, as two halves, of the ``length`` words from each of ``at``, joined by a space."""
        high, low = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        doc = self.doc[at]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        before = self.block.ends - np.diff(np.r_[0, self.block.ends])
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            if a == b:
                continue
            d = int(doc[a])
            start = int(self.starts[d])
            text = b" ".join(self.block.text[before[d] : self.block.ends[d]].split())
            stop = np.cumsum(self.lengths[start : int(self.ends[d])] + 1) - 1
            own = at[a:b] - start
            high[a:b], low[a:b] = digests(text, np.r_[0, stop + 1][own], stop[own + length - 1], salt)
        return high, low

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions of documents that have a window, and their hashes.

        Two equal windows, wherever they start, have an offset below the
        period at which both stand on a cover position; the words hashed there
        end within the window.
        """
        length = window - PERIOD + 1
        inside = np.arange(self.n) - self.starts[self.doc]
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(cover[inside % PERIOD] & (inside + length <= self.sizes[self.doc]) & (self.sizes[self.doc] >= window))
        return at, self.runs_of(at, length)


def _by_key(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted; each one's lowest and highest order; each place's key."""
    by = np.argsort(keys, kind="stable")
    k, o = keys[by], order[by]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    place = np.empty(len(keys), dtype=np.int64)
    if not len(k):
        return k, o, o, place
    place[by] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(k)]))
    return k[starts], np.minimum.reduceat(o, starts), np.maximum.reduceat(o, starts), place


def _settle_shared(asked: list[bytes]) -> list[bytes]:
    """For each key: is it in two documents, of one block or of several?"""
    sizes = [struct.unpack_from("<q", a)[0] for a in asked]
    keys = np.concatenate([np.frombuffer(a, "<u4", n, 8) for a, n in zip(asked, sizes, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8, offset=8 + 4 * n), count=n) for a, n in zip(asked, sizes, strict=True)]).astype(bool)
    by = np.argsort(keys, kind="stable")
    k = keys[by]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    counts = np.diff(np.r_[starts, len(k)])
    yes = (counts > 1) | np.logical_or.reduceat(many[by], starts)
    out = np.empty(len(k), dtype=bool)
    out[by] = np.repeat(yes, counts)
    return split(out, sizes)


class Windows:
    """Candidate windows of a block: distinct digests, sorted, and the smallest order of each."""

    def __init__(self, words: Words, answers: list[dict] | None, window: int, salt: bytes):
        self.at = _candidates(words, answers, window)
        self.own = words.order[words.doc[self.at]]
        high, low = words.windows(self.at, window, salt)
        by, new = runs(high, low)
        self.high, self.low = high[by][new], low[by][new]
        self.least = np.minimum.reduceat(self.own[by], new) if len(new) else self.own
        self.place = np.empty(len(by), dtype=np.int64)
        self.place[by] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(by)]))


def _settle_first(asked: list[bytes]) -> list[bytes]:
    """For each window: does a document of another block, of a smaller id, have it?"""
    sizes, highs, lows, orders = [], [], [], []
    for a in asked:
        n, base, width = struct.unpack_from("<qqq", a)
        sizes.append(n)
        highs.append(from_planes(a, n, 24))
        lows.append(np.frombuffer(a, "<u8", n, 24 + 8 * n))
        orders.append(np.frombuffer(a, f"<u{width}", n, 24 + 16 * n).astype(np.uint64).astype(np.int64) + base)
    order = np.concatenate(orders)
    by, new = runs(np.concatenate(highs), np.concatenate(lows))
    least = np.repeat(np.minimum.reduceat(order[by], new), np.diff(np.r_[new, len(by)]))
    out = np.empty(len(by), dtype=bool)
    out[by] = least < order[by]
    return split(out, sizes)


def _emit_anchors(buckets: int, window: int) -> Callable[[dict], Iterator[tuple[int, bytes]]]:
    ranges = Buckets(buckets)

    def emit(row: dict) -> Iterator[tuple[int, bytes]]:
        words = Words(unpack(row["payload"]))
        at, h = words.anchors(window)
        keys, low, high, _ = _by_key(h, words.order[words.doc[at]])
        many = low < high
        for k, a, b in ranges.slices(keys):
            yield k, struct.pack("<q", b - a) + keys[a:b].astype("<u4").tobytes() + np.packbits(many[a:b]).tobytes()

    return emit


def _candidates(words: Words, answers: list[dict] | None, window: int) -> np.ndarray:
    """Starts of the windows that hold a shared anchor."""
    at, h = words.anchors(window)
    if not len(at) or not answers:
        return np.empty(0, dtype=np.int64)
    keys, place = np.unique(h, return_inverse=True)
    shared = bits(answers, len(keys))[:, 0][place]
    mark = np.zeros(words.n + PERIOD + 1, dtype=np.int32)
    mark[at[shared] + 1] = 1
    total = np.cumsum(mark)
    starts = np.arange(words.n)
    holds = total[np.minimum(starts + PERIOD, words.n)] > total[starts]
    return np.flatnonzero(holds & (starts + window <= words.ends[words.doc]))


def _emit_windows(buckets: int, window: int, salt: bytes) -> Callable[[dict], Iterator[tuple[int, bytes]]]:
    ranges = Buckets(buckets)

    def emit(row: dict) -> Iterator[tuple[int, bytes]]:
        w = Windows(Words(unpack(row["payload"])), row["answers"], window, salt)
        for k, a, b in ranges.slices(w.high):
            base = int(w.least[a:b].min())
            span = int(w.least[a:b].max()) - base
            width = 4 if span < 1 << 32 else 8
            order = (w.least[a:b].astype(np.uint64) - np.uint64(base & (1 << 64) - 1)).astype(f"<u{width}")
            yield k, struct.pack("<qqq", b - a, base, width) + planes(w.high[a:b]) + w.low[a:b].tobytes() + order.tobytes()

    return emit


def _removed(words: Words, row: dict, window: int, salt: bytes) -> np.ndarray:
    """Which of a block's words lie in a window that an earlier document has."""
    w = Windows(words, row["answers"], window, salt)
    mark = np.zeros(words.n + 1, dtype=np.int32)
    if len(w.at):
        gone = w.at[(w.least[w.place] < w.own) | bits(row["windows"], len(w.high))[:, 0][w.place]]
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + window, -1)
    return np.cumsum(mark[:-1]) > 0


def _judged(docs: DataFrame, window: int, doc_id: str, text: str, carry: bool) -> tuple[DataFrame, bytes]:
    """Blocks with the answers from which :func:`_removed` tells what goes, and the digests' salt."""
    if window < PERIOD + 8:
        raise ValueError(f"windows have {PERIOD + 8} words or more")
    salt = os.urandom(16)
    blocks, total = pack(docs, doc_id, text, carry)
    buckets = max(1, -(-total // int(30 * BUCKET_KEYS * growth(total))))  # an anchor takes about 30 bytes of text
    shared = cut(ask(blocks, _emit_anchors(buckets, window), _settle_shared, ["block_id", "payload"]))
    asking = blocks.join(shared, "block_id", "left")
    firsts = ask(asking, _emit_windows(buckets, window, salt), _settle_first, ["block_id", "payload", "answers"])
    return asking.join(firsts.withColumnRenamed("answers", "windows"), "block_id", "left"), salt


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words that :func:`dedup` removes taken out of the texts.

    A text that loses words is its kept words, joined by one space; others
    stay as they are, a null one null.  All rows and columns are kept, whatever
    the columns are named; repeated ids and null ones count as in
    :func:`dedup`; an empty table stays empty.
    """
    whole, salt = _judged(docs, window, doc_id, text, carry=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = unpack(row["payload"])
                words = Words(block)
                gone = _removed(words, row, window, salt)
                texts = block.texts()
                for i, (a, n) in enumerate(zip(words.starts.tolist(), words.sizes.tolist(), strict=True)):
                    g = gone[a : a + n]
                    if g.any():
                        texts[i] = b" ".join([w for w, x in zip(texts[i].split(), g.tolist(), strict=True) if not x])
                rest, missing = carried(row["rest"])
                mended = pa.array([None if m else t for t, m in zip(texts, missing, strict=True)], pa.binary()).cast(pa.string())
                columns = [pa.chunked_array([mended]) if c == text else rest.column(c) for c in names]
                yield from pa.Table.from_arrays(columns, names).combine_chunks().to_batches()

    names = docs.columns
    return map_arrow(whole.select("payload", "rest", "answers", "windows"), finish, docs.schema)


def dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    A word is removed if it lies in ``window`` consecutive words that also
    start somewhere in a document of a smaller id.  Words are runs of non-white
    space, kept words are joined by one space.  Null or empty texts have no words.  Ids are integers; rows of
    equal ids do not remove from one another; a null id counts as larger than
    any other.  Rows come back one for one.

    Each document hashes a run of words at the positions of a difference cover
    only; what two documents share names the windows that can match, and their
    hashes of the whole window decide, with the smallest id of each.  Anchors
    are cut to 32 bits beside their bucket, which may add windows to compare
    and never loses one; windows are told apart by 128-bit digests under a
    salt of the run's own.  Other columns are not read; an empty table gives no
    rows.
    """
    whole, salt = _judged(docs, window, doc_id, text, carry=False)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = unpack(row["payload"])
                words = Words(block)
                gone = _removed(words, row, window, salt)
                total = np.r_[0, np.cumsum(gone)]
                counts = (total[words.ends] - total[words.starts]).tolist()
                kept = []
                for t, a, n in zip(block.texts(), words.starts.tolist(), counts, strict=True):
                    part = t.split()
                    if n:
                        part = [w for w, g in zip(part, gone[a : a + len(part)].tolist(), strict=True) if not g]
                    kept.append(b" ".join(part))
                out = {
                    "doc_id": pa.array(block.id_list(), pa.int64()),
                    "n_words": pa.array(words.sizes),
                    "n_removed": pa.array(counts, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return map_arrow(whole.select("payload", "answers", "windows"), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
