"""Benchmark decontamination by a broadcast set of normalised n-grams."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import keeps, keyed_texts, map_arrow, named, slices

#: Bytes of benchmark text per pass; each pass broadcasts at most about this.
PASS_BYTES = 4 << 20

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Vocabulary(dict):
    """Ids of the benchmark's words; every other word is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Windows:
    """The windows of some benchmark items, looked up by a rolling hash.

    A candidate is compared word by word with the window it names, so a hash
    collision is never a hit.
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.ids = _Vocabulary()
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in text.translate(FOLD).split()]
            for at in range(max(1, len(words) - n + 1) if words else 0):
                found.setdefault(tuple(words[at : at + n]), set()).add(item)
        rng = np.random.default_rng(7)
        self.code = rng.integers(1, 1 << 63, size=len(self.ids) + 1, dtype=np.uint64)
        self.power = np.ones(1, dtype=np.uint64)
        self.undo = np.ones(1, dtype=np.uint64)
        self.by_length = []
        for length in sorted({len(k) for k in found}):
            keys = [k for k in found if len(k) == length]
            rows = np.array(keys, dtype=np.int64).reshape(len(keys), length)
            self._grow(length)
            with np.errstate(over="ignore"):
                code = (self.code[rows] * self.power[:length]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(code, kind="stable")
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(code >> np.uint64(44)).astype(np.int64)] = True
            self.by_length.append((length, code[order], rows[order], [sorted(found[keys[i]]) for i in order], bits))

    def _grow(self, n: int) -> None:
        if len(self.power) < n + 1:
            with np.errstate(over="ignore"):
                self.power = np.r_[np.uint64(1), np.cumprod(np.full(2 * n, _ODD))]
                self.undo = np.r_[np.uint64(1), np.cumprod(np.full(2 * n, _UNDO))]

    def hits(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """For word ids of some texts that end at ``ends``: words hit, items by text."""
        n = len(words)
        mark = np.zeros(n + 1, dtype=np.int32)
        items: list[set[str]] = [set() for _ in ends]
        if not n or not self.by_length:
            return np.zeros(n, dtype=bool), items
        self._grow(n)
        with np.errstate(over="ignore"):
            prefix = np.r_[np.uint64(0), np.cumsum(self.code[words] * self.power[:n], dtype=np.uint64)]
            for length, codes, rows, owners, bits in self.by_length:
                if length > n:
                    continue
                code = (prefix[length:] - prefix[:-length]) * self.undo[: n - length + 1]
                at = np.flatnonzero(bits[(code >> np.uint64(44)).astype(np.int64)])
                doc = np.searchsorted(ends, at, side="right")
                at = at[at + length <= ends[doc]]
                first = np.searchsorted(codes, code[at])
                while len(at):  # equal codes stand side by side
                    inside = first < len(codes)
                    at, first = at[inside], first[inside]
                    same = codes[first] == code[at]
                    at, first = at[same], first[same]
                    true = np.ones(len(at), dtype=bool)
                    for k in range(length):
                        true &= words[at + k] == rows[first, k]
                    here, which = at[true], first[true]
                    np.add.at(mark, here, 1)
                    np.add.at(mark, here + length, -1)
                    pairs = np.unique((np.searchsorted(ends, here, side="right") << 32) | which)
                    for d, w in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
                        items[d].update(owners[w])
                    first = first + 1
        return np.cumsum(mark[:-1]) > 0, items


_built: list = []
keeps(__name__, _built.clear)


def _windows(shared, key: str, n: int) -> Windows:
    """The windows of a broadcast part of the benchmark, built once per Python worker."""
    if not _built or _built[0] != (key, n):
        _built[:] = [(key, n), Windows(shared.value, n)]
    return _built[1]


def _chunks(benchmark: DataFrame, item_id: str, text: str, pass_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items, in parts of about ``pass_bytes`` of text."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // pass_bytes))
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield [(r.item, r.text.encode()) for r in part.collect()]


def _scan(rows: DataFrame, items: list[tuple[str, bytes]], n: int, only_hits: bool) -> DataFrame:
    shared, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared, name, n)
        get = windows.ids.__getitem__
        for batch, texts in slices(batches):
            parts = [t.translate(FOLD).split() for t in texts]
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            ends = np.cumsum(sizes)
            words = np.fromiter((i for p in parts for i in map(get, p)), dtype=np.int64, count=int(ends[-1]))
            hit, found = windows.hits(words, ends)
            edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            spans: list[list[int]] = [[] for _ in parts]
            for a, b in edge.reshape(-1, 2).tolist():  # runs that touch at a text's end belong to both
                d = int(np.searchsorted(ends, a, side="right"))
                while a < b:
                    base = int(ends[d] - sizes[d])
                    to = min(b, int(ends[d]))
                    if to > a:
                        spans[d] += [a - base, to - base]
                    a, d = max(a, to), d + 1
            out = pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "key": batch.column("key"),
                "n_words": pa.array(sizes),
                "spans": pa.array(spans, pa.list_(pa.int64())),
                "items": pa.array([sorted(x) for x in found], pa.list_(pa.string())),
            })
            yield out.filter(pa.array([bool(s) for s in spans])) if only_hits else out

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, n_words long, spans array<long>, items array<string>")


def _clean(docs: DataFrame, items: list[tuple[str, bytes]], n: int, share: int, text: str) -> DataFrame:
    """:func:`decontaminate` in one pass, for a benchmark of one part."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared, name, n)
        get = windows.ids.__getitem__
        for batch, texts in slices(batches, text):
            parts = [(t or b"").translate(FOLD).split() for t in texts]
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            ends = np.cumsum(sizes)
            hit, _ = windows.hits(np.fromiter((i for p in parts for i in map(get, p)), dtype=np.int64, count=int(ends[-1])), ends)
            keep = []
            for k, (e, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                own = hit[e - size : e]
                some = int(own.sum())
                keep.append(not some or share * some < size)
                if some and keep[-1]:
                    texts[k] = cut_words(texts[k], np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).tolist())
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(texts, pa.binary()).cast(pa.string())).filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def _merged(spans: list[list[int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted((int(s[i]), int(s[i + 1])) for s in spans for i in range(0, len(s), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, key, n_words, spans and items of every row of ``docs``.

    ``spans`` are the maximal runs of words inside an occurrence of a
    benchmark window (start and end by turns, in words from 0), ``items`` the
    sorted ids, as strings, of the items that own those windows.  A window is
    ``n`` words of an item, or all of a shorter one.

    The benchmark is measured first.  Up to ``pass_bytes`` it is one broadcast
    and one pass without a shuffle; a larger one is dealt into parts of about
    that size, each a pass of its own, whose hits (only documents that have
    some) are merged by document.  Null or empty texts have no words; a null
    item id is the empty string; equal rows come back as often as they came.
    """
    rows = keyed_texts(docs, doc_id, text).withColumn("key", F.xxhash64("text"))
    chunks = _chunks(benchmark, item_id, item_text, pass_bytes)
    base = _scan(rows, next(chunks), n, only_hits=False)
    more = None
    for items in chunks:
        part = _scan(rows, items, n, only_hits=True)
        more = part if more is None else more.unionByName(part)
    if more is None:
        return base
    merge = F.pandas_udf(lambda spans: spans.map(_merged), "array<long>")
    same = ["doc_id", "key"]
    more = more.groupBy(*same).agg(F.collect_set("spans").alias("s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("i"))
    a, b = base.alias("a"), more.alias("b")
    return a.join(b, F.expr("a.key = b.key and a.doc_id <=> b.doc_id"), "left").select(
        "a.doc_id", "a.key", "a.n_words",
        merge(F.concat(F.array("a.spans"), F.coalesce("b.s", F.array().cast("array<array<long>>")))).alias("spans"),
        F.array_sort(F.array_union("a.items", F.coalesce("b.i", F.array().cast("array<string>")))).alias("items"),
    )


def digests(leaks: DataFrame, share: int = 20) -> DataFrame:
    """The counts, item digest and verdict of :func:`find_leaks`' rows."""
    hit = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("spans") - 2, F.lit(0)), F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.size("spans") > i, F.get("spans", i + 1) - F.get("spans", i)).otherwise(F.lit(0)))
    return leaks.withColumn("n_hit", F.coalesce(hit, F.lit(0))).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def cut_words(text: bytes, spans: list[int]) -> bytes:
    """``text`` without the words of ``spans``, each run leaving one space."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out += [text[at : words[a][0]]]
        at = words[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, hit spans cut out of the rest.

    A document goes if its hit words are a ``share``-th of its words or more;
    from others the hit words are removed; documents without a hit stay as
    they are.  All columns are kept, whatever their names; null texts stay null
    and empty ones empty; repeated rows go or stay alike; an empty table stays
    empty, and an empty benchmark removes nothing.
    """
    if benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0] <= PASS_BYTES:
        return _clean(docs, next(_chunks(benchmark, "item_id", "text", PASS_BYTES)), n, share, text)
    leaks = find_leaks(docs, benchmark, n, doc_id, text).where(F.size("spans") > 0).select("doc_id", "key", "n_words", "spans").dropDuplicates(["doc_id", "key"])
    # the row is one column, so that no name of it can clash
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"))
    whole = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    joined = rows.join(leaks, (F.xxhash64(whole) == F.col("key")) & F.col("row")[doc_id].eqNullSafe(F.col("doc_id")), "left")
    hit = F.expr("aggregate(sequence(0, size(spans) div 2 - 1), 0L, (s, i) -> s + spans[2 * i + 1] - spans[2 * i])")
    clean = joined.where("spans is null").select("row.*")
    mended = joined.where(F.col("spans").isNotNull() & (share * hit < F.col("n_words")))
    cut = F.pandas_udf(_cut_series, "string")
    return clean.unionByName(mended.select(*[cut(whole, F.col("spans")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]))


def _cut_series(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_words(t.encode(), list(s)).decode() for t, s in zip(texts, spans, strict=True)], dtype=object)

