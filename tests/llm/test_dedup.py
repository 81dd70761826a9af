import struct
from collections import Counter

import numpy as np
import pytest
import zstandard

import brute
from chorale.llm import blocks, components, difference_cover, simhash, suffix_buckets


def ordered(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs)
    assert ordered(got) == sorted(map(repr, brute.near_duplicates(rows)))
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_the_first_of_each_group(docs, rows):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    want = {c for k, _, c in brute.near_duplicates([r for r in rows if r[0] is not None])}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == want and len([i for i in ids if i is not None]) == len(want)
    assert ids.count(None) == sum(k is None for k, _ in rows)


def test_anchors_meet_within_the_threshold():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, size=200, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(p) for p in rng.choice(64, k, replace=False)) for b in base for k in range(1, 6)]
    fps = np.unique(np.r_[base, np.array(near, dtype=np.uint64)])
    rows, keys = simhash.anchors(fps)
    by_key = {}
    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
        by_key.setdefault(k, set()).add(r)
    met = {(a, b) for g in by_key.values() if len(g) > 1 for a in g for b in g if a < b}
    apart = np.bitwise_count(fps[:, None] ^ fps[None])
    need = {(a, b) for a, b in zip(*np.nonzero(apart <= 4), strict=True) if a < b}
    assert need <= met


def test_large_anchor_groups_are_split(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre ^ sum(1 << int(p) for p in rng.choice(64, 2, replace=False)) for _ in range(300)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for group in (8192, 16):
        found = components.components(simhash.linked_pairs(df, group))
        assert found.select("component").distinct().count() == 1 and found.count() == len(fps)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(edges.where("false")).count() == 0


def test_byte_repeats(docs, rows, empty, small_blocks):
    assert ordered(suffix_buckets.dedup(docs)) == sorted(map(repr, brute.byte_repeats(rows)))
    assert suffix_buckets.dedup(empty).count() == 0


def test_byte_repeats_return_the_bytes(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    df = spark.createDataFrame([(1, "left " + text), (2, text + " right")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in suffix_buckets.dedup(df, with_bytes=True).collect()} == {1: b"left ", 2: b" right"}


def test_word_repeats(docs, rows, empty, small_blocks):
    assert ordered(difference_cover.dedup(docs)) == sorted(map(repr, brute.word_repeats(rows)))
    assert difference_cover.dedup(empty).count() == 0
    with pytest.raises(ValueError):
        difference_cover.dedup(docs, window=30)


def test_word_repeats_taken_out_of_texts(docs, rows, small_blocks):
    got = difference_cover.remove_repeats(docs)
    assert got.columns == docs.columns
    judged = brute.word_repeats(rows)
    have = Counter((r.doc_id, brute.sha(" ".join(brute.SPACED.findall(r.text or "")))) for r in got.collect())
    assert have == Counter((k, h) for k, _, _, h in judged)
    untouched = Counter((k, t) for (k, t), (_, _, n, _) in zip(rows, judged, strict=True) if not n)
    assert untouched <= Counter((r.doc_id, r.text) for r in got.collect())


def test_cover_is_a_difference_set():
    p = difference_cover.PERIOD
    assert {(a - b) % p for a in difference_cover.COVER for b in difference_cover.COVER} == set(range(p))


def test_bucket_pointers_name_equal_bytes():
    """At each depth buckets are the classes of equal strings."""
    rng = np.random.default_rng(4)
    part = rng.integers(97, 100, 900, dtype=np.uint8)
    text = np.r_[part, rng.integers(97, 123, 500, dtype=np.uint8), part[:600], np.full(300, 120, np.uint8), part[300:]]
    for depth in (8, 16, 21, 64, 128, 200):
        starts = np.flatnonzero(rng.random(len(text) - depth) < 0.4)
        got = suffix_buckets.refined(text, starts, depth)
        name = {}
        want = [name.setdefault(text[s : s + depth].tobytes(), len(name)) for s in starts.tolist()]
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))
    assert not len(suffix_buckets.refined(text, np.empty(0, np.int64)))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_polynomial_hash_are_told_apart(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word}\n {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(difference_cover.dedup(df)) == sorted(map(repr, brute.word_repeats(rows)))
    assert {r.doc_id: r.n_removed for r in difference_cover.dedup(df).collect()} == {1: 0, 2: 0, 3: 50}


def test_strings_of_equal_gram_hash_are_told_apart(spark):
    rng = np.random.default_rng(9)
    tail = "".join(map(chr, rng.integers(33, 126, 184)))
    rows = [(1, "yc}cK_3R)`P!rJv!" + tail), (2, "`W|@[|b{,gq|xk%{" + tail), (3, "x" + tail), (4, "yc}cK_3R)`P!rJv!" + tail[:-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_buckets.dedup(df).collect()} == dict.fromkeys((1, 2, 3, 4), 0)
    # grams that hash alike only bring strings together
    again = spark.createDataFrame([*rows, (5, "zz" + rows[0][1]), (6, tail + rows[1][1] + "z")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_buckets.dedup(again).collect()} == {1: 200, 2: 200, 3: 0, 4: 0, 5: 200, 6: 200}


def test_texts_beyond_one_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix_buckets, "CHUNK", 150)
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(97, 123, 3000)))
    rows = [(1, text), (2, text[1000:1400] + "-" + text[200:900]), (3, text[2990:] + text[:10])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # chunks only cut the work: texts of any length choose alike
    assert ordered(suffix_buckets.dedup(df)) == sorted(map(repr, brute.byte_repeats(rows)))


def test_odd_column_names(spark):
    rows = [(1, "a " + " ".join(f"w{i}" for i in range(60)), 3), (2, None, 4), (3, " ".join(f"w{i}" for i in range(60)), 5)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "a.b"])
    got = {r[0]: (r[1], r[2]) for r in difference_cover.remove_repeats(df).collect()}
    assert got == {1: rows[0][1:], 2: (None, 4), 3: ("", 5)}


def test_a_blocks_grams_and_buckets_are_made_once(monkeypatch, rows):
    """The rounds of op5 without Spark: what a block has worked out comes back to it as a note."""
    made = Counter()
    for owner, name in ((suffix_buckets.Grams, "__init__"), (suffix_buckets, "refined"), (suffix_buckets.Grams, "minimisers")):
        work = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, work=work, name=name: (made.update([name]), work(*a))[1])
    salt, half = bytes(16), len(rows) // 2
    parts = []
    for part in (rows[:half], rows[half:]):
        texts = [(t or "").encode() for _, t in part]
        raw = struct.pack("<q", len(texts)) + bytes(8 * len(texts)) + np.array(list(map(len, texts)), "<i8").tobytes() + bytes(len(texts)) + b"".join(texts)
        parts.append({"block_id": len(parts) + 1, "payload": zstandard.ZstdCompressor().compress(raw)})
    for emit, settle in ((suffix_buckets._emit_stretches, suffix_buckets._settle_stretches), (suffix_buckets._emit_strings, suffix_buckets._settle_strings)):
        asked, answers = {}, {1: [], 2: []}
        for p in parts:
            got = list(emit(3, salt)(p))
            note = next((data for bucket, data in got if bucket is None), None)
            for bucket, data in got:
                if bucket is not None:
                    asked.setdefault(bucket, []).append((p["block_id"], data, note))
                    note = None
        for bucket, held in sorted(asked.items()):
            for (block, _, note), answer in zip(held, settle([h[1] for h in held]), strict=True):
                answers[block].append({"bucket": bucket, "answer": answer, "note": note})
        for p in parts:
            p["answers"] = answers[p["block_id"]]
    removed = []
    for p in parts:
        block = blocks.unpack(p["payload"])
        gone = suffix_buckets._covered(len(block.text), p["answers"])
        removed += [int(gone[e - s : e].sum()) for e, s in zip(block.ends.tolist(), np.diff(block.ends, prepend=0).tolist(), strict=True)]
    assert removed == [r[2] for r in brute.byte_repeats(rows)]
    # it was twice for refinement and three times for the rest
    assert {k: made[k] for k in ("__init__", "minimisers", "refined")} == dict.fromkeys(("__init__", "minimisers", "refined"), len(parts))


def test_notes_come_back():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 5000):
        for share in (0, 0.01, 0.5, 1):
            flags = rng.random(n) < share
            assert (blocks.between(blocks.edges(flags), n) == flags).all()
    arrays = [np.array([], dtype=np.int64), np.array([-5, 0, 1 << 30]), rng.integers(0, 1 << 31, 999)]
    back = blocks.noted([{"bucket": 0, "answer": b"", "note": None}, {"bucket": 2, "answer": b"", "note": blocks.note(*arrays)}])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back, strict=True))
    assert blocks.noted(None) is None


def test_a_block_without_open_strings_keeps_what_is_settled(spark, monkeypatch):
    """Whole copies, each in a block of its own: the second round has nothing to ask."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1000)
    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(97, 123, 900))) for _ in range(3)]
    rows = [(1, texts[0]), (2, texts[0]), (3, texts[1]), (4, texts[2]), (5, "short"), (6, None), (7, texts[2] + texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(suffix_buckets.dedup(df)) == sorted(map(repr, brute.byte_repeats(rows)))
    some = spark.createDataFrame(rows[:3], "doc_id long, text string")
    assert ordered(suffix_buckets.dedup(some)) == sorted(map(repr, brute.byte_repeats(rows[:3])))
