import math
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from chorale.llm import decontam, lattice, license_rules, licenses, token_counts, toxicity, trie_bpe, wordbpe


def test_licenses(docs, rows, empty):
    rules = license_rules.rules()
    assert len(rules) >= 200
    for *_, k, r in rules:  # each spelling of each rule passes its keyword and the gate
        for text in license_rules.spellings(r[6:-5]):
            assert k in f" {text} " and any(g in f" {text} " for g in license_rules.gate())
    got = sorted(repr((r[0], *r[1:7], round(r[7], 9), r[8])) for r in map(tuple, licenses.scan(docs).collect()))
    assert got == sorted(repr((k, *brute.licenses(t, rules))) for k, t in rows)
    assert licenses.scan(empty).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_license_overlaps(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0 and the GNU Lesser General Public License")], "doc_id long, text string")
    assert licenses.scan(df).first().labels == "apache,apache-2.0,gpl,lgpl,licensed"


def test_license_hits_cost_in_proportion(spark):
    """A megabyte of hits; Unicode is not folded."""
    import time

    text = "copyleft and " * 77_000
    df = spark.createDataFrame([(1, text), (2, "\u212aopyleft L\u0130CENSE M\u0130T License")], "doc_id long, text string")
    licenses.scan(df.where("doc_id = 2")).collect()
    began = time.perf_counter()
    one, two = licenses.scan(df).orderBy("doc_id").collect()
    assert time.perf_counter() - began < 20
    assert (one.n_words, one.n_detections, one.labels) == (154_000, 77_000, "copyleft")
    assert two.n_base == 0 and two.labels == ""


def test_long_words_count_as_the_library_does():
    import random
    import time

    rng = random.Random(8)
    words = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz") for n in (390, 401, 2000, 20_000)] + ["a" * 5001, "hahaha" * 700]
    words.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)))
    bpe = wordbpe.load(wordbpe.default_path())
    began = time.perf_counter()
    got = bpe.merge_count(words).tolist()
    assert time.perf_counter() - began < 15
    assert got == [len(e.ids) for e in bpe.library.encode_batch(words, add_special_tokens=False)]


def library():
    return wordbpe.load(wordbpe.default_path()).library


def test_token_counts(docs, rows, empty):
    enc = library().encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = sorted(repr((k, len((t or "").encode()), len(e.ids), len(e.ids) > 2048)) for (k, t), e in zip(rows, enc, strict=True))
    assert sorted(map(repr, map(tuple, token_counts.count_tokens(docs).collect()))) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_encode_and_decode(docs, rows, empty):
    lib = library()
    enc = lib.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = sorted(repr((k, len(e.ids), brute.sha(struct.pack(f"<{len(e.ids)}I", *e.ids)), brute.sha(lib.decode(e.ids, skip_special_tokens=False)))) for (k, _), e in zip(rows, enc, strict=True))
    assert sorted(map(repr, map(tuple, trie_bpe.digests(docs).collect()))) == want
    ids = trie_bpe.encode(docs)
    assert sorted(repr((r.doc_id, list(r.ids))) for r in ids.collect()) == sorted(repr((k, e.ids)) for (k, _), e in zip(rows, enc, strict=True))
    back = trie_bpe.decode(ids)
    assert sorted(repr((r.doc_id, r.text)) for r in back.collect()) == sorted(repr((k, lib.decode(e.ids, skip_special_tokens=False))) for (k, _), e in zip(rows, enc, strict=True))
    assert trie_bpe.digests(empty).count() == 0


def test_random_words_encode_as_the_library_does():
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("aaabcdeeefghiilmnnoprsttuxyzéß日!?'19") for _ in range(rng.randint(1, 24))) for _ in range(20_000)]
    words += ["a" * n for n in range(1, 60)] + ["hahaha" * n for n in range(1, 10)]
    bpe = wordbpe.load(wordbpe.default_path())
    raw = [w.encode() for w in words]
    counts = token_counts._known(wordbpe.default_path(), [raw])
    ids = trie_bpe._known(wordbpe.default_path(), [raw])
    for w, r, e in zip(words, raw, bpe.library.encode_batch(words, add_special_tokens=False), strict=True):
        assert counts[r] == len(e.ids) and ids[r][1] == struct.pack(f"<{len(e.ids)}I", *e.ids), w


def items(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    return bench + [(900, "mit license"), (901, None), (902, ""), (None, "w3 w4 w5"), (900, "q"), (903, " ".join(f"W{i}" for i in range(30)))]


@pytest.mark.parametrize("pass_bytes", [decontam.PASS_BYTES, 2000])
def test_leaks(spark, docs, rows, empty, pass_bytes):
    bench = spark.createDataFrame(items(spark), "item_id long, text string")
    got = decontam.digests(decontam.find_leaks(docs, bench, pass_bytes=pass_bytes))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute.leaks(rows, items(spark))))
    assert decontam.digests(decontam.find_leaks(empty, bench, pass_bytes=pass_bytes)).count() == 0
    assert decontam.digests(decontam.find_leaks(docs, bench.where("false"))).agg(F.sum("n_hit")).first()[0] == 0


@pytest.mark.parametrize("pass_bytes", [1 << 22, 100])
def test_decontaminate(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontam, "PASS_BYTES", pass_bytes)
    leak = " ".join(f"leak{i}" for i in range(13))
    other = " ".join(f"more{i}" for i in range(13))
    clean = " ".join(f"c{i}" for i in range(400))
    df = spark.createDataFrame([(1, f"a {leak} b", "x"), (2, f"{clean}, {leak.upper()}! end", "y"), (3, clean, "z"), (4, None, "n"), (5, "", "e")], "doc_id long, text string, __s string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(df, spark.createDataFrame([(1, leak), (2, other)], "item_id long, text string")).collect()}
    assert got == {2: f"{clean}, ! end", 3: clean, 4: None, 5: ""}


def test_segments():
    s = [4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]
    assert toxicity.maximal_segments(s) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    assert toxicity.maximal_segments([-1.0, -2.0]) == [] and toxicity.maximal_segments([]) == []


def segments(s, a=0, b=None):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    b = len(s) if b is None else b
    best, at = 0.0, None
    for i in range(a, b):
        total = 0.0
        for j in range(i, b):
            total += s[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    return [] if at is None else [*segments(s, a, at[0]), (*at, best), *segments(s, at[1], b)]


def test_segments_are_the_maximal_ones():
    import random

    rng = random.Random(6)
    for _ in range(200):
        s = [rng.uniform(-2, 1.5) for _ in range(rng.randint(0, 40))]
        got = toxicity.maximal_segments(s)
        want = segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_toxicity_scores(spark, docs, rows):
    """Scores against a plain version, with a model that was learned and one under which passages abound."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    twice = docs.unionByName(docs)  # repeated rows of an id are one training document
    learned, again = toxicity.learn(docs, labels), toxicity.learn(twice, labels)
    assert learned.word == again.word and learned.weights == pytest.approx(again.weights)
    eager = toxicity.Model({w.encode(): (9, 1) for w in "w1 w2 w3 word the a of ab and to in".split()}, 20, 400)
    eager.rate, eager.k, eager.weights = 0.9, 0.05, (-2.0, 0.3)

    def plain(m, text):
        words = brute.FOLDED.findall(brute.low(text))
        seen, s = Counter(), []
        for w in (w.encode() for w in words):
            odds = m.word[w] if w in m.word else m.stem.get(w[: toxicity.STEM], -toxicity.DRIFT) if len(w) > toxicity.STEM else -toxicity.DRIFT
            if odds > -toxicity.DRIFT:
                seen[w] += 1
                odds = (odds + toxicity.DRIFT) / seen[w] - toxicity.DRIFT
            s.append(odds)
        chance = math.log(max(1.0, m.k * len(s)))
        found = sorted(((m.rate * v - chance, a, b) for a, b, v in segments(s)), reverse=True)
        significant = [x for x in found if x[0] >= toxicity.SIGNIFICANT]
        e = found[0][0] if found else -chance
        for r in range(1, len(significant) + 1):
            t = sum(x[0] for x in significant[:r])
            e = max(e, t - math.log(t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))) - (r - 1) * math.log(2))
        a, b = m.weights
        return 1 / (1 + math.exp(-max(-30, min(30, a + b * max(-20, min(60, e)))))), sorted((x[1], x[2]) for x in significant)

    some = [(k, t) for k, t in rows if len((t or "").split()) < 300]
    # clusters of charged words, far apart
    some += [(7000 + k, (" calm" * 60).join([" w1 w2 w3 word the to"] * k)) for k in range(1, 6)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    many = 0
    for m in (learned, eager):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.score, sorted((p.start, p.end) for p in r.passages)) for r in toxicity.score(df, m).collect())
        want = sorted((k is None, k or 0, *plain(m, t)) for k, t in some)
        for x, y in zip(got, want, strict=True):
            assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=1e-9) and x[3] == y[3]
        many += sum(len(x[3]) > 1 for x in got)
    assert many > 5


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    scored = [(r.score, r.toxic) for r in toxicity.score(docs.where(held), model).join(labels, "doc_id").collect()]
    tox, clean = [s for s, y in scored if y], [s for s, y in scored if not y]
    auc = sum((a > b) + (a == b) / 2 for a in tox for b in clean) / len(tox) / len(clean)
    assert auc > 0.93 and sum(s >= 0.7 for s in tox) > 0.75 * len(tox) and sum(s >= 0.7 for s in clean) < 0.02 * len(clean)


def test_toxicity_edges(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    for known in (labels, labels.where("false")):
        model = toxicity.learn(docs, known)
        got = toxicity.score(docs, model)
        assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0


def test_lattice_sums_over_all_segmentations():
    import numpy as np
    import public_tokenizers

    pieces = lattice.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    scores = -np.log(np.arange(len(pieces)) + 20.0)
    scores -= np.log(np.exp(scores).sum())
    model = lattice.Lattice(pieces, scores)

    def brute_force(word):
        w = b" " + word
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * math.exp(scores[p]) for i in range(j) if (p := model.index.get(w[i:j])) is not None)
        return math.log(a[-1])

    words = [b"the", b"thanheein", "größe".encode(), b"x" * 47, b"ab" * 40, b"a", b"0123456789", bytes([255, 1, 2])]
    assert np.allclose(model.log_probabilities(words), [brute_force(w) for w in words])
    expected = model.expected(words, np.ones(len(words)))
    assert expected @ [len(p) for p in pieces] == pytest.approx(sum(len(w) + 1 for w in words))


def lattice_of(rows, rounds):
    """Piece scores and discount by forward and backward sums over each distinct training word."""
    import public_tokenizers

    pieces = lattice.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    index, scores = {p: i for i, p in enumerate(pieces)}, lattice.first_scores(len(pieces))
    counts = Counter(w for k, t in rows if not brute.held(k) for w in brute.SPACED.findall(brute.low(t)))

    def arcs(w):
        return [(i, j, index[w[i:j]]) for j in range(1, len(w) + 1) for i in range(max(0, j - 40), j) if w[i:j] in index]

    def forward(own, n, p):
        a = [1.0] + [0.0] * n
        for i, j, k in own:
            a[j] += a[i] * p[k]
        return a

    for _ in range(rounds):
        p = [math.exp(x) for x in scores]
        expected = [lattice.SMOOTH] * len(pieces)
        for w in counts:
            w = b" " + w.encode()
            own, n = arcs(w), len(w)
            if n > 60:
                for k, c in brute.long_word(w, index, scores).items():
                    expected[k] += c
                continue
            a, b = forward(own, n, p), [0.0] * n + [1.0]
            for i, j, k in reversed(own):
                b[i] += b[j] * p[k]
            for i, j, k in own:
                expected[k] += a[i] * p[k] * b[j] / a[n]
        total = sum(expected)
        scores = [math.log(x / total) for x in expected]
    return index, scores, counts, arcs


def test_lattice_scores(docs, rows, empty, small_blocks):
    """Every column against plain sums, the re-estimated score of whole documents included."""
    got = {}
    for r in lattice.score(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    index, scores, counts, arcs = lattice_of(rows, lattice.ROUNDS)
    n, v = sum(counts.values()), len(counts)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    ends = sum(not brute.held(k) for k, _ in rows)
    memo = {}

    def word(w):
        if w not in memo:
            x = b" " + w.encode()
            lat = brute.log_forward(x, index, scores)
            own = (counts[w] - d) / n if counts[w] else 0.0
            memo[w] = math.log10(own + d * v / n * math.exp(lat)) if lat > -600 else math.log10(own) if own else (math.log(d * v / n) + lat) / math.log(10)
        return memo[w]

    end = (ends + 0.5) / (n + ends + 1)
    for (k, text), (_, held, n_tokens, known, total, base) in zip(rows, brute.unigram(rows), strict=True):
        words = brute.SPACED.findall(brute.low(text))
        want = sum(map(word, words)) + len(words) * math.log10(1 - end) + math.log10(end)
        own = [r for r in got[k] if (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, known, total)]
        assert any(r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(want, rel=1e-7) for r in own), k
    assert sum(map(len, got.values())) == len(rows)
    assert lattice.score(empty).count() == 0


def test_lattice_tells_repeated_documents_apart(spark):
    """A text of rare words that the corpus has twice is likelier than those that it has once."""
    import random

    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choice("bdegiknorstu") for _ in range(6)) for _ in range(40))) for k in range(1, 60) if not brute.held(k)]
    rows += [(100 + k, t) for k, t in rows[:5] if not brute.held(100 + k)]
    twice = {t for _, t in rows[-3:]}
    text = dict(rows)
    got = {r.doc_id: r.score / r.n_tokens for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(v for k, v in got.items() if text[k] in twice) > max(v for k, v in got.items() if k < 100 and k > 10)
