import random

import numpy as np
import pytest

import brute
import corpus_pipeline
from chorale.llm import near_copies


def shingles(text):
    w = brute.SPACED.findall(brute.low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(rows):
    """The group of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def edited(rows, seed=5):
    """Copies with one to many words replaced: similarity from about 0.6 to 1."""
    rng = random.Random(seed)
    out = []
    for k, (_, t) in enumerate(rows):
        w = (t or "").split()
        if 40 < len(w) < 2000:
            for i in rng.sample(range(len(w)), rng.randint(1, max(1, len(w) // 22))):
                w[i] = f"new{rng.randint(0, 10**6)}"
            out.append((5000 + k, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def copies(rows):
    named = list({k: (k, t) for k, t in rows if k is not None}.values())
    return named + edited(named[:150])


@pytest.mark.parametrize("parts", [(2048, 1 << 20), (3, 500)])
def test_stage_keeps_the_first_of_each_jaccard_group(spark, copies, parts, monkeypatch):
    monkeypatch.setattr(near_copies, "PART_TEXTS", parts[0])
    monkeypatch.setattr(near_copies, "PART_SHINGLES", parts[1])
    df = spark.createDataFrame([(k, t, 1.0) for k, t in copies], "doc_id long, text string, score double").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    least = {}
    for (k, _), g in zip(copies, groups(copies), strict=True):
        least[g] = min(least.get(g, k), k)
    assert len(least) < len(copies) - 50
    assert sorted(r.doc_id for r in got.collect()) == sorted(least.values())


def test_similar_sets_share_a_prefix_shingle():
    rng = np.random.default_rng(2)
    common = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    count = rng.integers(3, 9, len(common))
    met = 0
    for size in (1, 2, 5, 9, 30, 200, 470, 2000):
        for _ in range(60):
            a = np.unique(np.r_[rng.integers(0, 1 << 63, size, dtype=np.uint64), rng.choice(common, rng.integers(0, 30))])
            b = np.unique(np.r_[rng.choice(a, max(1, int(len(a) * rng.uniform(0.75, 1))), replace=False), rng.integers(0, 1 << 63, len(a) // 9, dtype=np.uint64)])
            if alike(set(a.tolist()), set(b.tolist())):
                met += 1
                assert len(np.intersect1d(near_copies.prefix(a, common, count), near_copies.prefix(b, common, count)))
                assert near_copies.maybe_similar([near_copies.bins(a), near_copies.bins(b)], np.array([len(a), len(b)]))(0, np.array([1]))[0]
    assert met > 50


def test_empty_table(spark, empty):
    assert near_copies.keep_first(empty).count() == 0


def test_stages_after_it(spark):
    """Each stage against its plain version, with near-copies by Jaccard similarity."""
    folder = "/root/testdata/sf0.001"
    before, got = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, folder).localCheckpoint()
        got[name] = {r.doc_id: r for r in before.collect()}
    rows = [(k, r.text) for k, r in sorted(got["toxicity"].items())]
    least = {}
    for (k, _), g in zip(rows, groups(rows), strict=True):
        least[g] = min(least.get(g, k), k)
    first = set(least.values())
    assert set(got["simhash_near_dedup"]) == first == set(got["substring_dedup"])
    rows = [r for r in rows if r[0] in first]
    counts = {k: n for k, _, n, _ in brute.word_repeats(rows)}
    sub = got["substring_dedup"]
    assert all((sub[k].text == t) == (not counts[k]) for k, t in rows)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {k for k, *_, c in brute.leaks([(k, r.text) for k, r in sub.items()], bench) if c}
    assert set(got["decontamination"]) == first - bad == set(got["bpe"])


def test_repeated_and_missing_ids(spark, rows):
    """Rows of one id with unlike texts both stay, rows without an id take part."""
    rng = random.Random(1)
    plain = [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(6)]
    own = [(1, plain[0]), (1, plain[1]), (2, plain[1] + " more"), (3, plain[2]), (None, plain[2]), (None, plain[3]), (None, plain[3]), (None, plain[3] + " more"), (None, plain[4]), (4, plain[5]), (4, plain[5])]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(2)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()), key=repr)
    either = [x for x in got if x[0] is None and x[1].startswith(plain[3])]
    assert len(either) == 1
    assert sorted(set(got) - set(either), key=repr) == sorted([(1, plain[0]), (1, plain[1]), (3, plain[2]), (None, plain[4]), (4, plain[5])], key=repr) and len(got) == 6
    full = rows + edited(rows[:60])
    df = spark.createDataFrame(full, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in near_copies.keep_first(df).collect()]
    group = groups(full)
    of = {}
    for row, g in zip(full, group, strict=True):
        of.setdefault(g, []).append(row[0])
    where = dict(zip(full, group, strict=True))
    assert sorted(where[r] for r in kept) == sorted(of)
    assert all(k == min((i for i in of[where[k, t]] if i is not None), default=None) for k, t in kept)


def test_fingerprints_find_near_copies_and_decide_none(spark, copies, monkeypatch):
    """The stage's SimHash step by itself: with no other candidates, exactly the links within its bits remain."""
    rng = random.Random(3)
    long = [f"v{rng.randint(0, 10**6)}" for _ in range(3000)]
    own = copies[:150] + [(9000, " ".join(long)), (9001, " ".join(long[:-3])), (9002, " ".join(reversed(long))), (9003, " ".join(long[::2]))]
    sets = {}
    for k, t in own:
        s = near_copies.shingle_set((t or "").encode())
        sets.setdefault(s.tobytes(), (k, s))
    fold = near_copies.fold
    monkeypatch.setattr(near_copies, "_candidates", lambda texts, *_: texts.sparkSession.createDataFrame([], "a long, b long"))
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in near_copies.keep_first(df).collect()}
    assert 9000 in kept and 9001 not in kept and {9002, 9003} <= kept
    assert len(kept) < len(sets)
    # every pair within the covering's own bits that is alike was linked: one of the two is gone
    found = list(sets.values())
    links = [(a, b) for i, (a, s) in enumerate(found) for b, t in found[:i] if (fold(s) ^ fold(t)).bit_count() <= 4 and len(s) and 9 * len(np.intersect1d(s, t)) >= 4 * (len(s) + len(t))]
    assert links and not any({a, b} <= kept for a, b in links)
    # fingerprints alone link nothing: were all equal, the groups would still be those of the sets
    monkeypatch.undo()
    monkeypatch.setattr(near_copies, "_fingerprinted", lambda nodes: (nodes.select("node", near_copies.F.lit(0).cast("long").alias("near")), nodes.crossJoin(nodes.agg(near_copies.F.min("node").alias("a"))).where("a != node").selectExpr("a", "node as b")))
    least = {}
    for (k, _), g in zip(own, groups(own), strict=True):
        least[g] = min(least.get(g, k), k)
    assert sorted(r.doc_id for r in near_copies.keep_first(df).collect()) == sorted(least.values())
