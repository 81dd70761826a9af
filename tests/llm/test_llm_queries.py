"""The registered queries, against their SQL, and the pipeline against its parts."""

import pytest

import brute
import corpus_pipeline
from chorale.llm import registry, toxicity
from oracle import connect, same
from test_near_copies import groups

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert same(connect(FOLDER), registry.ORACLES[name], registry.QUERIES[name](spark, FOLDER)) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.learn(docs, labels)).where("score >= 0.7").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    least = {}
    for (k, _), g in zip(rows, groups(rows), strict=True):
        least[g] = min(least.get(g, k), k)
    first = set(least.values())
    rows = [r for r in rows if r[0] in first]
    counts = {k: n for k, _, n, _ in brute.word_repeats(rows)}
    got = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, FOLDER).localCheckpoint()
        got[name] = {r.doc_id: r for r in before.collect()}
    assert set(got["toxicity"]) == {r.doc_id for r in docs.collect()} - toxic
    assert set(got["simhash_near_dedup"]) == first
    sub = got["substring_dedup"]
    assert set(sub) == first and all((sub[k].text == t) == (not counts[k]) for k, t in rows)
    assert all(r.n_chars == len(r.text) for r in sub.values())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {k for k, *_, c in brute.leaks([(k, r.text) for k, r in sub.items()], bench) if c}
    assert set(got["decontamination"]) == first - bad == set(got["bpe"])
    assert not any(n for _, _, n, *_ in brute.leaks([(k, r.text) for k, r in got["decontamination"].items()], bench))
    assert [tuple(r) for r in corpus_pipeline.run(spark, FOLDER).orderBy("doc_id").collect()] == [tuple(got["bpe"][k]) for k in sorted(got["bpe"])]
