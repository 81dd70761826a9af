"""What Python workers keep and need: they share an executor's memory with its JVM."""

import tracemalloc

import numpy as np
import pyarrow as pa

from chorale.llm import blocks, common, trie_bpe, wordbpe
from chorale.llm.difference_cover import Words


def test_workers_let_go_of_other_operators_caches(spark, docs):
    """On a worker, after its BPE and then another operator's task."""

    def kept(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(trie_bpe._memo), len(trie_bpe._encoders), wordbpe.load.cache_info().currsize], pa.int64())})

    def left(module):
        kept.__module__ = module
        trie_bpe.digests(docs.coalesce(1)).collect()
        return [r.n for r in common.map_arrow(docs.select("doc_id").coalesce(1), kept, "n long").collect()]

    assert left(trie_bpe.__name__) == [1, 1, 1]
    assert left("chorale.llm.blocks") == [0, 0, 0]


def test_word_hashes_of_a_block_need_little_memory():
    """A block of 2 MB took 105 MB of arrays."""
    text = " ".join(f"w{i % 5000} some" for i in range(200_000)).encode()[: 2 << 20]
    ends = np.array([1 << 19, 1 << 20, len(text)])
    block = blocks.Block(np.arange(3), np.ones(3, dtype=bool), ends, text)
    tracemalloc.start()
    words = Words(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    # equal words in different slices have equal hashes
    flat = [w for t in block.texts() for w in t.split()]
    at = [i for i, w in enumerate(flat) if w == b"w7"]
    assert len(at) > 20 and len(set(words.runs_of(np.array(at), 1).tolist())) == 1
    assert len(set(words.runs_of(np.arange(words.n), 1).tolist())) == len(set(flat))
