import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"w{i}" for i in range(70))
#: Nulls, empty and long texts, ties, repeated rows, texts at the edges of each window.
ODD = [
    (10**9, None), (10**9 + 1, ""), (10**9 + 2, "   \n "), (None, LONG), (10**9 + 3, LONG), (10**9 + 3, LONG), (-5, "x y " + LONG), (None, None),
    (7, "a " * 120), (8, "ab" * 99), (9, "é" * 100), (11, "é" * 99 + "ab"), (12, LONG[:199]), (13, "q" * 200), (14, "q" * 199), (15, "MIT License"),
    (16, "the MIT-License; apache  LICENSE general public license mit license"), (17, "word " * 20_000), (18, "x" * 50_000),
    (19, "SPDX-License-Identifier: GPL-3.0-or-later Licensed under the Apache License, Version 2.0. All rights reserved, CC BY-NC-SA 4.0 É"),
    (20, "İstanbul ﬁ <|endoftext|>x<|startoftext|> don't I'LL 日本語 😀\x1cz é ́"), (21, " ".join(f"w{i}" for i in range(49))), (22, " ".join(f"w{i}" for i in range(50))),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Driver documents and odd ones, with extra columns of clashing names."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:20])]
    full = [(k, t, "k", 1, 2, "p", 0.5) for k, t in rows + ODD]
    return spark.createDataFrame(full, "doc_id long, text string, key string, fp int, n_words int, payload string, score double").repartition(3).localCheckpoint()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks and buckets from little text."""
    from chorale.llm import blocks, difference_cover, lattice, suffix_buckets

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(difference_cover, "BUCKET_KEYS", 3000)
    monkeypatch.setattr(suffix_buckets, "BUCKET_KEYS", 3000)
    monkeypatch.setattr(lattice, "BUCKET_WORDS", 1000)
