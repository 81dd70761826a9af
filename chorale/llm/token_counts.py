"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chorale.llm import wordbpe
from chorale.llm.common import keeps, keyed_texts, map_arrow, slices

#: Distinct words whose counts a Python worker remembers; a memo only.
MEMO = 200_000

_memo: dict[str, tuple[wordbpe.Memo, wordbpe.Memo]] = {}


def _forget() -> None:
    if _memo:
        _memo.clear()
        wordbpe.load.cache_clear()


keeps(__name__, _forget)


def _known(path: str, texts: list[list[bytes]]) -> dict[bytes, int]:
    """The memo, with every word of ``texts`` in it."""
    memo, sizes = _memo.setdefault(path, (wordbpe.Memo(MEMO), wordbpe.Memo(MEMO)))
    words = [w for w in set().union(*texts) if w not in memo]
    bpe = wordbpe.load(path)
    parts = bpe.pieces(words)
    pieces = [p for p in {p for ps in parts for p in ps} if p not in sizes]
    sizes.learn(pieces, _sizes(bpe, pieces))
    get = sizes.__getitem__
    memo.learn(words, [sum(map(get, ps)) for ps in parts])
    return memo


def _sizes(bpe: wordbpe.WordBpe, pieces: list) -> list[int]:
    """Symbols of each pre-token; a special token, an int, is one."""
    text = [p for p in pieces if isinstance(p, str)]
    found = iter(bpe.merge_count(text).tolist())
    return [next(found) if isinstance(p, str) else 1 for p in pieces]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    Counts are those of the tokenizer library without added begin or end
    tokens; special strings inside a text are one token each.  A null or empty
    text has no tokens; rows, repeated ones and null ids included, come back
    one for one; other columns are not read.  One pass without a shuffle:
    memory is bounded by an Arrow batch and the memo of distinct words.
    """
    path = tokenizer or wordbpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words = [t.split() for t in texts]
            memo = _known(path, words)
            counts = [sum(map(memo.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(map(len, texts), pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "over_limit": pa.array([n > limit for n in counts], pa.bool_()),
            })

    rows = keyed_texts(docs, doc_id, text)
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
