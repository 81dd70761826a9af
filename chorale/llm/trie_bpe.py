"""BPE encoding and decoding by a prefix-sharing walk over a trie of words."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm import wordbpe
from chorale.llm.common import keeps, keyed_texts, map_arrow, slices

#: Distinct words whose encodings a Python worker remembers; a memo only.
MEMO = 200_000

_memo: dict[str, wordbpe.Memo] = {}


class TrieEncoder:
    """Encodes many words at once, each shared prefix once.

    A prefix's encoding is fixed by its last token: the tokens before it are
    the encoding of the shorter prefix that it leaves.  A token may end a
    prefix if the pair it forms with the last token of that shorter prefix
    would survive merging as two tokens.  The words, sorted, are the trie in
    depth-first order; the path from the root holds one last-token state per
    depth, and the next word keeps the states of the prefix it shares.  Only
    the last character, which carries the word-end mark, is a leaf of its own.
    """

    def __init__(self, bpe: wordbpe.WordBpe):
        self.bpe = bpe
        self.longest = max(len(s) for s in bpe.vocab)
        self.apart: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def _reached(self, token: int) -> bool:
        """Whether merging the token's own characters gives the token."""
        got = self.alone.get(token)
        if got is None:
            s = self.bpe.strings[token]
            ends = s.endswith("</w>") and len(s) > 4
            body = s[:-4] if ends else s
            symbols = [self.bpe.vocab[c] for c in body]
            if ends:
                symbols[-1] = self.bpe.vocab[body[-1] + "</w>"]
            got = self.alone[token] = self._merged(symbols) == [token]
        return got

    def _merged(self, symbols: list[int]) -> list[int]:
        rank = self.bpe.pair_rank
        while len(symbols) > 1:
            low, at = min((rank.get(p, 1 << 40), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if low == 1 << 40:
                break
            strings = self.bpe.strings
            symbols[at : at + 2] = [self.bpe.vocab[strings[symbols[at]] + strings[symbols[at + 1]]]]
        return symbols

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side are what merging their text gives.

        Undoes the later of the merges that made the two sides, one at a time:
        the pair breaks if, at some moment, the symbols that meet had a merge
        of a rank below that of the merges undone so far.
        """
        key = (a << 20) | b
        got = self.apart.get(key)
        if got is not None:
            return got
        if len(self.apart) > 300_000:
            self.apart.clear()
        rank, split, pairs = self.bpe.rank, self.bpe.split, self.bpe.pair_rank
        limit_left = limit_right = 1 << 40
        got = True
        while True:
            r = pairs.get((a, b))
            # a merge on the left side of equal rank comes first, on the right after
            if r is not None and r < limit_left and r <= limit_right:
                got = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra >= rb:
                limit_left = min(limit_left, ra)
                a = split[a][1]
            else:
                limit_right = min(limit_right, rb)
                b = split[b][0]
        self.apart[key] = got
        return got

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct pre-token."""
        vocab, longest, apart = self.bpe.vocab, self.longest, self._stay_apart
        out: dict[str, list[int]] = {}
        last: list[int] = [-1]  # last[k]: the token that ends the path's first k characters
        size: list[int] = [0]
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word), len(last)) - 1
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            n = len(word)
            for k in range(shared + 1, n):
                likely = k - 1 - size[k - 1]  # the last token with one more character, or that character alone
                for i in (likely, k - 1, *range(max(0, k - longest), k - 1)):
                    token = vocab.get(word[i:k])
                    if token is not None and (apart(last[i], token) if i else self._reached(token)):
                        last.append(token)
                        size.append(k - i)
                        break
            end = word + "</w>"
            for i in range(max(0, n - longest), n):
                token = vocab.get(end[i:])
                if token is not None and (apart(last[i], token) if i else self._reached(token)):
                    ids, k = [token], i
                    break
            while k:
                ids.append(last[k])
                k -= size[k]
            ids.reverse()
            out[word] = ids
            before = word
        return out


_encoders: dict[str, TrieEncoder] = {}


def _forget() -> None:
    if _encoders:
        _memo.clear()
        _encoders.clear()
        wordbpe.load.cache_clear()


keeps(__name__, _forget)


def _close(path: str) -> None:
    """Let go of the last slice's words, in the worker's own memo."""
    if path in _memo:
        _memo[path].close()


def _known(path: str, texts: list[list[bytes]]) -> dict[bytes, tuple[int, bytes, bytes]]:
    """The memo, with every word of ``texts``: tokens, id bytes, decoded."""
    memo = _memo.setdefault(path, wordbpe.Memo(MEMO))
    words = [w for w in set().union(*texts) if w not in memo]
    bpe = wordbpe.load(path)
    encoder = _encoders.setdefault(path, TrieEncoder(bpe))
    parts = bpe.pieces(words)
    encoded = encoder.encode([p for p in {p for ps in parts for p in ps} if isinstance(p, str)])
    strings, found = bpe.strings, []
    for ps in parts:
        ids = [i for p in ps for i in ((p,) if isinstance(p, int) else encoded[p])]
        found.append((len(ids), struct.pack(f"<{len(ids)}I", *ids), " ".join([strings[i] for i in ids]).encode()))
    memo.learn(words, found)
    return memo


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Little-endian ids of each text as an array of int."""
    ends = np.r_[0, np.cumsum([len(p) // 4 for p in packed])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4").astype(np.int32)))


def encode(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``.

    As the tokenizer library encodes without added special tokens.  A null or
    empty text gives an empty array; rows come back one for one.
    """
    path = tokenizer or wordbpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words = [t.split() for t in texts]
            memo = _known(path, words)
            ids = _lists([b"".join([memo[x][1] for x in w]) for w in words])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": ids})

    rows = keyed_texts(docs, doc_id, text)
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids, special tokens kept.

    The file names no decoder, so tokens are joined by one space, as the
    library does.  Null or empty ids give an empty text; ids that the
    vocabulary lacks are skipped.
    """
    path = tokenizer or wordbpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = wordbpe.load(path).strings
        for batch in batches:
            texts = [" ".join(strings[i] for i in row or () if i in strings) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text.

    ``with_ids`` adds the ids themselves, an array of int.

    Encodes and decodes each text in one pass without a shuffle; ids are
    hashed as little-endian unsigned 32-bit integers.  Null is empty; rows
    come back one for one; other columns are not read.
    """
    path = tokenizer or wordbpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words = [t.split() for t in texts]
            memo = _known(path, words)
            n, a, b, ids = [], [], [], []
            for w in words:
                got = [x for x in map(memo.__getitem__, w) if x[0]]
                packed = b"".join([x[1] for x in got])
                n.append(len(packed) // 4)
                ids.append(packed if with_ids else b"")
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(b" ".join([x[2] for x in got])).hexdigest())
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array(a, pa.string()),
                "decoded_sha256": pa.array(b, pa.string()),
            }
            if with_ids:
                out["ids"] = _lists(ids)
            yield pa.RecordBatch.from_pydict(out)
        _close(path)

    rows = keyed_texts(docs, doc_id, text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(rows, run, schema + ", ids array<int>" * with_ids)
