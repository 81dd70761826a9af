"""Word-level BPE of a public tokenizer file: ranks, pre-tokens, caches.

Both token operators read the same ``tokenizers`` JSON file.  Its normaliser
and pre-tokeniser are the library's own; the merging is done here, in
:mod:`token_counts` by rank-synchronous array merging and in :mod:`trie_bpe`
by a walk over a trie.

A text is cut at ASCII white space first.  The file's normaliser composes
characters, folds case and turns white space into spaces, none of which acts
across a space, and its pre-tokeniser never joins characters across one, so
each white-space-delimited word can be handled once per distinct word.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np

_SPACE = re.compile(r"\s")
#: Words of printable ASCII and precomposed Latin letters need no library: they
#: are in normal form, fold one character at a time, and hold no other classes.
_EASY = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u017f0-9 ]+| ")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: visible bytes stand for themselves, others follow 255.
_BYTE_CHARS = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512), strict=False))


#: Symbols from which a pre-token is merged by itself.
LONG = 400


class WordBpe:
    """Vocabulary, merge ranks and pre-tokenisation of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or spec["pre_tokenizer"]["type"] != "Sequence":
            raise ValueError(f"{path}: not a word-level BPE file")
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair_rank[x, y] = r
            self.split.setdefault(z, (x, y))
            self.rank.setdefault(z, r)
        keys = np.array([(x << 20) | y for x, y in self.pair_rank], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_rank = np.fromiter(self.pair_rank.values(), dtype=np.int64)[order]
        self.key_token = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)[order]

    def pieces(self, words: list[bytes]) -> list[list]:
        """For each word, its pre-tokens (str) and special tokens (int)."""
        out: list[list] = [[] for _ in words]
        easy: list[int] = []
        rest: list[int] = []
        strings = [w.decode("utf-8", "replace") for w in words]
        for i, s in enumerate(strings):
            if self._special and "<|" in s and self._special.search(s):
                for part in self._special.split(s):
                    if part in self.special:
                        out[i].append(self.special[part])
                    elif part:
                        out[i] += self._pieces(part)
            elif _EASY.fullmatch(s):
                easy.append(i)
            elif _SPACE.search(s):
                out[i] += self._pieces(s)
            else:
                rest.append(i)
        at = iter(easy)
        for piece in _SPLIT.findall(" " + " ".join([strings[i] for i in easy]).lower()) if easy else ():
            if piece == " ":
                own = out[next(at)]
            elif piece.isascii():
                own.append(piece)
            else:
                own.append(piece.encode().decode("latin-1").translate(_BYTE_CHARS))
        for k in range(0, len(rest), 20_000):
            self._bulk([strings[i] for i in rest[k : k + 20_000]], [out[i] for i in rest[k : k + 20_000]])
        return out

    def _pieces(self, s: str) -> list[str]:
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(s))]

    def _bulk(self, words: list[str], out: list[list]) -> None:
        """Many words in one call of the library, told apart by their spaces."""
        joined = self.library.normalizer.normalize_str(" ".join(words))
        parts = joined.split(" ")
        if len(parts) != len(words):
            for w, o in zip(words, out, strict=True):
                o += self._pieces(w)
            return
        starts = np.zeros(len(parts), dtype=np.int64)
        np.cumsum([len(p) + 1 for p in parts[:-1]], out=starts[1:])
        ends = starts.tolist()
        for piece, (a, _) in self.library.pre_tokenizer.pre_tokenize_str(joined):
            out[bisect_right(ends, a) - 1].append(piece)

    def symbols(self, piece: str) -> list[int]:
        """A pre-token's characters as ids, the last one marked as word end."""
        v = self.vocab
        return [*[v[c] for c in piece[:-1]], v[piece[-1] + "</w>"]]

    def merge_count(self, pieces: list[str]) -> np.ndarray:
        """How many symbols each pre-token has once all merges are applied.

        The batch is one flat array of symbols with the sequence each belongs
        to.  A round finds every adjacent pair's rank, each sequence's lowest,
        and merges all places of that pair in all sequences at once; in a run
        of overlapping places every other one is taken, from the left.
        Sequences without a mergeable pair leave the batch.  Long ones need
        many rounds, and are merged one at a time by :meth:`_merge_long`.
        """
        n = len(pieces)
        counts = np.zeros(n, dtype=np.int64)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG]
        for i in set(range(n)).difference(short):
            counts[i] = self._merge_long(self.symbols(pieces[i]))
        if not short:
            return counts
        lengths = np.array([len(pieces[i]) for i in short], dtype=np.int64)
        flat = np.array([x for i in short for x in self.symbols(pieces[i])], dtype=np.int64)
        seq = np.repeat(short, lengths)
        never = np.int64(1 << 40)
        while len(flat):
            same = seq[1:] == seq[:-1]
            key = (flat[:-1] << 20) | flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = same & (self.keys[at] == key)
            rank = np.full(len(flat), never)
            rank[:-1][known] = self.key_rank[at[known]]
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(flat)])
            done = lowest == never
            counts[seq[starts[done]]] = sizes[done]
            here = (rank == np.repeat(lowest, sizes)) & (rank != never)
            places = np.flatnonzero(here)
            if not len(places):
                break
            first = np.r_[True, np.diff(places) != 1]
            run_start = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run_start) % 2 == 0]
            flat[places] = self.key_token[at[places]]
            keep = np.repeat(~done, sizes)
            keep[places + 1] = False
            flat, seq = flat[keep], seq[keep]
        return counts


    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: none) and token of each pair of symbols."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], -1), self.key_token[at]

    def _merge_long(self, symbols: list[int]) -> int:
        """Symbols left of one sequence; a round costs its own merges, not the sequence.

        Symbols are linked, and the places of each rank wait in a bucket.  The
        lowest rank's places are merged at once, as in :meth:`merge_count`, and
        only their neighbours get new ranks.
        """
        n = len(symbols)
        symbol = np.array([*symbols, 0], dtype=np.int64)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank, token = np.full(n + 1, -1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[after[places] < n]
            rank[places], token[places] = self._ranks(symbol[places], symbol[after[places]])
            places = places[rank[places] >= 0]
            by = places[np.argsort(rank[places], kind="stable")]
            for part in np.split(by, np.flatnonzero(np.diff(rank[by])) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in waiting:
                        heappush(heap, r)
                    waiting.setdefault(r, []).append(part)

        wait(np.arange(n))
        left = n
        while heap:
            r = heappop(heap)
            a = np.unique(np.concatenate(waiting.pop(r)))
            a = a[rank[a] == r]
            if not len(a):
                continue
            first = np.r_[True, a[1:] != after[a[:-1]]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            a = a[(np.arange(len(a)) - start) % 2 == 0]
            gone = after[a]
            symbol[a] = token[a]
            rank[gone] = -1
            after[a] = after[gone]
            before[after[a]] = a
            left -= len(a)
            near = np.unique(np.r_[before[a], a])
            near = near[near >= 0]
            rank[near] = -1
            wait(near)
        return left


class Memo(dict):
    """What the first distinct keys gave, for good, and what the current slice adds.

    The first ``most`` keys stay, which frequent words are among; the others
    are held for one slice only, so that memory is bounded.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.slice: dict = {}

    def __missing__(self, key):
        return self.slice[key]

    def learn(self, keys: list, values: list) -> None:
        """Take in a slice's new keys, in place of the last slice's."""
        room = max(0, self.most - len(self))
        self.update(zip(keys[:room], values[:room], strict=True))
        self.slice = dict(zip(keys[room:], values[room:], strict=True))

    def close(self) -> None:
        """Let go of the last slice's keys."""
        self.slice = {}


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The tokenizer, once per Python worker."""
    return WordBpe(path)


def default_path() -> str:
    """The public word-level BPE file of this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
