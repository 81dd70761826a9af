"""Language-model scores from a subword lattice."""

from __future__ import annotations

import base64
import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.blocks import answered, growth, grouped, pack, unpack
from chorale.llm.common import cut, map_arrow, named

#: Rounds in which the vocabulary's scores are re-estimated from the corpus.
ROUNDS = 2
#: Added to every piece's expected count.
SMOOTH = 0.05
#: Longest word, in bytes, that is handled with others of its length at once.
SHORT = 48
#: Distinct words of a bucket, about, before it grows with the total.
BUCKET_WORDS = 100_000


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a tiktoken file that can stand in a word, in order of rank.

    A word is scored with one space before it; a piece holds white space only
    as that space.
    """
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if not any(c in b" \t\n\x0b\x0c\r" for c in p[1:]) and p[:1] not in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r")]


class Lattice:
    """All segmentations of words into pieces, weighted by piece scores.

    ``scores`` are natural-log probabilities; forward sums run in log space
    over the ends of prefixes.  Substrings are looked up by a rolling hash
    over random byte codes; a hash of the table names exactly one piece.
    """

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.pieces, self.scores = pieces, scores
        rng = np.random.default_rng(11)
        self.code = rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
        self.longest = max(map(len, pieces))
        n = max(self.longest, SHORT) + 2
        with np.errstate(over="ignore"):
            self.power = np.r_[np.uint64(1), np.cumprod(np.full(n, np.uint64(0x9E3779B97F4A7C15)))]
            self.undo = np.r_[np.uint64(1), np.cumprod(np.full(n, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))))]
            codes = np.array([(self.code[np.frombuffer(p, np.uint8)] * self.power[: len(p)]).sum(dtype=np.uint64) for p in pieces], dtype=np.uint64)
        self.lengths = sorted({len(p) for p in pieces})
        self.index = {p: i for i, p in enumerate(pieces)}
        self.bits = 20
        slot = (codes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        self.table[slot[::-1]] = np.arange(len(pieces) - 1, -1, -1)
        self.codes = np.r_[codes, np.uint64(0)]
        lost = np.flatnonzero(self.table[slot] != np.arange(len(pieces)))
        by = lost[np.argsort(codes[lost])]
        self.more, self.more_id = codes[by], by
        self.crowded = np.zeros(1 << self.bits, dtype=bool)
        self.crowded[slot[lost]] = True

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The piece of each substring hash, or -1."""
        slot = (codes >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.table[slot]
        got = np.where(self.codes[got] == codes, got, -1)
        again = np.flatnonzero((got < 0) & self.crowded[slot])
        if len(again):
            at = np.minimum(np.searchsorted(self.more, codes[again]), len(self.more) - 1)
            hit = self.more[at] == codes[again]
            got[again[hit]] = self.more_id[at[hit]]
        return got

    def _arcs(self, words: list[bytes]) -> tuple[int, dict[tuple[int, int], np.ndarray]]:
        """For words of one length: the piece, or -1, from each start of each length."""
        n = len(words[0])
        x = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n)
        arcs = {}
        with np.errstate(over="ignore"):
            prefix = np.zeros((n + 1, len(words)), dtype=np.uint64)
            np.cumsum(self.code[x.T] * self.power[:n, None], axis=0, dtype=np.uint64, out=prefix[1:])
            for i in range(n):
                for k in self.lengths:
                    if i + k > n:
                        break
                    got = self.find((prefix[i + k] - prefix[i]) * self.undo[i])
                    if k == 1 or (got >= 0).any():
                        arcs[i, k] = got
        return n, arcs

    def _forward(self, n: int, m: int, arcs: dict) -> np.ndarray:
        score = np.r_[self.scores, -np.inf]
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0
        for (i, k), got in sorted(arcs.items()):
            on = np.flatnonzero(got >= 0)
            j = i + k
            alpha[j, on] = np.logaddexp(alpha[j, on], alpha[i, on] + score[got[on]])
        return alpha

    def _long(self, word: bytes, counts: Counter | None = None, weight: float = 1.0) -> float:
        """One word of any length, with memory in proportion to it."""
        n = len(word)
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0.0
        get, s = self.index.get, self.scores
        into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for k in self.lengths:
                if k > j:
                    break
                p = get(word[j - k : j])
                if p is not None:
                    into[j].append((j - k, p))
            v = [alpha[i] + s[p] for i, p in into[j]]
            top = max(v)
            alpha[j] = top + math.log(sum(math.exp(x - top) for x in v)) if top > -math.inf else top
        if counts is not None:
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0.0
            for j in range(n, 0, -1):
                for i, p in into[j]:
                    beta[i] = np.logaddexp(beta[i], beta[j] + s[p])
                    counts[p] += weight * math.exp(alpha[i] + s[p] + beta[j] - alpha[n])
        return float(alpha[n])

    def _groups(self, words: list[bytes]) -> Iterator[np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        by = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[by])) + 1
        for group in np.split(by, cuts):
            for a in range(0, len(group), 20_000):
                if len(group):
                    yield group[a : a + 20_000]

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural-log marginal probability of each word, its space included."""
        out = np.zeros(len(words))
        for group in self._groups(words):
            own = [b" " + words[i] for i in group]
            if len(own[0]) > SHORT:
                out[group] = [self._long(w) for w in own]
            else:
                n, arcs = self._arcs(own)
                out[group] = self._forward(n, len(own), arcs)[n]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts, by forward and backward sums, of counted words."""
        total = np.zeros(len(self.pieces))
        long_: Counter = Counter()
        score = np.r_[self.scores, -np.inf]
        for group in self._groups(words):
            own = [b" " + words[i] for i in group]
            if len(own[0]) > SHORT:
                for w, c in zip(own, counts[group], strict=True):
                    self._long(w, long_, float(c))
                continue
            n, arcs = self._arcs(own)
            alpha = self._forward(n, len(own), arcs)
            beta = np.full_like(alpha, -np.inf)
            beta[n] = 0
            weight = counts[group].astype(float)
            for (i, k), got in sorted(arcs.items(), reverse=True):
                on = np.flatnonzero(got >= 0)
                add = score[got[on]] + beta[i + k, on]
                beta[i, on] = np.logaddexp(beta[i, on], add)
                total += np.bincount(got[on], weight[on] * np.exp(alpha[i, on] + add - alpha[n, on]), minlength=len(total))
        for p, c in long_.items():
            total[p] += c
        return total


def _read(asked: bytes) -> tuple[list[bytes], np.ndarray]:
    (n,) = struct.unpack_from("<q", asked)
    return asked[8 + 8 * n :].split(b"\n"), np.frombuffer(asked, "<i8", n, 8)


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _dealt(words: list[bytes], buckets: int) -> list[tuple[int, list[int]]]:
    """Which of a block's distinct words go to each bucket that gets any, in order of bucket."""
    from xxhash import xxh3_64_intdigest

    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(xxh3_64_intdigest(w) % buckets, []).append(i)
    return sorted(out.items())


def held_out(doc_id) -> bool:
    """Whether a document is kept from learning: crc32 of its id's text mod 10 is 0."""
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Scores:
    """What learning leaves: piece scores, sizes of the training corpus, and the discount.

    A word of count c in N training words, V of them distinct, has probability
    (c - d) / N from its own count and d V / N times its lattice probability, d
    being the share that counts of 1 and 2 tell to take off each count.  Both
    parts come from all training documents; they add up to 1 over all words.
    """

    def __init__(self, pieces: list[bytes], scores: np.ndarray, ends: int, words: int, distinct: int, once: int, twice: int):
        self.pieces, self.scores = pieces, scores
        self.ends, self.words, self.distinct = ends, words, distinct
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        self.tokens, self.kinds = words + ends, distinct + (ends > 0)
        self.end = (ends + 0.5) / (self.tokens + 1)

    def log10(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 probability of words of these counts and natural-log lattice probabilities, ends aside."""
        if self.words:
            own = np.log(np.maximum(np.maximum(counts - self.discount, 0) / self.words, 1e-300))
            lattice = np.logaddexp(np.where(counts > 0, own, -np.inf), math.log(self.discount * self.distinct / self.words) + lattice)
        return (math.log1p(-self.end) + lattice) / math.log(10)


def first_scores(n: int) -> np.ndarray:
    """Natural-log scores of the pieces by their ranks, before any re-estimation."""
    scores = -np.log(np.arange(n) + 20.0)
    return scores - np.log(np.exp(scores).sum())


def score(docs: DataFrame, vocabulary_path: str | None = None, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row of ``docs`` by a model of those not held out.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    Tokens are lower-cased runs of non-white space, then one end.  The base is
    the sum of log10((c + 0.1) / (N + 0.1 (V + 1))); ``score`` is the log10
    probability of the text's words and end, see :class:`Scores`: a word's own
    share of the training corpus, and for all others its marginal probability,
    with a space before it, over all segmentations into the vocabulary's
    pieces.  Every byte is a piece, so that no text has probability zero.

    The vocabulary exists; its scores start from the pieces' ranks and are
    re-estimated from expected counts over the distinct words of the whole
    training corpus.  Each block sends its distinct words, with counts, to
    buckets once; the buckets are written, sorted, and passed over for each
    round, for the sizes, and to answer the blocks.  Only sums per piece of the
    fixed vocabulary reach the driver.

    Null and empty texts have one token, the end; ids are integers, a null one
    counts as held out; rows of equal ids are documents of their own; other
    columns are not read; an empty table gives no rows; rows come back one for
    one.
    """
    import public_tokenizers

    pieces = vocabulary(vocabulary_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    learns = F.pmod(F.crc32(F.coalesce(named(doc_id).cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0
    ends = docs.where(learns).count()
    blocks, total = pack(docs, doc_id, text)
    context = docs.sparkSession.sparkContext
    buckets = max(1, -(-total // int(150 * BUCKET_WORDS * growth(total))))  # a distinct word takes some 150 bytes of text

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload in zip(batch.column("block_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                block = unpack(payload)
                counts: dict[bytes, int] = {}
                later = []
                for i, t in zip(block.id_list(), block.texts(), strict=True):
                    words = _words(t)
                    if held_out(i):
                        later.append(words)
                        continue
                    for w in words:
                        counts[w] = counts.get(w, 0) + 1
                for words in later:
                    for w in words:
                        counts.setdefault(w, 0)
                words, n = list(counts), np.fromiter(counts.values(), "<i8", len(counts))
                for k, own in _dealt(words, buckets):
                    asked = struct.pack("<q", len(own)) + n[own].tobytes() + b"\n".join([words[i] for i in own])
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "block_id": pa.array([block_id], pa.int64()), "asked": pa.array([asked], pa.binary())})

    told = map_arrow(blocks, tell, "bucket long, block_id long, asked binary")
    dealt = cut(told.repartition("bucket").sortWithinPartitions("bucket", "block_id"))

    def learned(model: Lattice, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Expected counts by piece; -1: words of the corpus, -2: distinct ones, -3 and -4: those of count 1 and 2."""
        sums = np.zeros(len(pieces) + 4)
        at, held = None, []

        def done() -> None:
            counts: Counter = Counter()
            for asked in held:
                words, n = _read(asked)
                for w, c in zip(words, n.tolist(), strict=True):
                    if c:
                        counts[w] += c
            words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            sums[-4:] += [(n == 2).sum(), (n == 1).sum(), len(words), n.sum()]
            if words:
                sums[:-4] += model.expected(words, np.ones(len(words)))

        for batch in batches:
            for bucket, asked in zip(batch.column("bucket").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                if bucket != at:
                    done()
                    at, held = bucket, []
                held.append(asked)
        done()
        on = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(np.where(on < len(pieces), on, on - len(pieces) - 4)), "n": pa.array(sums[on])})

    def gather(model) -> dict[int, float]:
        found = map_arrow(dealt, lambda b: learned(model.value, b), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        return {r.piece: r.n for r in found.collect()}

    scores = first_scores(len(pieces))
    for _ in range(max(1, rounds)):
        got = gather(context.broadcast(Lattice(pieces, scores)))
        expected = np.array([got.get(k, 0.0) for k in range(len(pieces))]) + SMOOTH
        scores = np.log(expected / expected.sum())
    model = context.broadcast(Scores(pieces, scores, ends, *(round(got.get(k, 0.0)) for k in (-1, -2, -3, -4))))

    def settle_with(asked: list[bytes]) -> list[bytes]:
        lattice = _lattice(model)
        counts: dict[bytes, int] = {}
        parts = [_read(a) for a in asked]
        for words, n in parts:
            for w, c in zip(words, n.tolist(), strict=True):
                counts[w] = counts.get(w, 0) + c
        words = list(counts)
        log = model.value.log10(np.fromiter(counts.values(), np.int64, len(words)), lattice.log_probabilities(words))
        log = dict(zip(words, log.tolist(), strict=True))
        return [struct.pack("<q", len(w)) + np.array([counts[x] for x in w], "<i8").tobytes() + np.array([log[x] for x in w], "<f8").tobytes() for w, _ in parts]

    answers = grouped(answered(dealt, settle_with))
    joined = blocks.select("block_id", "payload").join(answers, "block_id", "left").select("payload", "answers")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        size = math.log10(m.tokens + 0.1 * (m.kinds + 1))
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = unpack(row["payload"])
                ids = block.id_list()
                parts = [_words(t) for t in block.texts()]
                index: dict[bytes, int] = {}
                # words in the order in which they went out: training documents first
                for i in sorted(range(len(ids)), key=lambda i: held_out(ids[i])):
                    for w in parts[i]:
                        if w not in index:
                            index[w] = len(index)
                count, log = np.zeros(len(index), dtype=np.int64), np.zeros(len(index))
                by_bucket = {a["bucket"]: a["answer"] for a in row["answers"] or []}
                for b, own in _dealt(list(index), buckets):
                    count[own] = np.frombuffer(by_bucket[b], "<i8", len(own), 8)
                    log[own] = np.frombuffer(by_bucket[b], "<f8", len(own), 8 + 8 * len(own))
                base = np.log10(count + 0.1) - size
                last = math.log10(m.ends + 0.1) - size
                out = []
                for i, words in zip(ids, parts, strict=True):
                    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    out.append((i, held_out(i), len(words) + 1, int((count[at] > 0).sum()) + (m.ends > 0), m.tokens, float(base[at].sum() + last), float(log[at].sum() + math.log10(m.end))))
                names = (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))
                yield pa.RecordBatch.from_pydict({n: pa.array([o[j] for o in out], t) for j, (n, t) in enumerate(names)})

    return map_arrow(joined, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_built: list = []


def _lattice(model) -> Lattice:
    """The lattice of a broadcast model, built once per Python worker."""
    if not _built or not np.array_equal(_built[0], model.value.scores):
        _built[:] = [model.value.scores, Lattice(model.value.pieces, model.value.scores)]
    return _built[1]
