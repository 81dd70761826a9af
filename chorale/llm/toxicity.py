"""Toxicity by maximum-scoring segments with extreme-value calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import cut, keyed_texts, map_arrow, named, slices
from chorale.llm.decontam import FOLD

#: Labelled rows per class that the model is learned from, by hash order.
SAMPLE = 10_000
#: Prior weight, in documents, of a stem's rate in its word's and of the base rate in a stem's.
WORD_PRIOR, STEM_PRIOR = 2.0, 8.0
#: Leading bytes that make a stem; bytes of the longest word that is learned.
STEM, WORD_BYTES = 5, 64
#: Standard errors taken off a token's log-odds, and what must be left for it to count:
#: of very many words some are toxic by chance, each a little.
ERRORS, LEAST = 1.5, 1.5
#: What each token costs, so that a passage has to earn its length.
DRIFT = 0.15
#: Evidence, in nats over chance, from which a passage is significant.
SIGNIFICANT = 3.0


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal scoring run (start, end, sum) of ``scores``, in linear time.

    Candidates are kept with the running total at their left and right ends; a
    new positive item either stands alone or takes over all candidates back to
    the last one whose left total is below its own.
    """
    left: list[float] = []
    right: list[float] = []
    start: list[int] = []
    end: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        l, r, a = total, total + s, i
        total = r
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j -= 1
            if j < 0 or right[j] >= r:
                break
            l, a = left[j], start[j]
            del left[j:], right[j:], start[j:], end[j:]
        left.append(l)
        right.append(r)
        start.append(a)
        end.append(i + 1)
    return [(a, b, r - l) for a, b, l, r in zip(start, end, left, right, strict=True)]


class Model:
    """Token log-odds, and the parameters that make a score of a segment sum."""

    def __init__(self, words: dict[bytes, tuple[int, int]], toxic: int, clean: int):
        base = (toxic + 0.5) / (toxic + clean + 1)
        stems: Counter = Counter()
        seen: Counter = Counter()
        for w, (y, z) in words.items():
            if len(w) > STEM:
                stems[w[:STEM]] += y
                seen[w[:STEM]] += y + z
        self.stem: dict[bytes, float] = {}
        rate: dict[bytes, float] = {}
        for s, n in seen.items():
            rate[s] = (stems[s] + STEM_PRIOR * base) / (n + STEM_PRIOR)
            self.stem[s] = self._sure(rate[s], base, n + STEM_PRIOR) - DRIFT
        self.word: dict[bytes, float] = {}
        for w, (y, z) in words.items():
            prior = rate.get(w[:STEM], base) if len(w) > STEM else base
            self.word[w] = self._sure((y + WORD_PRIOR * prior) / (y + z + WORD_PRIOR), base, y + z + WORD_PRIOR) - DRIFT
        self.rate, self.k = 1.0, 1.0
        self.weights = (-4.0, 1.0)

    @staticmethod
    def _odds(p: float) -> float:
        return math.log(p / (1 - p))

    def _sure(self, p: float, base: float, n: float) -> float:
        """Log-odds over the base rate less ``ERRORS`` standard errors, 0 if under ``LEAST``."""
        odds = self._odds(p) - self._odds(base)
        odds -= ERRORS * math.sqrt(1 / max(n * p, 0.5) + 1 / max(n * (1 - p), 0.5))
        return odds if odds >= LEAST else 0.0

    def token(self, word: bytes) -> float:
        got = self.word.get(word)
        return got if got is not None else self.stem.get(word[:STEM], -DRIFT) if len(word) > STEM else -DRIFT

    def scores(self, words: list[bytes], found: list[float]) -> np.ndarray:
        """Token scores of a text; a word's k-th place has a k-th of its log-odds.

        Text that repeats one word is no more toxic for it, and chance in the
        extreme-value law is that of independent tokens.
        """
        s = np.array(found, dtype=float)
        seen: Counter = Counter()
        for i in np.flatnonzero(s > -DRIFT).tolist():
            seen[words[i]] += 1
            s[i] = (s[i] + DRIFT) / seen[words[i]] - DRIFT
        return s

    def best(self, scores: np.ndarray) -> float:
        """The sum of the best segment, 0 if none is positive."""
        if not len(scores):
            return 0.0
        total = np.cumsum(scores)
        low = np.minimum.accumulate(np.r_[0.0, total[:-1]])
        return max(0.0, float((total - low).max()))

    def evidence(self, best: float, n: int) -> float:
        """Nats by which a segment sum is rarer than chance in ``n`` tokens.

        The law holds for long texts; short ones count as if chance gave one
        segment of sum 0, so that no evidence stays at or below 0.
        """
        return self.rate * best - math.log(max(1.0, self.k * n))

    def judged(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """Evidence of a text's token scores, and its significant passages with the evidence of each.

        A text without one has the evidence of its best segment; the others
        that of all their significant passages together.
        """
        n = len(scores)
        evidence = self.evidence(self.best(scores), n)
        if evidence < SIGNIFICANT:
            return evidence, []
        each = [(a, b, self.evidence(s, n)) for a, b, s in maximal_segments(scores.tolist())]
        each = [x for x in each if x[2] >= SIGNIFICANT]
        return self.together([x[2] for x in each]), each

    @staticmethod
    def together(evidence: list[float]) -> float:
        """Nats of several passages' joint rarity, by the sum statistic of extreme-value theory.

        The r best, of sum t, are as rare as exp(-t) t^(r-1) / (r! (r-1)!);
        the r that says most counts, less ln 2 for each step of the choice.
        """
        total, most = 0.0, -math.inf
        for r, e in enumerate(sorted(evidence, reverse=True), 1):
            total += e
            most = max(most, total - (r - 1) * math.log(2 * total) + math.lgamma(r + 1) + math.lgamma(r))
        return most

    def score(self, evidence: float) -> float:
        a, b = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * max(-20.0, min(60.0, evidence))))))

    def calibrate(self, histogram: dict[float, float], clean: list[tuple[float, int]]) -> None:
        """Fit rate and k to clean text that the scores were not learned from.

        ``histogram`` counts its token scores; ``clean`` are the best sum and
        the tokens of its documents.  The rate solves E[exp(rate * score)] = 1; given it,
        k is the maximum-likelihood scale of the extreme-value law.
        """
        x = np.array(list(histogram), dtype=float)
        p = np.array(list(histogram.values()), dtype=float)
        if len(x) and x.max() > 0 and (x * p).sum() < 0:
            p /= p.sum()
            lo, hi = 1e-6, 1.0
            while (p * np.exp(np.minimum(hi * x, 600))).sum() < 1 and hi < 64:
                hi *= 2
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * x, 600))).sum() < 1 else (lo, mid)
            self.rate = min(hi, 4.0)
        clean = [r for r in clean if r[1]]
        if clean:
            self.k = len(clean) / sum(n * math.exp(-self.rate * s) for s, n in clean)

    def weigh(self, rows: list[tuple[float, int, float]]) -> None:
        """Fit the link from evidence to score to documents' evidence, label and weight."""
        if {r[1] for r in rows} < {0, 1}:
            return
        e = np.clip([r[0] for r in rows], -20, 60)
        y = np.array([r[1] for r in rows], dtype=float)
        w = np.array([r[2] for r in rows])
        w = w / w.mean()
        a = np.stack([np.ones_like(e), e], axis=1)
        ridge = np.array([1e-4, 1e-3]) * len(e)

        def loss(beta: np.ndarray) -> float:
            z = a @ beta
            return float((w * (np.logaddexp(0, z) - y * z)).sum() + (ridge * beta * beta).sum() / 2)

        beta, now = np.array([-3.0, 0.5]), math.inf
        for _ in range(100):  # Newton's steps, halved until they help
            mu = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            hess = (a * (w * mu * (1 - mu))[:, None]).T @ a + np.diag(ridge)
            step = np.linalg.solve(hess, a.T @ (w * (y - mu)) - ridge * beta)
            before = now if now < math.inf else loss(beta)
            while (now := loss(beta + step)) > before and abs(step).max() > 1e-9:
                step = step / 2
            beta = beta + step
            if abs(step).max() < 1e-8:
                break
        self.weights = (float(beta[0]), max(0.0, float(beta[1])))


class _Tokens(dict):
    """Token scores of words met so far; a memo of bounded size."""

    def __init__(self, model: Model, most: int = 150_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: bytes) -> float:
        got = self[word] = self.model.token(word)
        return got

    def split(self, texts: list[bytes | None]) -> Iterator[list[bytes]]:
        """Folded words of each text."""
        if len(self) > self.most:
            self.clear()
        for t in texts:
            yield (t or b"").translate(FOLD).split()


def _sample(labels: DataFrame, doc_id: str, toxic: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Up to ``per_class`` training rows of each class, and each one's weight."""
    rows = labels.select(named(doc_id).alias("doc_id"), named(toxic).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), {c: n / min(n, per_class) for c, n in sizes.items()}


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = SAMPLE) -> Model:
    """The model, from at most ``per_class`` labelled rows of each class.

    Labels count only where crc32(doc_id) mod 3 is not 1; the larger label of
    a repeated id holds, and of rows with one id the smallest text (null is
    empty) stands for all.  The sample's texts are written once.  Words'
    document counts by class and half are added up in Spark; scores for the
    calibration come from the other half's counts.  Words of more than
    :data:`WORD_BYTES` bytes are known by their stems only.  What reaches the
    driver is bounded by the sample: a few numbers per document, and words that
    two toxic documents of it share.  Without labels of both classes scores
    stay low and even.
    """
    from collections import defaultdict

    sample, weight = _sample(labels, doc_id, toxic, per_class)
    rows = keyed_texts(docs, doc_id, text).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = cut(rows.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], Counter] = defaultdict(Counter)
        for batch, texts in slices(batches):
            for t, y, h in zip(texts, batch.column("toxic").to_pylist(), batch.column("half").to_pylist(), strict=True):
                own[y, h].update(set(t.translate(FOLD).split()))
                own[y, h][b""] += 1
        for (y, h), words in own.items():
            items = list(words.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in part], pa.binary()), "slot": pa.array([2 * h + y] * len(part), pa.int32()), "n": pa.array([n for _, n in part], pa.int64())})

    slots = [F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(4)]
    counted = map_arrow(rows, count, "word binary, slot int, n long").groupBy("word").agg(*slots)
    # a word that no two toxic documents of the sample share says nothing alone
    found = {bytes(r.word): (r.c0, r.c1, r.c2, r.c3) for r in counted.where(f"(c1 + c3 >= 2 and octet_length(word) <= {WORD_BYTES}) or word = X''").collect()}
    totals = found.pop(b"", (0, 0, 0, 0))

    def model(a: int, b: int) -> Model:
        use = [(0, 1), (2, 3)][a : b + 1]
        pick = lambda c: (sum(c[t] for _, t in use), sum(c[z] for z, _ in use))
        words = {w: pick(c) for w, c in found.items()}
        return Model({w: c for w, c in words.items() if c[0]}, *pick(totals))

    context = rows.sparkSession.sparkContext
    halves = (model(1, 1), model(0, 0))  # by half: learned from the other
    shared = context.broadcast(halves)

    def judged(batches: Iterator[pa.RecordBatch], models: tuple) -> Iterator[tuple[Model, np.ndarray, int]]:
        for batch, texts in slices(batches):
            for t, y, h in zip(texts, batch.column("toxic").to_pylist(), batch.column("half").to_pylist(), strict=True):
                m = models[h]
                words = t.translate(FOLD).split()
                yield m, m.scores(words, [m.token(w) for w in words]), y

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist: Counter = Counter()
        out = []
        for m, s, y in judged(batches, shared.value):
            if y == 0:
                out.append((m.best(s), len(s), False))
                hist.update(np.round(s, 1).tolist())
        out += [(k, n, True) for k, n in hist.items()]
        yield pa.RecordBatch.from_pydict({"x": pa.array([o[0] for o in out], pa.float64()), "n": pa.array([o[1] for o in out], pa.int64()), "count": pa.array([o[2] for o in out], pa.bool_())})

    hist: Counter = Counter()
    clean = []
    for r in map_arrow(rows, probe, "x double, n long, count boolean").collect():
        if r["count"]:
            hist[r.x] += r.n
        else:
            clean.append((r.x, r.n))
    full = model(0, 1)
    full.calibrate(hist, clean)
    for m in halves:
        m.rate, m.k = full.rate, full.k
    fitted = context.broadcast(halves)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(m.judged(s)[0], y) for m, s, y in judged(batches, fitted.value)]
        yield pa.RecordBatch.from_pydict({"e": pa.array([o[0] for o in out], pa.float64()), "y": pa.array([o[1] for o in out], pa.int32())})

    full.weigh([(r.e, r.y, weight[r.y]) for r in map_arrow(rows, weigh, "e double, y int").collect()])
    return full


def drop_toxic(docs: DataFrame, model: Model, at: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``at`` or more.

    Scores are those of :func:`score`.  One pass without a shuffle; all columns
    are kept, whatever their names; null and empty texts have the score of no
    evidence; repeated rows go or stay alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo = _Tokens(m)
        for batch, texts in slices(batches, text):
            keep = []
            for words in memo.split(texts):
                s = m.scores(words, list(map(memo.__getitem__, words)))
                keep.append(m.score(m.judged(s)[0]) < at)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_passages and passages of every row of ``docs``.

    A passage is a significant maximal segment: its first word, the one after
    its last (in words from 0) and its evidence.  The score grows with the
    evidence of all passages together (:meth:`Model.together`); a text without
    one has that of its best segment.  Null is empty; an empty text has the
    score of no evidence; other columns are not read; an empty table gives no
    rows; rows come back one for one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo = _Tokens(m)
        for batch, texts in slices(batches):
            scores, passages = [], []
            for words in memo.split(texts):
                s = m.scores(words, list(map(memo.__getitem__, words)))
                e, each = m.judged(s)
                scores.append(m.score(e))
                passages.append([{"start": a, "end": b, "evidence": v} for a, b, v in each])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "score": pa.array(scores, pa.float64()),
                "n_passages": pa.array(map(len, passages), pa.int64()),
                "passages": pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))),
            })

    rows = keyed_texts(docs, doc_id, text)
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_passages long, passages array<struct<start:long,end:long,evidence:double>>")
