"""Toxicity: maximum-scoring segments over word log-odds, calibrated by extreme-value statistics.

Word counts of toxic and other labelled documents give log-odds under an informative Dirichlet prior;
words whose log-odds are significant carry them as score, every other word costs a little. The
linear-time scan finds every maximal segment. Karlin-Altschul statistics of the words of
non-toxic text turn a segment's score and the document's length into an expected number of such
segments by chance; segments rarer than a bound are reported, and the best one's significance,
calibrated on the training rows, is the document's score.

Words, and word beginnings of a few lengths, are all counted, by hash: every task sums its own documents' first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bytesops as B
from quillon.llm.common import cut

#: At most so many labelled rows, about, are fitted on, chosen by a hash of doc_id.
MAX_ROWS = 60_000
#: Word counts that a task sums before it sends them.
HELD = 1 << 21
#: Bytes of a word's beginning that count as words of their own.
STEMS = (5, 6, 7)
#: Weight of the Dirichlet prior, as a share of all counts.
PRIOR = 0.1
COST = 0.3
SIGNIFICANT = 4.0


def is_held_out(c):
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(True))


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts with the hashes of their words and of the words' stems (words x 1 + stems), and the number of words of each."""
    buf, offs = B.raw(texts)
    for i, j in B.groups(offs):
        part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, counts = B.spans(part, o, B.ALNUM)
        # a word shorter than a stem stands for it
        yield i, j, np.stack([B.hashes(part, starts, ends)] + [B.hashes(part, starts, np.minimum(ends, starts + k)) ^ np.uint64(k) for k in STEMS], axis=1), counts


def _by_document(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Label and distinct hashes of each training text."""
    toxic = batch.column(0).to_numpy(zero_copy_only=False)
    for i, _, words, counts in _groups(batch.column(1)):
        at = np.concatenate([[0], np.cumsum(counts)])
        for d in range(len(counts)):
            yield int(toxic[i + d]), np.unique(words[at[d] : at[d + 1]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a word, by label: each document counts a word once."""

    def out(found: list[list[np.ndarray]]) -> pa.RecordBatch:
        h, k, y = [], [], []
        for label in (0, 1):
            word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found[label]]), return_counts=True)
            h.append(word.view(np.int64))
            k.append(n)
            y.append(np.full(len(n), label))
        h, k, y = (np.concatenate(x) for x in (h, k, y))
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(k * y), pa.array(k * (1 - y))], names=["word", "y1", "y0"])

    found: list[list[np.ndarray]] = [[], []]
    size = 0
    for batch in batches:
        for label, h in _by_document(batch):
            found[label].append(h)
            size += len(h)
            if size > HELD:
                yield out(found)
                found, size = [[], []], 0
    if size:
        yield out(found)


def segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end exclusive, score), in linear time (Ruzzo and Tompa).

    Only positive entries open a segment; between them a running sum stands in for the rest.
    """
    c = np.concatenate([[0.0], np.cumsum(x)])
    pos = np.flatnonzero(x > 0)
    if not len(pos):
        return []
    # neighbouring positives can't be split
    cuts = np.flatnonzero(np.diff(pos) > 1)
    firsts, lasts = pos[np.concatenate([[0], cuts + 1])], pos[np.concatenate([cuts, [len(pos) - 1]])] + 1
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, index of the nearest lower left sum
    for s, e in zip(firsts.tolist(), lasts.tolist(), strict=True):
        left, right = float(c[s]), float(c[e])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, s, e, j))
                break
            left, s = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, right - left) for left, right, s, e, _ in stack]


def best(x: np.ndarray) -> float:
    """The largest segment score (0 without any)."""
    if not len(x) or x.max() <= 0:
        return 0.0
    c = np.cumsum(x)
    low = np.minimum(np.minimum.accumulate(np.concatenate([[0.0], c[:-1]])), 0.0)
    return float((c - low).max())


class Model:
    def __init__(self, scores: np.ndarray, buckets: np.ndarray, lam: float, k: float = 0.1, a: float = 1.0, b: float = 0.0):
        self.scores, self.buckets, self.lam, self.k, self.a, self.b = scores, buckets, lam, k, a, b

    def of(self, words: np.ndarray) -> np.ndarray:
        """A word's score is the highest of its own and its stems'; known words of clean text cost more than others."""
        if not len(self.buckets) or not len(words):
            return np.full(len(words), -COST)
        at = np.minimum(np.searchsorted(self.buckets, words), len(self.buckets) - 1)
        return np.where(self.buckets[at] == words, self.scores[at], -COST).max(axis=1)

    def evidence(self, score: float, n: int) -> float:
        """-ln of the chance that n words of clean text hold a segment of that score: 1 - exp(-K n exp(-lambda S))."""
        if score <= 0:
            return 0.0
        expected = math.log(max(self.k * n, 1e-9)) - self.lam * score
        return -math.log(-math.expm1(-math.exp(expected))) if -30 < expected < 30 else max(0.0, -expected)

    def probability(self, evidence: float) -> float:
        z = self.a * evidence + self.b
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum of weight * exp(lambda * score) = 1, for a negative mean score; by bisection."""
    if not len(scores) or scores.max() <= 0 or (scores * weights).sum() >= 0:
        return 1.0
    f = lambda v: float((weights * np.exp(np.minimum(v * scores, 700))).sum()) - 1
    lo, hi = 0.0, 1.0
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def _logistic(e: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of one variable with a little ridge, by damped Newton steps."""
    theta = np.array([0.1, 0.0])
    for _ in range(100):
        z = np.clip(theta[0] * e + theta[1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        g = np.array([(w * (p - y) * e).sum(), (w * (p - y)).sum()]) + 1e-2 * theta
        v = w * p * (1 - p)
        h = np.array([[(v * e * e).sum(), (v * e).sum()], [(v * e).sum(), v.sum()]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def _odds(counts: DataFrame, t1: float, t0: float, least: float) -> DataFrame:
    """word, y0, delta of the words whose log-odds are at least so many standard errors from 0."""
    total = PRIOR * (t1 + t0)
    prior = F.lit(PRIOR) * (F.col("y1") + F.col("y0"))
    odds = counts.select("word", "y0", (F.col("y1") + prior).alias("a1"), (F.col("y0") + prior).alias("a0"))
    odds = odds.withColumn("delta", F.log(F.col("a1") / (t1 + total - F.col("a1"))) - F.log(F.col("a0") / (t0 + total - F.col("a0"))))
    return odds.where(F.abs(F.col("delta") / F.sqrt(1 / F.col("a1") + 1 / F.col("a0"))) >= least).select("word", "y0", "delta")


def _k(clean: DataFrame, model: Model) -> float:
    """K of the best segments of clean text, by maximum likelihood given lambda: texts with a segment of score s have density K n lambda exp(-lambda s - K n exp(-lambda s)), those without chance exp(-K n)."""
    shared = clean.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, weight = 0, 0.0
        for batch in batches:
            for _, _, words, counts in _groups(batch.column(0)):
                x, at = shared.value.of(words), np.concatenate([[0], np.cumsum(counts)])
                for d, n in enumerate(counts):
                    s = best(x[at[d] : at[d + 1]])
                    some += s > 0
                    weight += n * math.exp(-shared.value.lam * s)
        yield pa.RecordBatch.from_arrays([pa.array([some], pa.int64()), pa.array([weight])], names=["some", "weight"])

    r = clean.select("text").mapInArrow(run, "some bigint, weight double").agg(F.sum("some").alias("some"), F.sum("weight").alias("weight")).first()
    shared.unpersist()
    return max(float(r["some"] or 0), 0.5) / max(float(r["weight"] or 0), 1.0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most about max_rows labelled rows outside the held-out fifth; text and label are all it sees.

    Labels other than 0 and 1, and rows with null ids, are left out; with one class alone, every score is 0 (or 1).
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~is_held_out(F.col("doc_id")))
    n = usable.count()
    if n > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    words = cut(train.mapInArrow(_count, "word bigint, y1 bigint, y0 bigint").groupBy("word").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0), np.zeros(0, np.uint64), 1.0, 0.1, 1e-3, 30.0 if n1 else -30.0)
    t = words.agg(F.sum("y1").alias("t1"), F.sum("y0").alias("t0")).first()
    t1, t0 = float(t["t1"] or 0), float(t["t0"] or 0)
    # significant words of a bounded sample
    m = _odds(words.where(F.col("y1") + F.col("y0") >= 5), t1, t0, SIGNIFICANT).toPandas()
    m = m.assign(word=m["word"].to_numpy(np.int64).view(np.uint64)).sort_values("word")
    scores, buckets = m["delta"].to_numpy(float), m["word"].to_numpy(np.uint64)
    p = (m["y0"].to_numpy(float) + 0.1) / max(t0, 1.0)
    lam = _lambda(np.append(scores, -COST), np.append(p, max(0.0, 1 - p.sum())))
    model = Model(scores, buckets, lam)
    model.k = _k(train.where("toxic = 0"), model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            toxic = batch.column(0).to_pylist()
            for i, _, words, counts_ in _groups(batch.column(1)):
                x, at = shared.value.of(words), np.concatenate([[0], np.cumsum(counts_)])
                for d, k in enumerate(counts_):
                    key = (toxic[i + d], max(-1000, min(1000, round(10 * shared.value.evidence(best(x[at[d] : at[d + 1]]), int(k))))))
                    found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["toxic", "bin", "n"])

    h = train.mapInArrow(bins, "toxic int, bin int, n bigint").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    model.a, model.b = _logistic(h["bin"].to_numpy(float) / 10, h["toxic"].to_numpy(float), h["n"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, expect: float = 0.01) -> DataFrame:
    """doc_id, held_out, score, predicted, and the passages (first and last word, score) fewer than expect of which chance would give.

    Null and empty texts have no words, and score as a text without evidence. Null ids count as held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for i, j, words, counts in _groups(batch.column(1)):
                x, at = m.of(words), np.concatenate([[0], np.cumsum(counts)])
                scores, passages = [], []
                for d, n in enumerate(counts):
                    e = m.evidence(best(y := x[at[d] : at[d + 1]]), int(n))
                    scores.append(m.probability(e))
                    passages.append([{"first": s, "last": t - 1, "score": v} for s, t, v in segments(y) if m.evidence(v, int(n)) > -math.log(expect)] if e > -math.log(expect) else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, passages array<struct<first: bigint, last: bigint, score: double>>")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.expr("if(score >= 0.5, 1, 0)").alias("predicted"), "passages")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).drop("passages")
