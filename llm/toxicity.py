"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 5 characters (code points, lower-cased in any script) of a whole text, hashed to ``BUCKETS``.
On a bounded sample of labelled texts each feature gets the log ratio of its share among toxic and other
texts; logistic regression is fitted over features scaled so, on the features that tell the classes apart best.
The intercept then moves from the sample's balance to the shares of all labelled rows.

NULL text is empty; an empty text gets the score of the intercept. With labels of one class alone, or none,
every score is the smoothed share of toxic labels. Rows that repeat are each scored; NULL labels or ids teach nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.samples import labelled_sample
from llm.texts import learns

BUCKETS = 1 << 18
#: Bounds of the labelled sample: texts a class, and characters of a text (longer ones are not sampled).
SAMPLE_TEXTS, SAMPLE_CHARS = 1200, 20_000
FEATURES = 20_000
LEAST_TEXTS = 4
ROUNDS = 150
THRESHOLD = 0.7

#: Multipliers of the rolling and of the final hash, and code points looked at together.
STEP, MIX, SLICE = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 1 << 20


class Grams:
    """The distinct hashed n-grams of one text after another."""

    def __init__(self):
        self.seen = np.zeros(BUCKETS, bool)

    def of(self, text: str) -> np.ndarray:
        text = text.lower()
        for start in range(0, len(text), SLICE):
            part = text[start : start + SLICE + 4]  # no gram is cut
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            gram = codes
            for n in range(2, 6):
                if len(codes) < n:
                    break
                gram = gram[:-1] * STEP + codes[n - 1 :]
                if n > 2:
                    self.seen[((gram + np.uint64(n << 56)) * MIX) >> np.uint64(46)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def fit(sample: list[tuple[int, str]], toxic: int, other: int) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the intercept; ``toxic`` and ``other`` count all labelled rows."""
    prior = math.log((toxic + 1) / (other + 1))
    weights = np.zeros(BUCKETS, np.float32)
    y = np.array([label for label, _ in sample], float)
    if not 0 < y.sum() < len(y):
        return weights, prior
    grams = Grams()
    rows = [grams.of(text) for _, text in sample]
    column, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    inside = np.bincount(column, y[row], BUCKETS)
    total = np.bincount(column, minlength=BUCKETS)
    p, q = (inside + 1) / (y.sum() + 2), (total - inside + 1) / (len(y) - y.sum() + 2)
    ratio = np.where(total >= LEAST_TEXTS, np.log(p / q), 0.0)
    best = np.argsort(-np.abs(ratio) * np.sqrt(total), kind="stable")[:FEATURES]
    best = best[ratio[best] != 0]
    place = np.full(BUCKETS, -1)
    place[best] = np.arange(len(best))
    kept = place[column] >= 0
    row, column = row[kept], place[column[kept]]
    x = ratio[best][column]
    v, b = np.zeros(len(best)), 0.0
    m, s, rate = np.zeros(len(best) + 1), np.zeros(len(best) + 1), 0.02
    for step in range(1, ROUNDS + 1):
        margin = np.bincount(row, x * v[column], len(y)) + b
        off = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        slope = np.append(np.bincount(column, x * off[row], len(best)) / len(y) + 1e-4 * v, off.mean())
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        v, b = v - move[:-1], b - move[-1]
    weights[best] = v * ratio[best]
    return weights, b + prior - math.log(y.sum() / (len(y) - y.sum()))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on the sample of all rows that are not held out."""
    known = labels.where(learns(F.col("doc_id"), 3, 1)).select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = [(label, text) for label, _, text in labelled_sample(docs, known, SAMPLE_TEXTS, SAMPLE_CHARS, cut=False)]
    return fit(sample, counts.get(1, 0), counts.get(0, 0))


def score_texts(docs: DataFrame, weights: np.ndarray, intercept: float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with the score of each text."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def work(batches):
        grams = Grams()
        for batch in batches:
            scores = []
            for value in batch.column("__text"):
                margin = intercept + float(weights[grams.of(value.as_py() or "")].sum(dtype=np.float64))
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, margin)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return source.mapInArrow(work, f"{fields}, score double")
