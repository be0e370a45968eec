"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 < 1 < 2: toxic, low quality, good, from the labels table. All grades share one vector of hashed-text
weights; ordered thresholds t1 < t2 cut its score s: P(grade <= j) = sigmoid(t_{j+1} - s). Weights are fitted by
follow-the-regularised-leader with an L1 penalty, thresholds by gradient steps on their gaps (so they stay ordered), on a
bounded sample (``fit_rows`` labelled documents by hash of doc_id). Every document is scored on its whole text.

Results: expected_grade (0 to 2), tail (probability of the top grade), kept (tail of ``least`` or more).

Defined results: a null text is the empty one; without labels all weights are 0 and the thresholds (-1, 1); a rating
with a null part that decides it is no rating; of a document's several ratings the lowest counts; rows that repeat give repeated rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_text

GRADES = 3


def rating(labels: DataFrame):
    """0 for toxic, 1 for low quality that isn't toxic, 2 for good; null if a part that decides is null."""
    return F.when(labels["toxic"] == 1, 0).when(labels["toxic"] == 0, F.when(labels["quality"] == 0, 1).when(labels["quality"] == 1, 2))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def cumulative(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade <= j) for j = 0 .. GRADES-2, by row."""
    return sigmoid(cuts[None, :] - np.asarray(score)[:, None])


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = 4, alpha: float = 0.25, l1: float = 0.4, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts)."""
    z, n = np.zeros(hashed_text.DIM), np.zeros(hashed_text.DIM)
    first, gap = -1.0, np.log(2.0)
    g_first, g_gap = 1.0, 1.0

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((1.0 + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, y = rows[i]
            w = weights(at)
            s = w.sum()
            cuts = (-np.inf, first, first + np.exp(gap), np.inf)
            hi, lo = sigmoid(cuts[y + 1] - s), sigmoid(cuts[y] - s)
            p = max(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p  # derivatives of log P by the upper and the lower cut
            g = d_hi - d_lo  # of -log P by s
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
            by_first = -(d_hi * (y < 2)) + d_lo * (y > 0)
            by_gap = (-(d_hi if y == 1 else 0.0) + (d_lo if y == 2 else 0.0)) * np.exp(gap)
            g_first, g_gap = g_first + by_first**2, g_gap + by_gap**2
            first -= 0.3 * by_first / np.sqrt(g_first)
            gap = float(np.clip(gap - 0.3 * by_gap / np.sqrt(g_gap), -3, 3))
    return weights(slice(None)).astype(np.float32), np.array([first, first + np.exp(gap)])


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, fit_rows: int = 12_000) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail, kept."""
    weights, cuts = fit(hashed_text.labelled_sample(docs, labels, rating(labels), fit_rows))

    def score(rows):
        below = cumulative(hashed_text.sums(rows, weights), cuts)
        return [(1 - below).sum(axis=1), 1 - below[:, -1]]

    return hashed_text.scored(docs, score, ["expected_grade", "tail"]).withColumn("kept", F.col("tail") >= least)
