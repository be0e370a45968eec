"""Mixing sources to target weights with soft membership.

A multinomial classifier, fitted on a bounded sample of the labels table, gives each document posteriors over the domains
(clean, low, toxic). Document rates r >= 0 are then fitted so that the expected tokens of each domain, the sum of
rate x tokens x posterior, meet the targets: the least-squares problem over domains (each scaled by its tokens at rate 1)
is solved by accelerated projected gradient in the token-weighted norm, from r = 1. A step's gradient at a document is its
posterior times the domains' residuals, so an iteration needs one aggregate of as many numbers as there are domains; a
document's rate is replayed from the residuals of the last steps, inside one expression, and written beside the posteriors every
``REPLAYED`` steps.

Rates are real numbers; ``copies`` realises them: the whole part, and one more with the fraction's probability by a hash of
the text. ``target_gap`` is the largest relative deviation from a target that the steps taken leave; a warning is given where it isn't
under ``close``.

Defined results: a document without words has rate 1; a null text is empty; without labels every posterior is
uniform; a domain with no expected tokens cannot be fed and is left out of the residuals; of a document's several labels the
cleanest counts; an empty table gives an empty table.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashed_text
from .language_id import softmax

DOMAINS = ("clean", "low", "toxic")
REPLAYED = 10
#: Shares of the tokens after mixing.
TARGETS = {"clean": 0.97, "low": 0.025, "toxic": 0.005}


def domain(labels: DataFrame) -> Column:
    """A label's domain; null if a part that decides is null."""
    return F.when(labels["toxic"] == 1, 2).when(labels["toxic"] == 0, F.when(labels["quality"] == 0, 1).when(labels["quality"] == 1, 0))


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = 4, alpha: float = 0.2, l1: float = 0.4, l2: float = 0.05) -> np.ndarray:
    """Weights by bucket and domain, by follow-the-regularised-leader on the multinomial log loss."""
    k = len(DOMAINS)
    z, n = np.zeros((hashed_text.DIM, k)), np.zeros((hashed_text.DIM, k))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((1.0 + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, y = rows[i]
            w = weights(at)
            g = softmax(w.sum(axis=0))
            g[y] -= 1.0
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def posteriors(docs: DataFrame, labels: DataFrame, fit_rows: int = 8_000) -> DataFrame:
    """doc_id, a posterior for each domain, n_tokens, unit."""
    weights = fit(hashed_text.labelled_sample(docs, labels, domain(labels), fit_rows))
    return hashed_text.scored(docs, lambda rows: list(softmax(hashed_text.sums(rows, weights)).T), [f"p_{d}" for d in DOMAINS], count=True)


def replayed(steps: list[list[float]], moments: list[float]) -> Column:
    """A document's state after these steps from its x and y: x = max(0, y - p . g), then y = x + m (x - x before)."""
    start = F.struct("x", "y")
    if not steps:
        return start
    made = F.array(*(F.struct(*(F.lit(float(g)).alias(f"g{j}") for j, g in enumerate(s)), F.lit(float(m)).alias("m")) for s, m in zip(steps, moments, strict=True)))

    def step(state: Column, s: Column) -> Column:
        move = sum((F.col(f"p_{d}") * s[f"g{j}"] for j, d in enumerate(DOMAINS)), F.lit(0.0))
        x = F.greatest(F.lit(0.0), state["y"] - move)
        return F.struct(x.alias("x"), (x + s["m"] * (x - state["x"])).alias("y"))

    return F.aggregate(made, start, step)


def started(table: DataFrame) -> DataFrame:
    return table.withColumns({"x": F.lit(1.0), "y": F.lit(1.0)})


def advanced(table: DataFrame, steps: list, moments: list) -> DataFrame:
    """The table with the state after these steps."""
    return table.withColumn("_s", replayed(steps, moments)).withColumns({"x": F.col("_s.x"), "y": F.col("_s.y")}).drop("_s")


def fit_rates(table: DataFrame, targets: dict[str, float], steps: int = 60, close: float = 1e-4) -> tuple[list, list, DataFrame, float]:
    """Gradients and moments of the steps taken, the table with its state after them, and the largest relative gap left."""
    n = F.col("n_tokens").cast("double")
    first = table.agg(*(F.coalesce(F.sum(n * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in DOMAINS), F.coalesce(F.sum(n), F.lit(0.0)).alias("all")).first()
    base = np.array([first[d] for d in DOMAINS])
    want = np.array([targets.get(d, 0.0) for d in DOMAINS], dtype=float)
    want = want / want.sum() * first["all"]
    scale = np.where(base > 0, 1.0 / np.maximum(base, 1e-300), 0.0)
    table, done = started(table), 0
    taken: list[list[float]] = []
    moments: list[float] = []
    t, at = 1.0, base  # expected totals at y
    gap = float(np.abs((base - want) * scale).max())
    while first["all"] and gap >= close and len(taken) < steps:
        # for the scaled problem the gradient's Lipschitz constant in the token norm is at most 1: rows of posteriors sum to 1
        taken.append([float(g) for g in (at - want) * scale])
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        moments.append((t - 1) / t_next)
        t = t_next
        now = advanced(table, taken[done:], moments[done:])
        if len(taken) - done == REPLAYED:
            table, done = common.written(now, "mixing"), len(taken)
            now = table
        r = now.agg(*(F.sum(n * F.col(f"p_{d}") * F.col(v)).alias(f"{v}_{d}") for d in DOMAINS for v in ("x", "y"))).first()
        at = np.array([r[f"y_{d}"] for d in DOMAINS])
        gap = float(np.abs((np.array([r[f"x_{d}"] for d in DOMAINS]) - want) * scale).max())
    if first["all"] and gap >= close:
        warnings.warn(f"mixing: {len(taken)} steps leave a gap of {gap:.2g} to a target", stacklevel=2)
    return taken, moments, advanced(table, taken[done:], moments[done:]), gap


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, fit_rows: int = 8_000, steps: int = 60) -> DataFrame:
    """One row per document: doc_id, n_tokens, posteriors p_<domain>, rate, copies, target_gap."""
    table = common.written(posteriors(docs, labels, fit_rows), "posteriors")
    _, _, made, gap = fit_rates(table, targets or TARGETS, steps)
    rate = F.when(F.col("n_tokens") > 0, F.col("x")).otherwise(F.lit(1.0))
    copies = (F.floor("rate") + (F.col("unit") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return made.withColumn("rate", rate).select("doc_id", *(f"p_{d}" for d in DOMAINS), "n_tokens", "rate", copies.alias("copies"), F.lit(gap).alias("target_gap"))


def rates_of(p: np.ndarray, taken: list[list[float]], moments: list[float]) -> np.ndarray:
    """``replayed`` for rows of posteriors."""
    x = y = np.ones(len(p))
    for g, m in zip(taken, moments, strict=True):
        new = np.maximum(0.0, y - p @ np.array(g))
        x, y = new, new + m * (new - x)
    return x


def take(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, fit_rows: int = 8_000, steps: int = 60) -> DataFrame:
    """The rows of docs that the mixture takes, all columns, with ``rate`` and ``copies`` (1 or more) added; columns of these names are replaced.

    Rates are computed from a row's own text, so no join is needed and rows may repeat doc_ids.
    """
    weights = fit(hashed_text.labelled_sample(docs, labels, domain(labels), fit_rows))
    names = [f"p_{d}" for d in DOMAINS]
    table = common.written(hashed_text.scored(docs, lambda rows: list(softmax(hashed_text.sums(rows, weights)).T), names, count=True), "posteriors")
    taken, moments, _, _ = fit_rates(table, targets or TARGETS, steps)
    docs = docs.select(*(c for c in docs.columns if c not in ("rate", "copies")))
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("rate", T.DoubleType()), T.StructField("copies", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = hashed_text.Buckets()
        for b in batches:
            if not b.num_rows:
                continue
            texts = [x or "" for x in b.column(at).to_pylist()]
            rows = [hashed_text.featured(x, buckets) for x in texts]
            p = softmax(hashed_text.sums([r for r, _ in rows], weights)).astype(float)
            rate = np.where([n > 0 for _, n in rows], rates_of(p, taken, moments), 1.0)
            unit = np.array([hashed_text.unit_of(x) for x in texts])
            copies = np.floor(rate) + (unit < rate - np.floor(rate))
            made = pa.RecordBatch.from_arrays([*b.columns, pa.array(rate), pa.array(copies.astype(np.int64))], names=[*b.schema.names, "rate", "copies"])
            yield made.filter(pa.array(copies > 0))

    return docs.transform(common.arrow, run, schema)
