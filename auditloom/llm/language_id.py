"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to ``N`` lower-cased characters; tf is the share of a text's n-grams, idf comes
from the fitting rows. Weights are trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2),
then a temperature is fitted on rows that the weights haven't seen.

A text also has a rarity, the mean idf of its n-grams: how seldom the fitting rows have what it is made of. It doesn't depend on
the labels or their number. ``keep_known`` takes a text for one of no learned language where its rarity exceeds by ``margin`` all
that the rows held back from the weights show, also when only its words without digits are counted; texts of fewer than
``LEAST_GRAMS`` n-grams are too short to tell, and stay.

The model is fitted on a bounded sample: about ``per_label`` rows of each label, taken by a hash of doc_id; everything else
covers whole texts of all rows. Every label is learned: the model has a column for each, as a language list is short.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text if no labelled
row exists (``keep_known`` then drops all); equal texts get equal results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N, BITS = 3, 16
DIM = 1 << BITS
#: Characters handled at once.
CHUNK = 400_000
#: tf-idf values are small; one factor for all keeps the learning rate readable.
SCALE = 40.0
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
UNKNOWN = "und"
LEAST_GRAMS = 60


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def hashed(cp: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position; the last n-1 positions have none."""
    with np.errstate(over="ignore"):
        h = cp[: len(cp) - n + 1] * _MULTIPLIERS[0]
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * _MULTIPLIERS[1] + cp[k : len(cp) - n + 1 + k] * _MULTIPLIERS[2]
        h = (h + np.uint32(n)) * _MULTIPLIERS[0]
    return h >> np.uint32(32 - BITS)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def grams(length: int) -> int:
    """The number of n-grams of a text."""
    return sum(max(0, length - n + 1) for n in range(1, N + 1))


def lettered(text: str) -> str:
    """The words of a text that hold no digit, @ or =, without punctuation."""
    return " ".join(re.sub(r"[\W\d_]+", " ", w).strip() for w in text.split() if not re.search(r"[\d@=]", w))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text with their shares."""
    total = np.zeros(DIM, dtype=np.int64)
    cp = code_points(text.lower())
    for at in range(0, max(1, len(cp)), CHUNK):
        for n in range(1, N + 1):
            part = cp[at : at + CHUNK + n - 1]
            if len(part) >= n:
                total += np.bincount(hashed(part, n), minlength=DIM)
    at = np.flatnonzero(total)
    return at.astype(np.uint32), (total[at] / max(1, total.sum())).astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(label, *map(np.ndarray.tobytes, counts(text)), order, grams(len(text))) for label, text, order in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if has_letter(text)]
        if rows:
            label, at, share, order, size = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(at, pa.binary()), pa.array(share, pa.binary()), pa.array(order, pa.int64()), pa.array(size, pa.int64())], names=["label", "at", "share", "order", "size"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (DIM + 1, k), the last row the intercepts."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, per_label: int = 800, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> dict:
    """Fit on the rows of docs (text, label, id) with both text and label; a dict of arrays. The last column of the weights, after the labels, gives a text's rarity."""
    spark = common.prepare(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return {"labels": [], "weights": np.zeros((DIM, 1), np.float32), "bias": np.zeros(1), "temperature": 1.0, "rarest": np.inf}
    unit = (F.xxhash64(common.id_text(F.col("id")), F.lit("fit")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("unit")
    share = spark.createDataFrame([(k, min(1.0, per_label / v)) for k, v in sizes.items()], "label string, share double")
    picked = rows.join(F.broadcast(share), "label").where(unit < F.col("share"))
    got = picked.select("label", "text", F.xxhash64(common.id_text(F.col("id")), F.lit("order")).alias("order")).transform(common.arrow, _vectors, "label string, at binary, share binary, order long, size long").collect()
    got.sort(key=lambda r: (r["order"], r["label"], r["at"]))
    index = {x: i for i, x in enumerate(names)}
    seen = np.zeros(DIM)
    data, sizes = [], np.array([r["size"] for r in got])
    for r in got:
        at, tf = np.frombuffer(r["at"], np.uint32), np.frombuffer(r["share"], np.float32)
        seen[at] += 1
        data.append((at, tf, index[r["label"]]))
    idf = np.log((1 + len(data)) / (1 + seen)) + 1
    ready = [(np.append(at, DIM), np.append(tf * idf[at] * SCALE, 1.0), y) for at, tf, y in data]
    cut = len(ready) // 5 if len(ready) >= 20 else 0
    w = ftrl(ready[cut:], len(names), epochs, alpha, beta, l1, l2)
    held = np.array([x @ w[at] for at, x, _ in ready[:cut]]).reshape(cut, len(names))
    t = temperature(held, np.array([y for _, _, y in ready[:cut]], dtype=int))
    # n-grams that only the held rows have would not be known, so what they show is counted by the others
    known = np.zeros(DIM)
    for at, _, _ in data[cut:]:
        known[at] += 1
    rare = np.log((1 + len(data) - cut) / (1 + known)) + 1
    shown = [float(tf @ rare[at]) for (at, tf, _), n in zip(data[:cut], sizes[:cut], strict=True) if n >= LEAST_GRAMS]
    weights = np.column_stack([w[:DIM] * (idf * SCALE)[:, None], rare]).astype(np.float32)
    return {"labels": names, "weights": weights, "bias": np.append(w[DIM], 0.0), "temperature": t, "rarest": max(shown, default=np.inf)}


def logits(texts: list[str], model: dict) -> np.ndarray:
    """Logits of whole texts, and their rarity in the last column; short texts are laid end to end and summed by segment."""
    w, k = model["weights"], model["weights"].shape[1]
    out = np.zeros((len(texts), k))
    i = 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size + len(texts[i]) < CHUNK):
            group.append(i)
            size += len(texts[i])
            i += 1
        if len(group) == 1 and size > CHUNK:
            cp, sums, total = code_points(texts[group[0]].lower()), np.zeros(k), 0
            for at in range(0, len(cp), CHUNK):
                for n in range(1, N + 1):
                    part = cp[at : at + CHUNK + n - 1]
                    if len(part) >= n:
                        h = hashed(part, n)
                        sums += w[h].sum(axis=0, dtype=np.float64)
                        total += len(h)
            out[group[0]] = sums / max(1, total)
            continue
        lower = [texts[j].lower() for j in group]
        cp = code_points("".join(lower))
        ends = np.cumsum([len(x) for x in lower])
        starts = ends - [len(x) for x in lower]
        sums, total = np.zeros((len(group), k)), np.zeros(len(group))
        for n in range(1, N + 1):
            if len(cp) < n:
                continue
            rows = w[hashed(cp, n)]
            last = np.maximum(ends - n + 1, starts)  # n-grams don't reach into the next text
            some = np.flatnonzero(last > starts)
            if len(some):
                cuts = np.empty(2 * len(some), dtype=np.int64)
                cuts[0::2], cuts[1::2] = starts[some], last[some]
                closed = cuts[:-1] if cuts[-1] >= len(rows) else cuts
                sums[some] += np.add.reduceat(rows, closed, axis=0)[0::2]
                total[some] += last[some] - starts[some]
        out[group] = sums / np.maximum(total, 1)[:, None]
    return out + model["bias"]


def _predict(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    names, t = model["labels"], model["temperature"]
    for b in batches:
        texts = b.column(1).to_pylist()
        label, score, rarity = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        some = [i for i, x in enumerate(texts) if x is not None and has_letter(x)]
        if names and some:
            z = logits([texts[i] for i in some], model)
            p = softmax(z[:, : len(names)] / t)
            best = p.argmax(axis=1)
            for i, j in zip(some, best, strict=True):
                label[i] = names[j]
            score[some], rarity[some] = p[np.arange(len(some)), best], z[:, -1]
        kept = [b.column(i) for i in range(b.num_columns) if i != 1]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(label, pa.string()), pa.array(score), pa.array(rarity)], names=[*(n for i, n in enumerate(b.schema.names) if i != 1), "lang_pred", "score", "rarity"])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rarity."""
    common.prepare(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).transform(common.arrow, lambda it: _predict(it, model), "doc_id long, lang_pred string, score double, rarity double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that the contract lets the model learn from: crc32 of the id modulo 5 is not 0."""
    return docs.where(common.id_mod(docs["doc_id"], 5) != 0).select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("label"))


def identify(docs: DataFrame, **fit_options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = predict(docs, fit(training_rows(docs), **fit_options))
    return found.select("doc_id", (common.id_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rarity")


def keep_known(spark: SparkSession, docs: DataFrame, margin: float = 0.25, **fit_options) -> DataFrame:
    """docs without the rows that have no letter or are in no learned language; all columns pass through, rows as often as they occur."""
    common.prepare(spark)
    model = fit(training_rows(docs), **fit_options)

    bound = (1 + margin) * model["rarest"]

    def kept(batches):
        for b in batches:
            two = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(at)], names=["doc_id", "text"])
            found = next(_predict(iter([two]), model))
            long = np.array([x is not None and grams(len(x)) >= LEAST_GRAMS for x in b.column(at).to_pylist()], dtype=bool)
            strange = long & (found.column(3).to_numpy() > bound)
            for i in np.flatnonzero(strange):  # numbers, addresses and keys are rare in every language
                words = lettered(b.column(at)[i].as_py())
                strange[i] = grams(len(words)) >= LEAST_GRAMS and logits([words], model)[0, -1] > bound
            keep = np.array([x != UNKNOWN for x in found.column(1).to_pylist()], dtype=bool) & ~strange
            yield b.filter(pa.array(keep))

    at = docs.columns.index("text")
    return docs.transform(common.arrow, kept, docs.schema)
