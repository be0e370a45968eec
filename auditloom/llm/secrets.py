"""Secret scans: patterns, and two character Markov models compared by log-likelihood ratio.

One model describes random strings, the other ordinary identifiers; each is an order-one Markov chain over the
characters of candidate strings, trained from labelled samples: the values that the patterns find (and strings drawn
from a key alphabet with a fixed seed, so that the model exists before any secret is found) against the corpus's
ordinary words. The fitting rows are a bounded sample by hash of doc_id (``fit_rows``); the scan reads every whole text.

Base spans (kinds assign, access, hex) stay as found. A candidate is a maximal run of ``[A-Za-z0-9+/_=-]`` of
``SHORTEST`` characters or more that meets no base span, whatever it is made of; it becomes a span of kind ``random`` if its
log-likelihood ratio exceeds ``evidence`` (the odds against a run being a key, so that short runs must stand out more)
and ``threshold`` for each character.

Defined results: a null text is empty and has no span; the hash of no spans is that of the empty string; equal rows
give equal rows; other columns are not read; a very long run is one candidate, in linear time. Positions count code points.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the length may stand in the pattern
SHORTEST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CODE = {c: i for i, c in enumerate(ALPHABET)}
_TABLE = np.zeros(128, dtype=np.int64)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                found.append((m.start(), 1, m.end()))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    found.sort()
    return found


def base_values(text: str) -> list[str]:
    values = [text[s:e] for s, k, e in base_spans(text) if k]
    return values + [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 12]


def codes(s: str) -> np.ndarray:
    return _TABLE[np.frombuffer(s.encode("ascii"), dtype=np.uint8)]


def pair_counts(samples: list[str]) -> np.ndarray:
    """Counts of character pairs; row K is the start of a string."""
    k = len(ALPHABET)
    total = np.zeros((k + 1, k), dtype=np.int64)
    for s in samples:
        c = codes(s)
        if len(c):
            total[k, c[0]] += 1
            np.add.at(total, (c[:-1], c[1:]), 1)
    return total


def random_samples(n: int = 3000, seed: int = 7) -> list[str]:
    """Labelled random strings: keys over hexadecimal, upper-case, alphanumeric and base64 alphabets."""
    rng = np.random.default_rng(seed)
    kinds = (string.digits + "abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/")
    return ["".join(rng.choice(list(kinds[i % 4]), size=int(rng.integers(20, 48)))) for i in range(n)]


def log_model(total: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    p = total + smooth
    return np.log(p / p.sum(axis=1, keepdims=True))


_WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pair counts of found values, and behind them those of ordinary words."""
    k = len(ALPHABET)
    total = np.zeros((2, k + 1, k), dtype=np.int64)
    for b in batches:
        for text in b.column(0).to_pylist():
            spans = base_spans(text)
            met = np.zeros(len(text) + 1, dtype=bool)
            for s, _, e in spans:
                met[s:e] = True
            total[0] += pair_counts([s for s in base_values(text) if all(c in _CODE for c in s)])
            total[1] += pair_counts([m[0] for m in _WORD.finditer(text) if not met[m.start() : m.end()].any() and not _mixed(m[0])])
    flat = total.reshape(-1)
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["i", "n"])


def fit(docs: DataFrame, fit_rows: int = 2000) -> np.ndarray:
    """The table of log-likelihood ratios for character pairs; counts are summed before they are collected."""
    common.prepare(docs.sparkSession)
    share = min(1.0, fit_rows / max(1, docs.count()))
    unit = F.xxhash64(common.id_text(docs["doc_id"]), F.lit("secrets")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    counted = docs.where(unit < share).select(common.text_of(docs).alias("text")).transform(common.arrow, _samples, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    k = len(ALPHABET)
    total = np.zeros(2 * (k + 1) * k, dtype=np.int64)
    for r in counted.collect():
        total[r["i"]] = r["n"]
    secret, plain = total.reshape(2, k + 1, k)
    return log_model(secret + pair_counts(random_samples())) - log_model(plain)


def ratio(s: str, table: np.ndarray) -> float:
    """The log-likelihood ratio of a string."""
    c = codes(s)
    return float(table[-1, c[0]] + table[c[:-1], c[1:]].sum())


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def spans(text: str, table: np.ndarray, threshold: float, evidence: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those together with what the models add."""
    base = base_spans(text)
    more, i = [], 0
    reach = list(accumulate((e for _, _, e in base), max))  # furthest end of the base spans up to each
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while i < len(base) and base[i][0] < e:
            i += 1
        if not (i and reach[i - 1] > s) and ratio(m[0], table) > max(evidence, threshold * (e - s)):
            more.append((s, 3, e))
    return base, sorted(base + more) if more else base


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def _scan(batches: Iterator[pa.RecordBatch], table: np.ndarray, threshold: float, evidence: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for text in b.column(1).to_pylist():
            base, every = spans(text, table, threshold, evidence)
            kinds = [k for _, k, _ in every]
            row = (*(kinds.count(k) for k in range(3)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), kinds.count(3))
            for column, x in zip(out, row, strict=True):
                column.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[x.split()[0] for x in _OUT.split(", ")])


def scan(docs: DataFrame, threshold: float = 1.0, evidence: float = 16.0, fit_rows: int = 2000) -> DataFrame:
    """One row per document with its secrets."""
    table = fit(docs, fit_rows)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    return rows.transform(common.arrow, lambda it: _scan(it, table, threshold, evidence), _OUT)
