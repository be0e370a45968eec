"""LM scoring by a hierarchical Pitman-Yor model of words, with Chinese-restaurant seating sampled by Gibbs.

A restaurant stands for each context, the word before; its dishes are words, and its new tables send customers to one parent
restaurant of all words, whose base is uniform over the vocabulary and one unknown word. Every word before has a restaurant of its own.

Layout. Words are dealt to buckets by hash, in packed arrays and one shuffle: a bucket has all (context, word) types of its
words, their counts and the documents in which they occur. A word with a share of ``HOT`` or more of a sample is hot and dealt by
word and context class, in as many classes as its share asks for, so that no place holds much more than that share; its parent
statistics are summed over buckets. (Hotness decides where customers sit, not what they eat.) The sampler's global state is
two numbers for each hot word's restaurant, a few for the parent and one for each hot word; a pass over the buckets returns sums of that
size, packed in slices that Spark's tasks add up. The restaurants of all other words, rare ones, have no bound and are never in one
place: after a pass each bucket sends its tables and customers of each to the task that adds up that part of the hashes, which sends the
totals back to the buckets that asked; they meet the types in a join on a table bucketed by the same key, so the types don't move.

Sampling. A pass runs ``sweeps`` local sweeps with the global statistics of the pass before. In a sweep the number of tables of
each type with 2 to ``EXACT`` customers is drawn from its full conditional, with generalised Stirling numbers; for more customers
from the limit of that conditional or its saddle point (``many_tables``). The parent follows by the same rule. The last pass averages predictive probabilities over its samples after burn-in and scores all tokens with them.
Discounts are estimated from types with one and two customers; seeds are fixed by bucket and pass, so a lost task is redone alike.

Defined results: a null or empty text is one end token; a null doc_id counts as the empty text in the fold; rows that repeat are
scored each; without training rows every token has the base probability; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources.bucketed import BucketedTable

from . import common
from .shingles import mix, words_of

EXACT, FINE = 256, 64
#: Share of a type's customers up to which tables are few.
FEW = 0.02
FLUSH, BUCKETS, BUCKET_TOKENS = 1_000_000, 512, 2_000_000
#: Words with this share of the sample's tokens or more are hot; there are 1 / HOT of them at most.
HOT = 2e-5
END, START = b"\n", b"\n\n"  # not words, for they hold white space
_HELD = 1 << 15  # documents of a flush that are not learned from have indices from here
_ODD, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF)
#: Places in the sums that a pass returns, after the hot restaurants' tables; RARE: all tables of the others. Behind these the hot words.
TOKENS, VOCAB, TABLES0, ONES1, TWOS1, ONES0, TWOS0, RARE, FIXED = range(9)
#: In place of a hot word's number, of which there are 1 / HOT and one at most.
_RARE = 0xFFFF
SLICE = 1 << 16


class Words:
    """The hot words (even hashes, ascending) and the classes of context that each is dealt by."""

    def __init__(self, hot: np.ndarray, splits: np.ndarray):
        self.hot, self.splits = hot, splits

    def number_of(self, h: np.ndarray) -> np.ndarray:
        """The numbers of hot words."""
        return np.where(h & np.uint64(1), (h & _LOW) >> np.uint64(1), np.uint64(_RARE)).astype(np.uint16)

    def placed(self, h: np.ndarray, before: np.ndarray) -> np.ndarray:
        """A word's place: its code; for a hot word, its upper half is the hash of word and context class."""
        hot = np.flatnonzero(h & np.uint64(1))
        out = h.copy()
        if len(hot):
            low = h[hot] & _LOW
            with np.errstate(over="ignore"):
                x = mix(h[hot] + mix(before[hot]) % self.splits[(low >> np.uint64(1)).astype(np.int64)] * _ODD)
            out[hot] = (x & ~_LOW) | low
        return out


class TokenCodes(dict):
    """Codes of words: an even hash; for a hot word, twice its index and one below the hash's upper half. Forgets all when full."""

    def __init__(self, hot: np.ndarray):
        super().__init__()
        self.hot = {h: i for i, h in enumerate(hot.tolist())}

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        h = xxhash.xxh64_intdigest(word) & ~1
        i = self.hot.get(h)
        self[word] = h = h if i is None else h >> 32 << 32 | i << 1 | 1
        return h


def bucket_of(place: np.ndarray, buckets: int) -> np.ndarray:
    return (((place >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pack24(x: np.ndarray) -> bytes:
    """Numbers under 2**24 in two planes."""
    return (x & 0xFFFF).astype(np.uint16).tobytes() + (x >> 16).astype(np.uint8).tobytes()


def unpack24(blob: bytes) -> np.ndarray:
    n = len(blob) // 3
    return np.frombuffer(blob, np.uint16, n).astype(np.int64) + (np.frombuffer(blob, np.uint8, n, 2 * n).astype(np.int64) << 16)


_BLOBS = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("ctx", pa.binary()), ("rare", pa.binary()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])
_BLOBS_DDL = "bucket int, flush long, words binary, counts binary, docs binary, ctx binary, rare binary, key long, doc_id long, n_tokens long"


def _deal(batches: Iterator[pa.RecordBatch], known: Words, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed tokens by bucket, and a row for each document."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    codes, buckets, zstd = TokenCodes(known.hot), len(names), pa.Codec("zstd", 1)
    end, start = codes[END], codes[START]
    flush, held = part << 20, 0
    tokens: list[np.ndarray] = []
    rows: list[tuple[int, int | None, int]] = []
    used = [0, _HELD]

    def sent() -> Iterator[pa.RecordBatch]:
        h, n = np.concatenate(tokens), np.array([r[2] for r in rows])
        before = np.append(np.uint64(start), h[:-1])
        before[np.cumsum(n)[:-1]] = start
        place, d = known.placed(h, before), np.repeat(np.array([r[0] & 0xFFFF for r in rows], np.uint16), n)
        order = np.argsort(place, kind="stable")
        place, before, d = place[order], before[order], d[order]
        c = known.number_of(before)
        rare = np.flatnonzero(c == _RARE)
        before = before[rare]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        words, counts = place[first], np.diff(np.append(first, len(place))).astype(np.uint32)
        cut = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1))
        at = np.append(first, len(place))
        rare = np.searchsorted(rare, at[cut])
        for b in range(buckets):
            w0, w1 = cut[b], cut[b + 1]
            if w1 > w0:
                t0, t1 = at[w0], at[w1]
                row = (
                    int(names[b]), flush, words[w0:w1].tobytes(), counts[w0:w1].tobytes(),
                    zstd.compress(d[t0:t1], asbytes=True), zstd.compress(c[t0:t1], asbytes=True), before[rare[b] : rare[b + 1]].tobytes(), None, None, None,
                )
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOBS.types, strict=True)], schema=_BLOBS)
        key, ids, n = zip(*rows, strict=True)
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(names[np.array(key) % buckets], pa.int32()), *(pa.array(none, t) for t in _BLOBS.types[1:7]), pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], schema=_BLOBS)

    for b in batches:
        for doc_id, text, learn in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = words_of(text)
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
            h[-1] = end
            kind = 0 if learn else 1
            tokens.append(h)
            rows.append((flush << 16 | used[kind], doc_id, len(h)))
            used[kind] += 1
            held += len(h)
            if held >= FLUSH or used[0] == _HELD or used[1] == 2 * _HELD:
                yield from sent()
                tokens, rows, held, used = [], [], 0, [0, _HELD]
                flush += 1
    if rows:
        yield from sent()


_STATE = pa.schema([("words", pa.binary()), ("spans", pa.binary()), ("ctx", pa.binary()), ("train", pa.binary()), ("rare", pa.binary()), ("total", pa.binary()), ("tokens", pa.binary()), ("flushes", pa.binary()), ("bucket", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])
_STATE_DDL = "words binary, spans binary, ctx binary, train binary, rare binary, total binary, tokens binary, flushes binary, bucket int, key long, doc_id long, n_tokens long"


def _seat(batches: Iterator[pa.RecordBatch], hots: int) -> Iterator[pa.RecordBatch]:
    """The blobs of each bucket as types sorted by word and context, with their tokens in that order; rows come sorted by bucket."""
    last, rows = None, []
    for b in batches:
        docs = b.filter(b.column("key").is_valid())
        if docs.num_rows:
            none = [None] * docs.num_rows
            yield pa.RecordBatch.from_arrays([*(pa.array(none, t) for t in _STATE.types[:8]), *(docs.column(n) for n in ("bucket", "key", "doc_id", "n_tokens"))], schema=_STATE)
        rest = b.filter(b.column("key").is_null())
        for row in zip(*(rest.column(n).to_pylist() for n in ("bucket", "flush", "words", "counts", "docs", "ctx", "rare")), strict=True):
            if rows and row[0] != last:
                yield _seated(last, rows, hots)
                rows = []
            last = row[0]
            rows.append(row[1:])
    if rows:
        yield _seated(last, rows, hots)


def _seated(bucket: int, rows: list[tuple], hots: int) -> pa.RecordBatch:
    """Contexts: the hot ones by their number, behind them the bucket's rare ones, ascending."""
    rows.sort(key=lambda r: r[0])
    flushes = np.array([r[0] for r in rows], np.int64)
    words, of = np.unique(np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows]), return_inverse=True)
    counts = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
    zstd, sizes = pa.Codec("zstd"), [2 * int(np.frombuffer(r[2], np.uint32).sum()) for r in rows]
    docs, ctx = (np.concatenate([np.frombuffer(zstd.decompress(r[k], n, asbytes=True), np.uint16) for r, n in zip(rows, sizes, strict=True)]) for k in (3, 4))
    ctx = ctx.astype(np.int64)
    rare, number = np.unique(np.concatenate([np.frombuffer(r[5], np.uint64) for r in rows]), return_inverse=True)
    if hots + len(rare) > 1 << 24:
        raise OverflowError("a bucket has 2**24 contexts or more: lower BUCKET_TOKENS")
    ctx[ctx == _RARE] = hots + number
    key = (np.repeat(of.astype(np.int64), counts) << 24) + ctx
    wide = np.uint32 if len(rows) < 1 << 16 else np.uint64
    tokens = docs.astype(wide) + np.repeat(np.arange(len(rows)).astype(wide) << wide(16), np.array(sizes) // 2)
    order = np.argsort(key, kind="stable")
    key, tokens = key[order], tokens[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.diff(np.append(first, len(key))).astype(np.uint32)
    train = np.add.reduceat((tokens & wide(0xFFFF)) < _HELD, first, dtype=np.uint32)
    spans = np.bincount(key[first] >> 24, minlength=len(words)).astype(np.uint32)
    row = (words.tobytes(), spans.tobytes(), pack24(key[first] & 0xFFFFFF), train.tobytes(), rare.tobytes(), total.tobytes(), tokens.tobytes(), flushes.tobytes(), bucket, None, None, None)
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _STATE.types, strict=True)], schema=_STATE)


def stirling(d: float, n: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers, [customers, tables]."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        t = np.arange(c + 1)
        with np.errstate(divide="ignore"):
            stay = out[c, : c + 1] + np.log(np.maximum(c - d * t, 0.0))
        out[c + 1, 1 : c + 2] = out[c, : c + 1]
        out[c + 1, : c + 1] = np.logaddexp(out[c + 1, : c + 1], stay)
    return out


class Seating:
    """Draws numbers of tables for customers counted by type; types are sorted by their count once."""

    def __init__(self, customers: np.ndarray, d: float, theta: float, table: np.ndarray, rng: np.random.Generator):
        self.d, self.theta, self.table, self.rng = d, theta, table, rng
        self.customers = customers
        self.ones = np.minimum(customers, 1).astype(np.int64)
        order = np.argsort(customers, kind="stable")
        sizes = customers[order]
        # types of one size share a matrix, larger ones one of all sizes up to a bound
        tops = [*range(2, FINE + 1), 2 * FINE, 4 * FINE]
        ends = np.searchsorted(sizes, [1, *tops], "right")
        self.same = [(c, order[a:b]) for c, a, b in zip(tops, ends[:-1], ends[1:], strict=True) if b > a]
        self.many = order[ends[-1] :]

    def draw(self, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """tables: of the type's restaurant; parent: the probability that its parent serves the word."""
        out = self.ones.copy()
        logp = np.log(parent)
        for c, at in self.same:
            for part in np.array_split(at, max(1, len(at) * c // 4_000_000)):
                t = np.arange(1, c + 1)
                new = np.log(self.theta + self.d * (np.maximum(tables[part], 1)[:, None] - 1 + t[None, :] - 1) + 1e-300)
                w = self.table[self.customers[part], 1 : c + 1] + t[None, :] * logp[part][:, None] + np.cumsum(new, axis=1)
                w = np.exp(w - w.max(axis=1, keepdims=True))
                w = np.cumsum(w, axis=1)
                out[part] = 1 + (w < self.rng.random(len(part))[:, None] * w[:, -1:]).sum(axis=1)
        if len(self.many):
            at = self.many
            out[at] = many_tables(self.customers[at], self.d, self.theta + self.d * np.maximum(tables[at] - 1, 0), parent[at], self.rng)
        return out


def many_tables(c: np.ndarray, d: float, first: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables t for many customers c, from P(t) ~ S(c, t) prod_{j<t} p (first + d j).

    For few tables S(c, t) tends to a function of c times 1 / (d**t (t-1)!), which leaves a negative binomial. Otherwise S(c, t) is
    c! / (t! d**t) times the coefficient of z**c in (1 - (1 - z)**d)**t, whose saddle point gives mode and curvature of log P(t).
    """
    c, p = c.astype(float), np.minimum(p, 0.999)
    a, b = first * p, d * p
    r = a / b + 1
    t = 1 + rng.negative_binomial(r, 1 - p).astype(float)
    big = np.flatnonzero(1 + r * p / (1 - p) > FEW * c)
    if len(big):
        n, a, b = c[big], a[big], b[big]
        lo, hi = np.full(len(big), -700.0), np.zeros(len(big))  # logarithm of q = 1 - z
        for _ in range(60):
            q = np.exp((lo + hi) / 2)
            above = a * d / (d + b * np.expm1(d * np.log(q))) * (1 - q) * q ** (d - 1) > n
            lo, hi = np.where(above, (lo + hi) / 2, lo), np.where(above, hi, (lo + hi) / 2)

        def tables(q):
            return n * -np.expm1(d * np.log(q)) / (d * (1 - q) * q ** (d - 1))  # where q is the saddle point

        q = np.exp((lo + hi) / 2)
        mode, step = tables(q), np.minimum(1e-4 * q, 1e-4 * (1 - q))
        up, down = tables(q + step), tables(q - step)
        slope = (np.log(-np.expm1(d * np.log(q + step))) - np.log(-np.expm1(d * np.log(q - step)))) / (up - down)
        curve = 1 / mode - slope - b / (a + b * mode)
        t[big] = np.round(mode + 0.5 + rng.standard_normal(len(big)) / np.sqrt(np.maximum(curve, 1e-12)))
    return np.clip(t, 1, c).astype(np.int64)


def narrow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers in the width that makes them smallest, and apart from them those that exceed it; as they are sent to tasks."""
    kind = min((np.uint8, np.uint16, np.uint32), key=lambda k: len(x) * np.dtype(k).itemsize + 8 * np.count_nonzero(x > np.iinfo(k).max))
    more = np.flatnonzero(x > np.iinfo(kind).max)
    out = x.copy()
    out[more] = 0
    return out.astype(kind), more.astype(np.int32), x[more]


def widened(packed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    x, more, values = packed
    out = x.astype(np.float32)
    out[more] = values
    return out


class Global:
    """What all buckets share: customers and tables by hot restaurant, the parent's totals, hot words; of bounded size."""

    def __init__(self, customers: np.ndarray, sums: np.ndarray, contexts: int, theta1: float, theta0: float):
        """sums: tables by hot restaurant, the FIXED ones, then the parent's customers of hot words."""
        # single precision halves what a task holds, and is exact up to 2**24
        self.customers, self.tables, one = customers.astype(np.float32), sums[:contexts].astype(np.float32), sums[contexts : contexts + FIXED]
        self.n, self.vocab = float(one[TOKENS]), float(one[VOCAB])
        self.theta1, self.theta0 = theta1, theta0
        estimate = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a + b else 0.5
        self.d1, self.d0 = estimate(one[ONES1], one[TWOS1]), estimate(one[ONES0], one[TWOS0])
        self.hot_tables = sums[contexts + FIXED :]
        self.base = 1.0 / (self.vocab + 1.0)
        self.c0 = float(sums[:contexts].sum() + one[RARE])
        # tables of hot words in the parent: drawn here, as their customers come from several buckets
        seats = Seating(np.round(self.hot_tables).astype(np.int64), self.d0, theta0, stirling(self.d0, EXACT), np.random.default_rng(int(self.c0)))
        hot = len(self.hot_tables)
        self.t0 = float(one[TABLES0])
        self.hot_t0 = seats.draw(np.full(hot, max(self.t0, 1.0)), np.full(hot, self.base)).astype(float) if hot else np.zeros(0)
        self.t0 += float(self.hot_t0.sum())

    def __getstate__(self) -> dict:
        return {**self.__dict__, "customers": narrow(self.customers), "tables": narrow(self.tables)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({**state, "customers": widened(state["customers"]), "tables": widened(state["tables"])})

    def beside(self, customers: np.ndarray, tables: np.ndarray) -> Global:
        """The same with more restaurants behind the hot ones."""
        out = object.__new__(Global)
        out.__dict__.update({**self.__dict__, "customers": np.append(self.customers, customers), "tables": np.append(self.tables, tables)})
        return out

    def parent(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (np.maximum(c - self.d0 * t, 0.0) + (self.theta0 + self.d0 * self.t0) * self.base) / (self.theta0 + self.c0)

    def probability(self, c: np.ndarray, t: np.ndarray, ctx: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (np.maximum(c - self.d1 * t, 0.0) + (self.theta1 + self.d1 * self.tables[ctx].astype(float)) * parent) / (self.theta1 + self.customers[ctx].astype(float))


class Bucket:
    """One bucket's types, and its part of the sampler."""

    def __init__(self, words: bytes, spans: bytes, ctx: bytes, train: bytes, rare: bytes = b""):
        """rare: hashes of the contexts that aren't hot."""
        places = np.frombuffer(words, np.uint64)
        spans = np.frombuffer(spans, np.uint32).astype(np.int64)
        self.ctx, self.train = unpack24(ctx), np.frombuffer(train, np.uint32).astype(np.int64)
        self.rare = np.frombuffer(rare, np.uint64)
        self.first = np.cumsum(spans) - spans
        self.word = np.repeat(np.arange(len(spans)), spans)
        self.cold = (places & np.uint64(1)) == 0
        self.hot = np.where(self.cold, -1, ((places & np.uint64(0xFFFFFFFF)) >> np.uint64(1)).astype(np.int64))

    def sweeps(self, g: Global, n: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """After each sweep: tables by type, tables of the words in the parent, the parent's probability by word."""
        low, high = stirling(g.d1, EXACT), stirling(g.d0, EXACT)
        seats = Seating(self.train, g.d1, g.theta1, low, rng)
        tables = np.minimum(self.train, 1)
        hot = self.hot[~self.cold]
        for _ in range(n):
            c0 = np.add.reduceat(tables, self.first).astype(float)
            t0 = np.minimum(c0, 1)
            c0[~self.cold], t0[~self.cold] = g.hot_tables[hot], g.hot_t0[hot]
            some = np.flatnonzero(self.cold & (c0 > 1))
            if len(some):
                t0[some] = Seating(c0[some].astype(np.int64), g.d0, g.theta0, high, rng).draw(np.full(len(some), g.t0), np.full(len(some), g.base))
            parent = g.parent(c0, t0)
            tables = seats.draw(g.tables[self.ctx].astype(float), parent[self.word])
            yield tables, t0, parent

    def add_sums(self, out: np.ndarray, tables: np.ndarray, t0: np.ndarray, contexts: int) -> None:
        """Tables beyond each type's first by hot restaurant, the FIXED sums, the parent's customers of hot words."""
        more = np.flatnonzero((tables > 1) & (self.ctx < contexts))
        np.add.at(out, self.ctx[more], (tables[more] - 1).astype(out.dtype))
        c0, c = np.add.reduceat(tables, self.first), np.add.reduceat(self.train, self.first)
        one, hot = out[contexts:], ~self.cold
        one[TOKENS] += int(self.train.sum())
        one[VOCAB] += np.count_nonzero(self.cold & (c > 0))
        one[TABLES0] += int(t0[self.cold].sum())
        one[RARE] += int(tables[self.ctx >= contexts].sum())
        one[ONES1] += np.count_nonzero(self.train == 1)
        one[TWOS1] += np.count_nonzero(self.train == 2)
        one[ONES0] += np.count_nonzero(self.cold & (c0 == 1))
        one[TWOS0] += np.count_nonzero(self.cold & (c0 == 2))
        np.add.at(one, FIXED + self.hot[hot], c0[hot].astype(out.dtype))

    def add_counts(self, out: np.ndarray, contexts: int) -> None:
        """Types and customers by hot restaurant, and occurrences of hot words."""
        hot, own = ~self.cold, np.flatnonzero(self.ctx < contexts)
        np.add.at(out, self.ctx[own], (self.train[own] > 0).astype(out.dtype))
        np.add.at(out, contexts + self.ctx[own], self.train[own].astype(out.dtype))
        np.add.at(out, 2 * contexts + self.hot[hot], np.add.reduceat(self.train, self.first)[hot].astype(out.dtype))


    def asked(self, bucket: int, tables: np.ndarray, hots: int, parts: int) -> Iterator[tuple]:
        """Tables and customers here of each rare restaurant, by the part of the hashes in which they are added up."""
        at = np.flatnonzero(self.ctx >= hots)
        sums = [np.bincount(self.ctx[at] - hots, x[at], len(self.rare)).astype(np.int64) for x in (tables, self.train)]
        cut = np.searchsorted(bucket_of(self.rare, parts), np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            a, e = cut[p], cut[p + 1]
            yield (p, bucket, e - a, self.rare[a:e].tobytes(), *(_narrowest(x[a:e]) for x in sums))

    def seated(self, g: Global, told: list[dict] | None) -> Global:
        """told: the totals of the rare restaurants, from all parts."""
        told = sorted(told or [], key=lambda r: r["part"])
        tables, customers = (np.concatenate([np.zeros(0), *(_numbers(r[k], r["n"]) for r in told)]) for k in ("tables", "customers"))
        if len(tables) != len(self.rare):
            raise ValueError(f"{len(tables)} totals for {len(self.rare)} rare contexts")
        return g.beside(customers, tables)


def _narrowest(x: np.ndarray) -> bytes:
    most = int(x.max())
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)).tobytes()


def _numbers(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // n}").astype(np.int64)


def _pass(batches: Iterator[pa.RecordBatch], g: Global | None, hots: int, sweeps: int, seed: int, parts: int) -> Iterator[pa.RecordBatch]:
    """What each bucket has of the rare restaurants, and a task's sums of a pass in packed slices; without a state those of one table for each type, and the counts besides."""
    total = np.zeros(hots + FIXED + hots + (3 * hots if g is None else 0), np.uint32)
    tokens = 0
    for b in batches:
        for *row, bucket, told in zip(*(b.column(n).to_pylist() for n in ("words", "spans", "ctx", "train", "rare", "bucket", "told")), strict=True):
            k = Bucket(*row)
            tokens += int(k.train.sum())
            if tokens >= 1 << 32:
                raise OverflowError("a task has 2**32 training tokens or more: raise spark.sql.shuffle.partitions")
            if g is None:
                tables = np.minimum(k.train, 1)
                k.add_sums(total, tables, np.minimum(np.add.reduceat(tables, k.first), 1), hots)
                k.add_counts(total[hots + FIXED + hots :], hots)
            else:
                for tables, t0, _ in k.sweeps(k.seated(g, told), sweeps, np.random.default_rng([seed, bucket])):
                    pass
                k.add_sums(total, tables, t0, hots)
            asked = list(k.asked(bucket, tables, hots, parts))
            if asked:
                none = [None] * len(asked)
                columns = [*zip(*asked, strict=True), *(none for _ in _SLICED)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ASKED.types, strict=True)], schema=_ASKED)
    for b in _slices(total):
        part = pa.array([b.column("slice")[0].as_py() % parts], pa.int32())
        yield pa.RecordBatch.from_arrays([part, *(pa.nulls(1, t) for t in _ASKED.types[1:6]), *b.columns], schema=_ASKED)


def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole numbers in slices, empty ones left out; where few are not zero, those only, with the steps between them in two byte planes."""
    for i, at in enumerate(range(0, len(total), SLICE)):
        part = total[at : at + SLICE]
        some = np.flatnonzero(part)
        if not len(some):
            continue
        kind = next(k for k in (np.uint8, np.uint16, np.int64) if k is np.int64 or part.max() <= np.iinfo(k).max)
        steps = b""
        if 2 * len(some) < len(part):
            step = np.diff(some, prepend=0)
            part, steps = part[some], (step & 255).astype(np.uint8).tobytes() + (step >> 8).astype(np.uint8).tobytes()
        row = (i, np.dtype(kind).itemsize, steps, part.astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SLICED.types, strict=True)], schema=_SLICED)


_SLICED = pa.schema([("slice", pa.int32()), ("width", pa.int32()), ("steps", pa.binary()), ("sums", pa.binary())])
_SLICED_DDL = "slice int, width int, steps binary, sums binary"
_ASKED = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("rare", pa.binary()), ("tables", pa.binary()), ("customers", pa.binary()), *_SLICED])
_ASKED_DDL = "part int, bucket int, n int, rare binary, tables binary, customers binary, " + _SLICED_DDL


def _add_slice(out: np.ndarray, width: int, steps: bytes, sums: bytes) -> None:
    x = np.frombuffer(sums, {1: np.uint8, 2: np.uint16, 8: np.int64}[width])
    if steps:
        low, high = np.frombuffer(steps, np.uint8).reshape(2, -1).astype(np.int64)
        out[np.cumsum(low + (high << 8))] += x
    else:
        out[: len(x)] += x


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of several tasks added up."""
    by: dict[int, np.ndarray] = {}
    for b in batches:
        for i, *packed in zip(*(b.column(n).to_pylist() for n in _SLICED.names), strict=True):
            _add_slice(by.setdefault(i, np.zeros(SLICE, np.int64)), *packed)
    for i, x in by.items():
        for b in _slices(x):
            yield b.set_column(0, "slice", pa.array([i], pa.int32()))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of a part's rare restaurants, to each bucket in the order in which it asked; slices added up."""
    sliced, rows = [], []
    for b in batches:
        slices = b.filter(b.column("slice").is_valid())
        if slices.num_rows:
            sliced.append(slices.select(_SLICED.names))
        rest = b.filter(b.column("slice").is_null())
        rows += zip(*(rest.column(n).to_pylist() for n in ("part", "bucket", "n", "rare", "tables", "customers")), strict=True)
    for b in _added(iter(sliced)):
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in _ASKED.types[:6]), *b.columns], schema=_ASKED)
    if not rows:
        return
    part, buckets, n, hashes, *sums = zip(*rows, strict=True)
    _, of = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in hashes]), return_inverse=True)
    totals = [np.bincount(of, np.concatenate([_numbers(*x) for x in zip(s, n, strict=True)])).astype(np.int64)[of] for s in sums]
    ends = np.cumsum(n)
    for p, b, m, e in zip(part, buckets, n, ends, strict=True):
        row = (p, b, m, None, *(_narrowest(x[e - m : e]) for x in totals), *(None for _ in _SLICED))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _ASKED.types, strict=True)], schema=_ASKED)


_SUMS = pa.schema([("flush", pa.int64()), ("sums", pa.binary()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])
_SUMS_DDL = "flush long, sums binary, key long, doc_id long, n_tokens long"


def _score(batches: Iterator[pa.RecordBatch], g: Global, hot_counts: np.ndarray, sweeps: int, burn: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Each bucket's sums by document, packed by flush: places as steps in two byte planes, scores, base scores, unknown tokens."""
    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in ("words", "spans", "ctx", "train", "rare", "total", "tokens", "flushes", "bucket", "told")), strict=True):
            k = Bucket(*row[:5])
            own = k.seated(g, row[9])
            mean, kept = np.zeros(len(k.ctx)), 0
            for i, (tables, _, parent) in enumerate(k.sweeps(own, sweeps, np.random.default_rng([seed, row[8]]))):
                if i >= burn:
                    mean += own.probability(k.train, tables, k.ctx, parent[k.word])
                    kept += 1
            score = np.log10(mean / kept)
            count = np.add.reduceat(k.train, k.first).astype(float)
            count[~k.cold] = hot_counts[k.hot[~k.cold]]
            base, unknown = np.log10((count + 1) / (g.n + g.vocab + 1))[k.word], (count == 0)[k.word]
            total = np.frombuffer(row[5], np.uint32)
            flushes = np.frombuffer(row[7], np.int64)
            tokens = np.frombuffer(row[6], np.uint32 if len(flushes) < 1 << 16 else np.uint64)
            order = np.argsort(tokens, kind="stable")
            codes = tokens[order]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            codes, of = codes[first], np.repeat(np.arange(len(total), dtype=np.uint32), total)[order]
            parts = [np.add.reduceat(x[of], first) for x in (score, base, unknown.astype(np.int64))]
            group = (codes >> 16).astype(np.int64)
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            blobs = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                place = (codes[s:e] & 0xFFFF).astype(np.int64)
                step = np.diff(place, prepend=0)
                less = np.minimum(parts[2][s:e], 255).astype(np.uint8)
                many = np.flatnonzero(parts[2][s:e] > 255)
                head = np.array([e - s, len(many)], np.int64)
                blobs.append(
                    (int(flushes[group[s]]), b"".join(x.tobytes() for x in (head, (step & 255).astype(np.uint8), (step >> 8).astype(np.uint8), parts[0][s:e].astype(np.float32), parts[1][s:e], less, many, parts[2][s:e][many])))
                )
            flush, packed = zip(*blobs, strict=True)
            none = [None] * len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(flush, pa.int64()), pa.array(packed, pa.binary()), *(pa.array(none, pa.int64()) for _ in range(3))], schema=_SUMS)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2)
    at = 16
    out = []
    for kind, size in ((np.uint8, n), (np.uint8, n), (np.float32, n), (np.float64, n), (np.uint8, n), (np.int64, m), (np.int64, m)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    low, high, score, base, less, many, real = out
    unknown = less.astype(np.int64)
    unknown[many] = real
    return np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 8)), score.astype(float), base, unknown


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each flush with their sums over buckets, from rows sorted by flush; a flush, of at most 2**16 places, is sent when it ends."""
    last, sums, docs = None, np.zeros((3, 1 << 16)), []

    def ended() -> Iterator[pa.RecordBatch]:
        for b in docs:
            got = sums[:, b.column("key").to_numpy() & 0xFFFF]
            n = b.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(n - got[2].astype(np.int64)), pa.array(got[1]), pa.array(got[0])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        flush = batch.column("flush").to_numpy()
        cuts = [0, *(np.flatnonzero(flush[1:] != flush[:-1]) + 1), len(flush)]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            if a == e:
                continue
            if flush[a] != last:
                yield from ended()
                last, docs = flush[a], []
                sums[:] = 0
            part = batch.slice(a, e - a)
            named = part.filter(part.column("key").is_valid())
            if named.num_rows:
                docs.append(named)
            for blob in part.column("sums").drop_null().to_pylist():
                place, score, base, unknown = _unpacked(blob)
                sums[0, place] += score
                sums[1, place] += base
                sums[2, place] += unknown
    yield from ended()


def _round(types: DataFrame, size: int, parts: int, *args) -> tuple[np.ndarray, DataFrame]:
    """A pass: its sums, and what each bucket is told of its rare restaurants."""
    asked = types.transform(common.arrow, lambda it: _pass(it, *args, parts), _ASKED_DDL)
    made = common.written(asked.repartitionById(parts, "part").transform(common.arrow, _told, _ASKED_DDL), "hpylm_told")
    out = np.zeros(-(-size // SLICE) * SLICE, np.int64)
    for r in made.where("slice IS NOT NULL").collect():
        _add_slice(out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE], r["width"], r["steps"], r["sums"])
    return out[:size], made.where("slice IS NULL").select("bucket", "part", "n", "tables", "customers")


def _with(types: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """Types beside what their bucket is told; only this is shuffled, to where the bucket's types are."""
    each = told.repartition(parts, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("part", "n", "tables", "customers")).alias("told"))
    return types.join(each.hint("shuffle_hash"), "bucket", "left")


def _swept(spark: SparkSession) -> None:
    """Let Spark remove the shuffles that nothing needs any more; else they stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def _bucket_names(spark: SparkSession, buckets: int, parts: int) -> np.ndarray:
    """Numbers for the buckets which Spark's hash deals evenly to so many partitions."""
    each = -(-buckets // parts)
    rows = spark.range(parts * (2 * each + 64)).select(F.col("id").cast("int").alias("id")).withColumn("at", F.pmod(F.hash("id"), F.lit(parts)))
    found = rows.groupBy("at").agg(F.slice(F.sort_array(F.collect_list("id")), 1, each).alias("ids")).collect()
    return np.array(sorted((i, r["at"], x) for r in found for i, x in enumerate(r["ids"])))[:buckets, 2]


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = np.array([xxhash.xxh64_intdigest(w) & ~1 for text in b.column(0).to_pylist() for w in [*words_of(text), END]], np.uint64)
        u, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["i", "v"])


def frequent(rows: DataFrame, total: int, sample_rows: int) -> tuple[Words, int]:
    """Hot words of a sample, and about how many tokens there are."""
    share = min(1.0, sample_rows / max(1, total))
    unit = F.xxhash64("doc_id", F.lit("hot")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    counts = rows.where(unit < share).select("text").transform(common.arrow, _sample_counts, "i long, v long").groupBy("i").agg(F.sum("v").alias("v"))
    counts = common.cut(counts)
    n = counts.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("n")).first()["n"]
    shares = {np.int64(r["i"]).view(np.uint64): r["v"] / n for r in counts.where(F.col("v") >= max(8.0, HOT * n)).collect()}
    shares.setdefault(np.uint64(xxhash.xxh64_intdigest(START) & ~1), 0.0)
    hot = np.array(sorted(shares), np.uint64)
    return Words(hot, np.array([1 + int(shares[h] / HOT) for h in hot], np.uint64)), int(n / share)


def score(docs: DataFrame, learn: Column, passes: int = 2, sweeps: int = 4, samples: int = 4, theta1: float = 1.0, theta0: float = 1.0, sample_rows: int = 4000) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score. The model learns from the rows where ``learn`` is true."""
    spark = common.prepare(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    parts = common.parts(spark)
    known, tokens = frequent(rows, docs.count(), sample_rows)
    # buckets enough that a document's words are all apart already: what comes back for a document doesn't grow with the cluster
    names = _bucket_names(spark, max(BUCKETS, 2 * parts, tokens // BUCKET_TOKENS), parts)
    hots = len(known.hot)
    dealt = rows.transform(common.arrow, lambda it: _deal(it, known, names), _BLOBS_DDL)
    table = BucketedTable(spark, "hpylm", _STATE_DDL, ("bucket",), parts)
    table.append(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").transform(common.arrow, lambda it: _seat(it, hots), _STATE_DDL), dealt=True, compression="zstd")
    _swept(spark)
    state = table.read()
    types = state.where("words IS NOT NULL").select("words", "spans", "ctx", "train", "rare", "bucket")
    size, since = hots + FIXED + hots, common.mark()
    sums, told = _round(types.withColumn("told", F.lit(None).cast("string")), size + 3 * hots, parts, None, hots, 0, 0)
    sums, firsts, customers, hot_counts = (x.copy() for x in np.split(sums, [size, size + hots, size + 2 * hots]))
    vocab = sums[hots + VOCAB] + np.count_nonzero(hot_counts)
    for i in range(passes + 1):
        _swept(spark)
        sums[:hots] += firsts  # of each type, the first table
        sums[hots + VOCAB] = vocab
        g = Global(customers, sums, hots, theta1, theta0)
        if i < passes:
            sums, told = _round(_with(types, told, parts), size, parts, g, hots, sweeps, i + 1)
            common.release(spark, since, told)
    found = _with(state.where("words IS NOT NULL").select("words", "spans", "ctx", "train", "rare", "total", "tokens", "flushes", "bucket"), told, parts).transform(
        common.arrow, lambda it: _score(it, g, hot_counts, sweeps + samples, sweeps, passes + 1), _SUMS_DDL
    )
    names = state.where("key IS NOT NULL").select(F.shiftright("key", 16).alias("flush"), F.lit(None).cast("binary").alias("sums"), "key", "doc_id", "n_tokens")
    table.close()  # its files stay, and what reads them
    each = found.unionByName(names).repartition(parts, "flush").sortWithinPartitions("flush").transform(common.arrow, _collected, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return each.select("doc_id", "n_tokens", "n_known", F.lit(int(g.n)).cast("long").alias("train_tokens"), "base_score", "score")
