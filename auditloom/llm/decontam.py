"""Benchmark decontamination by template canonicalisation.

A text becomes a template: its words in lower case without surrounding punctuation, numbers (in digits or in English words), quantities (number and
unit) and names (capitalised within a sentence) as typed placeholders. Windows of ``width`` template tokens of documents and items
are hashed and joined; windows that meet are laid on diagonals (document position less item position); on a diagonal every slot
value of the item must stand for one value of the document, and names must stay distinct. Whether a capitalised first word is a name depends
on what precedes the item, so an item's first window stands in both forms; where document and item differ in that, the word must be the
same. An item is found in a document when a diagonal has ``least`` windows, or all windows that the item has.

A template with fewer than ``literals`` ordinary words tells little by itself. Such a sparse window counts where it is rare, that is, in no more than
``rare_share`` of the documents (``RARE_TEXTS`` at least), and has an ordinary word and three tokens; an item is also found when its full and
sparse windows together reach ``least``, or all it has. Items with sparse windows, or that could fall short of windows which don't depend on what
surrounds them, are indexed by their plain words too, and are found where the plain windows reach the same number. An item shorter than
``width`` is one window. A window that more than ``SHARED`` items have, such as a preamble, is no evidence for items with enough windows of their own. Documents are read whole.

Plan. The items' windows are a table; a bit set of their hashes, of bounded size, goes to all tasks, and only windows of
documents that it lets through leave them, once for each distinct text and task. They are joined with the table by hash (the table is broadcast
only if it is counted to be small), and a text's windows of one item meet in one task, sorted, where slots are checked. What is found is
joined to the documents by a 128-bit hash of the text. Benchmarks of any size thus take one scan of the documents.

Defined results: null and empty texts hold nothing; an empty benchmark finds nothing; rows of documents that repeat give repeated
rows; rows of the benchmark that repeat are one item; items with a null text or without words are never found; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, LEAST, LITERALS = 10, 4, 5
#: Share of the documents up to which a sparse window is rare, texts that it may always be in; items from which a window is no evidence.
RARE_SHARE, RARE_TEXTS, SHARED = 1e-3, 20, 20
EMPTY, NUMBER, NAME, UNIT, END, QUANTITY, SPELLED = 1, 2, 4, 8, 16, 32, 64
#: Number words (fixed values).
NUMBER_WORDS = frozenset((
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen",
))
#: Measurement units (fixed values).
UNITS = frozenset((
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "gal", "s", "sec", "min", "h", "hr", "hrs", "day",
    "days", "hour", "hours", "minute", "minutes", "second", "seconds", "meter", "meters", "metre", "metres", "mile", "miles", "gram", "grams",
    "kilogram", "kilograms", "liter", "liters", "litre", "litres", "foot", "feet", "inch", "inches", "pound", "pounds", "ounce", "ounces", "dollar",
    "dollars", "euro", "euros", "usd", "eur", "cent", "cents", "percent", "degrees", "kmh", "mph", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb",
    "w", "kw", "v", "a",
))
_KNOWN = {**dict.fromkeys(NUMBER_WORDS, NUMBER | SPELLED), **dict.fromkeys(UNITS, UNIT)}
_ENDS = frozenset(".!?")
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*\Z")
_GLUED = re.compile(r"[+-]?\d[\d.,]*([^\W\d_]+|%)\Z")
_SLOT = {NUMBER: np.uint64(0x1111111111111100), QUANTITY: np.uint64(0x2222222222222200), NAME: np.uint64(0x3333333333333300)}
_P = np.uint64(0x9E3779B97F4A7C15)
_CORE = np.uint64(0xFFFFFFFFFFFFFF00)
#: Forms of a window: template, words as they stand, template with few ordinary words.
TEMPLATE, WORDS, SPARSE = 0, 1, 2
#: Binary logarithm of the bits of the largest gate; rows of items' windows up to which they are broadcast, and of what is found.
GATE_BITS, SMALL_WINDOWS, SMALL_FOUND = 27, 200_000, 1_000_000


def edges(raw: str) -> tuple[str, str]:
    """A raw word without surrounding punctuation, and the punctuation behind it."""
    a, e = 0, len(raw)
    while a < e and not (raw[a].isalnum() or raw[a] == "_"):
        a += 1
    while a < e and not (raw[e - 1].isalnum() or raw[e - 1] == "_"):
        e -= 1
    return raw[a:e], raw[e:] if a < e else ""


def code_of(raw: str) -> int:
    """64 bits for a raw word: the hash of its core, and flags in the lowest eight."""
    if raw.isalpha() and raw.islower():
        core, flags = raw, _KNOWN.get(raw, 0)
    else:
        core, tail = edges(raw)
        if not core:
            return EMPTY
        flags = END if tail and not _ENDS.isdisjoint(tail) else 0
        low = core.lower()
        if core[0].isdigit() or core[0] in "+-":
            g = _GLUED.match(core + ("%" if tail.startswith("%") else ""))
            if g and (g[1] == "%" or g[1].lower() in UNITS):
                flags |= QUANTITY
            elif _NUMBER.match(core):
                flags |= NUMBER
        elif low in NUMBER_WORDS or "-" in low and all(x in NUMBER_WORDS for x in low.split("-")):
            flags |= NUMBER | SPELLED
        elif core[0].isupper() and core[1:].islower():
            flags |= NAME
        core = low
        if core in UNITS:
            flags |= UNIT
    return (xxhash.xxh64_intdigest(core.encode("utf-8", "surrogatepass")) & ~0xFF) | flags


class Codes(dict):
    """Codes of raw words; forgets all when full, so that memory stays bounded."""

    def __missing__(self, raw: str) -> int:
        if len(self) > 300_000:
            self.clear()
        c = self[raw] = code_of(raw)
        return c


def coded(raw: list[str], codes: Codes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, raw), np.uint64, len(raw))


def plain(c: np.ndarray) -> np.ndarray:
    """Tokens of the words as they stand, without placeholders."""
    return c[(c & np.uint64(EMPTY)) == 0] & _CORE


def template(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, kinds (0 for an ordinary word) and the raw word at which each token stands, from the codes of a text."""
    flags = (c & np.uint64(0xFF)).astype(np.uint8)
    start = np.append(True, (flags[:-1] & END) > 0)
    kind = np.where(flags & QUANTITY, QUANTITY, np.where(flags & NUMBER, NUMBER, np.where(((flags & NAME) > 0) & ~start, NAME, 0))).astype(np.uint8)
    # a number in several words is one, with its first word as its value
    spelled = (flags & SPELLED) > 0
    keep = ((flags & EMPTY) == 0) & ~np.append(False, spelled[:-1] & spelled[1:])[: len(flags)]
    unit = np.append(False, (kind[:-1] == NUMBER) & ((flags[1:] & UNIT) > 0) & (kind[1:] == 0))
    kind[:-1][unit[1:]] = QUANTITY
    at = np.flatnonzero(keep & ~unit)
    kind = kind[at]
    token = c[at] & _CORE
    for k, h in _SLOT.items():
        token[kind == k] = h
    return token, kind, at


def windows(token: np.ndarray, kind: np.ndarray, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, usable) of the windows of that width."""
    n = len(token) - width + 1
    if n <= 0:
        return token[:0], np.zeros(0, bool)
    with np.errstate(over="ignore"):
        x = np.full(n, np.uint64(width))
        for i in range(width):
            x = x * _P + token[i : i + n]
        x ^= x >> np.uint64(29)
        x *= _P
    plain = np.append(0, np.cumsum(kind == 0))
    return x, plain[width:] - plain[:n] >= min(literals, width)


def sparse(kind: np.ndarray, width: int, usable: np.ndarray) -> np.ndarray:
    """Which windows of three tokens or more are not usable but have an ordinary word."""
    if width < 3 or not len(usable):
        return np.zeros(len(usable), bool)
    plain = np.append(0, np.cumsum(kind == 0))
    return ~usable & (plain[width:] > plain[: len(usable)])


def flipped(c: np.ndarray, token: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Tokens and kinds with a capitalised first word as a name if it is an ordinary word, and the other way round."""
    if not c[at[0]] & np.uint64(NAME) or kind[0] not in (0, NAME):
        return None, kind
    token, kind = token.copy(), kind.copy()
    token[0], kind[0] = (c[at[0]] & _CORE, 0) if kind[0] else (_SLOT[NAME], NAME)
    return token, kind


def item_windows(text: str, codes: Codes, width: int, literals: int, least: int) -> list[tuple]:
    """An item's windows: form, hash, position, width, windows of this form that the item has, its full and sparse ones, slots, first word, whether that is a slot."""
    raw = text.split()
    c = coded(raw, codes)
    if not len(plain(c)):
        return []
    token, kind, at = template(c)
    w, words = min(width, len(token)), plain(c)
    h, usable = windows(token, kind, w, literals)
    few = sparse(kind, w, usable)
    pos, some = np.flatnonzero(usable), np.flatnonzero(few)
    total, value, led = max(1, len(pos)), int(c[at[0]] & _CORE), bool(kind[0])  # the first window may be usable in its other form only
    every = max(1, len(pos) + len(some))
    held = slots(c, kind, at)
    made = [(f, int(h[p]), int(p)) for f, places in ((TEMPLATE, pos), (SPARSE, some)) for p in places]
    first, form = flipped(c, token[:w], kind[:w], at)
    if first is not None:
        x, fit = windows(first, form, w, literals)
        made += [(f, int(x[p]), int(p)) for f, good in ((TEMPLATE, fit), (SPARSE, sparse(form, w, fit))) for p in np.flatnonzero(good)]
    out = [(f, x, p, w, total, every, held.within(p, w), value, led) for f, x, p in made]
    # what stands before and after an item decides on its first and its last token
    if not usable.all() or usable[1:-1].sum() < min(least, len(pos)):
        v = min(width, len(words))
        x = windows(words, np.zeros(len(words), np.uint8), v, 0)[0]
        out += [(WORDS, int(k), p, v, len(x), len(x), b"", 0, False) for p, k in enumerate(x)]
    return out


class slots:
    """The slots of a text: token positions, kinds, and hashes of the words there."""

    def __init__(self, c: np.ndarray, kind: np.ndarray, at: np.ndarray):
        self.pos = np.flatnonzero(kind)
        self.kind, self.value = kind[self.pos].astype(np.int64), (c[at[self.pos]] & _CORE).view(np.int64)

    def within(self, p: int, w: int) -> bytes:
        """Those of a window, packed."""
        a, e = np.searchsorted(self.pos, (p, p + w))
        return np.stack([self.pos[a:e], self.kind[a:e], self.value[a:e]]).tobytes()


def unpacked_slots(blob: bytes) -> dict[int, tuple[int, int]]:
    """Token position to kind and value."""
    pos, kind, value = np.frombuffer(blob, np.int64).reshape(3, -1).tolist()
    return dict(zip(pos, zip(kind, value, strict=True), strict=True))


def consistent(pairs: list[tuple[tuple[int, int], tuple[int, int]]]) -> bool:
    """Whether each value of the item stands for one value, and distinct names for distinct ones."""
    there: dict[tuple, tuple] = {}
    back: dict[tuple, tuple] = {}
    for a, b in pairs:
        if there.setdefault(a, b) != b or (a[0] == NAME and back.setdefault(b, a) != a):
            return False
    return True


class Gate:
    """A bit set of hashes with two probes each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    @staticmethod
    def probes(h: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return (h >> shift).astype(np.int64), ((h * _P ^ h >> np.uint64(31)) * _P >> shift).astype(np.int64)

    def lets(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be in the set."""
        one, two = self.probes(h, self.shift)
        some = np.flatnonzero(self.bits[one >> 3] >> (one & 7).astype(np.uint8) & 1)
        two = two[some]
        return some[np.flatnonzero(self.bits[two >> 3] >> (two & 7).astype(np.uint8) & 1)]


_ITEMS_DDL = "item long, item_id long, form int, h long, pos int, w int, total int, every int, slots binary, value long, led boolean"


def _items(batches: Iterator[pa.RecordBatch], width: int, literals: int, least: int) -> Iterator[pa.RecordBatch]:
    codes = Codes()
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.bool_())
    for b in batches:
        for item, item_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows = item_windows(text, codes, width, literals, least)
            if rows:
                form, h, pos, w, total, every, held, value, led = zip(*rows, strict=True)
                made = ([item] * len(rows), [item_id] * len(rows), form, np.array(h, np.uint64).view(np.int64), pos, w, total, every, held, np.array(value, np.uint64).view(np.int64), led)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types, strict=True)], names=[x.split()[0] for x in _ITEMS_DDL.split(", ")])


def _gate_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << bits - 3, np.uint8)
    for b in batches:
        for at in Gate.probes(b.column(0).to_numpy().view(np.uint64), np.uint64(64 - bits)):
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["bits"])


def gate_of(found: DataFrame, n: int) -> Gate:
    """The gate of a table of windows: 32 bits or more for each, up to a bound (beyond which it lets more through)."""
    bits = min(GATE_BITS, max(16, (32 * n).bit_length()))
    held = np.zeros(1 << bits - 3, np.uint8)
    # one row for each of a few tasks, added up one by one
    tasks = min(16, max(1, n // 1_000_000))
    for r in found.select("h").coalesce(tasks).transform(common.arrow, lambda it: _gate_bits(it, bits), "bits binary").toLocalIterator():
        held |= np.frombuffer(r["bits"], np.uint8)
    return Gate(held)


_HITS_DDL = "k1 long, k2 long, form int, h long, at int, mine binary"


def _hits(batches: Iterator[pa.RecordBatch], gate, widths: list[tuple[int, int]], literals: int) -> Iterator[pa.RecordBatch]:
    """Windows of texts that the gate lets through; a text that a task has just seen isn't taken again."""
    codes, seen, let = Codes(), set(), Gate(gate.value)
    for b in batches:
        out: list[tuple] = []
        for k1, k2, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = text.split()
            if not raw:
                continue
            c = coded(raw, codes)
            token, kind, at = template(c)
            words = plain(c)
            found, held, of_width = [], None, {}
            for form, w in widths:
                if form == WORDS:
                    h, usable = windows(words, np.zeros(len(words), np.uint8), w, 0)
                    p = let.lets(h)
                else:
                    if w not in of_width:
                        h, usable = windows(token, kind, w, literals)
                        of_width[w] = h, usable, let.lets(h)
                    h, usable, p = of_width[w]
                if not len(p):
                    continue
                held = slots(c, kind, at) if held is None else held
                p = p[(sparse(kind, w, usable) if form == SPARSE else usable)[p]]
                found += [(form, x, i, b"" if form == WORDS else held.within(i, w)) for x, i in zip(h[p].view(np.int64).tolist(), p.tolist(), strict=True)]
            if found and (k1, k2) not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen.add((k1, k2))
                out += [(k1, k2, *x) for x in found]
        if out:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in _HITS_DDL.split(", ")])


def agreed(met: list[dict], shift: int) -> str | None:
    """Whether the slots of a diagonal's windows are consistent: the kind of match, or None."""
    theirs, mine = {}, {}
    for r in met:
        theirs |= unpacked_slots(r["slots"])
        mine |= unpacked_slots(r["mine"])
    pairs = [(theirs[i], mine[i + shift]) for i in sorted(theirs) if i + shift in mine]
    led, alone = met[0]["led"], (NAME, met[0]["value"])
    lone = any(r["pos"] == 0 for r in met) and led != (shift in mine)
    if lone:
        pairs.append((alone, mine.get(shift, alone)))
    if not consistent(pairs) or lone and pairs[-1][1] != alone:
        return None
    return "exact" if all(a[1] == b[1] for a, b in pairs) else "template"


def judged(rows: list[dict], least: int) -> tuple[int, int, str] | None:
    """(matched windows, windows of the item, kind) of the best diagonal where a text holds an item, from the windows that meet."""
    diagonals: dict[int, dict[int, dict]] = defaultdict(lambda: defaultdict(dict))
    for r in rows:
        diagonals[r["at"] - r["pos"]][r["form"]][r["pos"]] = r
    best: dict[int, tuple[int, int, str]] = {}
    for shift, forms in diagonals.items():
        # a sparse window never stands for itself alone: full and sparse ones count together
        both = {**forms.get(SPARSE, {}), **forms.get(TEMPLATE, {})}
        for form, met, size in ((TEMPLATE, forms.get(TEMPLATE), "total"), (WORDS, forms.get(WORDS), "total"), (SPARSE, both if SPARSE in forms else None, "every")):
            if not met:
                continue
            met = list(met.values())
            total = met[0][size]
            if len(met) < min(least, total):
                continue
            kind = "exact" if form == WORDS else agreed(met, shift)
            if kind:
                best[form] = max(best.get(form, (0, 0, "")), (len(met), total, kind))
    return best.get(TEMPLATE, best.get(WORDS, best.get(SPARSE)))


_FOUND_DDL = "k1 long, k2 long, item_id long, matched_windows long, item_windows long, match_kind string"


def _judge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for t in common.runs(batches, ["k1", "k2", "item"]):
        got = judged(t.select(["form", "at", "pos", "total", "every", "slots", "mine", "value", "led"]).to_pylist(), least)
        if got:
            row = (t["k1"][0].as_py(), t["k2"][0].as_py(), t["item_id"][0].as_py(), *got)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, types, strict=True)], names=[x.split()[0] for x in _FOUND_DDL.split(", ")])


def _key(text: Column) -> tuple[Column, Column]:
    """A text's 128-bit hash."""
    return F.xxhash64(text), F.xxhash64(text, F.lit("second"))


def without_shared(table: DataFrame, least: int, shared: int) -> DataFrame:
    """The items' windows without those that more than ``shared`` items have, where an item has ``least`` others of the form; totals follow. Written."""
    many = common.written(table.groupBy("form", "h").agg(F.countDistinct("item").alias("items")).where(F.col("items") > shared).select("form", "h"), "shared-windows")
    if many.isEmpty():
        return table
    marked = table.join(F.broadcast(many.withColumn("many", F.lit(True))) if many.count() <= SMALL_WINDOWS else many.withColumn("many", F.lit(True)), ["form", "h"], "left")
    counts = marked.groupBy("item", "form").agg(F.countDistinct("pos").alias("all"), F.countDistinct(F.when(F.col("many").isNull(), F.col("pos"))).alias("own"))
    kept = counts.select("item", "form", F.when(F.col("own") >= least, F.col("own")).alias("own"), F.col("all"))
    sizes = kept.withColumn("size", F.coalesce("own", "all"))
    every = sizes.where(F.col("form") != WORDS).groupBy("item").agg(F.sum("size").cast("int").alias("_every"))
    rows = marked.join(sizes, ["item", "form"]).join(every, "item", "left").where(F.col("own").isNull() | F.col("many").isNull())
    total, whole = F.coalesce(F.col("own").cast("int"), "total"), F.when(F.col("form") == WORDS, F.col("every")).otherwise(F.col("_every"))
    return common.written(rows.withColumns({"total": total, "every": whole}).select(*table.columns), "evidence")


def rare_hits(hits: DataFrame, texts: int, rare_share: float) -> DataFrame:
    """Hits without those of sparse windows that too many texts hold; hits is a written table."""
    held = hits.where(F.col("form") == SPARSE).select("form", "h", "k1", "k2").distinct().groupBy("form", "h").agg(F.count("*").alias("texts"))
    common_ones = common.written(held.where(F.col("texts") > max(RARE_TEXTS, int(rare_share * texts))).select("form", "h"), "common-windows")
    return hits.join(common.small_side(common_ones, SMALL_WINDOWS), ["form", "h"], "left_anti")


def found_texts(docs: DataFrame, benchmark: DataFrame, width: int, least: int, literals: int, rare_share: float = RARE_SHARE, shared: int = SHARED) -> DataFrame:
    """Distinct texts (k1, k2) with the benchmark items that they hold; a written table."""
    spark = common.prepare(docs.sparkSession)
    parts = common.parts(spark)
    text = benchmark["text"].cast("string")
    items = benchmark.where(text.isNotNull()).select(F.xxhash64(benchmark["item_id"].cast("long"), text).alias("item"), benchmark["item_id"].cast("long").alias("item_id"), text.alias("text"))
    table = common.written(items.dropDuplicates(["item"]).transform(common.arrow, lambda it: _items(it, width, literals, least), _ITEMS_DDL), "item-windows")
    table = without_shared(table, least, shared)
    widths = [(r["form"], r["w"]) for r in table.select("form", "w").distinct().orderBy("form", "w").collect()]
    gate = spark.sparkContext.broadcast(gate_of(table, table.count()).bits)
    whole = common.text_of(docs)
    hits = docs.select(*(k.alias(n) for k, n in zip(_key(whole), ("k1", "k2"), strict=True)), whole.alias("text")).transform(common.arrow, lambda it: _hits(it, gate, widths, literals), _HITS_DDL)
    hits = hits.distinct()
    if any(form == SPARSE for form, _ in widths):
        hits = rare_hits(common.written(hits, "hits"), docs.count(), rare_share)
    met = hits.join(common.small_side(table, SMALL_WINDOWS), ["form", "h"])
    met = met.repartition(parts, "k1", "k2", "item").sortWithinPartitions("k1", "k2", "item")
    return common.written(met.transform(common.arrow, lambda it: _judge(it, least), _FOUND_DDL), "found-texts")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: int = LEAST, literals: int = LITERALS) -> DataFrame:
    """Pairs (doc_id, item_id) of documents with the benchmark items that they hold: matched_windows, item_windows, match_kind."""
    found = found_texts(docs, benchmark, width, least, literals)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *(k.alias(n) for k, n in zip(_key(common.text_of(docs)), ("k1", "k2"), strict=True)))
    return rows.join(common.small_side(found, SMALL_FOUND), ["k1", "k2"]).select("doc_id", "item_id", "matched_windows", "item_windows", "match_kind")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: int = LEAST, literals: int = LITERALS) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, with all columns."""
    gone = found_texts(docs, benchmark, width, least, literals).select(F.col("k1").alias("_al_k1"), F.col("k2").alias("_al_k2")).distinct()
    k1, k2 = _key(common.text_of(docs))
    return docs.join(common.small_side(gone, SMALL_FOUND), (k1 == F.col("_al_k1")) & (k2 == F.col("_al_k2")), "left_anti").select(*docs.columns)
