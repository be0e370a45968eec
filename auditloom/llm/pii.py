"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame operations only.

Base spans (email, ip, card, phone) are found by regular expressions and stay as found. They seed a bootstrap: the words
before and after an entity are lexical patterns; other strings with digits are candidate instances; patterns and
instances form a bipartite graph on which scores are passed back and forth (``rounds`` times): a pattern scores the mean score
of its instances, shrunk by ``shrink``, an instance the noisy-or of its patterns. Patterns of ``confident`` or more that
stand beside ``support`` distinct seeds or more discover the unseen candidates beside them as spans of kind ``context``.

Texts are read once; occurrences with their contexts go to a table in the shared folder, and all counts are grouped with partial
aggregation, so a pattern or an entity may hold any share of the rows.

Positions are running totals, taken in rounds that double, so a text of n matches costs n log n steps, however many it has. Regular
expressions are possessive and begin only where a run of their first class begins (or where the last match ended), so that long runs
cost linear time and the matches are those of the plain expressions.

Defined results: a null text is empty and has no span; the hash of no spans is that of the empty string; rows that repeat give
repeated rows; positions count code points; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole chain of digits, single spaces and hyphens between them, with 12 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A whole word with a digit.
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
NEAR = 48
_NONE = "CAST(array() AS array<struct<s:int,e:int,k:int,t:string,l:string,r:string>>)"


def scanned(array: str, step: str, nothing: str) -> str:
    """SQL for the running totals of an array, ``step`` of v and w: each round adds what lies 2**k places before, so n elements cost n log n."""
    return f"""
        aggregate(sequence(0, int(ceil(log2(greatest(size({array}), 1))))), {array},
            (a, k) -> transform(a, (v, i) -> {step.replace('w', f'(CASE WHEN i >= shiftleft(1, k) THEN a[i - shiftleft(1, k)] ELSE {nothing} END)')}))"""


def _located(kind: int, valid: str) -> str:
    """SQL for the spans of a kind: start, end, kind, text, words before and after. ``valid`` judges a match y.

    The pieces between matches (g) give the positions: their lengths and those of the matches (m) add up to the matches' ends (e).
    """
    # arrays meet in one zip: an array named inside a lambda may be computed again for each element
    return f"""
        filter(transform(arrays_zip(m{kind}, e{kind}, g{kind}, slice(g{kind}, 2, size(m{kind}))),
                         z -> named_struct('s', z.e{kind} - length(z.m{kind}), 'e', z.e{kind}, 'k', {kind}, 't', z.m{kind}, 'l', right(z.g{kind}, {NEAR}), 'r', left(z.`3`, {NEAR}))),
               y -> y.t IS NOT NULL AND {valid})"""


_DIGITS = "length(regexp_replace(y.t, '[^0-9]', ''))"
_LUHN = r"""pmod(aggregate(sequence(1, length(regexp_replace(y.t, '[^0-9]', ''))), 0, (z, i) -> z +
    CASE WHEN i % 2 = 1 THEN int(substr(reverse(regexp_replace(y.t, '[^0-9]', '')), i, 1))
         ELSE int(substr('0246813579', 1 + int(substr(reverse(regexp_replace(y.t, '[^0-9]', '')), i, 1)), 1)) END), 10) = 0"""
#: Gate, pattern and check of a match for each kind; 4 are the candidates.
_RULES = (
    ("contains(_t, '@')", EMAIL, "true"),
    (r"_t rlike '[0-9][.][0-9]'", IP, r"forall(split(y.t, '[.]'), p -> double(p) <= 255)"),
    (r"_t rlike '[0-9]'", CARD, _LUHN),
    ("contains(_t, '+')", PHONE, f"{_DIGITS} BETWEEN 9 AND 15"),
    (r"_t rlike '[0-9]'", CANDIDATE, r"length(y.t) BETWEEN 6 AND 64 AND length(regexp_replace(y.t, '[^0-9]', '')) >= 4"),
)
_WORD_BEFORE, _WORD_AFTER = r"(\p{L}+)[^\p{L}\s]{0,3}\s{0,2}$", r"^\s{0,2}[^\p{L}\s]{0,3}(\p{L}+)"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, base spans and other strings with digits that meet none of them, one row per document."""
    kinds = range(len(_RULES))
    none, ints = "CAST(array() AS array<string>)", "CAST(array() AS array<int>)"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("_t"))
    rows = rows.select("doc_id", "_t", *(F.expr(f"CASE WHEN {gate} THEN regexp_extract_all(_t, r'{p}', 0) ELSE {none} END").alias(f"m{i}") for i, (gate, p, _) in enumerate(_RULES)))
    rows = rows.select("doc_id", F.xxhash64("_t").alias("hash"), *(f"m{i}" for i in kinds), *(F.expr(f"CASE WHEN size(m{i}) > 0 THEN split(_t, r'{p}', -1) ELSE {none} END").alias(f"g{i}") for i, (_, p, _) in enumerate(_RULES)))
    rows = rows.select("*", *(F.expr(f"zip_with(m{i}, slice(g{i}, 1, size(m{i})), (t, x) -> length(x) + length(t))").alias(f"n{i}") for i in kinds))
    rows = rows.select("*", *(F.expr(f"CASE WHEN size(m{i}) = 0 THEN {ints} ELSE {scanned(f'n{i}', 'v + w', '0')} END").alias(f"e{i}") for i in kinds))
    rows = rows.select("doc_id", "hash", *(F.expr(f"CASE WHEN size(m{i}) = 0 THEN {_NONE} ELSE {_located(i, valid)} END").alias(f"f{i}") for i, (_, _, valid) in enumerate(_RULES)))
    rows = rows.select("doc_id", "hash", F.array_sort(F.concat("f0", "f1", "f2", "f3")).alias("base"), "f4")
    # in the order of all spans, the furthest end of the base spans before a candidate and the next start of those after it
    some = "size(f4) > 0 AND size(base) > 0"
    rows = rows.select("doc_id", "hash", "base", "f4", F.expr(f"CASE WHEN {some} THEN array_sort(concat(base, f4)) ELSE {_NONE} END").alias("every"))
    rows = rows.select("*", F.expr("transform(every, c -> CASE WHEN c.k < 4 THEN c.e ELSE 0 END)").alias("ends"), F.expr("transform(reverse(every), c -> CASE WHEN c.k < 4 THEN c.s ELSE 2147483647 END)").alias("starts"))
    rows = rows.select("doc_id", "hash", "base", "f4", "every", *(F.expr(f"CASE WHEN size(every) = 0 THEN {ints} ELSE {scanned(c, f'{f}(v, w)', z)} END").alias(c) for c, f, z in (("ends", "greatest", "0"), ("starts", "least", "2147483647"))))
    other = "CASE WHEN size(every) = 0 THEN f4 ELSE transform(filter(arrays_zip(every, ends, reverse(starts)), z -> z.every.k = 4 AND z.ends <= z.every.s AND z.`2` >= z.every.e), z -> z.every) END"
    return rows.select("doc_id", "hash", "base", F.expr(other).alias("other"))


def patterns(found: DataFrame, rounds: int, shrink: float) -> DataFrame:
    """Lexical patterns with their score and the number of distinct seeds beside them."""
    each = found.select(F.explode(F.concat("base", "other")).alias("o")).select(F.lower("o.t").alias("instance"), (F.col("o.k") < 4).alias("seed"), F.explode(_contexts(F.col("o"))).alias("pattern"))
    edges = common.written(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-edges")
    scored = edges.select("pattern", "instance", "n", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    for step in range(rounds):
        by_pattern = scored.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + shrink)).alias("p"))
        if step == rounds - 1:
            break
        met = edges.join(by_pattern, "pattern")
        by_instance = met.groupBy("instance").agg(F.max("seed").alias("is_seed"), (1 - F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(0.999)))))).alias("i"))
        scored = edges.join(by_instance, "instance").select("pattern", "instance", "n", F.when(F.col("is_seed"), 1.0).otherwise(F.col("i")).alias("score"))
    seeds = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("seeds"))
    return by_pattern.join(seeds, "pattern")


def _contexts(o: Column) -> Column:
    """The patterns at an occurrence: the word before, the word after."""
    before, after = F.lower(F.regexp_extract(o["l"], _WORD_BEFORE, 1)), F.lower(F.regexp_extract(o["r"], _WORD_AFTER, 1))
    return F.filter(F.array(F.when(before != "", F.concat(F.lit("<"), before)), F.when(after != "", F.concat(F.lit(">"), after))), lambda x: x.isNotNull())


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))))


def extract(docs: DataFrame, confident: float = 0.8, support: int = 5, rounds: int = 3, shrink: float = 2.0) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context."""
    found = common.written(occurrences(docs), "pii")
    good = patterns(found, rounds, shrink).where((F.col("p") >= confident) & (F.col("seeds") >= support)).select("pattern")
    new = (
        found.where(F.size("other") > 0)
        .select("doc_id", "hash", F.explode("other").alias("o"))
        .select("doc_id", "hash", F.struct(F.col("o.s").alias("s"), F.lit(4).alias("k"), F.col("o.e").alias("e")).alias("span"), F.explode(_contexts(F.col("o"))).alias("pattern"))
        .join(good, "pattern")
        .groupBy("doc_id", "hash")
        .agg(F.collect_set("span").alias("new"))
        .select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "new")
    )
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    rows = found.select("doc_id", "hash", base.alias("base")).join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    more = F.coalesce("new", F.expr("CAST(array() AS array<struct<s:int,k:int,e:int>>)"))
    return rows.select("doc_id", *(count(k) for k in range(4)), F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.concat("base", more)).alias("spans"), F.size(more).cast("long").alias("n_context"))
