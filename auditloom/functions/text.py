"""Text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import one_place

#: Words that keyword reports leave out (fixed values).
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "this", "that",
    "these", "those", "it", "its", "as", "from", "your", "you", "we", "our", "us", "will", "can", "if", "not", "all", "more", "about", "into", "than",
    "then", "which", "their", "they", "he", "she", "his", "her", "have", "has", "had", "do", "does", "did", "up", "out", "so", "no", "yes", "how",
    "what", "when", "where", "who", "why", "here", "there", "also", "may", "any", "each", "other",
)
WORD = r"[a-z][a-z'-]{2,}"
_BLOCK = r"(?i)</?(?:p|div|h[1-6]|li|br|tr|td|section|article|header|footer|nav|ul|ol)(?:\s[^>]*)?>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def keywords(text: Column) -> Column:
    """Words without stopwords, in order."""
    return F.filter(words(text), lambda w: ~w.isin(*STOPWORDS))


def shingles(tokens: Column, k: int) -> Column:
    """Distinct runs of k tokens; tokens should be a column, for an expression is evaluated anew for each run."""
    starts = F.sequence(F.lit(1), F.size(tokens) - k + 1)
    return F.when(F.size(tokens) >= k, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def syllables(word: Column) -> Column:
    """Vowel groups of a word's letters, one less for a final e, one at least; 0 without letters."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.greatest(F.regexp_count(w, F.lit("[aeiouy]+")), F.lit(1))
    return F.when(w == "", F.lit(0)).otherwise(F.when(w.endswith("e") & (groups > 1), groups - 1).otherwise(groups))


def syllables_of(letters: Column) -> Column:
    """Syllables of all words of a text of lower-case letters and spaces: the sum of ``syllables``, in three searches that don't go back."""
    groups = F.regexp_count(letters, F.lit("[aeiouy]++"))
    # a vowel group, a consonant, and an e at the end: two groups at least, and the last doesn't sound
    silent = F.regexp_count(letters, F.lit("(?<![a-z])[^aeiouy ]*+[aeiouy]++[^aeiouy ]++[a-z]*+(?<=e)"))
    return groups - silent + F.regexp_count(letters, F.lit("(?<![a-z])[^aeiouy ]++(?![a-z])"))


def flesch(text: Column) -> Column:
    """Flesch reading ease to one place; null under 20 words."""
    n = F.regexp_count(text, F.lit("[a-zA-Z']+"))
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[^.!?\s][^.!?]*+")), F.lit(1))
    sounds = syllables_of(F.lower(F.regexp_replace(F.regexp_replace(text, "'", ""), "[^a-zA-Z]+", " ")))
    return F.when(n >= 20, one_place(206.835 - 1.015 * (n / sentences) - 84.6 * (sounds / n)))


#: The character references that plain markup has; ampersands last.
REFERENCES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """Plain markup's character references as characters; others stay as they are."""
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_references(html: Column) -> Column:
    """Markup of which a parser decodes what ``unescaped`` does: all other ampersands are written as references to themselves."""
    return F.regexp_replace(html, "&(?!(?:" + "|".join(name[1:-1] for name, _ in REFERENCES) + ");)", "&amp;")


def visible_text(html: Column) -> Column:
    """Text of the body without scripts, styles and comments; block tags separate words. For malformed markup see the parser in ``html``."""
    body = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", "")
    body = F.regexp_replace(body, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->", "")
    flat = unescaped(F.regexp_replace(F.regexp_replace(body, _BLOCK, " "), r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def word_tier(n: Column) -> Column:
    return F.when(n < 150, "Thin").when(n <= 800, "Standard").otherwise("Deep")


def csv_field(x: Column) -> Column:
    """Quoted, with quotes doubled, where a quote, comma or line break is inside."""
    x = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def slug(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?i)[^a-z0-9]+", "-"))


def capital_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def last_modified_ts(x: Column) -> Column:
    """HTTP dates and ISO dates as timestamps; null where neither."""
    bare = F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z]{3},\s*", ""), r"\s*GMT$", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss")), F.when(x.rlike(r"^\s*\d{4}-"), F.try_to_timestamp(x)))
