"""Text columns: normalisation, matching, token F1, labels. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTICLES = ("a", "an", "the")
#: ASCII punctuation, as one character class.
ASCII_PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
#: Everything but letters, digits, underscores and blanks.
UNICODE_PUNCTUATION = r"[^\p{L}\p{N}_\s]"


#: White space of any kind, as Python's strip takes it.
WHITE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(c: Column) -> Column:
    """Without outer white space of any kind; linear in the text, whatever runs of blanks it holds."""
    return F.btrim(c, F.lit(WHITE))


def _tokens(c: Column, punctuation: str) -> Column:
    words = F.split(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), punctuation, ""), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES))


def em_tokens_ascii(c: Column) -> Column:
    """Answer tokens for screening: lower case, no ASCII punctuation, no articles; null counts as empty."""
    return _tokens(c, ASCII_PUNCTUATION)


def em_tokens_unicode(c: Column) -> Column:
    """Answer tokens for scoring: lower case, no Unicode punctuation (underscore kept), no articles."""
    return _tokens(c, UNICODE_PUNCTUATION)


def em_normalise_ascii(c: Column) -> Column:
    return F.array_join(em_tokens_ascii(c), " ")


def em_normalise_unicode(c: Column) -> Column:
    return F.array_join(em_tokens_unicode(c), " ")


def exact_match(prediction: Column, gold: Column, unicode: bool = True) -> Column:
    """Equality after normalisation; null equals the empty text."""
    norm = em_normalise_unicode if unicode else em_normalise_ascii
    return norm(prediction) == norm(gold)


def token_f1(prediction: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall over token bags: 1 if both are empty, 0 if one is."""
    p, g = em_tokens_ascii(prediction), em_tokens_ascii(gold)
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(g, t)))
    n, m = F.size(p), F.size(g)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (shared == 0), 0.0).otherwise(F.round(2.0 * shared / (n + m), 6))


def evidence_normalise(c: Column) -> Column:
    """Evidence text for containment: lower case, no quotes or backticks, single blanks."""
    plain = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), "[\"'`‘’“”]", "")
    return strip(F.regexp_replace(plain, r"\s+", " "))


def covers(needle: Column, haystack: Column) -> Column:
    """The normalised needle is not empty and lies in the haystack."""
    n = evidence_normalise(needle)
    return (F.length(n) > 0) & F.contains(evidence_normalise(haystack), n)


def pool_covers(needle: Column, texts: Column) -> Column:
    """The needle lies in one of the texts, or in all of them joined by line breaks."""
    return F.exists(texts, lambda t: covers(needle, t)) | covers(needle, F.array_join(texts, "\n"))


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def human_date(raw: Column) -> Column:
    """An ISO date as people write it, labelled UTC as it stands; anything else as it is."""
    parsed = F.try_to_timestamp(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1), F.lit("yyyy-MM-dd['T'][' ']HH:mm:ss"))
    return F.coalesce(F.date_format(parsed, "MMMM dd, yyyy 'at' hh:mm a 'UTC'"), raw)


def markdown_cell(c: Column) -> Column:
    """A text made safe for a cell of a table."""
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def markdown_fence(c: Column) -> Column:
    """A text made safe inside a fence."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("```"), F.lit("'''"))


def turn_range_label(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "-")


def category_key(c: Column) -> Column:
    """A category or domain without case and outer blanks; empty becomes null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def grading_reply(reply: Column, tags: Column, exact: bool = False) -> Column:
    """The tags a grader named: none for a short reply with 'none', else the tags in the reply, else all M/D numbers.

    The compatible reading takes a tag that is part of a longer one (M1 in M10); ``exact`` does not.
    """
    low = F.lower(F.coalesce(reply, F.lit("")))
    named = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(reply, F.lit(""))), F.lit(r"([MD][0-9]+)")))
    if exact:
        found = F.filter(tags, lambda t: F.array_contains(named, F.upper(t)))
    else:
        found = F.filter(tags, lambda t: F.contains(low, F.lower(t)))
    none = F.contains(low, F.lit("none")) & (F.length(strip(low)) < 20)
    return F.when(none, F.expr("cast(array() as array<string>)")).when(F.size(found) > 0, found).otherwise(F.array_intersect(named, tags))
