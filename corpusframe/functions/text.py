"""Analysis of text: tokens, query terms, token estimates, cuts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
CHARS_PER_TOKEN = 4
RESPONSE_CHARS = 15_000

# The words that a query does not search and does not highlight.
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "be", "been", "in", "on", "at", "to", "for", "of", "with", "by", "from", "and", "or", "not", "this", "that", "it", "how", "what", "where", "when", "why", "which", "do", "does", "did"]


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def query_tokens(text: Column) -> Column:
    """The tokens of a query that are worth highlighting: no stop words, nothing of one character."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def terms_of(query: str, highlight: bool = False) -> list[str]:
    """The distinct tokens of a query string, in order, on the driver."""
    found = list(dict.fromkeys(re.findall(r"[^\W]+", query.lower())))
    return [t for t in found if len(t) > 1 and t not in STOP_WORDS] if highlight else found


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("long")


def list_of(joined: Column) -> Column:
    """The parts of a comma-joined string, without blanks and empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def truncated(text: Column, limit: int = RESPONSE_CHARS) -> Column:
    """Texts over the limit are cut there, or at the last line end if that lies beyond four fifths, and say how much is missing."""
    head = F.substring(text, 1, limit)
    last = F.length(head) - F.instr(F.reverse(head), "\n")  # characters before the last line end
    at = F.when((F.instr(head, "\n") > 0) & (last > limit * 0.8), last).otherwise(F.lit(limit))
    notice = F.concat(F.lit("\n\n... ("), (F.length(text) - at).cast("string"), F.lit(" more characters not shown)"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), at.cast("int")), notice))
