"""Substrings and regular expressions by an index of trigrams: candidates from the index, then the exact test on those alone.

A pattern is turned into what every match must hold: alternatives of runs of letters, each of them some trigrams.  Rows that have the trigrams of one
alternative are candidates; only their texts are read and tested.  A pattern that asks for no three letters in a row (`.*`, `a|b`) has no such set, and then
all rows are tested.  Grams are of lower-cased text, so one index serves patterns with and without regard to case.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as C
from re import _parser as syntax

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3
#: A pattern with more alternatives than this counts as one that asks for nothing, as does a part of one.
ALTERNATIVES = 64


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text; null and short texts have none.  Slices of strings, which Python has and SQL puts together letter by
    letter, in Arrow batches."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        parts, ends = [pa.array([], pa.string())], [0]
        for one in texts:  # as Arrow strings they are small, as Python's they are not
            t = one.as_py() or ""
            parts.append(pa.array(dict.fromkeys(map("".join, zip(t, t[1:], t[2:], strict=False))), pa.string()))
            ends.append(ends[-1] + len(parts[-1]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts))

    return run(F.lower(text))


def postings(df: DataFrame, key: str, column: str) -> DataFrame:
    """(gram, key): which rows have a trigram.  Nothing is shuffled; write it sorted by gram (`operators.postings.written`)."""
    return df.select(F.explode(grams(F.col(column))).alias("gram"), key)


# --- what a pattern needs


class _Need:
    """A set of alternatives: each the texts that a match of it is (`whole`), or only the runs that it holds."""

    def __init__(self, whole: list[str] | None, held: list[frozenset[str]]):
        self.whole, self.held = whole, held  # held: alternatives of grams that every match has; [frozenset()] asks nothing


def _grams_of(run: str) -> frozenset[str]:
    return frozenset(run[i : i + SIZE] for i in range(len(run) - SIZE + 1))


def _settled(need: _Need) -> list[frozenset[str]]:
    if need.whole is None:
        return need.held
    return _both([_grams_of(w) for w in need.whole], need.held)


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    """Alternatives of what has one of each; too many are those of the side that asks more."""
    out = list(dict.fromkeys(x | y for x in a for y in b))
    if len(out) <= ALTERNATIVES:
        return out
    return max((a, b), key=lambda s: min(len(x) for x in s))


def _sequence(items, flags: int) -> _Need:
    """Items one after the other: runs of letters grow as long as each item is one of a few texts."""
    runs, held = [""], [frozenset()]
    for op, value in items:
        part = _item(op, value, flags)
        joined = None if part.whole is None else list(dict.fromkeys(a + b for a in runs for b in part.whole))
        if joined is not None and len(joined) <= ALTERNATIVES:
            runs, held = joined, _both(held, part.held)
            continue
        held = _both(held, _both([_grams_of(r) for r in runs], _settled(part)))
        runs = None
        break
    if runs is not None:
        return _Need(runs, held)
    rest = list(items)[list(items).index((op, value)) + 1 :]
    return _Need(None, _both(held, _settled(_sequence(rest, flags)) if rest else [frozenset()]))


def _letter(code: int) -> _Need:
    c = chr(code)
    return _Need([c.lower()], [frozenset()]) if c.isascii() else _NOTHING  # of other letters lower case may be several, or depend on rules


_NOTHING = _Need(None, [frozenset()])
_EMPTY = _Need([""], [frozenset()])


def _item(op, value, flags: int) -> _Need:
    if op is C.LITERAL:
        return _letter(value)
    if op is C.IN and all(k is C.LITERAL for k, _ in value) and len(value) <= 4:
        parts = [_letter(x) for _, x in value]
        return _NOTHING if any(p.whole is None for p in parts) else _Need(list(dict.fromkeys(w for p in parts for w in p.whole)), [frozenset()])
    if op is C.SUBPATTERN:
        return _sequence(value[-1], flags)
    if op is C.ATOMIC_GROUP:
        return _sequence(value, flags)
    if op is C.BRANCH:
        parts = [_sequence(x, flags) for x in value[1]]
        if all(p.whole is not None and p.held == [frozenset()] for p in parts):
            whole = list(dict.fromkeys(w for p in parts for w in p.whole))
            return _Need(whole, [frozenset()]) if len(whole) <= ALTERNATIVES else _Need(None, [frozenset()])
        held = list(dict.fromkeys(x for p in parts for x in _settled(p)))
        return _Need(None, held if len(held) <= ALTERNATIVES else [frozenset()])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = value
        part = _sequence(inner, flags)
        if least == most == 1:
            return part
        if least == 0 and most == 1 and part.whole is not None and part.held == [frozenset()]:
            return _Need(["", *part.whole], [frozenset()])
        return _NOTHING if least == 0 else _Need(None, _settled(part))
    if op is C.AT:
        return _EMPTY  # a place, not a letter
    if op in (C.ASSERT, C.ASSERT_NOT):
        return _EMPTY if op is C.ASSERT_NOT else _Need([""], [frozenset()])
    return _NOTHING


def needed(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, of which every match of the regular expression has one, whole; [frozenset()] if it can do without.

    A pattern that isn't understood, as it is of another dialect, asks for nothing."""
    try:
        parsed = syntax.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return [frozenset()]
    if parsed.state.flags & re.VERBOSE or re.search(r"\\[QEpPuxNXRGzZhHvV0-9]|&&|\(\?[^:=!<>ims-]|\(\?[ims]*[ux]", pattern):
        return [frozenset()]
    found = _settled(_sequence(list(parsed), parsed.state.flags))
    least = [a for a in found if not any(b < a for b in found)]  # what asks more than another adds nothing
    return least or [frozenset()]


def needed_by_text(text: str) -> list[frozenset[str]]:
    """The same of a substring."""
    runs = re.split(r"[^\x00-\x7f]", text)
    return [frozenset(g for run in runs for g in _grams_of(run.lower()))]


# --- search


def candidates(index: DataFrame, key: str, alternatives: list[frozenset[str]]) -> DataFrame | None:
    """(key) of the rows that have all trigrams of an alternative; None if any row may match.  The scan gets the trigrams as a filter."""
    if any(not a for a in alternatives):
        return None
    wanted = sorted(set().union(*alternatives))
    found = index.where(F.col("gram").isin(*wanted)).distinct()
    if len(alternatives) == 1:
        return found.groupBy(key).count().where(F.col("count") == len(wanted)).select(key)
    place = {g: k for k, g in enumerate(wanted)}
    has = found.groupBy(key).agg(F.collect_set("gram").alias("has"))  # of those wanted, so as many as the pattern has
    some = reduce(lambda a, b: a | b, [F.size(F.array_intersect("has", F.array(*[F.lit(g) for g in sorted(a, key=place.get)]))) == len(a) for a in alternatives])
    return has.where(some).select(key)


def _searched(df: DataFrame, index: DataFrame, key: str, alternatives: list[frozenset[str]], test: Column) -> DataFrame:
    keys = candidates(index, key, alternatives)
    return df.where(test) if keys is None else df.join(keys, key, "left_semi").where(test)


def grep(df: DataFrame, index: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """The rows whose text the regular expression (Java's) finds something in."""
    return _searched(df, index, key, needed(pattern), F.col(column).rlike(pattern))


def containing(df: DataFrame, index: DataFrame, key: str, column: str, text: str, any_case: bool = False) -> DataFrame:
    """The rows that hold a text."""
    test = F.lower(column).contains(text.lower()) if any_case else F.col(column).contains(text)
    return _searched(df, index, key, needed_by_text(text), test)
