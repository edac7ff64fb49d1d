"""Line windows: overlapping chunks of whole lines, and the lines around a place."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions.text import CHARS_PER_TOKEN

MAX_CHARS = 2_000
OVERLAP_CHARS = 200
MIN_TOKENS = 50


def line_windows(lengths: list[int], most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, tail: str = "stop") -> Iterator[tuple[int, int]]:
    """(start, end) of windows over lines of the given lengths: each takes lines until `most` characters are reached; the next begins
    where at most `overlap` characters are repeated.  With tail="cascade" windows go on from the last one, a line shorter each time."""
    ends = [0, *accumulate(n + 1 for n in lengths)]
    n, start = len(lengths), 0
    while start < n:
        end = max(start + 1, min(n, bisect.bisect_left(ends, ends[start] + most)))
        yield start, end
        if end == n and tail == "stop":
            return
        back = bisect.bisect_right(ends, ends[end] - overlap) - 1
        start = back if start < back < end else start + 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def bounds(lines: Column) -> Column:
    """array<struct<line_start, line_end, n_chars>>: the windows of a text's lines.

    Where a window begins depends on where the last one ended, so a worker walks over prefix sums; only line lengths reach it, in Arrow lists."""

    @F.arrow_udf("array<struct<line_start:int,line_end:int,n_chars:int>>")
    def walk(lengths: pa.Array) -> pa.Array:
        at = lengths.offsets.to_numpy()
        sizes = lengths.values.to_numpy(zero_copy_only=False)
        starts, ends, chars, first = [], [], [], [0]
        for a, b in zip(at[:-1], at[1:], strict=True):
            ahead = np.concatenate(([0], np.cumsum(sizes[a:b] + 1)))
            for s, e in line_windows(sizes[a:b].tolist()):
                starts.append(s + 1)
                ends.append(e)
                chars.append(int(ahead[e] - ahead[s]) - 1)
            first.append(len(starts))
        fields = {"line_start": starts, "line_end": ends, "n_chars": chars}
        found = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in fields.values()], list(fields))
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), found)

    return walk(F.transform(lines, lambda x: F.length(x)))


def windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, line_start, line_end, n_chars): the windows of each text."""
    return df.select(key, F.posexplode(bounds(lines_of(F.col(text)))).alias("part", "x")).select(key, "part", "x.*")


def text_blocks(df: DataFrame, key: str, text: str, prefix: Column, least: int = MIN_TOKENS) -> DataFrame:
    """The windows that hold enough tokens with their prefix, numbered anew: (key, part, line_start, line_end, token_count).  Nothing is shuffled."""
    tokens = lambda x: F.floor((x["n_chars"] + F.col("p")) / CHARS_PER_TOKEN).cast("int")
    found = df.select(key, F.length(prefix).alias("p"), bounds(lines_of(F.col(text))).alias("w"))
    kept = found.select(key, "p", F.posexplode(F.filter("w", lambda x: tokens(x) >= least)).alias("part", "x"))
    return kept.select(key, "part", "x.line_start", "x.line_end", tokens(F.col("x")).alias("token_count"))


def chunks(df: DataFrame, text: str, least: int = 0) -> DataFrame:
    """The windows with their text: all columns but the text, and part, line_start, line_end, token_count, content; of windows with enough tokens."""
    keep = [c for c in df.columns if c != text]
    lined = df.select(*keep, lines_of(F.col(text)).alias("__lines")).withColumn("__windows", bounds(F.col("__lines")))
    each = lined.select(*keep, "__lines", F.posexplode("__windows").alias("part", "x"))
    content = F.array_join(F.slice("__lines", F.col("x.line_start"), F.col("x.line_end") - F.col("x.line_start") + 1), "\n")
    tokens = F.floor(F.col("x.n_chars") / CHARS_PER_TOKEN).cast("int")
    return each.select(*keep, "part", "x.line_start", "x.line_end", tokens.alias("token_count"), content.alias("content")).where(F.col("token_count") >= least)


def context(df: DataFrame, key: str, text: str, start: int, end: int, radius: int = 10) -> DataFrame:
    """(key, line, shown): numbered lines around a range, those inside it marked."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "content")).withColumn("line", F.col("i") + 1)
    near = lines.where((F.col("i") >= max(0, start - 1 - radius)) & (F.col("i") < end + radius))
    mark = F.when(F.col("line").between(start, end), ">").otherwise(" ")
    return near.select(key, "line", F.concat(mark, F.lit(" "), F.lpad(F.col("line").cast("string"), 5, " "), F.lit(" | "), F.rtrim("content")).alias("shown"))


def file_row(path: Column, text: Column) -> list[Column]:
    """Columns of the files table that need no parser."""
    from corpusframe.functions import paths

    return [
        path.alias("id"),
        path.alias("path"),
        paths.base_name(path).alias("filename"),
        F.ltrim(F.regexp_replace(paths.suffix(path), r"^\.", "")).alias("extension"),
        paths.module(path).alias("module"),
        F.size(F.split(text, "\n")).alias("loc"),
    ]
