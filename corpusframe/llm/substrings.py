"""Removal of long repeated passages, found by recompression.

Words that a `WIDTH`-word window covers go if the window's words in order also begin a window of a document with a smaller doc_id.

1. Every text is parsed by recompression (`recompress`): runs and pairs of symbols get names that are the same in all tasks.  Each window has
   an anchor, the longest symbol that it determines.  Equal windows have equal anchors.  Consecutive windows with one anchor make one row (about one
   for five words).
2. A first round over all texts finds the symbols that texts share: a map-side combined minimum and maximum of text hashes for each anchor.  Only
   windows with a shared anchor can be repeated in another text.
3. A second round names those windows by the symbols of all levels that cover them, and takes the smallest doc_id of each name, a map-side
   combined minimum.  A second hash of the window's words, which shares nothing with the symbols' names, verifies each name: all windows of one name must
   have the same, else (names that collide) the windows of that name are told apart by it.  A join gives the windows that stand in a later document.
4. Each document is put together again without the words they cover.  Texts that equal a smaller document's as a whole are not parsed
   further: all their words go.

Scale and skew: nothing is paired within a group; a passage that many documents share is one group of partial minima, and a join with one row
on one side, whose other side Spark splits where it is skewed (copies of one text are dealt out by `common.salted`).  Intermediate tables are
written to the shared folder; they grow with the input, so they are never broadcast.

Defined results: null texts have no words; texts of fewer than `WIDTH` words lose none.  A null doc_id is neither smaller nor
larger than another, so such documents stay whole.  Rows with one doc_id don't remove each other's words; repeated rows give repeated rows.
An empty table gives an empty result.  Columns with any names are handed on, but for those named as a result.  A very long text is parsed in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import column, dropped, fields, over_pieces, salted, shielded, stored, table, text_of
from corpusframe.llm.recompress import ROUNDS, windows
from corpusframe.llm.textbytes import SPACED, row_hashes, window_hashes, words

WIDTH = 13


def anchor_rows(docs: DataFrame, key: str, text: str, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """(key, seq long: the text's hash, anchor long, start int, times int): windows start .. start + times - 1 have the anchor."""
    schema = fields(docs.select(key).schema, "seq long, anchor long, start int, times int")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(column(batch, "__text"), SPACED)
        h = w.hashes()
        best, _ = windows(h, w.first, width, rounds, named=False)
        at = _starts(w.first, width)
        row = np.searchsorted(w.first, at, side="right") - 1
        name = best[at]
        head = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (row[1:] != row[:-1])]) if len(at) else at
        times = np.diff(np.r_[head, len(at)])
        row = row[head]
        seq = row_hashes(h, w.first).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [column(batch, key).take(pa.array(row)), pa.array(seq[row]), pa.array(name[head].view(np.int64)), pa.array((at[head] - w.first[row]).astype(np.int32)), pa.array(times.astype(np.int32))],
            names=[key, "seq", "anchor", "start", "times"],
        )

    return docs.where(F.col(key).isNotNull()).select(key, text_of(docs, text).alias("__text")).mapInArrow(over_pieces(run, "__text"), schema)


def _starts(first: np.ndarray, width: int) -> np.ndarray:
    """The first words of all windows that stand inside one row."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    return np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def window_rows(candidates: DataFrame, key: str, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """(key, part int, name long, check long, at int) of the windows in `parts`, a list of (seq, spans) of which a text's own counts."""
    schema = fields(candidates.select(key).schema, "part int, name long, check long, at int")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(column(batch, "__text"), SPACED)
        h = w.hashes()
        seq = row_hashes(h, w.first).view(np.int64)
        chosen, place = np.zeros(len(h) + 1, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int32)
        for row, parts in enumerate(column(batch, "parts")):
            for k, part in enumerate(parts):
                if part["seq"].as_py() == seq[row]:
                    place[row] = k
                    spans = part["spans"].values
                    start = spans.field("start").to_numpy() + w.first[row]
                    np.add.at(chosen, start, 1)
                    np.add.at(chosen, start + spans.field("times").to_numpy(), -1)
        _, name = windows(h, w.first, width, rounds)
        at, check = window_hashes(w.hashes(1), w.first, width, 1)
        hit = np.cumsum(chosen)[at] > 0
        at, check = at[hit], check[hit]
        row = np.searchsorted(w.first, at, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [column(batch, key).take(pa.array(row)), pa.array(place[row]), pa.array(name[at].view(np.int64)), pa.array(check.view(np.int64)), pa.array((at - w.first[row]).astype(np.int32))], names=[key, "part", "name", "check", "at"]
        )

    return candidates.mapInArrow(over_pieces(run, "__text"), schema)


def first_documents(found: DataFrame, key: str) -> DataFrame:
    """(name, check, least): the smallest key of each repeated window's name; `check` is null unless the name stands for different words.
    A stored table."""
    sums = found.groupBy("name").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.min("check").alias("check"), F.max("check").alias("other"))
    sums = stored(sums.where((F.col("least") < F.col("most")) | (F.col("check") != F.col("other"))), "substring-first")
    verified = sums.where("check = other").select("name", F.lit(None).cast("long").alias("check"), "least")
    collided = sums.where("check != other").select("name")
    if collided.isEmpty():
        return verified
    apart = found.join(collided, "name", "left_semi").groupBy("name", "check").agg(F.min(key).alias("least"))
    return stored(verified.union(apart.select("name", "check", "least")), "substring-first")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """(key, parts array<struct<seq, whole boolean, at array<int>>>): for each text of a key, whether all of it is repeated, and the first
    words of its repeated windows.  A stored table; keys without repeats are not in it."""
    found = stored(anchor_rows(docs, key, text, width, rounds), "substring-anchors")
    texts = stored(found.groupBy(key, "seq").agg(F.count("*").alias("n")), "substring-texts")
    least = stored(texts.groupBy("seq").agg(F.min(key).alias("least"), F.count("*").alias("copies")).where("copies > 1"), "substring-least")
    n_copies = least.agg(F.sum("copies")).first()[0] or 0
    copies = stored(salted(texts, least, ["seq"], "copies", [key], n_copies).where(F.col(key) > F.col("least")).select(key, "seq"), "substring-copies")
    shared = stored(found.groupBy("anchor").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).where("a != b").select("anchor"), "substring-shared")
    spans = found.join(shared.hint("merge"), "anchor", "left_semi").groupBy(key, "seq").agg(F.collect_list(F.struct("start", "times")).alias("spans"))
    parts = stored(spans.join(copies, [key, "seq"], "left_anti").groupBy(key).agg(F.collect_list(F.struct("seq", "spans")).alias("parts")), "substring-parts")
    dropped(found, texts, least, shared)
    candidates = docs.select(key, text_of(docs, text).alias("__text")).join(parts.hint("merge"), key)
    named = stored(window_rows(candidates, key, width, rounds), "substring-windows")
    first = first_documents(named, key).withColumnRenamed("check", "own_check")
    later = named.join(first.hint("merge"), "name").where((F.col(key) > F.col("least")) & (F.col("own_check").isNull() | (F.col("own_check") == F.col("check"))))
    later = later.groupBy(key, "part").agg(F.collect_set("at").alias("at"))
    some = later.join(parts, key).select(key, F.struct(F.get("parts", F.col("part"))["seq"].alias("seq"), F.lit(False).alias("whole"), "at").alias("part"))
    whole = copies.select(key, F.struct("seq", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("at")).alias("part"))
    out = stored(some.union(whole).groupBy(key).agg(F.collect_set("part").alias("parts")), "substring-repeats")
    dropped(named, parts, copies)
    return out


@shielded("key", "text")
def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """All columns but the text, with n_words, n_removed (long), kept_text string: the words that stay, joined by one space; and removed
    array<struct<start,end>>: runs of removed words, end exclusive."""
    keep = [c for c in docs.columns if c != text]
    found = repeats(docs, key, text, width)
    held = found.select(F.col(key).alias("__key"), F.col("parts").alias("__parts")).hint("merge")
    rows = docs.select(*keep, text_of(docs, text).alias("__text"))
    joined = rows.join(held, rows[key] == held["__key"], "left").select(*keep, "__text", "__parts")
    schema = fields(docs.select(*keep).schema, "n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = column(batch, "__parts")
        some = np.flatnonzero(~np.asarray(parts.is_null().to_numpy(zero_copy_only=False)))
        w = words(column(batch, "__text").take(pa.array(some)), SPACED)
        seq = dict(zip(some.tolist(), row_hashes(w.hashes(), w.first).view(np.int64).tolist(), strict=True))
        n, gone, texts, runs = [], [], [], []
        for row, t in enumerate(column(batch, "__text")):
            own = t.as_py().encode("utf-8", "surrogatepass").split()
            n.append(len(own))
            cover = None
            for part in parts[row].as_py() or () if row in seq else ():
                if part["seq"] == seq[row]:
                    change = np.zeros(len(own) + 1, dtype=np.int64)
                    at = np.array([0] if part["whole"] else part["at"], dtype=np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, np.array([len(own)]) if part["whole"] else at + width, -1)
                    now = np.cumsum(change)[:-1] > 0
                    cover = now if cover is None else cover | now
            if cover is None:
                gone.append(0)
                runs.append([])
            else:
                own = [x for x, c in zip(own, cover.tolist(), strict=True) if not c]
                gone.append(n[-1] - len(own))
                edge = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(np.int8)))
                runs.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            texts.append(b" ".join(own).decode("utf-8", "surrogatepass"))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([column(batch, c) for c in keep] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string()), pa.array(runs, kind)], names=[*keep, "n_words", "n_removed", "kept_text", "removed"])

    return joined.mapInArrow(over_pieces(run, "__text"), schema)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
