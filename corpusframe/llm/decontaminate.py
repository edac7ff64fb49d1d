"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of whole documents of a partition, of bounded size.  Its words become symbols: the benchmark's words
have numbers, any other word is a separator, and so is a run of benchmark words that is shorter than the shortest test
phrase, for no phrase can occur in it.  The FM-index over the symbols finds test phrases by backward search and
locates them by sampled suffix positions; overlapping occurrences merge into removal spans.  Only phrases whose rarest word
(among the benchmark's phrases) is in the shard are searched, so a shard's cost follows what it shares with the benchmark and not the
benchmark's size.

The benchmark is the query set.  Its words and phrases are broadcast in blocks of `BLOCK_BYTES` of text, as flat arrays of about 24 bytes a
word.  A larger benchmark has more blocks: a task reads one after the other for each batch of rows and holds one at a time, in one
pass over the documents, without a shuffle.

Defined results: null and empty texts have no words.  An item without words has no phrase; a repeated item id is one
item; a null item id is written `null`.  Repeated documents give repeated rows, an empty table an empty one.  Columns with any names are handed on,
but for those named as a result; the stage hands all on.  A very long text is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import column, fields, give_back, lists, shielded, table, text_of
from corpusframe.llm.fmindex import FmIndex
from corpusframe.llm.textbytes import ALNUM, Words, pieces, raw, words

WINDOW = 10
BLOCK_BYTES = 16_000_000
SHARD_BYTES = 1_000_000


class Phrases:
    """A block of the benchmark: its vocabulary, and its distinct windows with the items that have them, in flat arrays."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        found = words(pa.array([t or "" for _, t in items], pa.large_string()), ALNUM, lower=True)
        numbers, number = {}, np.zeros(len(found.start), dtype=np.int32)
        for i in range(len(found.start)):
            number[i] = numbers.setdefault(found.word(i), len(numbers)) + 1
        self.vocabulary = list(numbers)
        said = ["null" if i is None else str(i) for i, _ in items]
        self.names = sorted(set(said))
        owner = np.searchsorted(np.array(self.names, dtype=object), np.array(said, dtype=object)) if items else np.zeros(0, np.int64)
        counts = found.counts()
        often = np.bincount(number, minlength=len(numbers) + 1)
        self.number = number
        #: For each length: where each phrase begins in `number`; which phrases have each word as their rarest (where the word's begin, and the phrases);
        #: their items likewise.
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({min(int(c), window) for c in counts if c}):
            own = np.flatnonzero(counts == length) if length < window else np.flatnonzero(counts >= window)
            n = counts[own] - length + 1
            at = np.repeat(found.first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            rows = np.stack([number[at + k] for k in range(length)], axis=1)
            _, head, inverse = np.unique(np.ascontiguousarray(rows).view(f"V{4 * length}").ravel(), return_index=True, return_inverse=True)
            rows = rows[head]
            pair = np.unique(inverse.astype(np.int64) * len(self.names) + np.repeat(owner[own], n))
            item_at = np.searchsorted(pair // len(self.names), np.arange(len(rows) + 1))
            rarest = rows[np.arange(len(rows)), often[rows].argmin(axis=1)]
            order = np.argsort(rarest, kind="stable")
            flat = (at[head], np.searchsorted(rarest[order], np.arange(len(numbers) + 2)), order, item_at, pair % len(self.names))
            self.by_length.append((length, *(x.astype(np.int32) for x in flat)))
        self.shortest = min((length for length, *_ in self.by_length), default=0)
        self.seed, self.sorted = 0, np.zeros(0, np.uint64)
        self.text = np.frombuffer(b"".join(self.vocabulary), dtype=np.uint8)
        self.begins = np.cumsum([0, *map(len, self.vocabulary)])
        while self.vocabulary:
            h = words(pa.array(self.vocabulary, pa.binary()), ALNUM).hashes(self.seed)
            self.order = np.argsort(h)
            self.sorted = h[self.order]
            if len(np.unique(h)) == len(h):
                break
            self.seed += 1

    def symbols(self, w: Words) -> np.ndarray:
        """The number of each word in the vocabulary, else 0; equal hashes count only with equal bytes."""
        out = np.zeros(len(w.start), dtype=np.int64)
        if not self.vocabulary or not len(out):
            return out
        h = w.hashes(self.seed)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        out = np.where(self.sorted[at] == h, self.order[at] + 1, 0)
        long_enough(out, w, self.shortest)
        hit = np.flatnonzero(out)
        size = (w.end - w.start)[hit]
        same = size == np.diff(self.begins)[out[hit] - 1]
        hit_same, size = hit[same], size[same]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        equal = w.data[np.repeat(w.start[hit_same], size) + step] == self.text[np.repeat(self.begins[out[hit_same] - 1], size) + step]
        if len(hit_same):
            same[same] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        out[hit[~same]] = 0
        return out


def long_enough(symbols: np.ndarray, w: Words, least: int) -> None:
    """Sets runs of symbols inside one row that are shorter than `least` to 0."""
    on = np.r_[False, symbols != 0, False]
    change = on[1:] != on[:-1]
    row_start = np.zeros(len(symbols) + 1, dtype=bool)
    row_start[w.first] = True
    start = np.flatnonzero(on[1:-1] & (change[:-1] | row_start[:-1]))
    end = np.flatnonzero(on[1:-1] & (change[1:] | row_start[1:])) + 1
    short = (end - start) < least
    size = (end - start)[short]
    symbols[np.repeat(start[short], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = 0


def search(w: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard: the first word, the number of words, and an item (once for each item that has the phrase)."""
    symbols = phrases.symbols(w)
    kept = np.flatnonzero(symbols)
    none = np.zeros(0, np.int64)
    if not len(kept):
        return none, none, none
    row = np.searchsorted(w.first, kept, side="right")
    apart = np.r_[False, (np.diff(kept) > 1) | (np.diff(row) > 0)]
    place = np.arange(len(kept)) + np.cumsum(apart)
    sequence = np.zeros(place[-1] + 2, dtype=np.int64)
    sequence[place] = symbols[kept]
    word_at = np.zeros(len(sequence), dtype=np.int64)
    word_at[place] = kept
    index = FmIndex(sequence, len(phrases.vocabulary))
    there = np.unique(symbols[kept])
    out = [(none, none, none)]
    for length, begin, rare_at, by_rarest, item_at, owners in phrases.by_length:
        wanted = by_rarest[_ranges(rare_at[there], rare_at[there + 1])]
        if len(wanted):
            phrase, position = index.locate(*index.find(phrases.number[begin[wanted][:, None] + np.arange(length)].astype(np.int64)))
            phrase = wanted[phrase]
            sizes = item_at[phrase + 1] - item_at[phrase]
            out.append((np.repeat(word_at[position], sizes), np.full(int(sizes.sum()), length), owners[_ranges(item_at[phrase], item_at[phrase + 1])]))
    return tuple(np.concatenate([o[k] for o in out]).astype(np.int64) for k in range(3))


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each low to before its high."""
    size = high - low
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def spans(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered words: first word, end word, and the number of runs in each row."""
    on = np.r_[False, covered, False]
    row_start = np.zeros(len(covered) + 1, dtype=bool)
    row_start[first] = True
    start = np.flatnonzero(on[1:-1] & (~on[:-2] | row_start[:-1]))
    end = np.flatnonzero(on[1:-1] & (~on[2:] | row_start[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, first))


class Finding:
    """What the blocks have found in a shard so far."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.words = batch, words(column(batch, "__text"), ALNUM, lower=True)
        self.change = np.zeros(len(self.words.start) + 1, dtype=np.int64)
        self.items: list[set[str]] = [set() for _ in range(batch.num_rows)]

    def search(self, phrases: Phrases) -> None:
        at, length, item = search(self.words, phrases)
        if len(at):
            np.add.at(self.change, at, 1)
            np.add.at(self.change, at + length, -1)
            row = np.searchsorted(self.words.first, at, side="right") - 1
            pair = np.unique(row * len(phrases.names) + item)
            for r, i in zip((pair // len(phrases.names)).tolist(), (pair % len(phrases.names)).tolist(), strict=True):
                self.items[r].add(phrases.names[i])

    def rows(self, others: list[str], clean: bool) -> pa.RecordBatch:
        w, covered = self.words, np.cumsum(self.change)[:-1] > 0
        start, end, n = spans(covered, w.first)
        shift = np.repeat(w.first[:-1], n)
        ranges = pa.StructArray.from_arrays([pa.array((start - shift).astype(np.int32)), pa.array((end - shift).astype(np.int32))], names=["start", "end"])
        hit = np.diff(np.r_[0, np.cumsum(covered)][w.first])
        text = column(self.batch, "__text")
        left = [cut(text, w.start[start], w.end[end - 1])] if clean else []
        found = [pa.array(w.counts(), pa.int64()), pa.array(hit, pa.int64()), lists(ranges, n), pa.array([sorted(i) for i in self.items], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([column(self.batch, c) for c in others] + found + left, names=[*others, "n_words", "n_hit", "hits", "items"] + ["clean_text"] * clean)


def _pass(held: list, others: list[str], clean: bool):
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(held) == 1:
                for piece in pieces(batch, "__text", SHARD_BYTES):
                    found = Finding(piece)
                    found.search(held[0].value)
                    yield found.rows(others, clean)
            else:
                shards = [Finding(piece) for piece in pieces(batch, "__text", SHARD_BYTES)]
                for block in held:
                    for found in shards:
                        found.search(block.value)
                    vars(block).pop("_value", None)  # one block at a time; the file it is read from stays
                for found in shards:
                    yield found.rows(others, clean)
            give_back()

    return go


def blocks(benchmark: DataFrame, item: str, text: str, size: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of about `size` bytes; each is collected by itself."""
    items = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // size) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield sorted(((r.item, r.text) for r in part.collect()), key=str)


def cut(texts: pa.Array, since: np.ndarray, to: np.ndarray) -> pa.Array:
    """The texts without the bytes between each `since` and `to`, which count over all of them."""
    data, off = raw(texts)
    gone = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(gone, since, 1)
    np.add.at(gone, to, -1)
    left = np.cumsum(gone, dtype=np.int32)[:-1] == 0
    off = np.r_[0, np.cumsum(left)][off].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(data[left].tobytes())).cast(pa.string())


@shielded("text")
def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """All columns but the text, n_words, n_hit (long), hits array<struct<start,end>> (word numbers, merged, end
    exclusive) and items array<string> (sorted); with `clean` also clean_text, without each run of hit words from its first to its last byte."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, text_of(docs, text).alias("__text"))
    schema = fields(docs.select(*keep).schema, "n_words long, n_hit long, hits array<struct<start:int,end:int>>, items array<string>" + ", clean_text string" * clean)
    context = docs.sparkSession.sparkContext
    held = [context.broadcast(Phrases(block, window)) for block in blocks(benchmark, item, item_text, block_bytes)]
    return rows.mapInArrow(_pass(held, keep, clean), schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@shielded("text", "n_chars")
def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents, with all their columns, without benchmark passages; a document of which no word is left goes.  Clean documents stay as they
    are."""
    found = find_contamination(docs.withColumn("__none", F.col(text).isNull()), benchmark, text, clean=True)
    left = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))).withColumn(text, F.when(~F.col("__none"), F.col("clean_text")))
    values = {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return left.withColumns(values).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))
