"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Text is lowered; each run of characters that aren't letters becomes one space.  For each language a model of order
`ORDER` is made from the counts of character sequences in training documents; all sequences are kept as 64-bit hashes in sorted
arrays with their discounted probability, and all contexts with their back-off weight.  The language with the lowest cross-entropy per
character is chosen.  Its posterior, with a temperature fitted on training documents that the models did not see, is the score; `rejected`
tells that the cross-entropy is beyond what `REJECT` of those documents of the language have.

Training takes about `SAMPLE` labelled documents of each language, whole, chosen by a hash of doc_id (a sixth of them for
calibration); with fewer it takes all.  At most `LANGUAGES` languages are learned, an error beyond.  So the model's size is bounded and
it is broadcast.  Scoring reads every whole text once, without a shuffle.  A very long text is counted and scored `BLOCK` symbols at a time.

Defined results: null and texts without a letter are `und` with score 0.  Labels that are null or empty aren't learned.  With nothing
to learn from, all is `und`.  Ties go to the language that sorts first.  Repeated rows have equal results, an empty table an empty one.  Columns
with any names are handed on, but for those named as a result.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import column, fields, lists, over_pieces, shielded, table, text_of
from corpusframe.llm.textbytes import mix

ORDER = 4
SAMPLE = 2_000
LANGUAGES = 200
REJECT = 0.995
CACHED = 1_000_000
UNKNOWN = "und"
PIECE = 1_000_000
BLOCK = 1 << 21


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it isn't a letter."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each text between two spaces (0), runs of other characters as one space; where each text begins."""
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if len(texts) == 1 and len(text := texts[0].as_py()) > BLOCK:
        parts = [_folded()[np.frombuffer(text[a : a + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)] for a in range(0, len(text), BLOCK)]
        symbols = np.concatenate([np.zeros(1, np.uint32), *parts, np.zeros(1, np.uint32)])
        symbols = symbols[np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]]
        return symbols, np.array([0, len(symbols)])
    whole = "\n\n".join(["", *texts.to_pylist(), ""])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts.to_pylist()], dtype=np.int64)
    begins = np.cumsum(np.r_[0, sizes + 2])  # at the first of the two line ends before each text
    symbols = _folded()[points]
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[begins + 1] = True  # so a text's last space and the next one's first stay apart
    keep[begins] = symbols[np.maximum(begins - 1, 0)] != 0
    place = np.r_[0, np.cumsum(keep)]
    return symbols[keep][:-1], place[begins + 1]


def grams(symbols: np.ndarray, first: np.ndarray, order: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the `order` symbols that end at each position, or at those in `at`; before a text's start stand spaces."""
    if at is None:
        at = np.arange(len(symbols))
        since = at - np.repeat(first[:-1], np.diff(first))
    else:
        since = at - first[np.searchsorted(first, at, side="right") - 1]
    out = np.full(len(at), order, dtype=np.uint64)
    for k in range(order - 1, -1, -1):
        part = symbols[at - np.minimum(since, k)].astype(np.uint64)
        part[since < k] = 0
        out = (out + part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return mix(out)


class KneserNey:
    """One language's model: for each order the sorted hashes of sequences with their discounted share, and of contexts with their back-off."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], alphabet: int):
        """counts: of each order from 1 on: hash, hash without the last symbol, hash without the first, count."""
        self.levels = []
        self.uniform = 1.0 / (alphabet + 1)
        for n, (gram, context, _, count) in enumerate(counts):
            if n < len(counts) - 1:  # lower orders count in how many ways a sequence is continued to the left
                longer = counts[n + 1][2]
                names, ways = np.unique(longer, return_counts=True)
                at = np.minimum(np.searchsorted(names, gram), max(0, len(names) - 1))
                count = np.where(names[at] == gram, ways[at], 1) if len(names) else np.ones_like(count)
            once, twice = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
            discount = once / (once + 2 * twice) if once and twice else 0.5
            names, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, weights=count, minlength=len(names))
            kinds = np.bincount(inverse, minlength=len(names))
            order = np.argsort(gram)
            share = (count - discount) / total[inverse]
            self.levels.append((gram[order], share[order], names, discount * kinds / total))

    def probability(self, by_order: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Of each symbol after its context; by_order and contexts have its hashes for each order from 1 on."""
        p = np.full(len(by_order[0]), self.uniform)
        for (gram, share, names, back), own, context in zip(self.levels, by_order, contexts, strict=True):
            if not len(gram):
                continue
            at = np.minimum(np.searchsorted(names, context), len(names) - 1)
            known = names[at] == context
            spot = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
            p = np.where(known, np.where(gram[spot] == own, share[spot], 0.0) + back[at] * p, p)
        return p


class Models:
    """All languages' models with the calibration; what workers get."""

    def __init__(self, names: list[str], models: list[KneserNey]):
        self.names, self.models = names, models
        self.temperature, self.limits = 1.0, [float("inf")] * len(names)

    def entropies(self, texts: pa.Array, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: nats per symbol in each language, the number of symbols, whether it has a letter."""
        symbols, first = letters(texts)
        rows = len(first) - 1
        total, has = np.zeros((rows, len(self.names))), np.zeros(rows, dtype=bool)
        for a in range(0, len(symbols), BLOCK):
            at = np.arange(a, min(a + BLOCK, len(symbols)))
            row = np.searchsorted(first, at, side="right") - 1
            scores, inverse = self._scores(symbols, first, at, cache)
            for k in range(len(self.names)):
                total[:, k] += np.bincount(row, weights=scores[inverse, k], minlength=rows)
            has |= np.bincount(row, weights=symbols[at] != 0, minlength=rows) > 0
        n = np.diff(first)
        return total / np.maximum(n, 1)[:, None], n, has

    def _scores(self, symbols: np.ndarray, first: np.ndarray, at: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Nats of the distinct sequences that end at some positions in each language, and which of them ends at each position."""
        unique, index, inverse = np.unique(grams(symbols, first, ORDER, at), return_index=True, return_inverse=True)
        known, values = cache.get("known", np.zeros(0, np.uint64)), cache.get("values", np.zeros((0, len(self.names)), np.float32))
        spot = np.minimum(np.searchsorted(known, unique), max(0, len(known) - 1))
        new = known[spot] != unique if len(known) else np.ones(len(unique), dtype=bool)
        scores = np.empty((len(unique), len(self.names)), dtype=np.float32)
        scores[~new] = values[spot[~new]]
        place = at[index[new]]
        # the context of an n-gram is the (n-1)-gram that ends one symbol before; at a text's start it is spaces only
        start = np.isin(place, first[:-1])
        before = np.maximum(place - 1, 0)
        own = [grams(symbols, first, n, place) for n in range(1, ORDER + 1)]
        contexts = [np.zeros(len(place), np.uint64)] + [np.where(start, _spaces(n), grams(symbols, first, n, before)) for n in range(1, ORDER)]
        for k, model in enumerate(self.models):
            scores[new, k] = -np.log(model.probability(own, contexts))
        if len(known) + len(place) > CACHED:
            cache.clear()
            known, values = known[:0], values[:0]
        if len(place):
            merged = np.concatenate([known, unique[new]])
            order = np.argsort(merged)
            cache["known"], cache["values"] = merged[order], np.concatenate([values, scores[new]])[order]
        return scores, inverse

    def choose(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language and its posterior; evidence grows with the square root of the length."""
        best = np.argmin(h, axis=1)
        evidence = (h.min(axis=1, keepdims=True) - h) * np.sqrt(n)[:, None] / self.temperature
        return best, 1.0 / np.exp(np.maximum(evidence, -700)).sum(axis=1)

    def calibrate(self, h: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """The temperature that makes the right language most likely, and each language's limit of cross-entropy."""
        evidence = -(h - h.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None]

        def loss(t: float) -> float:
            z = evidence / t
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))

        self.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        for k in range(len(self.names)):
            own = h[truth == k, k]
            if len(own) >= 20:
                self.limits[k] = float(np.quantile(own, REJECT))


@lru_cache(maxsize=16)
def _spaces(order: int) -> np.uint64:
    return grams(np.zeros(1, np.uint32), np.array([0, 1]), order)[0]


COUNTS = "lang string, n int, gram long, context long, shorter long, times long"


def counted(texts: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each order (and block of a very long text): its number, the distinct sequences, each without its last and without its first symbol, and
    how often it comes."""
    symbols, first = letters(texts)
    out = []
    starts = first[:-1][np.diff(first) > 0]
    for a in range(0, len(symbols), BLOCK):
        b, since = min(a + BLOCK, len(symbols)), max(a - 1, 0)
        by_order = [grams(symbols, first, n, np.arange(since, b)) for n in range(1, ORDER + 1)]
        at_start = np.zeros(b - a, dtype=bool)
        at_start[starts[(starts >= a) & (starts < b)] - a] = True
        for n in range(1, ORDER + 1):
            unique, at, times = np.unique(by_order[n - 1][a - since :], return_index=True, return_counts=True)
            none = np.zeros(len(at), np.uint64)
            context = np.where(at_start[at], _spaces(n - 1), by_order[n - 2][np.maximum(at + a - since - 1, 0)]) if n > 1 else none
            out.append((n, unique, context, by_order[n - 2][at + a - since] if n > 1 else none, times))
    return out


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    langs = column(batch, "lang")
    parts = []
    for lang in langs.unique().to_pylist():
        own = column(batch, "text").filter(pc.equal(langs, lang))
        for n, gram, context, shorter, times in counted(own):
            size = len(gram)
            parts.append(pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(np.full(size, n, np.int32)), *(pa.array(x.view(np.int64)) for x in (gram, context, shorter)), pa.array(times)], names=["lang", "n", "gram", "context", "shorter", "times"]))
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Models:
    """Learns from about `sample` documents of each language.  Workers count; the driver gets the sums, which the sample bounds."""
    rows = labelled.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND lang != '' AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    unit = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    share, few = F.lit(0), [name for name, n in counts.items() if n < 60]
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, min(1_000_000, 1 + 1_000_000 * sample // n)).otherwise(share)
    held = (F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(6)) == 0) & ~F.col("lang").isin(few or [""])
    chosen = rows.where(unit < share).withColumn("held", held).select("lang", "text", "held")
    sums = chosen.where(~F.col("held")).select("lang", "text").mapInArrow(over_pieces(_count, "text", PIECE), COUNTS).groupBy("lang", "n", "gram", "context", "shorter").agg(F.sum("times").alias("times")).toArrow()
    names, models = [], []
    for name in sorted(counts):
        own = sums.filter(pc.equal(sums.column("lang"), name))
        by_order = []
        for n in range(1, ORDER + 1):
            part = own.filter(pc.equal(own.column("n"), n)).sort_by("gram")
            by_order.append((*(part.column(c).to_numpy().view(np.uint64) for c in ("gram", "context", "shorter")), part.column("times").to_numpy().astype(np.float64)))
        if len(by_order[0][0]):
            models.append(KneserNey(by_order, len(by_order[0][0])))
            names.append(name)
    out = Models(names, models)
    place = {name: k for k, name in enumerate(names)}
    tests = chosen.where(F.col("held")).select("lang", "text")
    broadcast = labelled.sparkSession.sparkContext.broadcast(out)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, n, has = broadcast.value.entropies(column(batch, "text"), {})
        return pa.RecordBatch.from_arrays([column(batch, "lang"), pa.array(n, pa.int64()), pa.array(has, pa.bool_()), lists(pa.array(h.ravel()), np.full(len(n), h.shape[1]))], names=["lang", "n", "has", "h"])

    if names:
        got = tests.mapInArrow(over_pieces(measure, "text", PIECE), "lang string, n long, has boolean, h array<double>").where("has").orderBy("lang", "n", "h").toArrow()
        if got.num_rows:
            out.calibrate(np.array(got.column("h").to_pylist()), got.column("n").to_numpy(), np.array([place[x] for x in got.column("lang").to_pylist()]))
    return out


_CACHE: dict = {}


@shielded("text")
def predict(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """All columns but the text, lang_pred string, score double, cross_entropy double (nats per symbol), rejected boolean."""
    keep = [c for c in docs.columns if c != text]
    source = docs.select(*keep, text_of(docs, text).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(models)
    schema = fields(docs.select(*keep).schema, "lang_pred string, score double, cross_entropy double, rejected boolean")
    token = str(id(models)) + str(held._path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        if _CACHE.get("token") != token:
            _CACHE.clear()
            _CACHE.update(token=token, grams={})
        if m.names:
            h, n, has = m.entropies(column(batch, "__text"), _CACHE["grams"])
            best, score = m.choose(h, n)
            lowest = h.min(axis=1)
            limits = np.array(m.limits)[best]
        else:
            has, best, score, lowest, limits = (np.zeros(batch.num_rows, dtype=int) for _ in range(5))
        said = [m.names[b] if y else UNKNOWN for b, y in zip(best, has, strict=True)]
        return pa.RecordBatch.from_arrays(
            [column(batch, c) for c in keep] + [pa.array(said, pa.string()), pa.array(np.where(has, score, 0.0), pa.float64()), pa.array(np.where(has, lowest, 0.0), pa.float64()), pa.array((lowest > limits) | (np.asarray(has) == 0), pa.bool_())],
            names=[*keep, "lang_pred", "score", "cross_entropy", "rejected"],
        )

    return source.mapInArrow(over_pieces(run, "__text", PIECE), schema)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), models).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
