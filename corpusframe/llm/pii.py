"""Finding personal data, and information-theoretic sanitisation of the words that give it away.

Base spans: e-mail addresses, IP addresses, card numbers and phone numbers by fixed patterns.  Each distinct value is a protected entity, and so is what
values share: the domain of addresses, the network (first three parts) of IP addresses.  Over whole documents, with n(t), n(e) and n(t, e) of N documents, a
document that has the word t has the entity e with probability P(e | t) = n(t, e) / n(t); after the word -log2 P of the log2(N / n(e)) bits that it takes
to name e are left.  What counts is not P but its lower confidence bound (Wilson's, z = `CONFIDENT`), which asks for evidence: one that stands beside an
entity once, by chance, has a bound of 0.27, whatever N is, and it takes three documents, all with e, to pass 0.5.  A word outside base spans discloses e if
that bound is `GENERALISE` or more, so that less than a bit is left, and also as much as (n(e) / N) ** 0.5, so that at least half of the bits came from the
word and not from e being everywhere.  Then it becomes a placeholder in every document that has it, also where e is not; from `REMOVE` on it goes.

Scale: N, n(t), n(e) and n(t, e) count all rows.  The bound is at most n(t, e) / n(t) and n(t, e) at most n(e), so words in more than n(e) / GENERALISE
documents, and words in one or two, fall out before words and entities meet.  Entities that stand in the same documents have the same counts for every word and
are one class, so a document of a thousand addresses gives no thousand pairs a word.  Counts are map-side combined; joins with hot keys are salted
(`common.salted`); bitmaps of fixed size (`BITMAP_BITS`) only spare rows, an exact join follows each.  The texts are read three times.

Defined results: null and empty texts have no spans.  Repeated rows have the same spans each and count as documents each.  Rows are told apart by
their key (null is a value of its own) and a hash of the text.  An empty table gives an empty result.  Columns with any names are handed on
(`common.shielded`).  Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.llm.common import bitmap, column, dropped, fields, lists, over_pieces, salted, shielded, stored, table, text_of
from corpusframe.llm.textbytes import ALNUM, Words, mix, raw, words

KINDS = ("email", "ip", "card", "phone", "term")
GENERALISE, REMOVE = 0.5, 0.8
CONFIDENT = 1.645
BITMAP_BITS = 1 << 23
#: About how many pairs of a word and an entity class a worker holds at once.
MEETINGS = 1 << 18
PLACEHOLDERS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str):
    """Leftmost matches: all local characters before an @, back to the last match, and a dotted domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def addresses(text: str):
    """Four dotted numbers, leftmost first, taken from runs of digits and dots."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        at, groups = run.start(), []
        for part in [*run[0].split("."), ""]:
            groups = [*groups, (at, at + len(part))] if part else []
            at += len(part) + 1
            if len(groups) == 4:
                if all(len(n := text[a:b].lstrip("0")) <= 3 and int(n or 0) <= 255 for a, b in groups):
                    yield groups[0][0], groups[3][1]
                groups = []


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.start(), m.end()


def phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.start(), m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind."""
    return sorted((a, kind, b) for kind, find in enumerate((emails, addresses, cards, phones)) for a, b in find(text))


def entity(kind: int, value: str) -> int:
    """A 64-bit name of a protected entity; case and separators don't matter."""
    value = value.lower() if kind < 2 else "".join(filter(str.isdigit, value))
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def shared(kind: int, value: str) -> list[int]:
    """The names of what a value shares with others."""
    if kind == 0:
        return [entity(kind, value[value.index("@") :])]
    return [entity(kind, value.rpartition(".")[0])] if kind == 1 else []


def _free(w: Words, texts: pa.Array, spans: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words don't overlap a base span, and each word's first and end code point in its text."""
    data, off = raw(texts)
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]
    base = np.repeat(point[off[:-1]], w.counts())
    start, end = point[w.start] - base, point[w.end] - base
    free = np.ones(len(start), dtype=bool)
    for k, own in enumerate(spans):
        a, b = w.first[k], w.first[k + 1]
        for s, _, e in own:
            free[a + np.searchsorted(end[a:b], s, side="right") : a + np.searchsorted(start[a:b], e, side="left")] = False
    return free, start, end


def _names(w: Words) -> np.ndarray:
    return w.hashes().view(np.int64)


def _in_rows(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each pair of a row and a word comes first, by row."""
    with np.errstate(over="ignore"):
        both = mix(h.view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.unique(both, return_index=True)[1])


def find_base(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash long, spans array<struct<start,kind,end>>, entities array<long>, terms array<long>): the distinct entities of each
    text, and of a text that has some the distinct words outside its spans."""
    source = docs.select(F.col(key).alias("key"), text_of(docs, text).alias("__text")).withColumn("text_hash", F.xxhash64("__text"))
    schema = fields(source.select("key", "text_hash").schema, "spans array<struct<start:int,kind:int,end:int>>, entities array<long>, terms array<long>")
    kind_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = column(batch, "__text").to_pylist()
        spans = [base_spans(t) for t in texts]
        some = [k for k, s in enumerate(spans) if s]
        entities = [sorted({e for a, kind, b in own for e in (entity(kind, t[a:b]), *shared(kind, t[a:b]))}) for t, own in zip(texts, spans, strict=True)]
        part = column(batch, "__text").take(pa.array(some, pa.int64()))
        w = words(part, ALNUM, lower=True)
        free, _, _ = _free(w, part, [spans[k] for k in some])
        at = np.flatnonzero(free)
        row, h = w.rows()[at], _names(w)[at]
        at = _in_rows(row, h)
        sizes = np.zeros(len(texts), dtype=np.int64)
        sizes[some] = np.bincount(row[at], minlength=len(some))
        as_spans = pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in own] for own in spans], kind_type)
        return pa.RecordBatch.from_arrays(
            [column(batch, "key"), column(batch, "text_hash"), as_spans, pa.array(entities, pa.list_(pa.int64())), lists(pa.array(h[at]), sizes)], names=["key", "text_hash", "spans", "entities", "terms"]
        )

    return source.mapInArrow(over_pieces(run, "__text"), schema)


def word_counts(docs: DataFrame, wanted: np.ndarray, text: str = "text") -> DataFrame:
    """In how many documents each word occurs (term long, n long), of the words whose bit is set in `wanted`."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(column(batch, "__text"), ALNUM, lower=True)
        h = _names(w)
        at = np.flatnonzero(bits.value[h & (BITMAP_BITS - 1)])
        h = h[at]
        term, n = np.unique(h[_in_rows(w.rows()[at], h)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    rows = docs.select(text_of(docs, text).alias("__text"))
    return rows.mapInArrow(over_pieces(run, "__text"), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def entity_classes(some: DataFrame, n_some: int) -> DataFrame:
    """(key, text_hash, classes array<struct<class,n_entity>>): the classes of each row's entities; entities of the same rows are one class."""
    place = some.select("key", "text_hash", F.xxhash64("key", "text_hash").alias("row"), F.explode("entities").alias("entity"))
    low = F.col("row").bitwiseAND(F.lit(0x7FFFFFFF))
    sums = place.groupBy("entity").agg(F.count("*").alias("n_entity"), F.sum(low).alias("s"), F.min("row").alias("a"), F.max("row").alias("b"))
    named = stored(sums.select("entity", "n_entity", F.xxhash64("n_entity", "s", "a", "b").alias("class")), "pii-entities")
    found = salted(place, named, ["entity"], "n_entity", ["row"], n_some)
    return found.groupBy("key", "text_hash").agg(F.collect_set(F.struct("class", "n_entity")).alias("classes"))


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["key"].eqNullSafe(right["key"]) & (left["text_hash"] == right["text_hash"])


def bound(both: Column, n_term: Column) -> Column:
    """Wilson's lower bound of the share both / n_term."""
    p, z2 = both / n_term, CONFIDENT**2
    return (p + z2 / (2 * n_term) - CONFIDENT * F.sqrt(p * (1 - p) / n_term + z2 / (4 * n_term * n_term))) / (1 + z2 / n_term)


def _needed(n_term: Column) -> Column:
    """A word in n_term documents can reach GENERALISE only for entities in so many; a little less, for rounding.  Null if for none."""
    return F.when(bound(n_term, n_term) >= GENERALISE, n_term * F.lit(GENERALISE) * 0.999999)


def needed_levels(rare: DataFrame, top: int) -> np.ndarray:
    """For each remainder of a word's hash the least k such that an entity must be in 4 ** k documents to meet such a word; 255: none can."""
    out, k = np.full(BITMAP_BITS, 255, dtype=np.uint8), 0
    while 4**k <= top:
        k += 1
    for level in range(k - 1, -1, -1):
        out[bitmap(rare.where(F.col("needed") < 4 ** (level + 1)), "term", BITMAP_BITS)] = level
    return out


def _meetings(rows: DataFrame, levels: np.ndarray) -> DataFrame:
    """(class, n_entity, term, both): in how many of the rows (terms, classes) words and entity classes meet, of those that `levels` lets meet; counts
    of parts, to be summed."""
    held = rows.sparkSession.sparkContext.broadcast(levels)
    names = ["class", "n_entity", "term", "both"]

    def run(batches):
        for batch in batches:
            terms, classes = column(batch, "terms"), column(batch, "classes")
            flat, own = terms.flatten().to_numpy(), classes.flatten()
            in_row = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
            level = held.value[flat & (BITMAP_BITS - 1)]
            row = np.repeat(np.arange(batch.num_rows), np.diff(classes.offsets.to_numpy()))
            ident, n_entity = own.field("class").to_numpy(), own.field("n_entity").to_numpy()
            reach = (np.frexp(n_entity.astype(np.float64))[1] - 1) // 2  # the largest k with 4 ** k <= n_entity
            for k in np.unique(reach):
                hit = np.flatnonzero(level <= k)
                first = np.searchsorted(in_row[hit], np.arange(batch.num_rows + 1))
                these = np.flatnonzero(reach == k)
                so_far = np.cumsum(first[row[these] + 1] - first[row[these]])
                cuts = np.unique(np.searchsorted(so_far, np.arange(MEETINGS, so_far[-1], MEETINGS)))
                for part in np.split(these, cuts):  # MEETINGS pairs at a time, and those of one class more at most
                    size = first[row[part] + 1] - first[row[part]]
                    if not size.sum():
                        continue
                    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[row[part]], size)
                    of, term = np.repeat(part, size), flat[hit[at]]
                    pair, n = np.unique(np.rec.fromarrays([ident[of], n_entity[of], term]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(pair[f])) for f in ("f0", "f1", "f2")), pa.array(n)], names=names)

    return rows.select("terms", "classes").mapInArrow(run, "class long, n_entity long, term long, both long")


def disclosing(some: DataFrame, docs: DataFrame, total: int, text: str = "text") -> DataFrame:
    """(term, disclosure): the words that disclose an entity, with the largest bound; a stored table.  `some` is a stored table of the rows with
    entities: terms, classes."""
    top = some.select(F.explode("classes").alias("c")).agg(F.max("c.n_entity")).first()[0] or 1
    held = bitmap(some.select(F.explode("terms").alias("term")), "term", BITMAP_BITS)
    rare = stored(word_counts(docs, held, text).withColumn("needed", _needed(F.col("n"))).where(F.col("needed") <= top), "pii-rare")
    met = _meetings(some, needed_levels(rare, top)).groupBy("class", "n_entity", "term").agg(F.sum("both").alias("both"))
    least = F.greatest(F.lit(GENERALISE), F.sqrt(F.col("n_entity") / total))
    pairs = met.join(rare, "term").withColumn("disclosure", bound(F.col("both"), F.col("n"))).where(F.col("disclosure") >= least)
    out = stored(pairs.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-disclosing")
    dropped(rare)
    return out


def word_places(docs: DataFrame, wanted: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, text_hash, term, start int, end int): the places, outside base spans, of the words whose bit is set."""
    source = docs.select(F.col(key).alias("key"), text_of(docs, text).alias("__text")).withColumn("text_hash", F.xxhash64("__text"))
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = words(column(batch, "__text"), ALNUM, lower=True)
        h = _names(w)
        hit = np.flatnonzero(bits.value[h & (BITMAP_BITS - 1)])
        if not len(hit):
            return None
        row = np.searchsorted(w.first, hit, side="right") - 1
        texts = column(batch, "__text")
        some = np.unique(row)
        spans: list = [[] for _ in range(batch.num_rows)]
        for k in some:
            spans[k] = base_spans(texts[int(k)].as_py())
        free, start, end = _free(w, texts, spans)
        keep = free[hit]
        hit, row = hit[keep], row[keep]
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([column(batch, "key").take(at), column(batch, "text_hash").take(at), pa.array(h[hit]), pa.array(start[hit].astype(np.int32)), pa.array(end[hit].astype(np.int32))], names=["key", "text_hash", "term", "start", "end"])

    return source.mapInArrow(over_pieces(run, "__text"), fields(source.select("key", "text_hash").schema, "term long, start int, end int"))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored base spans of each row (see find_base), and stored term spans (key, text_hash, extra array<struct<start,kind,end,disclosure>>) of the
    rows that have them."""
    found = stored(find_base(docs, key, text), "pii-base")
    total = max(2, found.count())
    plain = found.where(F.size("entities") > 0).select("key", "text_hash", "entities", "terms")
    n_some = plain.agg(F.sum(F.size("entities"))).first()[0] or 0
    grouped = entity_classes(plain, n_some).withColumnsRenamed({"key": "of_key", "text_hash": "of_hash"})
    some = stored(plain.join(grouped, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("text_hash") == F.col("of_hash"))).select("key", "text_hash", "terms", "classes"), "pii-classes")
    words_ = disclosing(some, docs, total, text)
    places = stored(word_places(docs, bitmap(words_, "term", BITMAP_BITS), key, text), "pii-places")
    spans = places.join(words_, "term").select("key", "text_hash", F.struct("start", F.lit(4).alias("kind"), "end", "disclosure").alias("x"))
    out = stored(spans.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set("x")).alias("extra")), "pii-terms")
    dropped(some, words_, places)
    return found, out


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, extra = find_pii(table(spark, sf_dir, "documents"))
    terms = F.transform(F.coalesce("extra", F.array()), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    rows = found.join(extra, _same_row(found, extra), "left").select(found["key"].alias("doc_id"), "spans", terms.alias("terms"))
    name = F.array(*map(F.lit, KINDS))

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")

    def of_kind(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(digest(F.col("spans")), 256).alias("base_sha256"), digest(F.sort_array(F.concat("spans", "terms"))).alias("spans"))


def sanitised(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """Spans (start, kind, end, disclosure) become placeholders; words that disclose most are removed.  Where spans overlap, one placeholder stands for all: that of the first."""
    out, at = [], 0
    for start, kind, end, disclosure in sorted(spans):
        if start >= at:
            out += [text[at:start], "" if kind == 4 and disclosure >= REMOVE else PLACEHOLDERS[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


@shielded("key", "text")
def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with personal data, and the words that give it away, replaced in `text`; all other columns, and their order, stay.
    Null texts stay null."""
    _, extra = find_pii(docs, key, text)
    rows = docs.withColumn("__hash", F.xxhash64(text_of(docs, text)))
    same = rows[key].eqNullSafe(extra["key"]) & (rows["__hash"] == extra["text_hash"])
    joined = rows.join(extra, same, "left").select(*[rows[c] for c in docs.columns], extra["extra"].alias("__extra"))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, more in zip(column(batch, text).to_pylist(), column(batch, "__extra").to_pylist(), strict=True):
            spans = [(*s, 0.0) for s in base_spans(t)] if t else []
            spans += [(x["start"], x["kind"], x["end"], x["disclosure"]) for x in more or ()]
            out.append(sanitised(t, spans) if spans else t)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else column(batch, c) for c in names], names=names)

    return joined.mapInArrow(over_pieces(run, text), docs.schema)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
