"""Near-duplicate documents: ProbMinHash signatures, banding, verification, components.

A document's shingles are its runs of `WIDTH` words (lowered; all its words where it has fewer), weighted by 1 + ln of
how often they come.  ProbMinHash draws a Poisson process for each shingle, of the shingle's weight as rate; each arrival goes to a
random register, which keeps the earliest, and a shingle stops when its next arrival is later than all its document's registers.
So registers agree with the probability Jaccard similarity.  `BANDS` bands of `ROWS` registers give candidates; links are
pairs of different texts whose shingle sets have a Jaccard similarity of `SIMILAR` at least.  Classes are the connected components.
Where one text repeats what both share, the probability similarity is below that of the sets, so texts that repeat a shingle have
the bands of their unweighted shingles as well, whose registers agree with the set similarity: however often shingles repeat,
a pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS at least.

Scale and skew: equal word sequences are one node, by a map-side combined group.  In a bucket of any size only the leader (the
node with most company over all bands) is compared with the others: links grow with the members, not their square, and the join with
the leaders is salted (`common.salted`).  Where a bucket's
members are still in different components after that, untested pairs between components are verified too: all in a bucket of
`SMALL_BUCKET` nodes at most, and in larger ones those that an exact prefix filter on the shingle sets leaves.  So no link that banding finds
is lost and no bucket is capped.  Shingle sets are read only for nodes that
have a candidate; a bitmap of fixed size tells the workers which.

Defined results: null texts and texts without words are alone.  Repeated rows are copies.  Of a class the document with the smallest
doc_id stays (null last, ties by text hash), and of rows that repeat its key and words one.  An empty table gives an empty result.  Columns with any
names are handed on.  Very long texts are sketched `BLOCK` shingles at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import bitmap, column, dropped, fields, lists, over_pieces, salted, shielded, stored, table, text_of
from corpusframe.llm.components import components
from corpusframe.llm.textbytes import ALNUM, mix, row_hashes, window_hashes, words

WIDTH = 5
SIMILAR = (4, 5)  # intersection : union
BANDS, ROWS = 20, 5
SMALL_BUCKET = 32
BITMAP_BITS = 1 << 23
_HASH_BITS = 52
BLOCK = 1 << 18


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all rows: row, hash (52 bits), count; and each row's text hash and number of words."""
    w = words(texts, ALNUM, lower=True)
    h = w.hashes()
    at, hashes = window_hashes(h, w.first, width)
    row = np.searchsorted(w.first, at, side="right") - 1
    counts, name = w.counts(), row_hashes(h, w.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    row, hashes = np.concatenate([row, short]), np.concatenate([hashes, name[short]])
    key = (row.astype(np.uint64) << np.uint64(_HASH_BITS)) | (hashes >> np.uint64(64 - _HASH_BITS))
    key, times = np.unique(key, return_counts=True)
    return (key >> np.uint64(_HASH_BITS)).astype(np.int64), key & np.uint64((1 << _HASH_BITS) - 1), times, name.view(np.int64), counts


def prob_min_hash(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """For each row and register the shingle whose arrival came first (0 where a row has no shingle)."""
    earliest = np.full(rows * registers, np.inf)
    first = np.zeros(rows * registers, dtype=np.uint64)
    latest = np.full(rows, np.inf)
    for a in range(0, len(row), BLOCK):
        _arrivals(row[a : a + BLOCK], shingle[a : a + BLOCK], weight[a : a + BLOCK], registers, earliest, first, latest)
    return first.reshape(rows, registers)


def _arrivals(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int, earliest: np.ndarray, first: np.ndarray, latest: np.ndarray) -> None:
    """Lets some shingles' processes run until each is later than all registers of its row."""
    elapsed = np.zeros(len(row))
    turn = 0
    while len(row):
        turn += 1
        draw = mix(shingle * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        elapsed = elapsed - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        go = elapsed < latest[row]
        if not go.all():
            row, shingle, weight, elapsed, draw = row[go], shingle[go], weight[go], elapsed[go], draw[go]
        cell = row * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        better = elapsed < earliest[cell]
        cell_b, elapsed_b = cell[better], elapsed[better]
        np.minimum.at(earliest, cell_b, elapsed_b)
        won = earliest[cell_b] == elapsed_b
        first[cell_b[won]] = shingle[better][won]
        touched = np.unique(row)
        latest[touched] = earliest.reshape(-1, registers)[touched].max(axis=1)


def _bands(registers: np.ndarray) -> np.ndarray:
    bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), BANDS)).copy()
    for k in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + registers[:, k::ROWS][:, :BANDS])
    return bands.view(np.int64)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's band hashes (those of unweighted shingles, then those of weighted ones), which of them are its own and no repetition, text hash, number of words and of distinct shingles."""
    row, shingle, times, name, counts = shingles(texts)
    n = len(counts)
    plain = _bands(prob_min_hash(row, shingle, np.ones(len(row)), n, BANDS * ROWS))
    uneven = np.zeros(n, dtype=bool)
    uneven[row[times > 1]] = True
    weighted = plain.copy()
    if uneven.any():
        at, place = uneven[row], np.cumsum(uneven) - 1
        weighted[uneven] = _bands(prob_min_hash(place[row[at]], shingle[at], 1.0 + np.log(times[at]), int(uneven.sum()), BANDS * ROWS))
    own = np.concatenate([np.repeat((counts > 0)[:, None], BANDS, axis=1), weighted != plain], axis=1)
    return np.concatenate([plain, weighted], axis=1), own, name, counts, np.bincount(row, minlength=n)


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node long, n_words long, n_shingles long (distinct ones), bands array<long>); no bands where there is no word."""
    source = docs.select(key, text_of(docs, text).alias("__text"))
    schema = fields(docs.select(key).schema, "node long, n_words long, n_shingles long, bands array<long>")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bands, own, name, counts, sizes = signatures(column(batch, "__text"))
        return pa.RecordBatch.from_arrays([column(batch, key), pa.array(name), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), lists(pa.array(bands[own]), own.sum(axis=1))], names=[key, "node", "n_words", "n_shingles", "bands"])

    return source.mapInArrow(over_pieces(run, "__text"), schema)


def shingle_sets(docs: DataFrame, wanted: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, own array<int>, size int): the distinct shingles of rows whose bit (of key and node) is set."""
    source = docs.select(key, F.xxhash64(key).alias("__key"), text_of(docs, text).alias("__text"))
    schema = fields(docs.select(key).schema, "node long, own array<int>, size int")
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = words(column(batch, "__text"), ALNUM, lower=True)
        node = row_hashes(w.hashes(), w.first).view(np.int64)
        hit = np.flatnonzero(bits.value[(node ^ column(batch, "__key").to_numpy()) & (BITMAP_BITS - 1)])
        if not len(hit):
            return None
        part = batch.take(pa.array(hit))
        row, shingle, _, node, counts = shingles(column(part, "__text"))
        sizes = np.bincount(row, minlength=len(counts))
        return pa.RecordBatch.from_arrays([column(part, key), pa.array(node), lists(pa.array((shingle >> np.uint64(_HASH_BITS - 32)).astype(np.uint32).view(np.int32)), sizes), pa.array(sizes.astype(np.int32))], names=[key, "node", "own", "size"])

    return source.mapInArrow(over_pieces(run, "__text"), schema)


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("own").alias("own_u"))
    right = sets.select(F.col("node").alias("v"), F.col("own").alias("own_v"))
    both = pairs.join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("own_u", "own_v"))
    union = F.size("own_u") + F.size("own_v") - common
    return both.where(common * SIMILAR[1] >= union * SIMILAR[0]).select("u", "v")


def _by_prefix(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that may be similar, without comparing all: with shingles ordered by how rare they are
    among the members, similar sets share one among the first few of each, and enough can follow it in both."""
    t, u = SIMILAR
    owned = members.join(sets, "node").select("node", "component", F.explode("own").alias("shingle"))
    rare = owned.groupBy("shingle").agg(F.count("*").alias("df"))
    ordered = owned.join(rare, "shingle").groupBy("node", "component").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    n = F.size("own")
    head = ordered.select("node", "component", n.alias("n"), F.posexplode(F.slice("own", F.lit(1), n - F.ceil(n * t / u).cast("int") + 1)).alias("at", "s")).select("node", "component", "n", "at", F.col("s.shingle").alias("shingle"))
    head = stored(head, "neardup-heads")
    mixed = head.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("shingle")
    head = stored(head.join(mixed, "shingle", "left_semi"), "neardup-heads")
    x, y = head.alias("x"), head.alias("y")
    other = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.node") < F.col("y.node"))
    sizes = F.col("x.n") + F.col("y.n")
    enough = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) * (t + u) >= sizes * t
    return x.join(y, other & enough).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, node (text hash), class_id (the key of the document that stays), stays, n_copies of key and text."""
    rows = stored(prints(docs, key, text), "neardup-prints")
    some = rows.where("n_words > 0")
    nodes = stored(some.groupBy("node").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))).alias("least"), F.max("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")), "neardup-nodes")
    member = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    buckets = stored(member.groupBy("band").agg(F.count("*").alias("company")).where("company > 1"), "neardup-buckets")
    n_shared = buckets.agg(F.sum("company")).first()[0] or 0
    shared = stored(salted(member, buckets, ["band"], "company", ["node"], n_shared), "neardup-shared")
    weight = shared.groupBy("node").agg(F.sum("company").alias("weight"))
    weighted = shared.join(weight, "node")
    leaders = stored(weighted.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("l"), F.max("company").alias("company")).select("band", "company", F.col("l.node").alias("leader")), "neardup-leaders")
    first = stored(_ordered(salted(shared.select("band", "node"), leaders, ["band"], "company", ["node"], n_shared), "node", "leader"), "neardup-pairs")

    active = shared.select("node").distinct().join(nodes.select("node", F.col("least.key").alias("rep")), "node").select("node", F.col("node").bitwiseXOR(F.xxhash64("rep")).alias("bit"), "rep")
    active = stored(active, "neardup-active")
    sets = shingle_sets(docs, bitmap(active, "bit", BITMAP_BITS), key, text).withColumnRenamed(key, "rep")
    same = (sets["node"] == active["node"]) & sets["rep"].eqNullSafe(active["rep"])
    sets = stored(sets.join(active, same, "left_semi").dropDuplicates(["node"]).select("node", "own"), "neardup-sets")

    links = stored(_verified(first, sets), "neardup-links")
    found = components(links)
    # what the leaders did not settle: untested pairs of a bucket between different components
    placed = shared.join(found, "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a != b").select("band", "n")
    open_ = stored(placed.join(split, "band"), "neardup-open")
    few = open_.where(F.col("n") <= SMALL_BUCKET)
    x, y = few.alias("x"), few.alias("y")
    near = (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    fit = F.least("x.n_shingles", "y.n_shingles") * SIMILAR[1] >= F.greatest("x.n_shingles", "y.n_shingles") * SIMILAR[0]  # no similar pair fails this
    small = x.join(y, near & fit).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    large = stored(open_.where(F.col("n") > SMALL_BUCKET).select("node", "component").distinct(), "neardup-large")
    rest = small if large.isEmpty() else small.union(_by_prefix(large, sets))
    more = stored(_verified(rest.distinct().join(first, ["u", "v"], "left_anti"), sets), "neardup-links")
    if not more.isEmpty():
        found = components(found.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    of_node = nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    keeper = of_node.groupBy("component").agg(F.min(F.struct("least", "node")).alias("keeper"))
    moved = of_node.join(keeper, "component").select("node", F.col("keeper.least.key").alias("class_id"), F.col("keeper.node").alias("class_node"))
    per_row = rows.groupBy(key, "node", "n_words").agg(F.count("*").alias("n_copies"))
    dropped(buckets, shared, leaders, first, active, sets, links, open_, large)
    out = per_row.join(moved, "node", "left")
    alone = F.col("n_words") == 0
    return out.select(
        key, "node", F.when(alone, F.col(key)).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col(key).eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node")))).alias("stays"), "n_copies", "n_words"
    )


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    copies = found.select("doc_id", "class_id", "stays", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy"))
    return copies.select("doc_id", "class_id", (F.col("stays") & ((F.col("copy") == 1) | (F.col("n_words") == 0))).alias("stays"))


def with_node(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with `__node`, the hash of their words."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(column(batch, text), ALNUM, lower=True)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(row_hashes(w.hashes(), w.first).view(np.int64))], names=[*names, "__node"])

    return docs.mapInArrow(over_pieces(run, text), fields(docs.schema, "`__node` long"))


@shielded("key", "text")
def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns; documents without words stay, copies of a row of theirs too."""
    fate = stored(classes(docs, key, text).where("n_words > 0").where(~F.col("stays") | (F.col("n_copies") > 1)).select(F.col(key).alias("__key"), F.col("node").alias("__of"), F.col("stays").alias("__stays")), "neardup-fate")
    rows = with_node(docs, text)
    same = rows[key].eqNullSafe(fate["__key"]) & (rows["__node"] == fate["__of"])
    fated = fate.hint("merge")  # one row for each document that goes: it grows with the input, so it is never broadcast
    if fate.where("__stays").isEmpty():
        return rows.join(fated, same, "left_anti").select(*docs.columns)
    left = rows.join(fated, same, "left").where(F.coalesce("__stays", F.lit(True)))
    twice = F.col("__stays").isNotNull()
    return left.where(~twice).select(*docs.columns).union(left.where(twice).dropDuplicates([key, "__node"]).select(*docs.columns))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)
