"""Quality classification by co-training of two views.

The content view sees a text's bytes: how often pairs of neighbouring bytes come (hashed), how words repeat, and layout counts.  The metadata
view sees nothing of the text, only what the page's record says of it: source, language and length.  Two logistic regressions, one a view,
start from the labelled rows; each round, each scores all unlabelled documents and gives the most confident share of them, as pseudo-labels, to the
other, but none that its calibration on unseen labelled rows finds less likely than `CONFIDENT`: a view that can't tell gives nothing.  The share grows
from round to round.  Each view is then calibrated on labelled rows that neither has seen, and how the calibrated log odds are combined to score all documents is
fitted on others again.

Scale: of the labelled rows the classifiers see about `LABELLED`, whole texts, chosen by a hash of the key; their features (some KB a
row) are what the driver gets.  The unlabelled documents are all those without a label; their features are stored once, and workers score them
each round.  The confident share follows from counts of binned log odds, and a pseudo-labelled row counts in Newton's method by sums
that workers form, each over its splits of the stored rows, and a few workers over those: the driver gets `SUMS` matrices a step, whatever the input's size.  Scoring reads every text once, without
a shuffle, and every document is scored.

Defined results: null texts count as empty; null source, language or length are values of their own, and so is a column that isn't there.  An empty
table gives an empty result.  Columns with any names are handed on, but for `quality_score` as a result; the stage hands all on.  Very long texts are
counted in steps of `textbytes.STEP` bytes.  Repeated rows have equal scores.  A document with several
labels has their majority, good on a tie.  Rows whose log odds are in the bin where a share ends are all taken (copies share one
fate).  A row that is pseudo-labelled again has its latest label.  Without both kinds of labels every score is the share of good labels (1 if none).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import column, dropped, fields, give_back, lists, over_pieces, shielded, stored, table, text_of
from corpusframe.llm.textbytes import SPACED, STEP, mix, words

LABELLED = 4_000
PAIR_DIMS = 512
LAGS = 8
SOURCE_DIMS, LANG_DIMS = 64, 16
ROUNDS = 5
GIVEN = 0.02  # of the unlabelled rows: by so much more of them a view labels in each round than in the one before
CONFIDENT = 0.95  # and only rows that the view, calibrated on labelled rows that it has not seen, finds as likely good or bad
THRESHOLD = 0.5
SUMS = 8
SPLITS = 8  # of the pseudo-labelled rows that one task sums up, while there are more than SUMS
STEPS = 25
NEAR = 1e-6
BINS = 2_000  # for a factor e of large log odds
LAYOUT_DIMS = 7
CONTENT_DIMS = PAIR_DIMS + LAGS + LAYOUT_DIMS
LENGTHS = 24  # classes of length, each up to twice that of the one before
METADATA = ("source", "lang", "n_chars")


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums over rows, from where each row begins."""
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[off[1:]] - total[off[:-1]]


def _named(values: pa.Array, dims: int) -> np.ndarray:
    """One of `dims` columns is 1, by a hash of the value."""
    data = values.to_pylist()
    known = {v: hash_of(v) % dims for v in set(data)}
    out = np.zeros((len(data), dims), dtype=np.float32)
    out[np.arange(len(data)), [known[v] for v in data]] = 1
    return out


def hash_of(value: object) -> int:
    h = np.uint64(len(str(value)) + (value is None))
    for b in str(value).encode("utf-8", "surrogatepass"):
        h = mix(np.array([h + np.uint64(b)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
    return int(h)


def views(batch: pa.RecordBatch, text: str = "__text") -> tuple[np.ndarray, np.ndarray]:
    """The content and the metadata features of each row."""
    w = words(column(batch, text), SPACED)
    data, off = w.data, w.row_byte
    n = batch.num_rows
    size = np.maximum(np.diff(off), 1)
    pairs, codes = np.zeros(n * PAIR_DIMS, dtype=np.int64), np.zeros(n * 256, dtype=np.int64)
    for a in range(0, len(data), STEP):
        b = min(a + STEP, len(data))
        row = np.repeat(np.arange(n), np.clip(off[1:], a, b) - np.clip(off[:-1], a, b))
        code = np.r_[data[a - 1] if a else 0, data[a:b]].astype(np.uint32)
        pair = (code[:-1] * np.uint32(2_654_435_761) ^ code[1:] * np.uint32(40_503 * 65_537)) >> np.uint32(16) & np.uint32(PAIR_DIMS - 1)
        pair[np.clip(off[:-1][(off[:-1] >= a) & (off[:-1] < b)] - a, 0, None)] = 0  # a row's first byte has none before it
        pairs += np.bincount(row * PAIR_DIMS + pair, minlength=n * PAIR_DIMS)
        codes += np.bincount(row * 256 + code[1:].astype(np.int64), minlength=n * 256)
    counts = w.counts()
    some = np.maximum(counts, 1)
    h, of = w.hashes(), w.rows()
    repeats = np.zeros((n, LAGS))
    for lag in range(1, LAGS + 1):
        if len(h) > lag:
            again = np.r_[np.zeros(lag, bool), (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])]
            repeats[:, lag - 1] = _sums(again, w.first) / some
    codes = codes.reshape(n, 256)

    def share(first: int, last: int) -> np.ndarray:
        return codes[:, first : last + 1].sum(axis=1) / size

    upper, digit, lower = share(65, 90), share(48, 57), share(97, 122)
    mark = share(33, 126) - upper - digit - lower
    lines = codes[:, 10] + 1
    layout = np.stack([np.log1p(lines) / 3, np.log1p(size / lines) / 5, upper * 5, digit * 5, mark * 5, share(124, 124) * 20, np.log1p(_sums(w.end - w.start, w.first) / some)], axis=1)
    content = np.concatenate([np.sqrt(pairs.reshape(n, PAIR_DIMS) / size[:, None]), repeats * 4, layout], axis=1).astype(np.float32)
    return content, metadata(batch)


def metadata(batch: pa.RecordBatch) -> np.ndarray:
    """The metadata features of each row: source and language by name, the length's logarithm and class."""
    n = batch.num_rows
    there = [column(batch, c) if c in batch.schema.names else pa.nulls(n) for c in METADATA]
    length = np.array([-1.0 if v is None else max(0.0, float(v)) for v in there[2].to_pylist()])
    classes = np.zeros((n, LENGTHS), dtype=np.float32)
    classes[np.arange(n), np.where(length < 0, 0, np.clip(np.log2(np.maximum(length, 0) + 1).astype(int) + 1, 1, LENGTHS - 1))] = 1
    named = [_named(v, d) for v, d in zip(there, (SOURCE_DIMS, LANG_DIMS), strict=False)]
    return np.concatenate([np.log1p(np.maximum(length, 0))[:, None] / 5, classes, *named], axis=1).astype(np.float32)


def odds_of(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ w[:-1] + w[-1]


def binned(odds: np.ndarray) -> np.ndarray:
    return np.floor(np.arcsinh(np.clip(odds, -1e6, 1e6)) * BINS).astype(np.int64)


def newton_sums(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The rows' part of the loss, its gradient and second derivatives at w."""
    x = np.c_[x.astype(np.float64), np.ones(len(x))]
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    return loss, x.T @ (weight * (p - y)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x


class Logistic:
    """Logistic regression with a ridge penalty, by Newton's method: a step that does not lower the loss is halved.

    `asked` is where the next sums are wanted; `told` takes them."""

    def __init__(self, dims: int, ridge: float = 1.0):
        self.w = self.asked = np.zeros(dims + 1)
        self.penalty = np.full(dims + 1, ridge)
        self.penalty[-1] = 1e-6
        self.again()

    def again(self) -> None:
        """Starts anew from the present weights, for other rows."""
        self.asked, self.loss, self.step, self.done = self.w, np.inf, np.zeros_like(self.w), False

    def told(self, loss: float, slope: np.ndarray, bend: np.ndarray) -> None:
        loss += float((self.penalty * self.asked**2).sum()) / 2
        if loss <= self.loss:
            self.w, self.loss = self.asked, loss
            self.step = np.linalg.solve(bend + np.diag(self.penalty), slope + self.penalty * self.w)
        else:
            self.step = self.step / 2
        self.done = bool(np.abs(self.step).max() < NEAR)
        self.asked = self.w if self.done else self.w - self.step

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> Logistic:
        for _ in range(steps):
            self.told(*newton_sums(self.asked, x, y, weight))
            if self.done:
                break
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return odds_of(self.w, x)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x, dtype=np.float32)], pa.binary())


def _unpacked(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), dtype=np.float32).reshape(len(values), -1)


def _views_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :CONTENT_DIMS], x[:, CONTENT_DIMS:]


class Unlabelled:
    """All unlabelled documents' features, in a stored table, and what co-training asks of them."""

    def __init__(self, rows: DataFrame):
        self.rows = stored(rows, "quality-unlabelled")

    def bins(self, weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view the bins of log odds that occur, in order, and how many rows each has."""

        def run(batches):
            for batch in batches:
                of = [np.unique(binned(odds_of(w, x)), return_counts=True) for w, x in zip(weights, _views_of(_unpacked(column(batch, "x"))), strict=True)]
                view = np.repeat(np.arange(2, dtype=np.int32), [len(b) for b, _ in of])
                yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(np.concatenate([b for b, _ in of])), pa.array(np.concatenate([n for _, n in of]).astype(np.int64))], names=["view", "bin", "n"])
                give_back()

        got = self.rows.mapInArrow(run, "view int, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toArrow()
        view, at, n = (got.column(c).to_numpy() for c in ("view", "bin", "n"))
        order = np.argsort(at)
        return [(at[order][view[order] == v], n[order][view[order] == v]) for v in (0, 1)]

    def given(self, history: list[tuple[list[np.ndarray], list[tuple[int, int]]]]) -> DataFrame:
        """(view, label, x): the rows that each view has got from the other in the rounds so far, with their latest label."""

        def run(batches):
            for batch in batches:
                both = _views_of(_unpacked(column(batch, "x")))
                for v in (0, 1):
                    label = np.full(batch.num_rows, np.nan)
                    for weights, cuts in history:
                        odds = odds_of(weights[1 - v], both[1 - v])
                        at, (low, high) = binned(odds), cuts[1 - v]
                        label[at <= low] = 0
                        label[at >= high] = 1
                    hit = np.flatnonzero(~np.isnan(label))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), v, np.int32)), pa.array(label[hit]), _packed(both[v][hit])], names=["view", "label", "x"])
                give_back()

        return stored(self.rows.mapInArrow(run, "view int, label double, x binary"), "quality-given")


def _given_sums(given: DataFrame, weights: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """newton_sums of each view over the pseudo-labelled rows, which weigh half, by sums on workers."""

    def run(batches):
        total = [(0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))) for w in weights]
        for batch in batches:
            view, label = column(batch, "view").to_numpy(), column(batch, "label").to_numpy()
            for v in (0, 1):
                hit = np.flatnonzero(view == v)
                if len(hit):
                    part = newton_sums(weights[v], _unpacked(column(batch, "x").take(pa.array(hit))), label[hit], np.full(len(hit), 0.5))
                    total[v] = tuple(a + b for a, b in zip(total[v], part, strict=True))
            give_back()
        yield from _batches(total)

    def added(batches):
        yield from _batches(_added((r for batch in batches for r in batch.to_pylist()), weights))

    schema, splits = "view int, loss double, slope binary, bend binary", given.rdd.getNumPartitions()
    parts = given.coalesce(max(SUMS, -(-splits // SPLITS))).mapInArrow(run, schema)
    if splits > SUMS * SPLITS:
        parts = parts.repartition(SUMS).mapInArrow(added, schema)
    return _added(parts.toArrow().to_pylist(), weights)


def _batches(sums: list[tuple[float, np.ndarray, np.ndarray]]):
    for v, part in enumerate(sums):
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), pa.array([part[0]], pa.float64()), *(pa.array([a.tobytes()], pa.binary()) for a in part[1:])], names=["view", "loss", "slope", "bend"])


def _added(rows, weights: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The sums of parts, for each view."""
    out = [(0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))) for w in weights]
    for r in rows:
        loss, slope, bend = out[r["view"]]
        out[r["view"]] = (loss + r["loss"], slope + np.frombuffer(r["slope"]), bend + np.frombuffer(r["bend"]).reshape(bend.shape))
    return out


class CoTrained:
    """Two views' classifiers, their calibration, and the prior."""

    def __init__(self, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, unlabelled: Callable[[], Unlabelled], rounds: int = ROUNDS):
        self.constant = float(np.mean(y)) if len(y) else 1.0
        self.models: list[Logistic] | None = None
        self.n_unlabelled = 0
        if len(y) < 10 or self.constant in (0.0, 1.0):
            return
        test = np.arange(len(y)) % 4 == 3
        fit, joined = np.flatnonzero(test)[::2], np.flatnonzero(test)[1::2]
        if len(set(y[fit])) < 2 or len(set(y[joined])) < 2:
            fit = joined = np.flatnonzero(test)  # too few labels to part them
        seen, ones = y[~test], np.ones(int((~test).sum()))
        self.models = [Logistic(labelled[v].shape[1]).fit(labelled[v][~test], seen, ones) for v in (0, 1)]
        pool, history = unlabelled(), []
        for turn in range(1, rounds + 1):
            weights = [np.round(m.w, 6) for m in self.models]  # sums on workers differ in their last bits by the order of rows
            bins = pool.bins(weights)
            self.n_unlabelled = n = int(bins[0][1].sum())
            if not n:
                break
            each = max(1, int(n * min(0.5, GIVEN * turn)))
            n_bad, n_good = max(1, int(each * (1 - self.constant))), max(1, int(each * self.constant))
            cuts = []
            for v, (at, k) in enumerate(bins):
                low, high = self._confident(weights[v], labelled[v][fit], y[fit])
                cuts.append((min(low, int(at[np.searchsorted(np.cumsum(k), n_bad)])), max(high, int(at[::-1][np.searchsorted(np.cumsum(k[::-1]), n_good)]))))
            history.append((weights, cuts))
            given = pool.given(history)
            for m in self.models:
                m.again()
            for _ in range(STEPS):
                for v, (m, part) in enumerate(zip(self.models, _given_sums(given, [m.asked for m in self.models]), strict=True)):
                    own = newton_sums(m.asked, labelled[v][~test], seen, ones)
                    if not m.done:
                        m.told(*(a + b for a, b in zip(part, own, strict=True)))
                if all(m.done for m in self.models):
                    break
            dropped(given)
        dropped(pool.rows)
        for m in self.models:
            m.w = np.round(m.w, 6)
        self.scale = [self._line(self.models[v].w, labelled[v][fit], y[fit]) for v in (0, 1)]
        both = np.stack([self.view_odds(v, labelled[v][joined]) for v in (0, 1)], axis=1)
        told = np.array([True, True])  # a view that would speak against itself is left out, and the rest fitted without it
        while True:
            joint = Logistic(int(told.sum()), ridge=0.1).fit(both[:, told], y[joined], np.ones(len(joined)))
            if (joint.w[:-1] >= 0).all():
                break
            told[np.flatnonzero(told)[int(np.argmin(joint.w[:-1]))]] = False
        weight = np.zeros(2)
        weight[told] = joint.w[:-1]
        self.joint = (float(weight[0]), float(weight[1]), float(joint.w[-1]))

    @staticmethod
    def _line(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Calibrated log odds are a straight line of a view's own; a view that errs more than it is right says nothing."""
        line = Logistic(1, ridge=0.1).fit(odds_of(w, x)[:, None], y, np.ones(len(y)))
        return max(float(line.w[0]), 0.0), float(line.w[1])

    @classmethod
    def _confident(cls, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        """Up to which bin of its log odds a view is confident that a row is bad, and from which on that it is good."""
        a, b = cls._line(w, x, y)
        if a < 1e-3:
            return -(1 << 40), 1 << 40
        sure = np.log(CONFIDENT / (1 - CONFIDENT))
        low, high = ((s * sure - b) / a for s in (-1, 1))
        return int(binned(np.array([low]))[0]) - 1, int(binned(np.array([high]))[0]) + 1

    def view_odds(self, v: int, x: np.ndarray) -> np.ndarray:
        a, b = self.scale[v]
        return a * self.models[v].odds(x) + b

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.models is None:
            return np.full(len(content), self.constant)
        a, b, c = self.joint
        odds = a * self.view_odds(0, content) + b * self.view_odds(1, metadata) + c
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _inputs(docs: DataFrame, text: str, *more: str) -> DataFrame:
    there = [(F.col(c).cast("double") if c == "n_chars" else F.col(c).cast("string")).alias(c) for c in METADATA if c in docs.columns]
    return docs.select(*more, *there, text_of(docs, text).alias("__text"))


def _featured(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Features and labels of a bounded number of rows, in the order of their keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, metadata = views(batch)
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "label"), lists(pa.array(content.ravel()), np.full(n, content.shape[1])), lists(pa.array(metadata.ravel()), np.full(n, metadata.shape[1]))], names=["key", "label", "content", "metadata"])

    schema = fields(rows.select("key", "label").schema, "content array<float>, metadata array<float>")
    got = rows.mapInArrow(over_pieces(run, "__text"), schema).orderBy(F.xxhash64("key"), "key").toArrow()
    n = got.num_rows
    features = tuple(got.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1), np.float32) for c in ("content", "metadata"))
    return features, got.column("label").to_numpy().astype(np.float64) if n else np.zeros(0)


def _features(rows: DataFrame) -> DataFrame:
    """(key, x binary): the features of both views as single-precision numbers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(batch, "key"), _packed(np.concatenate(views(batch), axis=1))], names=["key", "x"])

    return rows.mapInArrow(over_pieces(run, "__text"), fields(rows.select("key").schema, "x binary"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rounds: int = ROUNDS) -> CoTrained:
    """Fits on a sample of the labelled rows and on all unlabelled ones; see the module's text."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    unit = F.pmod(F.xxhash64(F.lit(8), F.col("key")), F.lit(1_000_000))
    n_marks = marks.count()
    chosen = marks.where(unit < min(1_000_000, 1 + 1_000_000 * LABELLED // max(1, n_marks)))
    rows = _inputs(docs.withColumn("key", F.col(key)), text, "key")
    labelled, y = _featured(rows.join(F.broadcast(chosen), "key"))  # `chosen` has about LABELLED rows at most

    def unlabelled() -> Unlabelled:
        # the labels grow with the input: their keys are never broadcast, and features move instead of texts
        return Unlabelled(_features(rows).join(marks.select("key").hint("merge"), "key", "left_anti").select("x"))

    return CoTrained(labelled, y, unlabelled, rounds)


@shielded("text", *METADATA)
def scored(docs: DataFrame, model: CoTrained, text: str = "text") -> DataFrame:
    """All columns and quality_score double."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    told = docs.columns
    source = docs.withColumns({f"__own{k}": F.col(c) for k, c in enumerate(told)})
    source = _inputs(source, text, *[f"__own{k}" for k in range(len(told))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(column(batch, f"__own{k}") for k in range(len(told))), pa.array(held.value.score(*views(batch)), pa.float64())], names=[*told, "quality_score"])

    return source.mapInArrow(over_pieces(run, "__text"), fields(docs.schema, "quality_score double"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text", *METADATA), model).select("doc_id", "quality_score", (F.col("quality_score") >= THRESHOLD).alias("kept"))


@shielded("text", *METADATA)
def accepted(docs: DataFrame, model: CoTrained, text: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    return scored(docs, model, text).where(F.col("quality_score") >= THRESHOLD).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))
