"""Quality rules joined by weak supervision, in DataFrame functions alone.

Each rule looks at a facet of its own and votes for good (1), bad (-1), clearly bad (-2), or abstains (0): what several measures of one facet
say is one graded vote, as they err together.  A document is good or bad, and a bad one is bad in one of as many ways as there are rules; within
each of these classes rules err independently.  (With one class for all bad documents a text that is bad in one way alone is outvoted by all the
rules that look elsewhere.)  Expectation-maximisation fits the classes' shares and each rule's votes in each class, and so its accuracy, to how often each
pattern of votes occurs over all documents: at most 4 ** rules numbers, and a few hundred in fact, whatever the input's size.
A document's posterior probability of being good then follows from its votes.  The base rules fail a document whatever its posterior.

Defined results: null and empty texts have no word; they fail the base rules.  Repeated rows give repeated rows, an empty table an empty one.
Columns with any names are handed on, but for those named as a measure or result.  Equally likely classes (posterior 0.5) count as good.  A text is
one value of the JVM, words and all, so a very long one (some hundred MB) needs an executor's heap to match.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import shielded, stored, table, text_of

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED = 50  # hundredths of the words
ROUNDS = 50
PRIOR_GOOD = 0.8
PRIOR_WEIGHT = 0.2  # of the belief before anything is learned, against the votes themselves
VALUES = (1, 0, -1, -2)
IF_GOOD = {1: 1.0, 0: 1.0, -1: 0.1, -2: 0.02}  # how much likelier than on average a vote is for a good document
IF_BAD = {1: 0.001, 0: 0.01, -1: 1.0, -2: 1.0}  # and for one that is bad in the rule's own way; other rules vote as on average


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column) -> Column:
    """How many words stand in a three-word window that occurs twice or more in the array."""

    def covered(sorted_pairs: Column) -> Column:
        m = F.size(sorted_pairs)
        both = F.zip_with(F.slice(sorted_pairs, F.lit(1), m - 1), F.slice(sorted_pairs, F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        at = F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    hashes = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashes, counted))


MEASURES = ["n_words", "word_chars", "n_distinct", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", "n_upper", "n_stops", "n_shouts", "n_runs", "n_bars"]


@shielded("text")
def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and what the rules look at."""
    keep = [c for c in docs.columns if c != text]
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).alias("n_repeat_words"),
        )

    blank = F.trim(t, F.lit(BLANKS)) == ""
    split = F.when(blank, F.array().cast("array<string>")).otherwise(F.split(F.trim(t, F.lit(BLANKS)), BLANK))
    out = docs.select(*keep, text_of(docs, text).alias("__text"))
    return out.select(
        *keep,
        let(split, of_words).alias("of_words"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("of_lines"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit(r"[.!?](\s|$)")).cast("long").alias("n_stops"),
        F.regexp_count(t, F.lit(r"[!?]{2,}")).cast("long").alias("n_shouts"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]{3,}")).cast("long").alias("n_runs"),
        F.regexp_count(t, F.lit(r"(^|\s)[|<>&](\s|$)")).cast("long").alias("n_bars"),
    ).select(*keep, "of_words.*", "of_lines.*", *MEASURES[6:])


def rule_votes() -> dict[str, Column]:
    """Each rule's vote from the measures."""
    c = F.col

    def vote(*bad: Column, good: Column | None = None) -> Column:
        """Several bad signs of one facet are a graver vote."""
        signs = reduce(lambda a, x: a + x, [F.coalesce(x, F.lit(False)).cast("int") for x in bad])
        out = F.when(signs >= 2, -2).when(signs == 1, -1)
        return (out if good is None else out.when(good, 1)).otherwise(0)

    n = F.greatest(c("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    return {
        "v_repeat": vote(c("n_repeat_words") * 20 > 7 * n, good=c("n_repeat_words") * 20 < n),
        "v_variety": vote(c("n_distinct") * 5 < n, good=c("n_distinct") * 2 > n),
        "v_symbols": vote(c("n_symbols") * 10 > n, c("n_symbols") * 50 > chars, c("n_runs") * 20 > n, c("n_bars") * 20 > n),
        "v_lines": vote(c("n_dup_lines") * 2 > c("n_lines")),
        "v_word": vote((chars < 3 * n) | (chars > 15 * n)),
        "v_upper": vote(c("n_upper") * 10 > chars * 3),
        "v_stops": vote(c("n_stops") * 200 < n, good=(c("n_stops") * 50 > n) & (c("n_stops") * 2 < n)),
        "v_shouts": vote(c("n_shouts") * 20 > n),
    }


class Model:
    """Expectation-maximisation over vote patterns.  Class 0 is good, class k + 1 bad in the way that rule k looks for."""

    def __init__(self, counts: dict[tuple[int, ...], int], rounds: int = ROUNDS):
        total = sum(counts.values())
        rules = len(next(iter(counts), ()))
        self.prior = [PRIOR_GOOD, *([(1 - PRIOR_GOOD) / rules] * rules)] if rules else [1.0]
        average = [{v: (1 + sum(n for p, n in counts.items() if p[j] == v)) / (total + len(VALUES)) for v in VALUES} for j in range(rules)]
        self.votes = [[_shaped(average[j], IF_GOOD if not k else IF_BAD if k == j + 1 else None) for j in range(rules)] for k in range(len(self.prior))]
        belief = [[{v: PRIOR_WEIGHT * total * share * x for v, x in of.items()} for of in votes] for share, votes in zip(self.prior, self.votes, strict=True)]
        weight = [PRIOR_WEIGHT * total * share for share in self.prior]
        for _ in range(rounds if total else 0):
            size, sums = list(weight), [[dict(of) for of in votes] for votes in belief]
            for pattern, n in counts.items():
                for k, p in enumerate(self.posterior(pattern)):
                    size[k] += n * p
                    for j, v in enumerate(pattern):
                        sums[k][j][v] += n * p
            self.prior = [x / sum(size) for x in size]
            self.votes = [[{v: x / sum(of.values()) for v, x in of.items()} for of in votes] for votes in sums]

    def logs(self, k: int) -> tuple[float, list[dict[int, float]]]:
        """The logarithms of a class's share and of its votes."""
        return math.log(self.prior[k]), [{v: math.log(x) for v, x in of.items()} for of in self.votes[k]]

    def posterior(self, pattern: tuple[int, ...]) -> list[float]:
        """How likely each class is, given the votes."""
        each = [share * math.prod(of[v] for of, v in zip(votes, pattern, strict=True)) for share, votes in zip(self.prior, self.votes, strict=True)]
        return [x / sum(each) for x in each]

    def accuracies(self) -> list[float]:
        """Of each rule's votes that are no abstentions the expected share that is right."""
        out = []
        for j in range(len(self.prior) - 1):
            right = self.prior[0] * self.votes[0][j][1] + sum(s * (v[j][-1] + v[j][-2]) for s, v in zip(self.prior[1:], self.votes[1:], strict=True))
            out.append(right / sum(s * (1 - v[j][0]) for s, v in zip(self.prior, self.votes, strict=True)))
        return out


def _shaped(average: dict[int, float], factor: dict[int, float] | None) -> dict[int, float]:
    out = {v: x * (factor[v] if factor else 1.0) for v, x in average.items()}
    return {v: x / sum(out.values()) for v, x in out.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


@shielded(*MEASURES)
def judged(measures: DataFrame) -> DataFrame:
    """Adds base_failed, posterior and kept to a table of measures, which is read twice; columns of these names are replaced."""
    votes = list(rule_votes().values())
    patterns = measures.select(*[v.alias(f"v{j}") for j, v in enumerate(votes)]).groupBy(*[f"v{j}" for j in range(len(votes))]).count().collect()
    model = Model({tuple(r[:-1]): r[-1] for r in sorted(patterns)})
    names = [f"__vote{j}" for j in range(len(votes))]

    def log_of(k: int) -> Column:
        share, each = model.logs(k)
        out = F.lit(share)
        for name, of in zip(names, each, strict=False):
            out = out + reduce(lambda a, v, name=name, of=of: a.when(F.col(name) == v, of[v]), VALUES[1:], F.when(F.col(name) == VALUES[0], of[VALUES[0]]))
        return out

    good = log_of(0)
    odds = [F.exp(log_of(k) - good) for k in range(1, len(model.prior))]
    found = measures.withColumns(dict(zip(names, votes, strict=True))).withColumns({"base_failed": base_failed(), "posterior": F.lit(1.0) / reduce(lambda a, x: a + x, odds, F.lit(1.0))})
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop(*names)


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = stored(measured(table(spark, sf_dir, "documents").select("doc_id", "text")), "rule-measures")
    return judged(measures).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
