"""Chat formatting with minimum-cost role repair.

A conversation is legal if it has a system message at most, first, then user and assistant messages in turn, and ends with the
assistant's.  Each turn may keep its role, be given another, or be merged into the message before it, and empty messages may be
inserted; dynamic programming over the automaton of last roles finds the cheapest way.  The repaired sequence is rendered in
ChatML; the `piece`s of a conversation's turns, one after the other, are the rendered text.

Scale and skew: turns are range-partitioned and sorted by conversation and turn, so even one conversation with a third of all turns is split.
The cost of going from one state to another is a 4 x 4 matrix over (min, +) for any stretch of turns, and matrices combine: each
partition tells the driver those of its first and last conversation (two rows a partition), the driver settles the states at the cuts, and
each partition then solves its own stretches.  The partitions are fixed by a checkpoint in between.

Defined results: turns are ordered by turn (null last), role, text.  Unknown and null roles cost less to relabel; null text is
empty.  A null conv_id is a conversation of its own.  Repeated rows are turns of their own.  Of equally cheap repairs, that with the earlier role in
(system, user, assistant) from the end backwards is taken.  In texts `<|` is rendered `< |`, so that no text can open or close a message.  An empty
table gives an empty result.  Columns beside the four that are named are not read, so their names can't clash.  Very long texts come one after the
other; a partition's turns of one conversation are held at once, and the range partition deals out a conversation of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import bounded_batches, column, fields, shared_dir, table

ROLES = ("start", "system", "user", "assistant")
NAMES = {"system": 1, "user": 2, "human": 2, "prompter": 2, "assistant": 3, "bot": 3, "gpt": 3, "model": 3}
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
MERGE, RELABEL, RELABEL_SYSTEM, RELABEL_UNKNOWN, INSERT = 1, 2, 4, 1, 3
NEVER = 1 << 40
BATCH_TURNS = 500
#: What must follow a last role before the end.
AT_END = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def steps(role: int) -> list[list[tuple[int, str, int] | None]]:
    """For a turn of the role (0: unknown): from each state to each role the cost, whether it merges, and the role inserted before it (0: none)."""
    table_: list[list[tuple[int, str, int] | None]] = [[None] * 4 for _ in range(4)]
    for q in (1, 2, 3):
        label = 0 if q == role else RELABEL_UNKNOWN if role == 0 else RELABEL_SYSTEM if 1 in (q, role) else RELABEL
        for s in range(4):
            ways = []
            if (s, q) in LEGAL:
                ways.append((label, "new", 0))
            if s == q:
                ways.append((label + MERGE, "merge", 0))
            ways += [(label + INSERT, "new", m) for m in (2, 3) if (s, m) in LEGAL and (m, q) in LEGAL]
            table_[s][q] = min(ways, default=None)
    return table_


STEPS = [steps(r) for r in range(4)]
END = [INSERT * len(AT_END[s]) for s in range(4)]
Matrix = list[list[int]]


def known(role: str | None) -> int:
    return NAMES.get((role or "").strip().lower(), 0)


def stretch(roles: list[int]) -> Matrix:
    """The cheapest way through the turns from each state to each state."""
    now = [[0 if s == q else NEVER for q in range(4)] for s in range(4)]
    for r in roles:
        step = STEPS[r]
        now = [[min((row[s] + step[s][q][0] for s in range(4) if step[s][q]), default=NEVER) for q in range(4)] for row in now]
        now = [[min(x, NEVER) for x in row] for row in now]
    return now


def settle(matrices: list[Matrix]) -> list[int]:
    """The states at all cuts of a conversation, the start and the end included, on a cheapest way."""
    costs = [[0, NEVER, NEVER, NEVER]]
    for m in matrices:
        costs.append([min(costs[-1][s] + m[s][q] for s in range(4)) for q in range(4)])
    state = min(range(4), key=lambda q: (costs[-1][q] + END[q], q))
    out = [state]
    for m, before in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        state = min(range(4), key=lambda s: (before[s] + m[s][state], s))
        out.append(state)
    return out[::-1]


def solve(roles: list[int], first: int, last: int) -> list[int]:
    """The role of each turn on a cheapest way between two states."""
    costs = [[0 if s == first else NEVER for s in range(4)]]
    for r in roles:
        costs.append([min((costs[-1][s] + STEPS[r][s][q][0] for s in range(4) if STEPS[r][s][q]), default=NEVER) for q in range(4)])
    out, state = [], last
    for k in range(len(roles) - 1, -1, -1):
        out.append(state)
        step = STEPS[roles[k]]
        state = min((s for s in range(4) if step[s][state]), key=lambda s: (costs[k][s] + step[s][state][0], s))
    return out[::-1]


def message(role: int, text: str) -> str:
    return f"<|im_start|>{ROLES[role]}\n{text}"


CLOSE = "<|im_end|>\n"


def repaired(roles: list[int], texts: list[str], first: int, last: int, ends: bool) -> Iterator[tuple[str, str, str, str, int, str]]:
    """For each turn: new role, action, role inserted before, roles inserted after, cost, rendered piece."""
    state = first
    for k, (r, text, q) in enumerate(zip(roles, texts, solve(roles, first, last), strict=True)):
        cost, how, inserted = STEPS[r][state][q]
        action = {("new", True): "keep", ("new", False): "relabel", ("merge", True): "merge", ("merge", False): "relabel+merge"}[how, q == r]
        text = text.replace("<|", "< |")
        if how == "merge":
            piece = "\n" + text
        else:
            piece = (CLOSE if state else "") + (message(inserted, "") + CLOSE if inserted else "") + message(q, text)
        after: tuple[int, ...] = ()
        if ends and k == len(roles) - 1:
            after = AT_END[q]
            cost += INSERT * len(after)
            piece += CLOSE + "".join(message(m, "") + CLOSE for m in after)
        yield ROLES[q], action, ROLES[inserted] if inserted else "", ",".join(ROLES[m] for m in after), cost, piece
        state = q


def _fragments(batches: Iterator[pa.RecordBatch], conv: str, wanted: list[str]) -> Iterator[tuple[object, list[list]]]:
    """The rows of each conversation of a partition, which come one after the other."""
    name, held, began = None, [[] for _ in wanted], False
    for batch in batches:
        for row in zip(column(batch, conv).to_pylist(), *(column(batch, c).to_pylist() for c in wanted), strict=True):
            if began and row[0] != name:
                yield name, held
                held = [[] for _ in wanted]
            name, began = row[0], True
            for part, value in zip(held, row[1:], strict=True):
                part.append(value)
    if began:
        yield name, held


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn: conv, turn, role, text_chars, role_out, action, inserted_before, inserted_after, cost, piece."""
    spark = turns.sparkSession
    bounded_batches(spark)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["conv", F.col("turn").asc_nulls_last(), "role", F.xxhash64("text"), "text"]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # equal rows may stand in any order, so a random last key deals out even those
    fixed = rows.withColumn("deal", F.rand(3)).repartitionByRange("conv", F.col("turn").asc_nulls_last(), "role", F.xxhash64("text"), "deal").sortWithinPartitions(*order).drop("deal").checkpoint()

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k = TaskContext.get().partitionId(), None, 0
        edge = []
        for name, (roles,) in _fragments(batches, "conv", ["role"]):
            last = (k, name, roles)
            if k == 0:
                edge.append(last)
            k += 1
        if last and last[0]:
            edge.append(last)
        for k, name, roles in edge:
            flat = [x for row in stretch([known(r) for r in roles]) for x in row]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int64()), pa.array([None if name is None else str(name)], pa.string()), pa.array([flat], pa.list_(pa.int64()))], names=["part", "k", "conv", "cost"])

    edges = sorted(fixed.select("conv", "role").mapInArrow(summary, "part int, k long, conv string, cost array<long>").collect(), key=lambda r: (r.part, r.k))
    cuts: dict[tuple[int, int], tuple[int, int, bool]] = {}
    at = 0
    while at < len(edges):
        to = at + 1
        while to < len(edges) and edges[to].conv == edges[at].conv and edges[to].k == 0 and edges[to].part > edges[to - 1].part:
            to += 1
        states = settle([[list(e.cost[4 * s : 4 * s + 4]) for s in range(4)] for e in edges[at:to]])
        for e, a, b in zip(edges[at:to], states, states[1:], strict=False):
            cuts[e.part, e.k] = (a, b, e is edges[to - 1])
        at = to
    told = spark.sparkContext.broadcast(cuts)  # two entries a partition at most
    out_names = ["conv", "turn", "role", "text_chars", "role_out", "action", "inserted_before", "inserted_after", "cost", "piece"]
    schema = fields(fixed.select("conv", "turn", "role").schema, "text_chars long, role_out string, action string, inserted_before string, inserted_after string, cost int, piece string")
    kinds = {n: fixed.schema[n].dataType for n in ("conv", "turn")}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {n: to_arrow_type(k) for n, k in kinds.items()}

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (name, (numbers, roles, texts)) in enumerate(_fragments(batches, "conv", ["turn", "role", "text"])):
            r = [known(x) for x in roles]
            first, last, ends = told.value.get((part, k)) or (0, settle([stretch(r)])[1], True)
            each, at = repaired(r, texts, first, last, ends), 0
            while some := list(islice(each, BATCH_TURNS)):
                found, to = list(zip(*some, strict=True)), at + len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), arrow["conv"]), pa.array(numbers[at:to], arrow["turn"]), pa.array(roles[at:to], pa.string()), pa.array([len(t) for t in texts[at:to]], pa.int64()), *(pa.array(x, pa.string()) for x in found[:4]), pa.array(found[4], pa.int32()), pa.array(found[5], pa.string())],
                    names=out_names,
                )
                at = to

    out = fixed.mapInArrow(solved, schema)
    return out.withColumnsRenamed({"conv": conv, "turn": turn, "role": role})


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
