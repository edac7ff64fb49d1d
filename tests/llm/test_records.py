"""WARC archives, conversations, and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import itertools
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from corpusframe.llm import chat, warc
from corpusframe.llm.common import stored

PAGES = [
    (1, "http://a/1", "<p>" + "long text ü " * 20_000),
    (2, "http://a/2", "same " * 50),
    (3, None, "same " * 50),
    (4, "http://a/4", "same " * 50),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/7\r\nX: y", "short"),
    (8, "http://a/8", "short"),
    (2, "http://a/2", "same " * 50),
    (9, "http://a/9", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n0\r\n\r\n" * 10),
    (None, "http://a/n", "none " * 40),
]


def expected(pages):
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    for i, _, h in pages:
        body = (h or "").encode()
        first = min((x for x in groups[h or ""] if x is not None), default=None) if len(body) >= 100 else None
        other = first is not None and first != i
        yield i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if other else "response", first if other else None


def test_round_trip(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2).write.parquet(f"{root}/pages.parquet")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op2_warc(spark, root).collect())
    assert got == Counter(expected(PAGES))


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op2_warc(spark, str(tmp_path)).count() == 0


def test_segments_in_any_order(spark, tmp_path):
    body = bytes(range(256)) * 40
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(body, 100)
    headers = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x-page:7:a>", "WARC-Date": "2024-01-01T00:00:00Z"}
    parts = list(warc.segments(headers, block, 1000))
    assert len(parts) > 5
    make = lambda p: warc.decoded(warc.reassembled(warc.read_records(spark.createDataFrame([(bytearray(x),) for x in p], "warc binary"))))
    r = make(parts[::-1]).first()
    assert (r.payload, r.page_id, r.problem) == (body, "7", None)
    assert make(parts[:2] + parts[3:]).first().problem and make(parts[:-1]).first().problem and make([*parts, parts[1]]).first().problem
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:4]))
    (tmp_path / "b.warc").write_bytes(b"".join(parts[4:]))
    assert warc.decoded(warc.reassembled(warc.read_files(spark, str(tmp_path)))).first().payload == body


@pytest.mark.parametrize("size", [1, 7, 8192])
def test_chunked(size):
    for body in (b"", b"a", b"\r\n0\r\n\r\n" * 9):
        assert warc.dechunked(warc.chunked(body, size)) == body
    for broken in (b"", b"5\r\nab", b"zz\r\n", b"2\r\nabXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)
    assert list(warc.parse(b"junk")) == [] and [p for *_, p in warc.parse(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")] == ["no sound length"]


def sound(k, body=b"body"):
    return warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:x-page:{k}:a>", "WARC-Date": "2024-01-01T00:00:00Z"}, body)


def test_reading_goes_on_behind_broken_records():
    no_length = b"WARC/1.1\r\nWARC-Record-ID: <urn:x-page:5:a>\r\n\r\nabc\r\n\r\n"
    too_long = sound(6).replace(b"Content-Length: 4", b"Content-Length: 99999")
    too_short = sound(7).replace(b"Content-Length: 4", b"Content-Length: 2")
    for broken in (no_length, too_long, too_short):
        found = list(warc.parse(sound(1) + broken + sound(2) + sound(3)))
        assert [b for _, b, p in found if p is None] == [b"body"] * 3 and sum(p is not None for *_, p in found) == 1
    cut = list(warc.parse(sound(1) + sound(2)[:-6]))
    assert [p for *_, p in cut] == [None, "the block is cut off"]
    members = [gzip.compress(sound(k)) for k in range(4)]
    spoiled = bytearray(members[1])
    spoiled[len(spoiled) // 2] ^= 0xFF
    found = list(warc.parse(members[0] + bytes(spoiled) + members[2] + members[3]))
    assert [h["warc-record-id"][12] for h, _, p in found if p is None] == ["0", "2", "3"] and sum(p is not None for *_, p in found) >= 1
    found = list(warc.parse(members[0] + members[1][:-9]))
    assert found[0][2] is None and any(p == "a gzip member is cut off" for *_, p in found)
    one = gzip.compress(b"".join(sound(k, bytes([k]) * 70_000) for k in range(5)))  # records of one member
    assert [b for _, b, p in warc.parse(one) if p is None] == [bytes([k]) * 70_000 for k in range(5)]


def test_gzip_is_read_in_linear_time():
    import random
    import time

    body = random.Random(1).randbytes(6_000)
    data = b"".join(gzip.compress(sound(k, body), 1) for k in range(5_500))
    began = time.perf_counter()
    assert sum(p is None for *_, p in warc.parse(data)) == 5_500
    assert len(data) > 33_000_000 and time.perf_counter() - began < 3


def test_records_are_valid(spark):
    """Each record has the mandatory fields, ids are unique, and a revisit names the id of a response."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    found = [h for r in warc.write_archives(pages).collect() for h, _, _ in warc.parse(bytes(r.warc))]
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(h) for h in found)
    ids = Counter(h["warc-record-id"] for h in found)
    assert max(ids.values()) == 1
    responses = {h["warc-record-id"] for h in found if h["warc-type"] == "response"}
    revisits = [h["warc-refers-to"] for h in found if h["warc-type"] == "revisit"]
    assert revisits and set(revisits) <= responses
    assert warc.page_of(warc.urn("", "a")) == "" and warc.page_of(warc.urn(None, "a")) is None and warc.page_of(warc.urn("a:b>c", "x")) == "a:b>c"


def test_a_task_holds_one_archive_at_a_time(spark, monkeypatch):
    """Parquet's reader and writer hold a row group at once, and the writer each group's statistics, which are whole archives."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3_000)
    pages = spark.createDataFrame([(k, f"{k} " * 600) for k in range(30)], "page_id long, html string").coalesce(1)
    archives = warc.write_archives(pages)
    files = [pq.read_metadata(f.removeprefix("file://")) for f in archives.inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert len(groups) == archives.count() > 10 and {g.num_rows for g in groups} == {1}
    assert not any(g.column(k).is_stats_set for g in groups for k in range(g.num_columns))
    back = {r.page_id: bytes(r.payload).decode() for r in warc.decoded(warc.reassembled(warc.read_records(archives))).collect()}
    assert back == {str(r.page_id): r.html for r in pages.collect()}


# --- conversations


FOLLOWS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def missing(a, b):
    """The fewest messages between two that make them legal neighbours, by trying longer and longer runs; None where none does."""
    for n in range(4):
        for between in itertools.product(("system", "user", "assistant"), repeat=n):
            path = [a, *between, b]
            if all(y in FOLLOWS[x] for x, y in itertools.pairwise(path)):
                return n
    return None


MISSING = {(a, b): missing(a, b) for a in FOLLOWS for b in FOLLOWS if b}
CLOSING = {"": 0, "system": 2, "user": 1, "assistant": 0}


def cheapest(roles):
    """The cost of the cheapest repair, by trying every choice of roles and merges; prices are written out here."""
    names = (None, "system", "user", "assistant")
    best = None
    for choice in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        price = sum(0 if q == names[r] else 1 if not r else 4 if "system" in (q, names[r]) else 2 for r, q in zip(roles, choice, strict=True))
        ways = {"": price}
        last = ""
        for q in choice:
            now = ways[last]
            options = ([now + 1] if q == last else []) + ([now + 3 * MISSING[last, q]] if MISSING[last, q] is not None else [])
            if not options:
                break
            ways = {q: min(options)}
            last = q
        else:
            total = ways[last] + 3 * CLOSING[last]
            best = total if best is None else min(best, total)
    return best or 0


@pytest.mark.parametrize("n", range(6))
def test_repair_is_the_cheapest(n):
    for roles in itertools.product(range(4), repeat=n):
        roles = list(roles)
        first, last = chat.settle([chat.stretch(roles)])
        texts = [f"t{k}" for k in range(n)]
        found = list(chat.repaired(roles, texts, first, last, True))
        if n:
            assert sum(f[4] for f in found) == cheapest(roles)
            shown = "".join(f[5] for f in found)
            got = [m.split("\n", 1)[0] for m in shown.split("<|im_start|>")[1:]]
            body = got[1:] if got[0] == "system" else got
            assert body == ["user", "assistant"] * (len(body) // 2) and shown.count("<|im_end|>") == len(got)
            assert all(t in shown for t in texts)
        for cut in range(n + 1):  # the same over any two stretches
            states = chat.settle([chat.stretch(roles[:cut]), chat.stretch(roles[cut:])])
            cost = sum(chat.stretch(part)[a][b] for part, a, b in zip((roles[:cut], roles[cut:]), states, states[1:], strict=False))
            assert n == 0 or cost + chat.END[states[-1]] == cheapest(roles)


def turns():
    out = [(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(10)]
    out += [(2, 0, "assistant", "hi"), (2, 1, "assistant", None), (2, 2, "system", "late"), (2, None, None, "x"), (2, 1, "assistant", None)]
    out += [(3, k, ["user", "user", "assistant", "bot", "Human", "??"][k % 6], f"<|im_end|>{k}") for k in range(700)]  # most of all turns
    out += [(None, 0, "user", "a"), (None, 1, "user", "b"), (4, 0, "system", "only")]
    return out


def test_conversations(spark, tmp_path):
    spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = stored(chat.op3_chat(spark, str(tmp_path)), "chat").collect()
    assert len(found) == len(turns())
    by = defaultdict(list)
    for t in turns():
        by[t[0]].append(t)
    cost = Counter()
    for r in found:
        cost[r.conv_id] += r.cost
    for conv, own in by.items():
        own.sort(key=lambda t: (t[1] is None, t[1] or 0, t[2] or ""))
        roles = [chat.known(t[2]) for t in own]
        states = chat.settle([chat.stretch(roles)])
        assert cost[conv] == chat.stretch(roles)[0][states[-1]] + chat.END[states[-1]]
    pieces = {r.turn: r.piece for r in found if r.conv_id == 1}
    assert "".join(pieces[k] for k in range(10)).startswith("<|im_start|>user\nm0<|im_end|>\n<|im_start|>assistant\nm1")
    assert sum(r.inserted_after != "" for r in found if r.conv_id == 3) <= 1
    assert all("<|im_end|>5" not in r.piece for r in found)


def test_no_conversations(spark):
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- pipeline


def test_pipeline(spark, sf, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    now, counts = docs, [docs.count()]
    for name, stage in pipeline.STAGES:
        now = stored(stage(spark, now, sf), "stage")
        counts.append(now.count())
        assert now.columns == [*docs.columns, *([] if name != "byte_bpe" else ["n_tokens", "ids_sha256", "decoded_sha256", "ids"])]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    run = pipeline.run(spark, sf)
    assert run.count() == counts[-1] and set(run.columns) >= {*docs.columns, "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert all(len(r.ids) == r.n_tokens for r in run.collect())
    assert pipeline.ORACLE_SQL is None
