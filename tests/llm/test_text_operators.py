"""Operators on documents against brute force over the small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import bpe, decontaminate, fmindex, langid, neardup, pii, quality, recompress, registry, rules, substrings
from corpusframe.llm import textbytes as tb
from corpusframe.llm.common import bitmap, stored
from corpusframe.llm.components import components

from .conftest import rows

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHA = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def bag(found, *columns):
    return Counter(tuple(r[c] for c in columns) for r in found.collect())


# --- kernels


@pytest.mark.parametrize("letters", ["SPACED", "ALNUM"])
def test_words_are_those_of_the_pattern(letters):
    texts = [t for _, t, *_ in rows()] + ["ÄÖ straße x9 A-b", "\x0b\x0c a\x1cb", "日本 語", "end"]
    lower = letters == "ALNUM"
    w = tb.words(pa.array(texts), getattr(tb, letters), lower)
    pattern = ALNUM if lower else SPACED
    expected = [pattern.findall(low(t) if lower else t or "") for t in texts]
    got = [[w.word(i).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
    assert got == expected
    h = w.hashes()
    flat = [x for e in expected for x in e]
    assert len(set(h.tolist())) == len(set(flat)) and len({(a, b) for a, b in zip(h.tolist(), flat, strict=True)}) == len(set(flat))
    alone = tb.words(pa.array(["zz", flat[3]]), getattr(tb, letters), lower).hashes()
    assert alone[1] == h[3]
    at, x = tb.window_hashes(h, w.first, 4)
    windows = [tuple(e[i : i + 4]) for e in expected for i in range(len(e) - 3)]
    assert len(at) == len(windows) and len(set(x.tolist())) == len(set(windows))
    assert len(set(tb.row_hashes(h, w.first).tolist())) == len({tuple(e) for e in expected})


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 900, 3, 3)] + [None])], names=["text"])
    assert sum((p.column(0).to_pylist() for p in tb.pieces(batch, limit=10)), []) == batch.column(0).to_pylist()


def test_bitmap(spark):
    values = [0, 1, 2, 32_767, 32_768, 32_769, 65_536, -1, -(1 << 40), 1 << 50]
    got = np.flatnonzero(bitmap(spark.createDataFrame([(v,) for v in values], "x long"), "x", 1 << 17))
    assert set(got.tolist()) == {v % (1 << 17) for v in values}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 4), (3, 1)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 4: 4, 5: 4} | {100 + i: 100 for i in range(31)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1, personal data

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


HARD = ["a@b.c@d.e", "@x.y", "a@@b.c", "x@y", "x@-.-", "a@b..c", "..@a.b", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1.1.1.1", "00001.0.0.01", "1..2.3.4.5", "9" * 4000 + ".1.1.1", "4111-1111 11111111", "4111--1111", "4111 1111 1111 1111 4111 1111 1111 1111", "+1", "+12 3", "+1 (555) 010-9999-", "++49 30 123456789", "+" * 9, "é a@b.co 日 +49 (30) 1234567", "1." * 3000, "a" * 3000 + "@"]


@pytest.mark.parametrize("text", HARD)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_random_texts():
    import random

    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("12345 .-+()@ab") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark, sf, docs):
    found = stored(pii.op1_pii(spark, sf), "pii")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found.collect())
    want = Counter()
    for i, t, *_ in rows():
        s = plain_spans(t or "")
        want[(i, *(sum(x[1] == k for x in s) for k in range(4)), SHA(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s)))] += 1
    assert got == want
    want_spans = Counter((i, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in own)) for i, own in disclosed(rows()))
    assert bag(found, "doc_id", "spans") == want_spans
    assert sum("term" in s for _, s in want_spans) >= 8


def wilson(k, of, z=pii.CONFIDENT):
    p = k / of
    return (p + z * z / (2 * of) - z * math.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def disclosed(data):
    """Base spans and the words that disclose, by counting whole documents: a direct computation of P(e | t) and its bound."""
    docs = []
    for i, t, *_ in data:
        t = t or ""
        spans = plain_spans(t)
        marked = [(m.start(), m.end(), low(m[0])) for m in ALNUM.finditer(low(t))]
        free = [w for w in marked if not any(w[0] < e and s < w[1] for s, _, e in spans)]
        entities = {(k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b])) for a, k, b in spans}
        entities |= {(0, "@" + v.split("@")[1]) for k, v in entities if k == 0} | {(1, ".".join(v.split(".")[:3])) for k, v in entities if k == 1}
        docs.append((i, spans, entities, free, {w for *_, w in marked}))
    n = len(docs)
    n_term = Counter(w for *_, every in docs for w in every)
    n_entity = Counter(e for _, _, entities, _, _ in docs for e in entities)
    both = Counter((w, e) for _, _, entities, free, _ in docs for w in {w for *_, w in free} for e in entities)
    sure = {w for (w, e), k in both.items() if wilson(k, n_term[w]) >= max(pii.GENERALISE, math.sqrt(n_entity[e] / n))}
    for i, spans, entities, free, _ in docs:
        yield i, sorted([*spans, *((a, 4, b) for a, b, w in free if w in sure)])


def test_terms_of_a_known_entity_go_and_chance_words_stay(spark):
    """A word tells of an entity if documents say so, several of them; a word that stood beside one once does not."""
    from .conftest import prose

    texts = [f"{prose(i, 40)} project heron reports to kim@corp.example.org" for i in range(12)]
    texts += [f"{prose(50 + i, 40)} desk {i} of person{i}@firm.example.com is on the ninth floor" for i in range(9)]
    texts += [f"{prose(100 + i, 40)} only{i} wrote once{i} to someone{i}@place{i}.example.net" for i in range(80)]
    texts += [f"{prose(300 + i, 40)} heron" if i < 2 else prose(300 + i, 40) for i in range(200)]
    texts += ["an unsubscribe link of news@all.example.com"] * 300
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found, extra = pii.find_pii(docs)
    gone = {r.key: {texts[r.key][x.start : x.end].lower() for x in r.extra} for r in extra.collect()}
    assert {"heron", "project", "reports"} <= gone[0] and gone[101] == gone[102] == {"heron"}, "also where the address is not"
    assert {"ninth", "floor"} <= gone[12], "of a firm: no address comes twice"
    assert all(not {w for w in gone.get(i, ()) if w.startswith(("only", "once"))} for i in range(21, 101)), "chance"
    assert not {w for k, own in gone.items() for w in own if k < 301} & {"unsubscribe", "the", "of", "at"}
    assert {i: sorted([*map(tuple, r), *t]) for i, r, t in ((r.key, r.spans, [(x.start, 4, x.end) for e in extra.where(F.col("key") == r.key).collect() for x in e.extra]) for r in found.where("key < 8").collect())} == {
        i: s for i, s in disclosed([(i, t) for i, t in enumerate(texts)]) if i < 8
    }
    for n in (10**3, 10**6, 10**12):  # whatever the number of documents
        assert wilson(1, 1) < wilson(2, 2) < pii.GENERALISE < wilson(3, 3) and math.sqrt(1 / n) < pii.GENERALISE


def test_words_that_disclose(spark):
    """A code word that stands in for an address is replaced where the address is not, a common word nowhere; a hot entity and copies count."""
    from .conftest import prose

    texts = [f"{prose(i, 40)} agent nightjar writes to kim@corp.example.org" for i in range(20)]
    texts += [f"{prose(100 + i, 40)}" for i in range(400)]
    texts += [f"{prose(900, 20)} nightjar came", "nightjar"]
    texts += [f"{prose(901, 30)} press office info@hub.example.com"] * 100
    texts += [" ".join(f"u{k}@many.example.com" for k in range(300)) + " one list of all"]
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found, extra = pii.find_pii(docs)
    spans = {r.key: [*map(tuple, r.spans)] for r in found.collect()}
    terms = {r.key: [(x.start, x.kind, x.end) for x in r.extra] for r in extra.collect()}
    want = dict(disclosed(data))
    assert {i: sorted([*spans[i], *terms.get(i, [])]) for i in spans} == want
    assert want[421] == [(0, 4, 8)] and any(k == 4 for _, k, _ in want[420]) and not want[100]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("nightjar" not in t and "@" not in t for t in clean.values()) and all(clean[i] == texts[i] for i, own in want.items() if not own)


def test_sanitising(spark, docs, none):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    before = {i: t for i, t, *_ in rows() if i is not None}
    assert all("@" not in t for t in text.values() if t) and any("[EMAIL]" in t for t in text.values() if t)
    untouched = [i for i, own in disclosed(rows()) if not own and i not in (None, 5, 7)]
    assert len(untouched) > 50 and all(text[i] == before[i] for i in untouched)
    assert pii.sanitise(none).count() == 0
    assert pii.sanitised("abcdef", [(1, 0, 3, 0), (2, 4, 5, 1)]) == "a[EMAIL]f"


def test_word_counts(docs):
    want = Counter(w for _, t, *_ in rows() for w in set(ALNUM.findall(low(t))))
    got = pii.word_counts(docs, np.ones(pii.BITMAP_BITS, dtype=bool))
    assert Counter(r.n for r in got.collect()) == Counter(want.values())


# --- 4, language


def test_language(spark, sf, none):
    found = langid.op4_langid(spark, sf)
    got = defaultdict(list)
    for r in found.collect():
        got[r.doc_id].append(r)
    import zlib

    for i, t, lang, *_ in rows():
        r = got[i][0]
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        if i is not None and i < 70:
            assert r.lang_pred == lang
    assert sum(map(len, got.values())) == len(rows())
    empty = langid.train(none)
    assert [r.lang_pred for r in langid.predict(none, empty).collect()] == []
    one = spark.createDataFrame([(1, "abc", "xx")], "doc_id long, text string, lang string")
    assert langid.predict(one, empty).first().lang_pred == "und" and langid.predict(one, langid.train(one)).first().lang_pred == "xx"


def plain_kneser_ney(text, order=4):
    """Interpolated Kneser-Ney over a string, by dictionaries."""
    marked = " " + re.sub(r"[^a-z]+", " ", text.lower()).strip() + " "

    def gram(s, i, n):
        return "".join(s[j] if j >= 0 else " " for j in range(i - n + 1, i + 1))

    counts = [Counter(gram(marked, i, n) for i in range(len(marked))) for n in range(1, order + 1)]
    for n in range(order - 1):
        ways = Counter(g[1:] for g in counts[n + 1])
        counts[n] = Counter({g: ways.get(g, 1) for g in counts[n]})
    levels = []
    for c in counts:
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        total, kinds = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        levels.append((c, one / (one + 2 * two) if one and two else 0.5, total, kinds))

    def probability(g):
        p = 1 / (len(counts[0]) + 1)
        for n, (c, discount, total, kinds) in enumerate(levels):
            own = g[len(g) - n - 1 :]
            if total[own[:-1]]:
                p = (max(c[own] - discount, 0) if own in c else 0) / total[own[:-1]] + discount * kinds[own[:-1]] / total[own[:-1]] * p
        return p

    return lambda s: [probability(gram(s, i, order)) for i in range(len(s))]


def test_kneser_ney_is_that_of_a_direct_computation():
    text = "the cat sat on the mat, the end of that tale; a cat and a bat at tea"
    parts = langid.counted(pa.array([text]))
    model = langid.KneserNey([(*p[1:4], p[4].astype(float)) for p in parts], len(parts[0][1]))
    models = langid.Models(["xx"], [model])
    for other in ("the bat ate that cat", "zebra quiz", "end"):
        h, n, _ = models.entropies(pa.array([other]), {})
        want = plain_kneser_ney(text)(" " + other + " ")
        assert n[0] == len(want) and abs(h[0, 0] * n[0] + sum(map(math.log, want))) < 1e-4


def test_kneser_ney_sums_to_one():
    text = "abracadabra banana band"
    parts = langid.counted(pa.array([text]))
    model = langid.KneserNey([(*p[1:4], p[4].astype(float)) for p in parts], len(parts[0][1]))
    for context in ("a", "ba", "ana", "zzz", "d"):
        total = 0.0
        for c in sorted(set(text)):
            symbols, first = langid.letters(pa.array([context + c + "x"]))  # what follows keeps a space from being the last
            at = np.array([len(context) + 1])
            own = [langid.grams(symbols, first, k, at) for k in range(1, 5)]
            before = [np.zeros(1, np.uint64)] + [langid.grams(symbols, first, k, at - 1) for k in range(1, 4)]
            total += model.probability(own, before)[0]
        assert 0.8 < total <= 1.0001  # the rest is for symbols that were never seen


# --- 5, byte-level BPE


def test_bpe(spark, sf, docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, *_ in rows():
        ids = coder.encode_ordinary(t or "")
        want[i, len(ids), SHA(np.array(ids, "<u4").tobytes()), SHA(t or "")] += 1
    assert bag(bpe.op5_byte_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decode(bpe.encode(docs, with_offsets=True))
    assert Counter(r.decoded_text for r in back.collect()) == Counter(t or "" for _, t, *_ in rows())
    assert bpe.encode(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0


def test_bpe_has_the_ranks_of_the_tiktoken_file():
    import base64

    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = bpe.ByteBpe(bpe.vocabulary_path(), p.PATTERN)
    assert all(coder.bytes[i] == token for token, i in ranks.items())
    assert all(coder._merged(token.decode("utf-8")) == (i,) for token, i in ranks.items() if token.isascii() or _decodes(token))


def _decodes(token):
    try:
        return bool(token.decode("utf-8"))
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("text", ["", "naïve 日本語 🙂🙂 it's  I'll \n\n\t x", "<|endoftext|> plain", "'s'ss 're", "a b   c", "\x00\x7f", "é" * 2000])
def test_bpe_texts(text):
    import public_tokenizers as p

    coder = bpe.ByteBpe(bpe.vocabulary_path(), p.PATTERN, cached=2)
    ids = coder.encode(text)
    assert coder.encode(text) == ids and coder.decode(ids).decode() == text
    assert "".join(coder.decode_stream([[i] for i in ids])) == text
    start, end = coder.offsets(text, ids)
    assert len(start) == len(ids) and (not ids or (start[0] == 0 and end[-1] == len(text))) and all(a < b for a, b in zip(start, end, strict=True))
    assert len(set(bpe.byte_table())) == 256


# --- 6, near duplicates


def brute_classes(texts):
    sets = []
    for t in texts:
        w = ALNUM.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates(spark, sf, docs, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    data = rows()
    root = brute_classes([t for _, t, *_ in data])
    members = defaultdict(list)
    for k, r in enumerate(root):
        members[r].append(data[k][0])
    want = Counter((data[k][0], min((x for x in members[r] if x is not None), default=None)) for k, r in enumerate(root))
    found = stored(neardup.op6_neardup(spark, sf), "op6")
    assert bag(found, "doc_id", "class_id") == want
    blank = sum(not ALNUM.findall(low(t)) for _, t, *_ in data)
    assert found.where("stays").count() == len({r for k, r in enumerate(root) if ALNUM.findall(low(data[k][1]))}) + blank


def test_deduplication(spark, docs, none):
    data = rows()
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    root = brute_classes([t for _, t, *_ in data])
    texts = [t for _, t, *_ in data]
    blank = sum(not ALNUM.findall(low(t)) for t in texts)
    assert kept.count() == len({r for r, t in zip(root, texts, strict=True) if ALNUM.findall(low(t))}) + blank
    assert neardup.deduplicate(none).count() == 0


def test_registers_agree_as_often_as_sets_are_similar():
    n, shared = 300, 240
    a, b = np.arange(1, n + 1, dtype=np.uint64), np.arange(n - shared + 1, 2 * n - shared + 1, dtype=np.uint64)
    got = neardup.prob_min_hash(np.r_[np.zeros(n, int), np.ones(n, int)], np.r_[a, b], np.ones(2 * n), 2, 4000)
    assert abs(np.mean(got[0] == got[1]) - shared / (2 * n - shared)) < 0.03
    heavy = neardup.prob_min_hash(np.zeros(2, int), np.array([5, 6], np.uint64), np.array([3.0, 1.0]), 1, 4000)
    assert abs(np.mean(heavy == 5) - 0.75) < 0.03


def test_pairs_that_repeat_their_shingles_unevenly_are_found(spark):
    from .conftest import prose

    texts = []
    for k in range(40):
        w = prose(2000 + k, 200).split()
        n = len(w)
        passage = w[20 : 20 + 3 * n // 10]
        texts += [" ".join(w), " ".join([*w[: n - n // 12], *(f"other{k}x{i}" for i in range(n // 12)), *passage * 50])]
    root = brute_classes(texts)
    assert all(root[k] == k - k % 2 for k in range(len(texts)))
    found = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == dict(enumerate(root))


def test_a_text_beside_its_repetition_under_a_foreign_leader(spark, monkeypatch):
    from .conftest import prose

    base = prose(3000, 100)
    texts = [base, " ".join([base] * 3), *(prose(3001 + i, 100) for i in range(20))]
    assert brute_classes(texts) == [0, 0, *range(2, 22)]
    real = neardup.prints
    # one bucket for all, led by one of the 20 others
    monkeypatch.setattr(neardup, "prints", lambda *given: real(*given).withColumn("bands", F.array(F.lit(1).cast("long"))))
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert real(data, "doc_id", "text").orderBy(F.desc("node")).first().doc_id > 1
    assert {r.doc_id: r.class_id for r in neardup.classes(data).collect()} == dict(enumerate([0, 0, *range(2, 22)]))


# --- 7, repeated passages


def test_repeated_passages(spark, sf, docs, none):
    data = rows()
    first: dict[tuple, int] = {}
    for i, t, *_ in data:
        w = SPACED.findall(t or "")
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t, *_ in data:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[i, len(w), sum(gone), SHA(" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert sum(n for _, _, n, _ in want) > 500
    assert bag(substrings.op7_substrings(spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    runs = substrings.remove(docs).where("n_removed > 0").first()
    assert sum(x["end"] - x["start"] for x in runs.removed) == runs.n_removed
    assert substrings.remove(none).count() == 0


def window_names(part, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(recompress, "PART", part)
    for vocabulary in (2, 5, 400):
        word = tb.mix(rng.integers(1, vocabulary + 1, 4000).astype(np.uint64))
        copy = word[1000:1400]
        joined = np.concatenate([word, tb.mix(rng.integers(1, vocabulary + 1, 37).astype(np.uint64)), copy])
        first = np.array([0, 700, 4010, len(joined)])
        anchors, names = recompress.windows(joined, first, 13)
        by: dict[bytes, set] = defaultdict(set)
        for k in range(len(joined) - 12):
            if np.searchsorted(first, k, side="right") == np.searchsorted(first, k + 12, side="right"):
                by[joined[k : k + 13].tobytes()].add((int(anchors[k]), int(names[k])))
        yield by


@pytest.mark.parametrize("part", [1 << 18, 300])
def test_windows_are_named_by_their_symbols(part, monkeypatch):
    """Equal windows have equal anchors and names, different ones different names, also where a long text is parsed in parts."""
    for by in window_names(part, monkeypatch):
        assert max(map(len, by.values())) == 1
        assert len({name for found in by.values() for _, name in found}) == len(by)


def test_names_come_from_symbols(monkeypatch):
    """With one name for all symbols windows can't be told apart."""
    real = recompress.symbols

    def constant(*given):
        for name, *more in real(*given):
            yield np.ones_like(name), *more

    monkeypatch.setattr(recompress, "symbols", constant)
    by = next(window_names(1 << 18, monkeypatch))
    assert len({name for found in by.values() for _, name in found}) < len(by) / 2


def test_colliding_names_are_told_apart_by_their_words(spark):
    rows_ = [(1, 7, 100), (2, 7, 100), (3, 7, 200), (4, 7, 200), (5, 8, 1), (6, 8, 1), (7, 9, 1)]
    found = spark.createDataFrame(rows_, "doc_id long, name long, check long")
    assert {(r.name, r.check, r.least) for r in substrings.first_documents(found, "doc_id").collect()} == {(7, 100, 1), (7, 200, 3), (8, None, 5)}


# --- 8, quality


def test_quality(spark, sf, docs, none):
    found = quality.op8_quality(spark, sf).collect()
    assert len(found) == len(rows()) and all(0 <= r.quality_score <= 1 for r in found)
    kept = quality.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality_score for r in quality.scored(docs, quality.train(docs, no_labels)).select("quality_score").collect()} == {1.0}
    assert quality.scored(none, quality.train(none, no_labels)).count() == 0


def test_co_training_learns(spark):
    from .conftest import prose

    good = [(i, prose(i, 80), "en", f"s{i % 3}") for i in range(200)]
    bad = [(1000 + i, prose(i, 40).upper().replace(" ", "!! "), "en", "junk") for i in range(120)]
    data = spark.createDataFrame([(i, t, a, b, len(t)) for i, t, a, b in good + bad], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in (good + bad)[::2]], "doc_id long, quality int")
    score = {r.doc_id: r.quality_score for r in quality.scored(data, quality.train(data, labels)).collect()}
    right = sum((s >= 0.5) == (i < 1000) for i, s in score.items())
    assert right >= 0.98 * len(score)


def test_co_training_helps(spark):
    """Sources that no label covers: the content view's confident labels teach the metadata view, which judges texts that say nothing."""
    from .conftest import prose

    data = []
    for i in range(3_000):
        source = i % 30
        good = source % 2
        plain = i // 30 % 10 < 4  # four in ten texts are alike in good and bad sources
        text = prose(i, 40)
        shown = text if plain else text.replace(" ", "; ") if good else text.upper().replace(" ", "!! ")
        data.append((i, shown, "en", f"site{source}", 400, good, plain))
    docs = spark.createDataFrame([d[:5] for d in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, good) for i, *_, good, _ in data if i % 30 < 6 and i < 1_500], "doc_id long, quality int")

    def right(rounds):
        model = quality.train(docs, labels, rounds=rounds)
        score = {r.doc_id: r.quality_score for r in quality.scored(docs, model).collect()}
        held = [(score[i], good) for i, *_, good, plain in data if i % 30 >= 6 and plain]
        return sum((s >= 0.5) == bool(good) for s, good in held) / len(held)

    before, after = right(0), right(quality.ROUNDS)
    assert after > before + 0.2 and after > 0.8


def test_metadata_view_sees_no_text():
    def batch(text):
        return pa.RecordBatch.from_arrays([pa.array([text]), pa.array(["s"]), pa.array(["en"]), pa.array([5.0])], names=["__text", "source", "lang", "n_chars"])

    (a, x), (b, y) = quality.views(batch("some words")), quality.views(batch("||| 9 Ü\n"))
    assert (x == y).all() and not (a == b).all()


def test_co_training_takes_its_share_of_all_unlabelled_documents(spark, monkeypatch):
    from .conftest import prose

    texts = [prose(i, 30) if i % 3 else prose(i, 20).upper().replace(" ", "!! ") for i in range(5_000)]
    data = spark.createDataFrame([(i, t, "en", f"s{i % 7}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 5_000, 10)], "doc_id long, quality int")
    seen, real, sample, featured = [], quality.Unlabelled.given, [], quality._featured

    def given(self, history):
        seen.append(real(self, history))
        return seen[-1]

    monkeypatch.setattr(quality.Unlabelled, "given", given)
    monkeypatch.setattr(quality, "_featured", lambda found: sample.append(featured(found)) or sample[-1])
    monkeypatch.setattr(quality, "dropped", lambda df: None)
    model = quality.train(data, labels)
    assert model.n_unlabelled == 4_500  # no labelled document, and no sample of the others
    assert len(seen) == quality.ROUNDS
    # the fit by sums on workers is the fit on all rows at once
    labelled, y = sample[0]
    test = np.arange(500) % 4 == 3
    for v in (0, 1):
        rows_ = seen[-1].where(F.col("view") == v).collect()
        assert len(rows_) >= 0.02 * 4_500 * 0.9
        x = np.concatenate([labelled[v][~test], np.stack([np.frombuffer(r.x, np.float32) for r in rows_])])
        want = quality.Logistic(x.shape[1]).fit(x, np.r_[y[~test], [r.label for r in rows_]], np.r_[np.ones(375), np.full(len(rows_), 0.5)], steps=200)
        assert np.abs(want.w - model.models[v].w).max() < 1e-4


# --- 9, rules


def test_rules(spark, sf, none):
    want = Counter()
    for i, t, *_ in rows():
        t = t or ""
        w = SPACED.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if SPACED.search(line):
                again += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered), failed] += 1
    found = rules.op9_weak_supervision(spark, sf)
    assert bag(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not found.where("base_failed AND kept").count()
    assert rules.judged(stored(rules.measured(none), "none")).count() == 0


def test_verdicts_are_those_of_a_direct_computation(spark, docs):
    """Expectation-maximisation over documents one by one, in arrays."""
    measures = stored(rules.measured(docs), "measures")
    votes = [tuple(r) for r in measures.select(*rules.rule_votes().values()).collect()]
    x = np.array([[rules.VALUES.index(v) for v in p] for p in votes])
    n, k = x.shape
    average = np.stack([(x == v).sum(axis=0) + 1 for v in range(4)], axis=1) / (n + 4)
    theta = np.tile(average, (k + 1, 1, 1))
    theta[0] *= [rules.IF_GOOD[v] for v in rules.VALUES]
    for j in range(k):
        theta[j + 1, j] *= [rules.IF_BAD[v] for v in rules.VALUES]
    theta /= theta.sum(axis=2, keepdims=True)
    share = np.r_[rules.PRIOR_GOOD, np.full(k, (1 - rules.PRIOR_GOOD) / k)]
    weight = rules.PRIOR_WEIGHT * n * share
    cast = weight[:, None, None] * theta
    for turn in range(rules.ROUNDS + 1):
        p = share * np.exp(sum(np.log(theta[:, j, x[:, j]]) for j in range(k))).T
        p /= p.sum(axis=1, keepdims=True)
        if turn < rules.ROUNDS:
            share = (p.sum(axis=0) + weight) / (n + weight.sum())
            theta = cast + np.stack([np.stack([p.T @ (x[:, j] == v) for v in range(4)], axis=1) for j in range(k)], axis=1)
            theta /= theta.sum(axis=2, keepdims=True)
    got = sorted((r.doc_id or -1, r.posterior) for r in rules.judged(measures).collect())
    keys = [r.doc_id or -1 for r in measures.select("doc_id").collect()]
    assert np.allclose([x for _, x in got], [x for _, x in sorted(zip(keys, p[:, 0], strict=True))], atol=1e-6)
    assert 0 < sum(r.kept for r in rules.judged(measures).collect()) < n


def test_expectation_maximisation_finds_good_rules():
    import random

    r = random.Random(2)
    counts, truth = Counter(), defaultdict(Counter)
    for _ in range(5000):
        way = r.choice((0, 1, 2)) if r.random() < 0.2 else None
        wrong = (0.002, 0.01, 0.03)
        pattern = tuple(-2 if way == j and r.random() < 0.9 else -1 if way != j and r.random() < wrong[j] else r.choice((0, 0, 1)) for j in range(3))
        counts[pattern] += 1
        truth[pattern][way is None] += 1
    model = rules.Model(counts)
    right = sum(n for p, of in truth.items() for good, n in of.items() if (model.posterior(p)[0] >= 0.5) == good)
    assert right > 0.92 * 5000
    assert min(model.accuracies()) > 0.8 and abs(model.prior[0] - 0.8) < 0.1
    assert rules.Model({}).posterior(()) == [1.0]


# --- 10, benchmark


def test_contamination(spark, sf, docs, none):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    phrases = defaultdict(set)
    for r in items.collect():
        w = ALNUM.findall(low(r.text))
        for k in range(max(1, len(w) - 9) if w else 0):
            phrases[tuple(w[k : k + 10])].add("null" if r.item_id is None else str(r.item_id))
    want = Counter()
    for i, t, *_ in rows():
        w = ALNUM.findall(low(t))
        hit, who = set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    who |= phrases[tuple(w[k : k + n])]
        want[i, len(w), len(hit), len(who), SHA(",".join(sorted(who))), bool(hit)] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sum(x[2] > 0 for x in want) >= 2
    assert bag(decontaminate.op10_decontaminate(spark, sf), *columns) == want
    blocks = decontaminate.find_contamination(docs, items, block_bytes=100)
    assert Counter((r.doc_id, r.n_hit, len(r["items"])) for r in blocks.collect()) == Counter((x[0], x[2], x[3]) for x in want.elements())
    cut = decontaminate.decontaminate_stage(spark, docs, sf)
    assert cut.columns == docs.columns and all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())
    assert not decontaminate.find_contamination(cut.where("doc_id != 76"), items.where("item_id = 1")).where("n_hit > 0").count()
    assert decontaminate.find_contamination(none, items).count() == 0 and decontaminate.find_contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_a_hundred_thousand_phrases():
    """Flat arrays of some 24 bytes a word and the vocabulary; a shard's search finds what is planted, and only that."""
    import random

    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3_000)]
    items = [(i, " ".join(r.choices(vocabulary, k=60))) for i in range(2_000)]
    phrases = decontaminate.Phrases(items)
    n = sum(len(a) for _, a, *_ in phrases.by_length)
    assert n >= 100_000
    assert phrases.number.nbytes + sum(x.nbytes for of in phrases.by_length for x in of[1:]) < 30 * 120_000
    planted = [" ".join(items[k][1].split()[10:25]) for k in (5, 77, 1999)]
    texts = [" ".join(r.choices(vocabulary, k=3_000)) + " stop " + p + " stop" for p in planted] + ["nothing here"]
    w = tb.words(pa.array(texts), tb.ALNUM, True)
    at, length, item = decontaminate.search(w, phrases)
    row = np.searchsorted(w.first, at, side="right") - 1
    assert Counter(zip(row.tolist(), [int(phrases.names[i]) for i in item], strict=True)) == {(0, 5): 6, (1, 77): 6, (2, 1999): 6} and set(length.tolist()) == {10}
    assert sorted((at - w.first[row]).tolist()) == sorted([*range(3_001, 3_007)] * 3)


def test_fm_index():
    rng = np.random.default_rng(5)
    for alphabet in (1, 2, 7):
        s = rng.integers(0, alphabet + 1, 3000)
        s[-1] = 0
        index = fmindex.FmIndex(s, alphabet, every=5)
        for n in (1, 2, 5, 9):
            at = rng.integers(0, len(s) - n, 40)
            phrases = np.stack([s[a : a + n] for a in at])
            phrases = np.unique(phrases[(phrases > 0).all(axis=1)], axis=0)
            if not len(phrases):
                continue
            phrase, place = index.locate(*index.find(phrases))
            got = sorted(zip(phrase.tolist(), place.tolist(), strict=True))
            assert got == sorted((k, i) for k, p in enumerate(phrases) for i in range(len(s) - n + 1) if (s[i : i + n] == p).all())


# --- all


#: Names that operators use inside or for their results.
CLASH = """__text __hash __extra __node __key __of __stays __null __none __own0 __own1 __kept0 __kept1 __salt __parts __ids __key2 key text_hash spans entities terms
extra term class classes both row n_entity disclosure sure start end node bands band company stays class_id n_copies n_words n_shingles own size component leader weight
seq anchor times parts name check part at least most whole kept_text removed n_removed quality_score label x view kept n_hit hits items clean_text lang_pred score
cross_entropy rejected ids starts ends n_tokens ids_sha256 decoded_sha256 decoded decoded_text word_chars n_distinct n_repeat_words n_lines n_dup_lines n_symbols
n_upper n_stops n_shouts n_runs n_bars base_failed posterior of_words of_lines""".split()  # fmt: skip


@pytest.fixture(scope="module")
def clash(docs):
    given = docs.toDF(*docs.columns)
    return given.select("*", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(CLASH)])


def ours(df, columns):
    return Counter(tuple(str(r[df.columns.index(c)]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("few", [8, 1])
def test_sums_of_many_splits(spark, monkeypatch, few):
    """In one step or two, the sums over pseudo-labelled rows are those over all of them at once."""
    monkeypatch.setattr(quality, "SUMS", few)
    monkeypatch.setattr(quality, "SPLITS", 2)
    r = np.random.default_rng(4)
    x = [r.normal(size=(60, d)).astype(np.float32) for d in (5, 3)]
    label = [(r.random(60) < 0.5).astype(float) for _ in range(2)]
    rows = [(v, float(label[v][k]), x[v][k].tobytes()) for v in (0, 1) for k in range(60)]
    given = spark.createDataFrame(rows, "view int, label double, x binary").repartition(9)
    weights = [r.normal(size=6), r.normal(size=4)]
    for got, w, own, y in zip(quality._given_sums(given, weights), weights, x, label, strict=True):
        for a, b in zip(got, quality.newton_sums(w, own, y, np.full(60, 0.5)), strict=True):
            assert np.allclose(a, b)


STAGES = [quality.quality_stage, neardup.neardup_stage, decontaminate.decontaminate_stage, pii.pii_stage]


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_stages_with_clashing_columns(spark, sf, docs, none, clash, stage):
    """A stage gives the same documents whatever else they carry, and hands that on unchanged."""
    out = stage(spark, clash, sf)
    assert out.columns == clash.columns
    assert ours(out, docs.columns) == ours(stage(spark, docs, sf), docs.columns)
    assert all(r[len(docs.columns) + k] == f"v{k}" for r in out.collect() for k in range(len(CLASH)))
    assert stage(spark, none, sf).count() == 0


@pytest.mark.parametrize(
    ("run", "columns"),
    [
        (lambda d: bpe.encode(d), ["doc_id", "ids"]),
        (lambda d: bpe.round_trip(d, with_ids=True), ["doc_id", "text", "n_tokens", "ids"]),
        (lambda d: rules.judged(rules.measured(d)), ["doc_id", "n_words", "n_repeat_words", "base_failed", "kept"]),
        (lambda d: substrings.remove(d), ["doc_id", "n_words", "n_removed", "kept_text", "removed"]),
        (lambda d: langid.predict(d, langid.train(d.limit(0))), ["doc_id", "lang_pred", "score", "rejected"]),
        (lambda d: decontaminate.find_contamination(d, d.limit(3), item="doc_id"), ["doc_id", "n_words", "n_hit", "hits", "items"]),
        (lambda d: quality.scored(d, quality.CoTrained((np.zeros((0, 1)),) * 2, np.zeros(0), None)), ["doc_id", "text", "quality_score"]),
        (lambda d: pii.find_base(d), ["key", "spans", "entities"]),
        (lambda d: neardup.classes(d), ["doc_id", "node", "class_id", "stays", "n_copies"]),
    ],
    ids=["encode", "round_trip", "rules", "substrings", "langid", "contamination", "quality", "pii", "classes"],
)
def test_operators_with_clashing_columns(docs, none, clash, run, columns):
    """An operator's results are the same whatever columns there are; those it does not name are handed on."""
    few = docs.where("doc_id < 40 OR doc_id > 70 OR doc_id IS NULL") if "class_id" in columns else docs
    plain, odd = run(few), run(clash.join(few.select(F.col("doc_id").alias("d")).distinct(), clash["doc_id"].eqNullSafe(F.col("d")), "left_semi") if few is not docs else clash)
    assert ours(plain, columns) == ours(odd, columns)
    assert run(none).count() == 0


def test_one_very_long_text(monkeypatch):
    """Texts beyond the steps in which kernels work give the same as in one step."""
    from .conftest import prose

    text = prose(77, 3_000) + " " + "y" * 5_000 + " " + "again " * 500
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["__text"])
    w = tb.words(batch.column(0), tb.SPACED)
    coder = bpe._coder(None)
    found = []
    for step in (1 << 20, 997):
        for module, name in ((tb, "STEP"), (quality, "STEP"), (langid, "BLOCK"), (neardup, "BLOCK"), (bpe, "PIECES")):
            monkeypatch.setattr(module, name, step)
        tb._powers.cache_clear()
        counts = Counter()
        for n, gram, context, shorter, times in langid.counted(batch.column(0)):
            for g in zip(gram.tolist(), context.tolist(), shorter.tolist(), times.tolist(), strict=True):
                counts[n, *g[:3]] += g[3]
        h = w.hashes()
        row, shingle, times, *_ = neardup.shingles(batch.column(0))
        found.append((h.tolist(), tb.row_hashes(h, w.first).tolist(), [v.tolist() for v in quality.views(batch)], langid.letters(batch.column(0))[0].tolist(), counts, neardup.prob_min_hash(row, shingle, 1 + np.log(times), 1, 100).tolist(), list(map(int, coder.encode(text)))))
    tb._powers.cache_clear()
    for a, b in zip(*found, strict=True):
        assert a == b


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 13)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 18])
def test_meetings_in_parts(spark, monkeypatch, at_once):
    """Pairs of words and entity classes are the same however many are held at once; a row without words or classes has none."""
    rng = np.random.default_rng(3)
    terms = [list(map(int, rng.choice(40, k, replace=False))) for k in (9, 0, 23, 5, 1, 30)]
    classes = [[{"class": int(c), "n_entity": int(1 + 5 * (c % 3))} for c in rng.choice(20, k, replace=False)] for k in (3, 4, 0, 8, 1, 12)]
    level = np.where(np.arange(pii.BITMAP_BITS) % 3 == 0, 255, np.arange(pii.BITMAP_BITS) % 3 - 1).astype(np.uint8)
    of_class = pa.list_(pa.struct([("class", pa.int64()), ("n_entity", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(range(6)), pa.array(terms, pa.list_(pa.int64())), pa.array(classes, of_class)], names=["key", "text_hash", "terms", "classes"])

    source = mock.MagicMock()
    source.sparkSession.sparkContext.broadcast.side_effect = lambda value: mock.Mock(value=value)
    source.select.return_value.mapInArrow.side_effect = lambda run, schema: run
    monkeypatch.setattr(pii, "MEETINGS", at_once)
    got: Counter = Counter()
    for out in pii._meetings(source, level)([batch]):
        for r in out.to_pylist():
            got[r["class"], r["n_entity"], r["term"]] += r["both"]
    wanted = Counter((c["class"], c["n_entity"], t) for ts, cs in zip(terms, classes, strict=True) for t in ts for c in cs if level[t] != 255 and 4 ** int(level[t]) <= c["n_entity"])
    assert wanted and got == wanted
