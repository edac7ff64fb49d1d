"""Small tables with all that documents shouldn't be: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone market garden winter letter bridge window doctor summer island yellow silver copper engine forest valley harbour thunder kitchen village".split()
GERMAN = "der die und nicht über straße garten fenster brücke mädchen schön größer vögel wälder häuser kälte müde früh spät zwölf".split()


def prose(seed: int, n: int, words: list[str] = WORDS) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        line = [r.choice(words) + (r.choice(["", "s", "ly", "ed", str(r.randint(0, 99))]) if r.random() < 0.5 else "") for _ in range(r.randint(5, 14))]
        out += line
        out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows() -> list[tuple]:
    base = [prose(i, 120) for i in range(40)] + [prose(100 + i, 120, GERMAN) for i in range(30)]
    texts: list[str | None] = list(base)
    texts += [base[0], base[0], base[1]]  # exact copies
    w = base[2].split(" ")
    texts.append(" ".join([*w[:60], "changed", *w[61:]]))  # a near copy
    passage = " ".join(prose(500, 60).split())
    texts += [base[3] + " " + passage, passage + " " + base[4], "start " + passage + " end"]
    texts += [None, "", "   \n\t ", "one", "###", "a b c d", "x" * 50_000, "word " * 3_000, prose(900, 20_000)]
    texts += ["mail me at ann.lee@example.com or +1 (555) 010-9999, ip 10.0.0.1, card 4111 1111 1111 1111."]
    texts += [f"contact codeword zebra{i % 3} bob@corp.example.org now {prose(700 + i, 15)}" for i in range(8)]
    out = [(i, t, "de" if 40 <= i < 70 else "en", f"src{i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[5], out[5]]  # repeated rows
    out += [(None, base[6], None, None, None), (None, base[7], "en", "src1", 3), (7, base[8], "en", "src1", 3)]  # no key, and a key twice
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark, docs, tmp_path_factory):
    """A folder with the tables that the queries read."""
    root = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{root}/documents.parquet")
    items = [(1, " ".join(prose(3, 120).split()[10:40])), (2, "Start here"), (2, "Start here"), (3, None), (4, ""), (None, "zebra1 BOB corp"), (10, " ".join(prose(3, 120).split()[12:42]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(60)] + [(61, None, 0), (None, 1, 0), (62, 1, 0), (62, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root
