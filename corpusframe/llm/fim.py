"""Fill-in-middle: a text cut at two places, its middle moved to the end, in SQL functions alone.

A delimiter that the text can't hold is put behind each unit (a run of letters A-Z, or one other code point): the text's own delimiters and escape
characters are escaped, one regexp_replace appends the delimiter to every unit, the delimiters are counted, substring_index takes the units before the
first place, between the two and behind the second, and the parts are unescaped.  Nothing is shuffled, and a text costs time and memory by its length.

The places, and whether a text is cut at all, follow from a digest of seed and document key, so a rerun or another partitioning gives the same rows.

Defined results: a null text counts as the empty one; empty texts, and texts that hold a marker, stay as they are (form `plain`).  A null key is
hashed as the empty word.  Repeated rows give repeated rows, an empty table an empty one.  Columns with any names are handed on, but for those
named as a result, which are replaced.  The two places may be equal (an empty middle), or at either end (an empty prefix or suffix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import shielded, table, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
CUT = 90  # of a hundred texts that may be cut
SPM = 20  # of a hundred cut texts: suffix first
MARK, ESCAPE = "\x01", "\x02"
UNIT = f"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def escaped(text: Column) -> Column:
    """The text without MARK: every ESCAPE in it is followed by 0 or 1."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(MARK), F.lit(f"{ESCAPE}1"))


def plain(part: Column) -> Column:
    """A stretch of marked units as it was in the text."""
    return F.replace(F.replace(F.replace(part, F.lit(MARK)), F.lit(f"{ESCAPE}1"), F.lit(MARK)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def units(marked: Column, count: Column) -> Column:
    """The first units, or with a negative count what is behind the delimiter that is so many from the end."""
    return F.call_function("substring_index", marked, F.lit(MARK), count.cast("int"))


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits for a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


@shielded("text", "key")
def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, cut: int = CUT, spm: int = SPM, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """All columns, and: n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output."""
    keep = docs.columns
    p, s, m = (F.lit(x) for x in markers)
    whole, marked, n = F.col("__text"), F.col("__marked"), F.col("n")
    first, second, form = F.col("__first"), F.col("__second"), F.col("form")
    held = whole.contains(markers[0]) | whole.contains(markers[1]) | whole.contains(markers[2])
    out = docs.withColumn("__text", text_of(docs, text)).withColumn("__draws", F.array(*draws(F.col(key), seed)))
    out = out.withColumn("__marked", F.regexp_replace(escaped(whole), UNIT, f"$0{MARK}"))
    out = out.withColumn("n", (F.length(marked) - F.length(F.replace(marked, F.lit(MARK)))).cast("long"))
    draw = lambda k: F.get("__draws", F.lit(k))
    one, other = draw(0) % (n + 1), draw(1) % (n + 1)
    out = out.withColumns(
        {
            "__first": F.least(one, other),
            "__second": F.greatest(one, other),
            "form": F.when((whole == "") | held | (draw(2) % 100 >= cut), "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm"),
        }
    )
    parts = F.struct(
        plain(units(marked, first)).alias("p"),
        plain(units(units(marked, second), first - second)).alias("m"),  # of second - 1 delimiters, the one behind the prefix
        plain(units(marked, second - n - 1)).alias("s"),
    )
    out = out.withColumn("__parts", F.when(form != "plain", parts))
    of = lambda name: F.col(f"__parts.{name}")
    return out.select(
        *keep,
        n,
        form,
        F.length(of("p")).cast("long").alias("prefix_chars"),
        F.length(of("m")).cast("long").alias("middle_chars"),
        F.when(form == "psm", F.concat(p, of("p"), s, of("s"), m, of("m"))).when(form == "spm", F.concat(s, of("s"), p, of("p"), m, of("m"))).otherwise(whole).alias("output"),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text from output and form alone; no part of a cut text holds a marker, so the markers found are those that were put there."""
    p, s, m = markers
    front, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    before, after = F.substring_index(front, p, -1), F.substring_index(front, s, -1)
    psm = F.concat(F.substring_index(before, s, 1), middle, after)
    spm = F.concat(before, middle, F.substring_index(after, p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
     h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(CAST('0x' || d[1:8] AS UBIGINT) AS BIGINT) AS h1, CAST(CAST('0x' || d[9:16] AS UBIGINT) AS BIGINT) AS h2, CAST(CAST('0x' || d[17:24] AS UBIGINT) AS BIGINT) AS h3, CAST(CAST('0x' || d[25:32] AS UBIGINT) AS BIGINT) AS h4 FROM t),
     f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
     c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
