"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusframe.llm.bpe import op5_byte_bpe
from corpusframe.llm.chat import op3_chat
from corpusframe.llm.decontaminate import op10_decontaminate
from corpusframe.llm.fim import OP11_SQL, op11_fill_in_middle
from corpusframe.llm.langid import op4_langid
from corpusframe.llm.lines import OP12_SQL, op12_line_dedup
from corpusframe.llm.neardup import op6_neardup
from corpusframe.llm.oracles import OP6_SQL, OP7_SQL, OP10_SQL
from corpusframe.llm.pii import op1_pii
from corpusframe.llm.quality import op8_quality
from corpusframe.llm.rules import op9_weak_supervision
from corpusframe.llm.substrings import op7_substrings
from corpusframe.llm.warc import OP2_SQL, op2_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_warc": op2_warc,
    "op3_chat": op3_chat,
    "op4_langid": op4_langid,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_neardup": op6_neardup,
    "op7_substrings": op7_substrings,
    "op8_quality": op8_quality,
    "op9_weak_supervision": op9_weak_supervision,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_line_dedup": op12_line_dedup,
}

ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op6_neardup": OP6_SQL, "op7_substrings": OP7_SQL, "op10_decontaminate": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_line_dedup": OP12_SQL}
