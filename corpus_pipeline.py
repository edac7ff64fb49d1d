"""A training-data pipeline: each stage takes all documents that its predecessor kept.

Five stages, as they are dealt: quality classifier, near duplicates, benchmark passages, personal data, token ids.  The first four hand on the
columns of the documents, whatever they are called; the last adds n_tokens, ids and the digests of ids and decoded bytes to them.  WARC archives,
conversations, language, repeated passages and quality rules are operators of their own (`corpusframe.llm`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusframe.llm.bpe import bpe_stage
from corpusframe.llm.common import stored, table
from corpusframe.llm.decontaminate import decontaminate_stage
from corpusframe.llm.neardup import neardup_stage
from corpusframe.llm.pii import pii_stage
from corpusframe.llm.quality import quality_stage

STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontaminate_stage),
    ("personal_data", pii_stage),
    ("byte_bpe", bpe_stage),
]

#: A trained classifier and sketches can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
