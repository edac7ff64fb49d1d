"""What the jobs share: config files, the command line, the log, counts of what passes by."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


def config(job: str, given: str | None = None) -> dict:
    """The job's config file, and over it a file of the user's."""
    out = json.loads((Path(__file__).parent / f"{job}.json").read_text())
    return out | (json.loads(Path(given).read_text()) if given else {})


def counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """The rows, counted on their way, so no pass is made for the log."""
    seen = Observation(f"count-{uuid.uuid4().hex}")
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def opened(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table, with the types it was written with; without a row where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))


def command(job: str, text: str, arguments: list[str], run: Callable, given: list[str] | None = None) -> dict:
    """Runs a job from the command line, in a session of its own.  `run` takes the session, the arguments in order and the config."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=text)
    for a in arguments:
        p.add_argument(f"--{a}", required=True)
    p.add_argument("--config", help=f"a JSON file with values that replace those of {job}.json")
    a = p.parse_args(given)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from corpusframe.sources import session

    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        session.ship(spark)
        return run(spark, *[getattr(a, x) for x in arguments], config(job, a.config))
    finally:
        spark.stop()


def total(name: str) -> Column:
    """A sum that is 0 of no rows."""
    return F.coalesce(F.sum(name), F.lit(0)).cast("long")
