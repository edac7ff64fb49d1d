"""Giving the package to a session's workers, which else know only what is installed on their machines; folders that all of them share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> str:
    """Sends this package to all workers as a zip file; its name."""
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="corpusframe-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))  # Spark's file server hands it to each executor
    return str(target)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the one that spark.checkpoint.dir names; without that setting, as in tests, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows over as many tasks as a shuffle has, and four for each core at least, for work that costs far more than its bytes tell: a scan cuts
    its input by bytes, so a small file would be one task.  The number is given, so adaptive execution doesn't put the parts together again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)
