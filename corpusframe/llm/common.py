"""What the operators of this subpackage share: reading tables, tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.llm.textbytes import PIECE_BYTES, pieces


BATCH_BYTES = 8_000_000
_MALLOC: list = []
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For rows of some MB.  Parquet's reader and writer hold a row group at once, and the writer keeps each group's least and largest value until the file ends.
ROW_BY_ROW = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false"}


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark cut the Arrow batches that it sends to workers by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Hands memory that a worker has freed back to the system; workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if not _MALLOC:
        try:
            _MALLOC.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):
            _MALLOC.append(lambda _: 0)
    _MALLOC[0](0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which spark.checkpoint.dir names.  A folder of the driver's own machine is no substitute on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpusframe-shared"  # driver and executors are one process


def stored(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts the lineage: lost executors cost no recomputation.

    The shuffles that led to it are removed with the write's end, so disk holds those of one step at most.  With `large_rows` a task
    holds one row at a time, and not all rows that fit a row group when compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**ROW_BY_ROW if large_rows else {}).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shielded(*own: str) -> Callable:
    """For a function (docs, ...) -> DataFrame that reads some columns and hands all others on: while it runs the others have
    names of no meaning, so none clashes with a name that it uses inside; then all have their names again.  `own` names the columns that it
    reads, or parameters that hold their names.

    A result column that the function adds wins over a column of the same name that was handed in."""

    def around(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = signature(run)

        @wraps(run)
        def go(docs: DataFrame, *given, **more) -> DataFrame:
            bound = names.bind(docs, *given, **more)
            bound.apply_defaults()
            read = {bound.arguments.get(c, c) for c in own}
            apart = {f"__kept{k}": c for k, c in enumerate(docs.columns) if c not in read}
            back = {c: k for k, c in apart.items()}
            out = run(docs.toDF(*[back.get(c, c) for c in docs.columns]), *given, **more)
            added = {c.lower() for c in out.columns if c not in apart}
            wanted = [c for c in out.columns if apart.get(c, "").lower() not in added]
            return out.select(*wanted).toDF(*[apart.get(c, c) for c in wanted])

        return go

    return around


HOT_KEYS = 100_000


def salted(left: DataFrame, right: DataFrame, on: list[str], times: str, row: list[str], rows: int) -> DataFrame:
    """Inner join on columns without nulls where `right` has one row a key and, in the column `times`, how many rows of `left` have the key.

    A key with more than max(500, rows / HOT_KEYS) of the left table's `rows` is dealt over several parts by a hash of the columns
    `row`, so no task gets them all; there are HOT_KEYS such keys at most, which bounds what is broadcast."""
    unit = max(500, rows // HOT_KEYS)
    parts = F.ceil(F.col(times) / unit).cast("int")
    dealt = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    hot = right.where(F.col(times) > unit).select(*on, parts.alias("__parts"))
    marked = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*row), F.col("__parts")), F.lit(0)).cast("int"))
    return marked.drop("__parts").join(dealt, [*on, "__salt"]).drop("__salt")


def fields(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with further fields."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, with null as the empty text."""
    bounded_batches(df.sparkSession)
    return F.coalesce(df[column].cast("string"), F.lit(""))


def over_pieces(run: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", limit: int = PIECE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands on slices of bounded size."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, limit):
                out = run(piece)
                if out is not None and out.num_rows:
                    yield out
            give_back()

    return go


def bitmap(df: DataFrame, name: str, bits: int) -> np.ndarray:
    """Which remainders modulo `bits` (a power of two) a long column has: some rows of 4 KB, whatever the number of values."""
    bit = F.col(name).bitwiseAND(F.lit(bits - 1))
    rows = df.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(bits + 2 * 32_768, dtype=bool)
    for r in rows:  # bucket b holds the values from (b - 1) * 32768 + 1 on, and bucket 0 the value 0
        held = np.unpackbits(np.frombuffer(bytes(r.bits), dtype=np.uint8), bitorder="little").astype(bool)
        if r.bucket == 0:
            out[0] |= held[0]
        else:
            at = (r.bucket - 1) * 32_768 + 1
            out[at : at + len(held)] |= held
    return out[:bits]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lists(values: pa.Array, sizes) -> pa.ListArray:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
