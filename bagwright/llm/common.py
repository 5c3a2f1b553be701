"""Shared plumbing: scratch tables in the cluster's shared folder and Arrow batch mapping."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of text an Arrow batch holds at most; the default of 10,000 is too many for long texts.
ARROW_ROWS = 500
#: Rows of text that Parquet's reader decodes at once at most; the default of 4,096 takes a task's heap tens of MB, of long texts hundreds.
READ_ROWS = 128


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset and Spark runs on one machine, one of ours."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + _own_folder()
    return folder.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="bagwright-")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a Parquet table in the shared folder and returns a scan of it.

    This cuts lineage: a lost executor costs a re-read, not a recomputation. discard() removes a table
    that nothing reads any more; the others stay until the cluster clears its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bagwright/{tag}-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables of materialize(); other DataFrames are let be."""
    for df in tables:
        if df is not None and (path := vars(df).get("_scratch")):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column of `taken` has it (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, unless the session has a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def small_reads(spark: SparkSession) -> None:
    """Bounds the rows that Parquet's reader decodes at once, unless the session has a smaller bound."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if not 0 < int(spark.conf.get(key, "4096")) <= READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with state: make() runs once per task and gives the function for its batches."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives memory that a task has freed back to the machine: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def held_out(doc_id, mod: int, rest: int):
    """Column: crc32 of doc_id as text, modulo mod, is rest. A null doc_id counts as the empty text."""
    from pyspark.sql import functions as F

    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod) == rest
