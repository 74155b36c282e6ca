"""Helpers shared by the training-data operators: table access, scratch tables, Arrow task plumbing."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.session import share_package

#: Rows and bytes of a batch that Spark hands to a Python task. Documents are some kilobytes on average and a few are
#: much longer, so a small batch keeps a worker's memory bounded.
ARROW_ROWS, ARROW_BYTES = 1000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python task gets at once, and let workers import this package from where the driver has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    share_package(spark)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def let_go(spark: SparkSession) -> None:
    """Let go of shuffle files of steps that are done: Spark deletes them once the driver's JVM has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to a new table in the shared scratch folder and read it back.

    This cuts lineage with replicated, column-pruned storage: a lost executor never forces the upstream stages to
    run again, and several readers share one computation. Before that, shuffle files of steps that are written already are
    let go of.
    """
    let_go(df.sparkSession)
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more: what was made of them is written by now."""
    for t in tables:
        files, spark = t.inputFiles(), t.sparkSession
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def hash_bound(most: int, rows: int) -> int:
    """The 64-bit hash up to which about `most` of `rows` rows lie; all of them, if there are no more."""
    return 2**63 - 1 if rows <= most else max(-(2**63), most * 2**64 // rows - 2**63 - 1)


def hashed_sample(df: DataFrame, most: int) -> DataFrame:
    """About `most` different rows (all, if there are fewer) by a hash of the whole row, rows that repeat once.

    There is no sort, no row of the others is moved, and a row that repeats without end cannot fill the sample.
    """
    return df.where(F.xxhash64(*df.columns) <= hash_bound(most, df.count())).dropDuplicates()


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; NULL for a NULL doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def crc_mod_py(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column, a null as the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


def joined(source: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about `most` bytes, for work that is done once per distinct value of a batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in source:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def batches(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def chunked(items: Iterable, size: int) -> Iterator[list]:
    out: list = []
    for x in items:
        out.append(x)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out
