"""Results of earlier runs, as Parquet tables named by what made them: settings and the content of the tables that went in."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.sources.files import entries, exists

ATOMIC = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def cache_token(**inputs: object) -> str:
    """16 hex digits over all inputs, in the order of their names."""
    text = "\n".join(f"{k}={v!r}" for k, v in sorted(inputs.items()))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def row_text(df: DataFrame) -> Column:
    """A row as text that no other row has: columns by name, each value with its length; a null has none."""

    def told(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        value = c.cast("string") if kind in ATOMIC or kind.startswith("decimal") else F.hex(c) if kind == "binary" else F.to_json(F.struct(c))
        return F.concat(F.lit(f"{len(name)}:{name}="), F.coalesce(F.concat(F.length(value), F.lit(":"), value), F.lit("-")))

    return F.concat_ws(";", *(told(n, k) for n, k in sorted(df.dtypes)))


def table_digest(df: DataFrame) -> DataFrame:
    """(n, total_1, total_2, mixed_1, mixed_2): rows, and sums and exclusive ors of two halves of their hashes.

    The order of rows and their partitions make no difference, repeated rows do. One scan with partial sums.
    """
    digest = F.md5(row_text(df).cast("binary"))
    halves = {f"h{k}": F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint") for k, start in ((1, 1), (2, 17))}
    totals = [F.coalesce(F.sum(F.col(f"h{k}").cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"total_{k}") for k in (1, 2)]
    mixed = [F.coalesce(F.bit_xor(f"h{k}"), F.lit(0).cast("bigint")).alias(f"mixed_{k}") for k in (1, 2)]
    return df.select(*(c.alias(n) for n, c in halves.items())).agg(F.count("*").alias("n"), *totals, *mixed)


def content(df: DataFrame) -> str:
    """What tells a table's columns and rows from others', whatever their order."""
    return cache_token(columns=sorted(df.dtypes), rows=tuple(table_digest(df).head()))


def latest(spark: SparkSession, path: str) -> str | None:
    """The newest whole version of a table; Spark marks a write that has ended, in any file system."""
    whole = [n for n in entries(spark, path) if n.startswith("v-") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return f"{path}/{whole[-1]}" if whole else None


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], ignore: bool = False) -> DataFrame:
    """The newest version of the table at path, made first where there is no whole one (or it is ignored).

    Each writer has a folder of its own, so two that write at once leave two whole versions and spoil neither; a version that
    is being read is never replaced. Types are declared, so "NA" stays text.
    """
    found = None if ignore else latest(spark, path)
    if found is None:
        found = f"{path}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        make().write.parquet(found)
    return spark.read.parquet(found)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir; in local mode a temporary one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, name: str, make: Callable[[], DataFrame], folder: str | None = None, ignore: bool = False, given: tuple[DataFrame, ...] = (), **inputs: object) -> DataFrame:
    """What make gives, computed once: below `folder`, to be found again, else in scratch.

    Its name there is made of the inputs and of the content of the given tables, which are what it is made from.
    """
    path = scratch(spark, name)
    if folder:
        path = f"{folder}/{name}-{cache_token(given=[content(df) for df in given], **inputs)}"
    return cached(spark, path, make, ignore)
