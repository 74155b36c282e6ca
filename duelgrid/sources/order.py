"""The order in which rows stand in files, whatever partitions Spark makes of them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORD = "ord"


def _is_scan(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def place(df: DataFrame, first: int = 0) -> Column:
    """A row's place: the number of its source, then file by path, block in the file, and row in the block.

    Spark reads larger files first and packs small ones together, so a row number over all partitions follows sizes. The
    rows of one block are read by one task, one after the other, so the running number orders them, and only them. df is a
    scan of files; other tables have no blocks, and their rows go by the running number alone.
    """
    path, block = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start")) if _is_scan(df) else (F.lit(""), F.lit(0).cast("long"))
    return F.struct(F.lit(first).alias("source"), path.alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("row"))


def in_load_order(df: DataFrame, name: str = ORD, first: int = 0) -> DataFrame:
    """df with the place of each row as a column; take it before any other step."""
    return df.withColumn(name, place(df, first))
