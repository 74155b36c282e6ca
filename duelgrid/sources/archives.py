"""Zip archives of CSV files as a Spark data source: an entry is a partition, read as a stream."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from duelgrid.session import share_package

ROWS = 5000
#: Columns that tell where a row stood: the entry's number by name, and the row in it.
ENTRY, ROW = "_entry", "_row"


def opened(path: str) -> zipfile.ZipFile:
    """An archive of any file system that Arrow can seek in; only what is asked of it is read."""
    import pyarrow.fs as fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return zipfile.ZipFile(io.BufferedReader(system.open_input_file(inside)))


def tables_in(archive: zipfile.ZipFile) -> list[str]:
    return sorted(n for n in archive.namelist() if not n.endswith("/") and not n.startswith("__MACOSX"))


def frames(stream, rows: int | None = None) -> Iterator[pd.DataFrame]:
    """All columns as text; empty fields are null, as in Spark's own CSV reader."""
    made = pd.read_csv(stream, dtype=str, keep_default_na=False, na_values=[""], chunksize=ROWS, nrows=rows)
    return iter(made)


class ZipEntry(InputPartition):
    def __init__(self, number: int, name: str):
        self.number, self.name = number, name


class ZipCsvReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[ZipEntry]:
        with opened(self.path) as z:
            return [ZipEntry(k, n) for k, n in enumerate(tables_in(z))]

    def read(self, partition: ZipEntry) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema if f.name not in (ENTRY, ROW)]
        with opened(self.path) as z, z.open(partition.name) as stream:
            at = 0
            for df in frames(stream):
                n = len(df)
                columns = [pa.array(df[c].where(df[c].notna(), None), pa.string()) if c in df.columns else pa.nulls(n, pa.string()) for c in names]
                place = [pa.array([partition.number] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *place], names=[*names, ENTRY, ROW])
                at += n


class ZipCsv(DataSource):
    """spark.read.format("zipcsv").load("archive.csv.zip"): the text columns of the first entry, and where each row stood."""

    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as z, z.open(tables_in(z)[0]) as stream:
            names = list(next(frames(stream, 1), pd.DataFrame()).columns)
        return StructType([*(StructField(n, StringType()) for n in names), StructField(ENTRY, LongType()), StructField(ROW, LongType())])

    def reader(self, schema: StructType) -> ZipCsvReader:
        return ZipCsvReader(self.options["path"], schema)


def read_zip(spark: SparkSession, path: str, schema: str | None = None, order: str | None = None) -> DataFrame:
    """The rows of all CSV files of an archive, in columns as text or, where a schema is given, of its types; their place as column `order`."""
    share_package(spark)
    spark.dataSource.register(ZipCsv)
    text = spark.read.format("zipcsv").option("path", path).load()
    place = F.struct(F.lit(0).alias("source"), F.lit(path).alias("path"), F.col(ENTRY).alias("block"), F.col(ROW).alias("row"))
    places = [place.alias(order)] if order else []
    if schema is None:
        return text.select(*(f"`{c}`" for c in text.columns if c not in (ENTRY, ROW)), *places)
    kinds = dict(part.strip().replace("`", "").split(" ", 1) for part in schema.split(","))
    return text.select(*(F.col(f"`{c}`").try_cast(k).alias(c) for c, k in kinds.items()), *places)
