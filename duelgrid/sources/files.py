"""Files of any file system that Spark knows, from the driver: names, texts, and writes that readers see whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _opened(spark, path)
    return system.exists(at)


def entries(spark: SparkSession, folder: str) -> list[str]:
    """Names below a folder, in order; none where it does not exist."""
    at, system = _opened(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def files_below(spark: SparkSession, folder: str, enter: Callable[[str], bool] = lambda name: True) -> Iterator[tuple[str, int]]:
    """Path and size of each file at any depth below folder, folders in order; one whose name `enter` refuses is not even listed."""
    at, system = _opened(spark, folder)
    if not system.exists(at):
        return
    for status in sorted(system.listStatus(at), key=lambda s: s.getPath().getName()):
        name, path = status.getPath().getName(), status.getPath().toString()
        if name.startswith((".", "_")):
            continue
        if not status.isDirectory():
            yield path, status.getLen()
        elif enter(name):
            yield from files_below(spark, path, enter)


def read_text(spark: SparkSession, path: str) -> str:
    at, system = _opened(spark, path)
    stream = system.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside its place and rename it there, over what was there before."""
    jvm = spark._jvm
    at, system = _opened(spark, path)
    system.mkdirs(at.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    whole = system.makeQualified(at)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration()).rename(system.makeQualified(beside), whole, how)
