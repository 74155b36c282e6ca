"""Run records: JSON coercion, fingerprints of samples and key sets, what ran where on what."""

from __future__ import annotations

import hashlib
import json
import math
import platform
from collections.abc import Iterator, Mapping
from datetime import datetime, timezone
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.session import share_package
from duelgrid.sources.files import files_below, write_text

#: Bytes that a task joins before it hands them on to the one that hashes.
PIECE = 1 << 20
DEPENDENCIES = ("pyspark", "pyarrow", "pandas", "numpy", "pyyaml")
METADATA = "run-metadata.json"


def to_jsonable(value: Any) -> Any:
    """Plain JSON values: NaN and infinities become null, numpy scalars numbers, sets sorted lists."""
    if isinstance(value, Mapping):
        return {str(k): to_jsonable(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((to_jsonable(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
    if isinstance(value, (list, tuple, np.ndarray)):
        return [to_jsonable(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def sha256_text(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


def _ascii_json(text: Column) -> Column:
    """A JSON string in ASCII: what JSON must escape, and characters beyond ASCII as \\uXXXX, in pairs beyond 16 bits."""

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        unit = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)))
        return F.when(code < 127, c).when(code == 127, c).when(code < 0x10000, unit(code)).otherwise(pair)

    text = F.to_json(F.array(text.cast("string")))
    text = text.substr(F.lit(2), F.length(text) - 2)
    return F.when(text.rlike("^[\\x00-\\x7f]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))


def listed_digest(rows: DataFrame, separator: str, name: str) -> DataFrame:
    """(name, n): sha256 over `[`, the texts of rows (o, j) in the order of o, with the separator between them, and `]`.

    Rows are dealt out by ranges of o and sorted in parallel, and each task joins its texts to pieces of a megabyte. A hash is one
    stream of bytes, so the pieces pass one task in order; it holds one of them at a time, and Spark sorts them on disk.
    """
    share_package(rows.sparkSession)
    kind = "part long, seq long, n long, piece binary"

    def joined(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def piece() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([separator.encode().join(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n", "piece"])

        for batch in source:
            for text in batch.column("j").to_pylist():
                held.append(text.encode())
                size += len(held[-1])
                if size >= PIECE:
                    yield piece()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield piece()

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(b"["), 0
        for batch in source:
            for count, text in zip(batch.column("n").to_pylist(), batch.column("piece").to_pylist()):
                if count:
                    digest.update((separator.encode() if n else b"") + text)
                n += count
        digest.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=[name, "n"])

    pieces = rows.select("o", "j").repartitionByRange("o").sortWithinPartitions("o").select("j").mapInArrow(joined, kind)
    # a row of no texts keeps the last task there when there are none
    none = rows.sparkSession.range(1).selectExpr("-1L part", "0L seq", "0L n", "cast('' as binary) piece")
    return pieces.unionAll(none).repartition(1).sortWithinPartitions("part", "seq").mapInArrow(hashed, f"{name} string, n long")


def sample_fingerprint(rows: DataFrame, order: str = "index") -> DataFrame:
    """(fingerprint, n): sha256 over the JSON list of a sample's index, model_a, model_b and question_id, by `order`, its sampled order."""
    index = F.when(F.col("index").cast("string").rlike(r"^-?\d+$"), F.col("index").cast("string")).otherwise(_ascii_json(F.col("index")))
    fields = [F.lit('{"index": '), index]
    for k in ("model_a", "model_b", "question_id"):
        fields += [F.lit(f', "{k}": '), _ascii_json(F.col(k))]
    return listed_digest(rows.select(F.col(order).alias("o"), F.concat(*fields, F.lit("}")).alias("j")), ", ", "fingerprint")


def set_hash(df: DataFrame, column: str) -> DataFrame:
    """(digest, n): sha256 of the sorted distinct values as compact JSON; order and repeats do not matter."""
    numeric = dict(df.dtypes)[column] in ("int", "bigint", "smallint", "tinyint")
    value = F.col(column).cast("string") if numeric else F.to_json(F.array(F.col(column))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(column)))) - 2)
    distinct = df.select(value.alias("j")).where("j is not null").distinct()
    return listed_digest(distinct.select(F.col("j").alias("o"), "j"), ",", "digest")


def as_json(value: Any) -> str:
    return json.dumps(to_jsonable(value), indent=2, sort_keys=True, allow_nan=False) + "\n"


def write_json(path: str | Path, value: Any, spark: SparkSession | None = None) -> None:
    """A JSON file: of any file system that Spark knows, or a local one where there is no session."""
    if spark is not None:
        write_text(spark, str(path), as_json(value))
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(as_json(value))


def environment() -> dict[str, str]:
    return {"python_version": platform.python_version(), "platform": platform.platform()}


def dependencies() -> dict[str, str]:
    """Versions of what runs; a package that is not there is left out."""
    out = {}
    for name in DEPENDENCIES:
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            continue
    return out


def source_revision(start: Path | None = None) -> str | None:
    """The commit of the checkout that this package runs from, if it is one."""
    for folder in (start or Path(__file__).resolve()).parents:
        git = folder / ".git"
        if git.is_dir():
            head = (git / "HEAD").read_text().strip()
            if not head.startswith("ref: "):
                return head
            ref = head.removeprefix("ref: ")
            if (git / ref).exists():
                return (git / ref).read_text().strip()
            packed = (git / "packed-refs").read_text().splitlines() if (git / "packed-refs").exists() else []
            return next((line.split()[0] for line in packed if line.endswith(f" {ref}")), None)
    return None


def inventory(spark: SparkSession, folder: str) -> list[dict[str, Any]]:
    """Path below folder and size of all that a run has left there, its record apart."""
    rows = [{"path": path.rsplit(f"{folder.rstrip('/').rsplit('/', 1)[-1]}/", 1)[-1], "bytes": size} for path, size in files_below(spark, folder)]
    return [r for r in rows if r["path"] != METADATA]


def run_metadata(
    entry: str, config: Any, results: Any, payloads: Mapping[str, DataFrame], artifacts: list = (), started: datetime | None = None,
    system_prompt: str | None = None, template: str | None = None, key: str = "instruction_index",
) -> dict:
    """A run's record: what ran, where, on how many rows of each payload, with which prompts, results and files."""
    now = datetime.now(timezone.utc)
    started = started or now
    keyed = next((df for df in payloads.values() if key in df.columns), None)
    return to_jsonable({
        "schema": 1, "entry": entry, "started": started.isoformat(), "finished": now.isoformat(), "duration_sec": (now - started).total_seconds(),
        "config": config, "results": results, "artifacts": sorted(artifacts, key=str), "dataset_statistics": {k: df.count() for k, df in payloads.items()},
        "environment": environment(), "dependencies": dependencies(), "git_hash": source_revision(),
        "key_set_sha256": None if keyed is None else set_hash(keyed, key).head().digest,
        "system_prompt_sha256": sha256_text(system_prompt), "template_sha256": sha256_text(template),
    })
