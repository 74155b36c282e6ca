"""Aligning instructions with model outputs by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_outputs(outputs: DataFrame, order: str = "ord") -> DataFrame:
    """The last output of each (instruction_index, model), a missing one as ''."""
    return outputs.groupBy("instruction_index", "model").agg(F.max_by(F.coalesce("output", F.lit("")), order).alias("output"))


def outputs_wide(outputs: DataFrame, models: list[str], order: str = "ord") -> DataFrame:
    """One row per instruction and one column per model, for display."""
    return outputs.groupBy("instruction_index").pivot("model", models).agg(F.max_by(F.coalesce("output", F.lit("")), order))


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def model_outputs(outputs: DataFrame, model: str, order: str = "ord") -> DataFrame:
    """instruction_index and completion of one model; only its rows are read."""
    return last_outputs(outputs.where(F.col("model") == model), order).select("instruction_index", F.col("output").alias("completion"))


def missing(instructions: DataFrame, completions: DataFrame, key: str = "instruction_index") -> DataFrame:
    return instructions.join(completions, key, "left_anti")


def check_covered(lost: DataFrame, name: str, key: str = "instruction_index") -> None:
    """Raise if there is a row in lost, naming the first five."""
    ids = [str(r[0]) for r in lost.select(key).orderBy(key).limit(6).collect()]
    if ids:
        raise ValueError(f"'{name}' answers all but {lost.count()} instruction(s). First missing ids: {', '.join(ids[:5])}.")


def align(instructions: DataFrame, completions: DataFrame, name: str, key: str = "instruction_index", strict: bool = True) -> DataFrame:
    """Inner join that, where strict, raises if any instruction has no completion."""
    if strict:
        check_covered(missing(instructions, completions, key), name, key)
    return instructions.join(completions, key)


def pair(instructions: DataFrame, a: DataFrame, b: DataFrame, key: str = "instruction_index", strict: bool = True) -> DataFrame:
    """instructions with completion_a and completion_b."""
    left = align(instructions, a.select(key, F.col("completion").alias("completion_a")), "A", key, strict)
    return align(left, b.select(key, F.col("completion").alias("completion_b")), "B", key, strict)


def per_row_baseline(instructions: DataFrame, outputs: DataFrame, order: str = "ord", strict: bool = False) -> DataFrame:
    """The completion of each row's own baseline (column model_b): one composite join; where strict, each row must have one."""
    last = last_outputs(outputs, order).withColumnsRenamed({"model": "model_b", "output": "completion_b"})
    if strict:
        check_covered(instructions.join(last, ["instruction_index", "model_b"], "left_anti"), "baselines by category")
    return instructions.join(last, ["instruction_index", "model_b"])


def with_fallback(precomputed: DataFrame, generated: DataFrame, key: str = "instruction_index") -> DataFrame:
    """Precomputed completions, and generated ones where there is none."""
    return precomputed.unionByName(generated.join(precomputed, key, "left_anti").select(*precomputed.columns))
