"""Which model each instruction is compared with."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.functions.text import fixed_map

# The datasets' own baselines; a mapping goes by category.
BASELINES: dict[str, str | Mapping[str, str]] = {
    "alpaca-eval": "gpt4_1106_preview",
    "arena-hard-v0.1": "gpt-4-0314",
    "arena-hard-v2.0": {
        "hard_prompt": "o3-mini-2025-01-31", "coding": "o3-mini-2025-01-31", "math": "o3-mini-2025-01-31",
        "creative_writing": "gemini-2.0-flash-001",
    },
    "m-arena-hard-v0.1": "CohereLabs/aya-expanse-8b",
    "m-arena-hard-v2.0": "google/gemini-2.5-flash",
    "mt-bench": "gpt-4",
}
# Languages of the multilingual tasks, their names, and the arenas of rating tasks.
EU_LANGUAGES = ("cs", "de", "el", "en", "es", "fr", "it", "nl", "pl", "pt", "ro", "uk")
OTHER_LANGUAGES = ("ar", "fa", "he", "hi", "id", "ja", "ko", "ru", "tr", "vi", "zh")
MULTILINGUAL = ("m-arena-hard-v0.1", "m-arena-hard-v2.0")
ARENAS = {"elo-lmarena-100k": "LMArena-100k", "elo-lmarena-140k": "LMArena-140k", "elo-lmarena": "LMArena", "elo-comparia": "ComparIA", "elo-lmarena-55k": "LMArena-55k"}


def split_multilingual(name: str) -> tuple[str, tuple[str, ...]] | None:
    """(dataset, languages) of `dataset`, `dataset-xx` or `dataset-EU`; None for another name."""
    for dataset in MULTILINGUAL:
        if name == dataset:
            return dataset, EU_LANGUAGES + OTHER_LANGUAGES
        suffix = name.removeprefix(f"{dataset}-")
        if suffix == "EU":
            return dataset, EU_LANGUAGES
        if suffix != name and suffix in EU_LANGUAGES + OTHER_LANGUAGES:
            return dataset, (suffix,)
    return None


def native_baseline(task: str) -> str | Mapping[str, str] | None:
    split = split_multilingual(task)
    return BASELINES.get(split[0] if split else task)


def with_baseline(instructions: DataFrame, task: str, model_b: str | None = None) -> DataFrame:
    """instructions with column model_b: one model for all, or by category; unknown categories are an error at run time."""
    chosen = model_b or native_baseline(task)
    if chosen is None:
        raise ValueError(f"task {task!r} has no baseline of its own; name a model")
    if isinstance(chosen, str):
        return instructions.withColumn("model_b", F.lit(chosen))
    if "category" not in instructions.columns:
        raise ValueError(f"task {task!r} picks its baseline by category, and there is no such column")
    found = fixed_map(F.col("category"), dict(chosen))
    unknown = F.raise_error(F.concat(F.lit("no baseline for category "), F.coalesce("category", F.lit("NULL")))).cast("string")
    return instructions.withColumn("model_b", F.coalesce(found, unknown))


def distinct_baselines(instructions: DataFrame) -> DataFrame:
    """(baselines, flat): the distinct baselines, sorted and joined by +, and whether there is one only; a run compares with few of them."""
    names = F.array_sort(F.collect_set("model_b"))
    return instructions.agg(F.array_join(names, "+").alias("baselines"), (F.size(names) == 1).alias("flat"))


def display_name(instructions: DataFrame) -> str:
    return distinct_baselines(instructions).head().baselines
