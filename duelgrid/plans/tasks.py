"""What each task's published data looks like and how a run goes over it: one table, which the command line walks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.operators.completions import model_outputs
from duelgrid.plans.baselines import EU_LANGUAGES, OTHER_LANGUAGES, split_multilingual
from duelgrid.sources import tables
from duelgrid.sources.files import entries, exists

#: Completions of a model, None where the data has none.
Completions = Callable[[str], "DataFrame | None"]
TABLE_SUFFIXES = (".csv", ".csv.zip", ".parquet", ".jsonl")


@dataclass
class Data:
    """Instructions (or two-turn questions), all outputs where the data has them in one table, and a model's completions."""

    instructions: DataFrame
    completions: Completions
    outputs: DataFrame | None = None


@dataclass(frozen=True)
class Task:
    #: A name, with * for any rest.
    pattern: str
    read: Callable[[SparkSession, str, str], Data] | None
    #: pairs, two_turns or ratings.
    run: str = "pairs"


def outputs_of(outputs: DataFrame | None) -> Completions:
    """Completions out of a table of instruction_index, model, output and ord."""

    def of(model: str) -> DataFrame | None:
        if outputs is None or outputs.where(F.col("model") == model).isEmpty():
            return None
        return model_outputs(outputs, model)

    return of


def _arena_hard(spark: SparkSession, root: str, task: str) -> Data:
    folder = f"{root}/{task}" if exists(spark, f"{root}/{task}") else root
    asked, outputs = tables.arena_hard(spark, folder)
    return Data(asked, outputs_of(outputs), outputs)


def _multilingual(spark: SparkSession, root: str, task: str) -> Data:
    _, languages = split_multilingual(task)
    asked = tables.multilingual(spark, root, languages, EU_LANGUAGES + OTHER_LANGUAGES)
    return Data(asked, lambda model: None)


def _two_turns(spark: SparkSession, root: str, task: str) -> Data:
    """Questions, answers a model and file, and the reference answers of another model where they are there."""
    folder = f"{root}/data/mt_bench" if exists(spark, f"{root}/data/mt_bench") else root
    reference = next((p for p in (f"{root}/reference_answer/gpt-4.jsonl", f"{folder}/reference_answer/gpt-4.jsonl") if exists(spark, p)), None)
    questions = tables.two_turn_questions(spark.read.json(f"{folder}/question.jsonl"), spark.read.json(reference) if reference else None)

    def answers(model: str) -> DataFrame | None:
        path = next((p for p in (model if model.endswith(".jsonl") else "", f"{folder}/model_answer/{model}.jsonl") if p and exists(spark, p)), None)
        return tables.two_turn_answers(spark.read.json(path)) if path else None

    return Data(questions, answers)


def _contexts(spark: SparkSession, root: str, task: str) -> Data:
    return Data(tables.contexts(spark, root, task), lambda model: None)


def _tables(spark: SparkSession, root: str, task: str) -> Data:
    """instructions/{task} and, where there is one, model_outputs/{task}, both below root or root/tables."""
    root = f"{root}/tables" if exists(spark, f"{root}/tables") else root

    def found(folder: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame | None:
        names = [n for n in entries(spark, f"{root}/{folder}") if any(n == f"{task}{s}" for s in TABLE_SUFFIXES)]
        return read(spark, f"{root}/{folder}/{names[0]}") if names else None

    asked, outputs = found("instructions", tables.read_table), found("model_outputs", tables.read_ordered)
    if asked is None:
        raise FileNotFoundError(f"no instructions/{task} below {root}")
    if outputs is not None:
        outputs = outputs.select("instruction_index", "model", F.coalesce("output", F.lit("")).alias("output"), "ord")
    return Data(asked, outputs_of(outputs), outputs)


#: The first pattern that fits counts.
TASKS = (
    Task("elo-*", None, "ratings"),
    Task("mt-bench", _two_turns, "two_turns"),
    Task("m-arena-hard-*", _multilingual),
    Task("arena-hard-*", _arena_hard),
    Task("*fluency*", _contexts),
    Task("*", _tables),
)


def task_of(name: str) -> Task:
    return next(t for t in TASKS if fnmatch(name, t.pattern))


def with_files(spark: SparkSession, data: Data) -> Data:
    """A model may be a file of its completions."""
    return Data(data.instructions, lambda m: tables.completion_file(spark, m) if m.endswith(TABLE_SUFFIXES) and exists(spark, m) else data.completions(m), data.outputs)
