"""Asking models: a provider registry, retries inside tasks, judge and completion stages as mapInPandas.

A provider makes either a function of many prompts or a coroutine of one. Coroutines run on one event loop a task, with a
bounded window of requests under way.
"""

from __future__ import annotations

import asyncio
import inspect
import re
import time
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duelgrid.functions.text import THINKING_MODELS, category_temperature, truncate
from duelgrid.session import share_package

#: prompts -> answers, or a coroutine of one prompt
Model = Callable[[list[str]], list[str]] | Callable[[str], Awaitable[str]]
#: (name without provider, options) -> a model; called inside the task, so clients are never pickled, only what makes them.
Provider = Callable[[str, dict], Model]
PROVIDERS: dict[str, Provider] = {}
RETRIED = re.compile(r"\b(408|409|425|429|500|502|503|504|529)\b|timed? ?out|connection|overloaded|rate limit", re.I)
ATTEMPTS, FIRST_WAIT, SPLIT = 5, 1.0, 4
#: Requests that a task has under way at once.
WINDOW = 32
NO_FOLLOW_UP = "No follow-up question."
# Fixed value: tokens that a local engine lets a thinking judge think.
THINKING_BUDGET = 512


def provider(name: str) -> Callable[[Provider], Provider]:
    def register(f: Provider) -> Provider:
        PROVIDERS[name] = f
        return f

    return register


@provider("Dummy")
def dummy(name: str, options: dict) -> Model:
    """Answers every prompt with its own name."""
    return lambda prompts: [name] * len(prompts)


def judge_defaults(spec: str, engine_kwargs: dict, override: dict) -> dict:
    """Engine settings of a judge: only a local engine takes the evaluated model's, a bound on thinking and, for 8-bit weights, an 8-bit cache."""
    kind, _, name = spec.partition("/")
    if kind != "VLLM":
        return dict(override)
    made, low = {**engine_kwargs, **override}, name.lower()
    if any(k in low for k, _ in THINKING_MODELS):
        made.setdefault("thinking_token_budget", THINKING_BUDGET)
    if "fp8" in low:
        made.setdefault("kv_cache_dtype", "fp8")
    return made


def provider_of(spec: str) -> tuple[Provider, str]:
    kind, _, name = spec.partition("/")
    if kind not in PROVIDERS:
        raise ValueError(f"unknown provider {kind!r}; registered: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[kind], name


def make_model(spec: str, **options: object) -> Model:
    make, name = provider_of(spec)
    return make(name, dict(options))


def ask(model: Model, prompts: list[str], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Answers in order. After a passing failure only the unanswered rest is asked again, in ever smaller chunks."""
    answers: list[str] = []
    for attempt in range(attempts):
        size = max(1, -(-len(prompts) // SPLIT**attempt))
        try:
            while len(answers) < len(prompts):
                answers += model(prompts[len(answers) : len(answers) + size])
            return answers
        except Exception as e:  # what a client raises is its own affair
            if attempt == attempts - 1 or not RETRIED.search(str(e)):
                raise
            sleep(wait * 2**attempt)
    return answers


def is_coroutine(model: Model) -> bool:
    return inspect.iscoroutinefunction(model) or inspect.iscoroutinefunction(getattr(model, "__call__", None))


async def ask_each(
    model: Callable[[str], Awaitable[str]], prompts: list[str], window: int = WINDOW, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT,
    sleep: Callable[[float], Awaitable[None]] = asyncio.sleep,
) -> list[str]:
    """Answers in order, with at most `window` requests under way.

    A prompt that fails in passing is asked again, it alone, after a wait that doubles; meanwhile its place in the window is
    free for others. Any other failure ends all.
    """
    answers: list[str | None] = [None] * len(prompts)
    places = asyncio.Semaphore(max(1, window))

    async def one(k: int) -> None:
        for attempt in range(attempts):
            try:
                async with places:
                    answers[k] = await model(prompts[k])
                return
            except Exception as e:  # what a client raises is its own affair
                if attempt == attempts - 1 or not RETRIED.search(str(e)):
                    raise
            await sleep(wait * 2**attempt)

    # no more tasks than may be of use, however many prompts there are
    left = iter(range(len(prompts)))

    async def worker() -> None:
        for k in left:
            await one(k)

    async with asyncio.TaskGroup() as group:
        for _ in range(min(len(prompts), 2 * max(1, window))):
            group.create_task(worker())
    return answers


class Asker:
    """A task's way to its models: one event loop for all coroutines."""

    def __init__(self, window: int):
        self.window, self.loop = window, None

    def __call__(self, model: Model, prompts: list[str]) -> list[str]:
        if not is_coroutine(model):
            return ask(model, prompts)
        self.loop = self.loop or asyncio.new_event_loop()
        try:
            return self.loop.run_until_complete(ask_each(model, prompts, self.window))
        except* Exception as e:
            first = e.exceptions[0]
        raise first

    def close(self) -> None:
        if self.loop:
            self.loop.close()


def complete(
    df: DataFrame, spec: str, prompt: str = "prompt", output: str = "completion", heat: str | None = None, window: int = WINDOW, **options: object
) -> DataFrame:
    """df with a column of the model's answers; partitions are asked in parallel.

    A partition has one model, or one for each value of the column `heat`, its temperature, whose rows are asked together:
    rows are sorted by it inside their partitions, so that a batch rarely holds two. A coroutine is asked for at most `window`
    prompts at a time.
    """
    df = df.sortWithinPartitions(heat) if heat else df
    share_package(df.sparkSession)
    schema = StructType([*df.drop(output).schema, StructField(output, StringType())])
    make, name = provider_of(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[object, Model] = {}
        asker = Asker(window)
        try:
            for b in batches:
                b = b.assign(**{output: ""})
                for t, rows in b.groupby(heat, dropna=False) if heat else [(None, b)]:
                    if t not in models:
                        models[t] = make(name, options | ({"temperature": float(t)} if heat else {}))
                    if len(rows):
                        b.loc[rows.index, output] = asker(models[t], rows[prompt].fillna("").tolist())
                yield b
        finally:
            asker.close()

    return df.drop(output).mapInPandas(run, schema)


def complete_instructions(instructions: DataFrame, spec: str, limit: int | None = None, **options: object) -> DataFrame:
    """instruction_index and completion of a model asked for each instruction, cut to length."""
    asked = instructions.select("instruction_index", truncate(F.col("instruction"), limit).alias("_p"))
    return complete(asked, spec, "_p", **options).drop("_p")


def complete_two_turns(questions: DataFrame, spec: str, by_category: bool = True, **options: object) -> DataFrame:
    """completion_turn_1 and completion_turn_2: the second prompt holds the first turn; categories set temperatures unless one is given."""
    by_category = by_category and "temperature" not in options
    df, column = questions, "_t" if by_category else None
    if by_category:
        df = df.withColumn("_t", category_temperature(F.col("category")))
    df = complete(df.withColumn("_p", F.coalesce("turn_1", F.lit(""))), spec, "_p", "completion_turn_1", column, **options)
    follow_up = F.coalesce(F.nullif("turn_2", F.lit("")), F.lit(NO_FOLLOW_UP))
    second = F.concat_ws("\n\n", F.col("_p"), F.col("completion_turn_1"), follow_up)
    return complete(df.withColumn("_p", second), spec, "_p", "completion_turn_2", column, **options).drop("_p", "_t")
