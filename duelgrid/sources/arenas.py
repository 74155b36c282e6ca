"""Human arena battles in four published shapes, as one table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.sources import language
from duelgrid.sources.order import ORD, in_load_order

COLUMNS = ("question_id", "tstamp", "model_a", "model_b", "winner", "conversation_a", "conversation_b", "benchmark", "lang", "turns")
CONVERSATION = "array<struct<role:string,content:string>>"


def conversation(column: Column, source_type: str) -> Column:
    """A conversation with contents as text. Contents may be strings or blocks; blocks are joined by spaces."""
    if source_type.replace(" ", "") == CONVERSATION:
        return column
    if "content:array" in source_type:
        text = lambda m: F.array_join(F.transform(F.filter(m["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), " ")
        return F.transform(column, lambda m: F.struct(m["role"].alias("role"), text(m).alias("content")))
    return F.transform(column, lambda m: F.struct(m["role"].alias("role"), m["content"].cast("string").alias("content")))


def _talk(prompt: Column, answer: Column) -> Column:
    pair = lambda role, c: F.struct(F.lit(role).alias("role"), c.cast("string").alias("content"))
    return F.array(pair("user", prompt), pair("assistant", answer))


def seconds(column: Column, kind: str) -> Column:
    """Epoch seconds of a number of seconds or of a timestamp."""
    return F.unix_seconds(column.cast("timestamp")) if kind.startswith(("timestamp", "date")) else column.cast("long")


def finish(df: DataFrame, benchmark: str, single_turn: bool = False) -> DataFrame:
    """The common columns of rows with a winner, and the order where there is one; turns counts messages but the first.

    A missing language is filled in by the caller.
    """
    types = dict(df.dtypes)
    for side in ("conversation_a", "conversation_b"):
        df = df.withColumn(side, conversation(F.col(side), types[side]))
    if "lang" not in df.columns:
        df = df.withColumn("lang", F.lit(None).cast("string"))
    df = df.withColumns({
        "winner": F.when(F.col("winner") == "both_bad", "tie (bothbad)").otherwise(F.col("winner")), "benchmark": F.lit(benchmark),
        "lang": F.lower("lang"), "turns": F.size("conversation_a") - 1, "question_id": F.col("question_id").cast("string"),
    }).where(F.col("winner").isNotNull())
    if single_turn:
        df = df.where(F.size("conversation_a") == 2)
    return df.select(*COLUMNS, *_kept(df, ORD))


def _kept(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def _language(df: DataFrame) -> list[Column]:
    """The column that holds languages, under either of two names."""
    found = _kept(df, "language", "lang")
    return [F.col(found[0]).alias("lang")] if found else []


def arena_55k(df: DataFrame, single_turn: bool = False) -> DataFrame:
    """One-hot winners (a tie goes before a, a before b), prompt and two responses."""
    flag = lambda c: F.col(c).cast("int") == 1
    winner = F.when(flag("winner_tie"), "tie").when(flag("winner_model_a"), "model_a").when(flag("winner_model_b"), "model_b")
    return finish(df.select(
        F.col("id").alias("question_id"), F.lit(0).cast("long").alias("tstamp"), "model_a", "model_b", winner.alias("winner"),
        _talk(F.col("prompt"), F.col("response_a")).alias("conversation_a"), _talk(F.col("prompt"), F.col("response_b")).alias("conversation_b"),
        *_language(df), *_kept(df, ORD),
    ), "LMArena-55k", single_turn)


def arena_parquet(df: DataFrame, benchmark: str, single_turn: bool = False) -> DataFrame:
    """The 100k and 140k shapes: ids and times under either of two names; an existing language column is kept."""
    types = dict(df.dtypes)
    first = lambda *names: next(n for n in names if n in types)
    time = first("tstamp", "timestamp")
    return finish(df.select(
        F.col(first("question_id", "id")).alias("question_id"), seconds(F.col(time), types[time]).alias("tstamp"),
        "model_a", "model_b", "winner", "conversation_a", "conversation_b", *_language(df), *_kept(df, ORD),
    ), benchmark, single_turn)


def arena_comparia(df: DataFrame, single_turn: bool = False) -> DataFrame:
    """The winner is the chosen model's side, or a tie where both are equal; a chosen model on neither side is dropped."""
    types = dict(df.dtypes)
    chosen = F.col("chosen_model_name")
    winner = (
        F.when(F.coalesce(F.col("both_equal").cast("boolean"), F.lit(False)), "tie")
        .when(chosen == F.col("model_a_name"), "model_a").when(chosen == F.col("model_b_name"), "model_b")
    )
    key = next(n for n in ("question_id", "id", "conversation_pair_id") if n in types)
    time = next(n for n in ("tstamp", "timestamp") if n in types)
    return finish(df.select(
        F.col(key).alias("question_id"), seconds(F.col(time), types[time]).alias("tstamp"), F.col("model_a_name").alias("model_a"),
        F.col("model_b_name").alias("model_b"), winner.alias("winner"), "conversation_a", "conversation_b",
        *_language(df), *_kept(df, ORD),
    ), "ComparIA", single_turn)


READERS: dict[str, Callable[[SparkSession, str, int], DataFrame]] = {
    "LMArena-55k": lambda s, root, k: arena_55k(in_load_order(s.read.csv(f"{root}/lmarena-55k", header=True, multiLine=True, escape='"'), first=k)),
    "LMArena-100k": lambda s, root, k: arena_parquet(_merged(s, f"{root}/lmarena-100k", k), "LMArena-100k"),
    "LMArena-140k": lambda s, root, k: arena_parquet(_merged(s, f"{root}/lmarena-140k", k), "LMArena-140k"),
    "ComparIA": lambda s, root, k: arena_comparia(in_load_order(s.read.parquet(f"{root}/comparia"), first=k)),
}
GROUPS = {"LMArena": ("LMArena-100k", "LMArena-55k", "LMArena-140k")}


def _merged(spark: SparkSession, path: str, first: int) -> DataFrame:
    return in_load_order(spark.read.option("mergeSchema", True).parquet(path), first=first)


def load_arena(spark: SparkSession, root: str, arena: str | None = None, detector: language.Loader | None = None) -> DataFrame:
    """One arena, the group LMArena, or all where none is named, with `ord`, the order in which arenas, files and rows stand.

    Where a detector is given, it fills in the languages that an arena lacks.
    """
    names = GROUPS.get(arena, (arena,) if arena else tuple(READERS))
    if lost := [n for n in names if n not in READERS]:
        raise ValueError(f"unknown arena {lost[0]!r}; known: {', '.join([*READERS, *GROUPS])}")
    found = reduce(DataFrame.unionByName, (READERS[n](spark, root, k) for k, n in enumerate(names)))
    return with_language(found, detector) if detector else found


def with_language(df: DataFrame, detector: language.Loader = language.DEFAULT) -> DataFrame:
    """Fill missing languages by a detector of the first user text."""
    return language.with_language(df, F.get("conversation_a", F.lit(0))["content"], detector)
