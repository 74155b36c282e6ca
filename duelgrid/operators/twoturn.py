"""Two-turn benchmark judging: questions to judge items, verdicts of both orders to preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.functions.prefs import conservative_winner, inconsistent, verdict_winner, winner_preference
from duelgrid.functions.text import needs_reference, safe_text, verdict


def turn_flags(mode: str) -> tuple[bool, bool]:
    if mode not in ("both", "single", "multi"):
        raise ValueError(f"unknown turns mode {mode!r}")
    return mode in ("both", "single"), mode in ("both", "multi")


def joined_questions(questions: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Questions with references by id, integer-like ids made alike; their own references stay where no table is given."""
    if references is None:
        return questions
    key = F.coalesce(F.col("instruction_index").cast("string").try_cast("bigint").cast("string"), F.col("instruction_index").cast("string"))
    left = questions.drop("reference_turn_1", "reference_turn_2").withColumn("_k", key)
    right = references.select(key.alias("_k"), "reference_turn_1", "reference_turn_2")
    return left.join(right, "_k", "left").drop("_k")


def judge_items(pairs: DataFrame, mode: str = "both", limit: int | None = None) -> DataFrame:
    """One item per question and turn from questions with completion_{a,b}_{1,2}; an empty second question gives none."""
    single, multi = turn_flags(mode)
    text = lambda c: safe_text(F.col(c), limit)
    ref = needs_reference(F.col("category"))
    prompt = lambda turn: F.concat(
        F.when(ref, "pair-math-v1").otherwise("pair-v2"), F.lit("-multi-turn" if turn == 2 else "")
    )
    turn_1 = F.struct(F.lit(1).alias("turn"), prompt(1).alias("prompt_name"))
    turn_2 = F.struct(F.lit(2).alias("turn"), prompt(2).alias("prompt_name"))
    wanted = [t for t, on in ((turn_1, single), (F.when(text("turn_2") != "", turn_2), multi)) if on]
    kept = [c for c in pairs.columns if c not in ("turn", "prompt_name")]
    return pairs.select(*kept, F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("_i")).select(*kept, "_i.turn", "_i.prompt_name")


def swapped_items(items: DataFrame, both: bool = True) -> DataFrame:
    """Each item twice, with the answers as they are and exchanged; only as they are, where not both."""
    both = items.withColumn("swapped", F.explode(F.array(*(F.lit(x) for x in ((False, True) if both else (False,))))))
    exchange = {}
    for n in (1, 2):
        a, b = f"completion_a_{n}", f"completion_b_{n}"
        if a in items.columns and b in items.columns:
            exchange[a] = F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))
            exchange[b] = F.when(F.col("swapped"), F.col(a)).otherwise(F.col(b))
    return both.withColumns(exchange)


def resolve_both(judged: DataFrame, first: str = "judge_completion", second: str = "judge_completion_swapped") -> DataFrame:
    """winner_1, winner_2, winner, inconsistent and pref of items judged in both orders."""
    g1 = verdict_winner(verdict(F.col(first)), F.lit(False))
    g2 = verdict_winner(verdict(F.col(second)), F.lit(True))
    out = judged.withColumns({"winner_1": g1, "winner_2": g2})
    a, b = F.col("winner_1"), F.col("winner_2")
    return out.withColumns({"winner": conservative_winner(a, b), "inconsistent": inconsistent(a, b)}).withColumn("pref", winner_preference(F.col("winner")))


def resolve_one(judged: DataFrame, judgment: str = "judge_completion") -> DataFrame:
    """winner and pref of items judged in one order; none is inconsistent."""
    out = judged.withColumns({"winner": verdict_winner(verdict(F.col(judgment)), F.lit(False)), "inconsistent": F.lit(False)})
    return out.withColumn("pref", winner_preference(F.col("winner")))


def inconsistencies(resolved: DataFrame, by: list[str]) -> DataFrame:
    """n_inconsistent and n_items of resolved items, by group."""
    return resolved.groupBy(*by).agg(F.count_if("inconsistent").alias("n_inconsistent"), F.count("*").alias("n_items"))
