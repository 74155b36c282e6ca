"""Preference expressions: 0 means A won, 1 means B won, 0.5 a tie, NULL unparseable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelgrid.functions.text import score_a, score_b

TEMPERATURE = 0.3
#: Hash-derived numbers are taken from so many leading hex digits of an md5.
HASH_DIGITS = 8


def preference(a: Column, b: Column, temperature: float | Column = TEMPERATURE) -> Column:
    """P(B wins) by scores: 1 - e^(T a) / (e^(T a) + e^(T b)), written so that large scores do not overflow."""
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    return F.nanvl(F.lit(1.0) / (F.lit(1.0) + F.exp(t * (a - b))), F.lit(None).cast("double"))


def parsed_preference(judge_text: Column, temperature: float | Column = TEMPERATURE) -> Column:
    return preference(score_a(judge_text), score_b(judge_text), temperature)


def verdict_winner(verdict: Column, swapped: Column) -> Column:
    """model_a, model_b, tie or error in the unswapped frame."""
    return (
        F.when((verdict == "A") & ~swapped | (verdict == "B") & swapped, "model_a")
        .when((verdict == "B") & ~swapped | (verdict == "A") & swapped, "model_b").otherwise(verdict)
    )


def winner_preference(winner: Column) -> Column:
    """0 / 1 / 0.5 for model_a / model_b / a tie of either kind, else NULL."""
    return F.when(winner == "model_a", 0.0).when(winner == "model_b", 1.0).when(winner.isin("tie", "tie (bothbad)"), 0.5)


def preference_winner(pref: Column) -> Column:
    """The hard label; an unparseable preference counts as a tie here."""
    return F.when(pref < 0.5, "model_a").when(pref > 0.5, "model_b").otherwise("tie")


def swapped(pref: Column) -> Column:
    return 1 - pref


def conservative_winner(first: Column, second: Column) -> Column:
    """A winner only where both orders agree; error if either is one; else a tie."""
    return F.when((first == "error") | (second == "error"), "error").when(first == second, first).otherwise("tie")


def inconsistent(first: Column, second: Column) -> Column:
    return (first != "error") & (second != "error") & (first != second)


def hash_number(*parts: Column | str | int) -> Column:
    """A number from the md5 of the parts: the same in any partitioning and in any engine."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.left(F.md5(F.concat_ws("~", *columns).cast("binary")), F.lit(HASH_DIGITS)), 16, 10).cast("long")


def coin(*parts: Column | str | int) -> Column:
    return hash_number(*parts) % 2 == 0
