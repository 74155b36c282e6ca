"""Win, loss and tie summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary_columns(pref: Column) -> list[Column]:
    """num_battles counts all rows; the rate is over parseable ones and NULL where there are none."""
    wins, losses, ties = F.count_if(pref < 0.5), F.count_if(pref > 0.5), F.count_if(pref == 0.5)
    decided = wins + losses + ties
    return [
        F.count("*").alias("num_battles"), wins.alias("num_wins"), losses.alias("num_losses"), ties.alias("num_ties"),
        (F.count("*") - decided).alias("num_missing"),
        F.try_divide(wins + F.lit(0.5) * ties, decided).alias("winrate"),
    ]


def pref_summary(df: DataFrame, pref: str = "pref", by: list[str] | None = None) -> DataFrame:
    """One row, or one per group; rows with a NULL group are left out."""
    if not by:
        return df.agg(*summary_columns(F.col(pref)))
    for k in by:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*by).agg(*summary_columns(F.col(pref)))


def pref_summary_each(df: DataFrame, keys: list[str], pref: str = "pref") -> DataFrame:
    """The overall summary and that of each key's values, in one scan: columns key, value and the summary's."""
    sets = F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value")), *(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    each = df.select(pref, F.explode(sets).alias("g")).where("g.value is not null")
    return each.groupBy(F.col("g.key").alias("key"), F.col("g.value").alias("value")).agg(*summary_columns(F.col(pref)))


def parse_failures(df: DataFrame, by: list[str], **prefs: str) -> DataFrame:
    """How many preferences of a group could not be parsed: a count for each given name of a column."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(c).isNull()).alias(n) for n, c in prefs.items()))


def stack_swapped(df: DataFrame, pref: str = "pref", pref_swapped: str = "pref_swapped") -> DataFrame:
    """Both orders as 2n rows in the unswapped frame, from one scan."""
    both = F.array(
        F.struct(F.lit(False).alias("swapped"), F.col(pref).alias("pref")),
        F.struct(F.lit(True).alias("swapped"), (1 - F.col(pref_swapped)).alias("pref")),
    )
    rest = [c for c in df.columns if c not in (pref, pref_swapped)]
    return df.select(*rest, F.explode(both).alias("_o")).select(*rest, "_o.swapped", "_o.pref")
