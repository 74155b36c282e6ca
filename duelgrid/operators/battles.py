"""Arena battles: filters, per-group heads, seeded sampling, opponents, counts, well-represented models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.functions.prefs import coin, preference_winner


def languages(df: DataFrame, langs: list[str] | None, column: str = "lang", strict: bool = False) -> DataFrame:
    """Rows of the given languages, all without any; where strict, a row without a language is an error."""
    if not langs:
        return df
    unknown = F.raise_error(F.lit(f"a battle has no {column}: give load_arena a detector")).cast("string")
    return df.where((F.coalesce(F.col(column), unknown) if strict else F.col(column)).isin(*langs))


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def head_per_group(df: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """The first n rows of each group; Spark prunes to n per group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def seeded_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly n rows (all, if fewer) without replacement, by the order of a hash of seed and key."""
    shuffled = F.md5(F.concat_ws("~", F.lit(str(seed)), F.col(key)).cast("binary"))
    return df.withColumn("_h", shuffled).orderBy("_h", key).limit(n).drop("_h")


def sampling_mode(n_random: int | None, n_head: int | None, n_per_language: int | None) -> str:
    """seeded_random or head; a random sample excludes both heads, which go together."""
    if n_random is None:
        return "head"
    if n_head is not None or n_per_language is not None:
        raise ValueError("a random sample goes neither with a head nor with a head per language")
    return "seeded_random"


def panel(
    df: DataFrame, n_random: int | None, n_head: int | None, n_per_language: int | None, key: str, order: str, seed: int = 0, group: str = "lang"
) -> DataFrame:
    """The battles that are judged: a seeded sample, or the first of each language and of those the first in all, in load order."""
    if sampling_mode(n_random, n_head, n_per_language) == "seeded_random":
        return seeded_sample(df, n_random, key, seed)
    if n_per_language is not None:
        df = head_per_group(df, n_per_language, group, order)
    return df if n_head is None else head(df, n_head, order)


def assign_opponents(df: DataFrame, seed: int, key: str = "battle_id") -> DataFrame:
    """Adds two hash coins: whether side a is the opponent, and whether the evaluated model takes position A."""
    return df.withColumns({
        "opponent_is_a": coin(seed, "opponent", F.col(key)), "ours_is_a": coin(seed, "position", F.col(key)),
    }).withColumn("opponent", F.when(F.col("opponent_is_a"), F.col("model_a")).otherwise(F.col("model_b")))


def battle_results(df: DataFrame, ours: str, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Named battles from judged rows (opponent, ours_is_a, pref): pref stays in the A/B frame.

    pref_hard takes an unparseable judgment as a tie, as hard ratings do; pref keeps it NULL.
    """
    a = F.when(F.col("ours_is_a"), F.lit(ours)).otherwise(F.col("opponent"))
    b = F.when(F.col("ours_is_a"), F.col("opponent")).otherwise(F.lit(ours))
    winner = preference_winner(F.col("pref"))
    hard = F.when(winner == "model_a", 0.0).when(winner == "model_b", 1.0).otherwise(0.5)
    return df.select(*keep, a.alias("model_a"), b.alias("model_b"), winner.alias("winner"), "pref", hard.alias("pref_hard"))


def in_our_frame(df: DataFrame, ours_is_a: str = "ours_is_a", pref: str = "pref") -> DataFrame:
    return df.withColumn("pref_ours", F.when(F.col(ours_is_a), F.col(pref)).otherwise(1 - F.col(pref)))


def battles_per_model(df: DataFrame) -> DataFrame:
    sides = df.select(F.explode(F.array("model_a", "model_b")).alias("model"))
    return sides.groupBy("model").agg(F.count("*").alias("battles"))


def pair_counts(df: DataFrame) -> DataFrame:
    """(model_a, model_b, battles) of ordered pairs, which are few however many battles there are."""
    return df.groupBy("model_a", "model_b").agg(F.count("*").alias("battles"))


def well_represented_pairs(df: DataFrame, least: int = 500, one_in: int | None = None) -> DataFrame:
    """pair_counts() of models that both have at least `least` battles or, where given, one of `one_in` sides of all battles."""
    pairs = pair_counts(df)
    each = pairs.select(F.explode(F.array("model_a", "model_b")).alias("model"), "battles").groupBy("model").agg(F.sum("battles").alias("n"))
    if one_in is None:
        often = each.where(F.col("n") >= least)
    else:
        often = each.join(F.broadcast(each.agg(F.sum("n").alias("all"))), F.col("n") * one_in >= F.col("all"))  # one row
    for side in ("model_a", "model_b"):
        pairs = pairs.join(often.select(F.col("model").alias(side)), side, "left_semi")
    return pairs.select("model_a", "model_b", "battles")


def well_represented(df: DataFrame, least: int = 500) -> DataFrame:
    """Battles of models that both have at least `least` battles, counted before the filter: one join on pairs."""
    return df.join(well_represented_pairs(df, least), ["model_a", "model_b"], "left_semi")


def arena_profile(df: DataFrame) -> DataFrame:
    """Battles, distinct models over both sides and distinct languages, exactly, in one scan."""
    sides = df.select("lang", F.posexplode(F.array("model_a", "model_b")).alias("side", "model"))
    return sides.agg(F.count_if(F.col("side") == 0).alias("battles"), F.countDistinct("model").alias("models"), F.countDistinct("lang").alias("languages"))
