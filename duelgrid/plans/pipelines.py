"""The end-to-end runs: pairwise comparison, arena ratings and two-turn judging, on DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.functions.prefs import preference, winner_preference
from duelgrid.functions.text import score_a, score_b, strip_thinking, truncate
from duelgrid.operators import battles as B
from duelgrid.operators import ratings as R
from duelgrid.operators.calibration import calibrate_temperature
from duelgrid.operators.completions import pair
from duelgrid.operators.summary import pref_summary, pref_summary_each
from duelgrid.operators.twoturn import judge_items, resolve_both, resolve_one, swapped_items
from duelgrid.plans.cache import written
from duelgrid.plans.config import RunConfig
from duelgrid.plans.inference import complete, complete_instructions, complete_two_turns
from duelgrid.plans.prompts import TEMPLATE, Preset, render_pair, render_single_turn, render_two_turns, resolve
from duelgrid.sources.order import ORD


def preset_of(config: RunConfig) -> Preset:
    """The judge's system prompt and template: files, then a named preset, then the task's default."""
    found = resolve(config.task, config.judge.preset, config.judge.system_file, config.judge.template_file)
    return replace(found, explain=found.explain or config.judge.explain)


def _asked(items: DataFrame, config: RunConfig, preset: Preset) -> DataFrame:
    """items with the judge's answer to judge_input."""
    options = config.judge.generation_kwargs(config.models.engine_kwargs)
    if preset.system is not None:
        options |= {"system": preset.system}
    return complete(items, config.judge.model, "judge_input", "judge_completion", window=config.in_flight, **options)


def _orders(df: DataFrame, config: RunConfig) -> DataFrame:
    both = config.judge.swap_mode == "both"
    return df.withColumn("swapped", F.explode(F.array(*(F.lit(x) for x in ((False, True) if both else (False,))))))


def _once(judge: Callable[[DataFrame], DataFrame], rows: DataFrame, name: str, config: RunConfig, **inputs: object) -> DataFrame:
    """What judge makes of rows, written and read back, so that whatever is derived from it asks no model again.

    Where a cache is named, an earlier run's judgments count only if they are of the same rows under the same settings,
    prompts included.
    """
    preset = preset_of(config)
    described = {"task": config.task, "models": vars(config.models), "judge": vars(config.judge), "chars": config.truncate_chars, "preset": vars(preset)}
    return written(rows.sparkSession, name, lambda: judge(rows), config.cache_folder, config.ignore_cache, (rows,), **described, **inputs)


def annotate(pairs: DataFrame, config: RunConfig) -> DataFrame:
    """Judge completion_a against completion_b, once or in both orders: prompts, judge texts, raw scores and preferences.

    Reasoning is removed from answers before they are cut to length. pref is in the unswapped frame; raw scores stay, so
    another temperature needs no new judging.
    """
    preset = preset_of(config)
    both = _orders(pairs, config)
    a, b = F.col("completion_a"), F.col("completion_b")
    first, second = (F.when(F.col("swapped"), y).otherwise(x) for x, y in ((a, b), (b, a)))
    template = preset.template or TEMPLATE
    prompt = render_pair(F.col("instruction"), strip_thinking(first), strip_thinking(second), config.truncate_chars, template, preset.explain)
    return with_scores(_asked(both.withColumn("judge_input", prompt), config, preset))


def with_scores(judged: DataFrame, temperature: float = 0.3) -> DataFrame:
    """Raw scores and preferences of judge texts."""
    text = F.col("judge_completion")
    return with_preferences(judged.withColumns({"score_a": score_a(text), "score_b": score_b(text)}), temperature)


def with_preferences(judged: DataFrame, temperature: float = 0.3) -> DataFrame:
    """(Re)compute pref from raw scores at a temperature."""
    p = preference(F.col("score_a"), F.col("score_b"), temperature)
    return judged.withColumn("pref", F.when(F.col("swapped"), 1 - p).otherwise(p))


def _limited(instructions: DataFrame, config: RunConfig) -> DataFrame:
    """The first instructions by index, whole numbers by value."""
    if not config.n_instructions:
        return instructions
    return instructions.orderBy(F.col("instruction_index").try_cast("bigint").asc_nulls_last(), "instruction_index").limit(config.n_instructions)


def completions_of(instructions: DataFrame, spec: str, config: RunConfig, given: DataFrame | None = None, baseline: bool = False) -> DataFrame:
    """instruction_index and completion of a model: given ones, and generated ones where there is none, each asked for once."""
    wanted = instructions if given is None else instructions.join(given, "instruction_index", "left_anti")
    options = config.models.generation_kwargs(baseline)
    make = lambda: complete_instructions(wanted, spec, config.truncate_chars, window=config.in_flight, **options)
    made = written(instructions.sparkSession, "completions", make, config.cache_folder, config.ignore_cache, (wanted,), task=config.task, spec=spec, options=options, chars=config.truncate_chars)
    return made if given is None else given.select("instruction_index", "completion").unionByName(made.select("instruction_index", "completion"))


def evaluate(
    instructions: DataFrame, completions_a: DataFrame | None, completions_b: DataFrame | None, config: RunConfig, by: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(annotations, summary) of two models' completions; the summary also by each of the given columns.

    Where completions are None, the configured model is asked for them. Every prompt is judged once; the summary comes from
    the written annotations.
    """
    instructions = _limited(instructions, config)
    if completions_a is None:
        completions_a = completions_of(instructions, config.models.model_a, config)
    if completions_b is None:
        completions_b = completions_of(instructions, config.models.model_b, config, baseline=True)
    judged = _once(lambda df: annotate(df, config), pair(instructions, completions_a, completions_b), "annotations", config)
    return judged, pref_summary_each(judged, list(by)) if by else pref_summary(judged)


@dataclass
class Ratings:
    summary: DataFrame
    battles: DataFrame
    leaderboard: DataFrame
    human: dict[str, float]
    error: DataFrame
    temperature: float


def rate(arena: DataFrame, completions: DataFrame, config: RunConfig, calibration: DataFrame | None = None) -> Ratings:
    """Rate a model by judged battles against an arena's answers, together with the arena's human battles.

    arena: battle_id, model_a, model_b, winner, lang, conversation_a, conversation_b, and ord, the load order by which heads are
    taken (else by battle_id); completions: battle_id, completion. Asked languages need a language in every row.
    calibration: human battles judged already, with delta (score difference) and y (1: A preferred); where it is None and
    calibration is asked for, a seeded sample of the arena's battles is judged. Every prompt is judged once.
    """
    ours, elo = config.models.model_a, config.elo
    panel = B.languages(arena, elo.languages, strict=True)
    order = ORD if ORD in arena.columns else "battle_id"
    total = elo.n_head if config.n_instructions is None else config.n_instructions
    panel = B.panel(panel, elo.n_random, total, elo.n_per_language, "battle_id", order, config.seed)
    placed = B.assign_opponents(panel, config.seed).join(completions.select("battle_id", "completion"), "battle_id")
    side = F.when(F.col("opponent_is_a"), F.col("conversation_a")).otherwise(F.col("conversation_b"))
    theirs, mine = F.get(side, F.lit(1))["content"], F.col("completion")
    pairs = placed.withColumns({
        "instruction": F.get("conversation_a", F.lit(0))["content"],
        "completion_a": F.when(F.col("ours_is_a"), mine).otherwise(theirs), "completion_b": F.when(F.col("ours_is_a"), theirs).otherwise(mine),
    })
    pairs = pairs.select("battle_id", "instruction", "completion_a", "completion_b", "opponent", "ours_is_a")
    judged = _once(lambda df: annotate(df, config), pairs, "battles", config)
    temperature = 0.3
    if elo.calibrate and elo.soft:
        calibration = calibration_battles(arena, config) if calibration is None else calibration
        temperature = calibrate_temperature(calibration, default=temperature)
        judged = with_preferences(judged, temperature)
    frame = B.in_our_frame(judged)
    results = B.battle_results(judged, ours).select("model_a", "model_b", (F.col("pref") if elo.soft else F.col("pref_hard")).alias("pref"))
    human = B.well_represented(arena.select("model_a", "model_b", "winner"), elo.least_battles)
    human = human.select("model_a", "model_b", winner_preference(F.col("winner")).alias("pref"))
    both = results.unionByName(human)
    samples = R.bootstrap(both, elo.bootstraps, config.seed, baseline=elo.baseline)
    board = R.leaderboard(samples, B.battles_per_model(both), ours)
    reference = R.fit_bradley_terry(human, baseline=elo.baseline)
    error = R.mean_absolute_error(board.withColumnRenamed("mean", "rating"), R.ratings_frame(arena.sparkSession, reference), ours)
    return Ratings(pref_summary(frame, "pref_ours"), both, board, reference, error, temperature)


def calibration_battles(arena: DataFrame, config: RunConfig) -> DataFrame:
    """delta and y of a seeded sample of human battles without ties, judged in one order: the judge's scores and the human's choice."""
    decided = B.languages(arena, config.elo.languages).where(F.col("winner").isin("model_a", "model_b"))
    panel = B.seeded_sample(decided, config.elo.n_calibration, "battle_id", config.seed + 1) if config.elo.n_calibration else decided
    answer = lambda c: F.get(c, F.lit(1))["content"]
    pairs = panel.select(
        "battle_id", F.get("conversation_a", F.lit(0))["content"].alias("instruction"), answer("conversation_a").alias("completion_a"),
        answer("conversation_b").alias("completion_b"), (F.col("winner") == "model_a").cast("double").alias("y"),
    )
    fixed = replace(config, judge=replace(config.judge, swap_mode="fixed"))
    judged = _once(lambda df: annotate(df, fixed), pairs, "calibration", fixed)
    return judged.select((F.col("score_a") - F.col("score_b")).alias("delta"), "y")


def judge_two_turns(questions: DataFrame, a: DataFrame | None, b: DataFrame | None, config: RunConfig, mode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(judged items, summary overall, by category and by turn), by verdicts or, where the preset is one of scores, by those.

    Verdicts of both orders give one cautious result an item; scores of both orders are two results. With a fixed order the
    answers are judged as they stand. Texts are cut to length before reasoning is removed. Completions have
    instruction_index, completion_turn_1 and _2; where they are None, the configured model is asked. Every prompt is judged once.
    """
    spark, preset, questions = questions.sparkSession, preset_of(config), _limited(questions, config)
    for side, df, spec in (("a", a, config.models.model_a), ("b", b, config.models.model_b)):
        if df is None:
            options = config.models.generation_kwargs(side == "b")
            make = lambda s=spec, o=options: complete_two_turns(questions, s, window=config.in_flight, **o).select("instruction_index", "completion_turn_1", "completion_turn_2")
            asked = questions.select("instruction_index", "category", "turn_1", "turn_2")
            df = written(spark, "two-turns", make, config.cache_folder, config.ignore_cache, (asked,), spec=spec, options=options)
        named = df.select("instruction_index", *(F.col(f"completion_turn_{k}").alias(f"completion_{side}_{k}") for k in (1, 2)))
        questions = questions.join(named, "instruction_index")
    items = judge_items(questions, mode or config.turns, config.truncate_chars)
    items = swapped_items(items, both=config.judge.swap_mode == "both")
    prompt = _verdict_prompt(config) if preset.delegated else _scored_prompt(config, preset)
    judged = _once(lambda df: _asked(df.withColumn("judge_input", prompt), config, preset), items, "two-turn-items", config)
    if not preset.delegated:
        scored = with_scores(judged)
        return scored, pref_summary_each(scored, ["category", "turn"])
    key = ["instruction_index", "category", "turn", "prompt_name"]
    pick = lambda c, s: F.max(F.when(F.col("swapped") == s, F.col(c)))
    wide = judged.groupBy(*key).agg(pick("judge_completion", False).alias("judge_completion"), pick("judge_completion", True).alias("judge_completion_swapped"))
    resolved = resolve_both(wide) if config.judge.swap_mode == "both" else resolve_one(wide.drop("judge_completion_swapped"))
    return resolved, pref_summary_each(resolved, ["category", "turn"])


def _two_turn_texts(config: RunConfig) -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    """A question's text, and an answer's without reasoning, both cut to length."""
    text = lambda c: truncate(F.col(c), config.truncate_chars)
    return text, lambda c: strip_thinking(text(c))


def _verdict_prompt(config: RunConfig) -> Column:
    text, cut = _two_turn_texts(config)
    reference = F.col("prompt_name").startswith("pair-math")
    one = render_single_turn(text("turn_1"), cut("completion_a_1"), cut("completion_b_1"), F.when(reference, text("reference_turn_1")))
    answers = [(cut(f"completion_{s}_1"), cut(f"completion_{s}_2")) for s in "ab"]
    two = render_two_turns(text("turn_1"), text("turn_2"), *answers)
    two_reference = render_two_turns(text("turn_1"), text("turn_2"), *answers, (text("reference_turn_1"), text("reference_turn_2")))
    return F.when(F.col("turn") == 1, one).when(reference, two_reference).otherwise(two)


def _scored_prompt(config: RunConfig, preset: Preset) -> Column:
    """The preset's template over the first turn, or over both turns of each assistant; references stand with the question."""
    text, cut = _two_turn_texts(config)
    reference = F.col("prompt_name").startswith("pair-math")
    told = lambda k: F.when(reference, F.concat(F.lit(f"\n\n[Reference Answer {k}]\n"), text(f"reference_turn_{k}"))).otherwise("")
    talk = lambda s: F.concat(F.lit("[Turn 1]\n"), cut(f"completion_{s}_1"), F.lit("\n\n[Turn 2]\n"), cut(f"completion_{s}_2"))
    asked = F.concat(F.lit("[Turn 1]\n"), text("turn_1"), told(1), F.lit("\n\n[Turn 2]\n"), text("turn_2"), told(2))
    multi = F.col("turn") == 2
    either = lambda one, two: F.when(multi, two).otherwise(one)
    question = either(F.concat(text("turn_1"), told(1)), asked)
    sides = [either(cut(f"completion_{s}_1"), talk(s)) for s in "ab"]
    return render_pair(question, *sides, None, preset.template or TEMPLATE, preset.explain)
