"""End-to-end runs with a model that writes down what it is asked."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from duelgrid.operators import twoturn as TT
from duelgrid.plans import inference, pipelines
from duelgrid.plans.config import build


@pytest.fixture
def diary(tmp_path, monkeypatch):
    """A provider whose models note each prompt with their options and answer by a fixed rule."""
    folder = str(tmp_path)

    def make(name, options):
        def answer(prompts):
            from pathlib import Path

            for p in prompts:
                Path(folder, uuid.uuid4().hex).write_text(json.dumps([name, p, options]))
            # the longer first answer wins by score, the word of the prompt's length decides verdicts
            return [f"score_A: {len(p) % 7} score_B: 3 [[{'AB'[len(p) % 2]}]]" if name == "judge" else f"{name} says {len(p)}" for p in prompts]

        return answer

    monkeypatch.setitem(inference.PROVIDERS, "Diary", make)
    return lambda: [json.loads(f.read_text()) for f in tmp_path.iterdir() if f.is_file()]


def instructions(spark):
    return spark.createDataFrame([(str(k), f"do {'x' * k}", "ab"[k % 2]) for k in range(9)], "instruction_index string, instruction string, category string").repartition(3)


def completions(spark, name):
    return spark.createDataFrame([(str(k), f"<think>no</think>{name} {k}") for k in range(9)], "instruction_index string, completion string")


def test_each_prompt_is_judged_once_and_settings_reach_the_judge(spark, diary, tmp_path):
    values = {"models.model_a": "Diary/a", "models.model_b": "Diary/b", "judge.model": "Diary/judge", "judge.swap_mode": "both", "judge.temperature": 0.25, "judge.preset": "fluency"}
    config = build(**values)
    judged, summary = pipelines.evaluate(instructions(spark), completions(spark, "a"), completions(spark, "b"), config, ["category"])
    rows, counted = judged.collect(), summary.collect()
    assert len(rows) == 18 and judged.count() == 18
    asked = diary()
    assert len(asked) == 18 and {p for _, p, _ in asked} == {r.judge_input for r in rows} and not any("<think>" in p for _, p, _ in asked)
    assert all(o["temperature"] == 0.25 and "fluency" in o["system"] for _, _, o in asked)
    overall = next(r for r in counted if r.key == "")
    assert overall.num_battles == 18 and overall.num_wins == sum(r.pref < 0.5 for r in rows)
    # a template file is the prompt, and a run that may use a cache asks nothing anew
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "t.txt").write_text("Q {user_prompt} 1 {completion_A} 2 {completion_B} {output}")
    config = build(**values | {"judge.template_file": str(tmp_path / "sub" / "t.txt"), "cache_folder": f"file://{tmp_path}/sub/cache"})
    for _ in range(2):
        again, _ = pipelines.evaluate(instructions(spark), completions(spark, "a"), completions(spark, "b"), config)
        assert {r.judge_input[:5] for r in again.collect()} == {"Q do "}
    assert len(diary()) == 36


def test_models_are_asked_where_completions_lack(spark, diary):
    config = build(**{"models.model_a": "Diary/a", "models.model_b": "Diary/b", "judge.model": "Diary/judge", "models.temperature": 0.5, "models.baseline": {"temperature": 0.9}, "n_instructions": 4})
    some = completions(spark, "a").where("instruction_index < 2")
    whole = pipelines.completions_of(instructions(spark), "Diary/a", config, some).collect()
    assert len(whole) == 9 and sum(r.completion.startswith("a says") for r in whole) == 7
    before = len(diary())
    judged, _ = pipelines.evaluate(instructions(spark), None, None, config)
    assert judged.count() == 4
    new = [x for x in diary() if x[0] != "judge"]
    assert len(diary()) - before == 12 and {o["temperature"] for n, _, o in new if n == "b"} == {0.9}


def two_turns(spark):
    rows = [(str(k), c, f"q{k}", f"r{k}" if k != 2 else None, "ref 1", "ref 2") for k, c in enumerate(["math", "writing", "stem"])]
    questions = spark.createDataFrame(rows, "instruction_index string, category string, turn_1 string, turn_2 string, reference_turn_1 string, reference_turn_2 string")
    answers = lambda s: spark.createDataFrame([(str(k), f"{s}1 {k}", f"<think>x</think>{s}2 {k}") for k in range(3)], "instruction_index string, completion_turn_1 string, completion_turn_2 string")
    return questions, answers("a"), answers("b")


@pytest.mark.parametrize("preset", ["fastchat-pairwise", "default"])
@pytest.mark.parametrize("order", ["fixed", "both"])
def test_two_turns_by_verdicts_or_scores_in_one_order_or_both(spark, diary, preset, order):
    config = build(**{"task": "mt-bench", "models.model_a": "Diary/a", "judge.model": "Diary/judge", "judge.swap_mode": order, "judge.preset": preset})
    judged, summary = pipelines.judge_two_turns(*two_turns(spark), config)
    rows, asked, orders = judged.collect(), diary(), 2 if order == "both" else 1
    assert len(asked) == 5 * orders and not any("<think>" in p for _, p, _ in asked)  # one question has no second turn
    assert next(r for r in summary.collect() if r.key == "").num_battles == len(rows)
    assert sum("ref 1" in p for _, p, _ in asked) == 2 * orders and sum("ref 2" in p for _, p, _ in asked) == orders
    if preset == "default":
        assert len(rows) == 5 * orders and {r.swapped for r in rows} == ({False, True} if order == "both" else {False})
        p = {(r.instruction_index, r.turn, r.swapped): r for r in rows}
        assert all((r.pref < 0.5) == ((r.score_a > r.score_b) != r.swapped) or r.score_a == r.score_b for r in p.values())
    else:
        assert len(rows) == 5 and all("swapped" not in r and r.inconsistent in (False, True) for r in rows)
        if order == "fixed":
            assert not any(r.inconsistent for r in rows) and {r.winner for r in rows} <= {"model_a", "model_b"}


def test_two_turns_are_asked_at_the_categorys_temperature(spark, diary):
    config = build(**{"task": "mt-bench", "models.model_a": "Diary/a", "models.model_b": "Diary/b", "judge.model": "Diary/judge", "turns": "single"})
    questions, _, _ = two_turns(spark)
    judged, _ = pipelines.judge_two_turns(questions, None, None, config)
    assert {r.turn for r in judged.collect()} == {1}
    heat = {(n, p.split("\n")[0]): o["temperature"] for n, p, o in diary() if n in "ab"}
    assert heat == {(n, q): t for n in "ab" for q, t in (("q0", 0.0), ("q1", 0.7), ("q2", 0.1))}


def test_ratings_calibrate_on_judged_human_battles(spark, diary):
    say = lambda q, a: [("user", q), ("assistant", a)]
    rows = [(str(k), f"m{k % 3}", f"m{(k + 1) % 3}", "model_a" if k % 4 else "tie", "en", say(f"q{k}", "x" * k), say(f"q{k}", "y")) for k in range(40)]
    talk = "array<struct<role: string, content: string>>"
    arena = spark.createDataFrame(rows, f"battle_id string, model_a string, model_b string, winner string, lang string, conversation_a {talk}, conversation_b {talk}")
    mine = spark.createDataFrame([(str(k), "z" * k) for k in range(40)], "battle_id string, completion string")
    values = {"task": "elo-lmarena", "models.model_a": "Diary/me", "judge.model": "Diary/judge", "elo.least_battles": 1, "elo.bootstraps": 3, "elo.calibrate": True, "elo.n_calibration": 20}
    made = pipelines.rate(arena, mine, build(**values))
    board = made.leaderboard.collect()
    assert {r.model for r in board} == {"Diary/me", "m0", "m1", "m2"} and made.summary.head().num_battles == 40 and made.error.head().models == 3
    assert len(diary()) == 40 + 20 and made.temperature != 0.3 and made.leaderboard.count() == 4 and len(diary()) == 60


def test_judge_settings():
    given = {"gpus": 2}
    assert inference.judge_defaults("OpenAI/x", given, {"a": 1}) == {"a": 1}
    assert inference.judge_defaults("VLLM/Qwen3-8B-FP8", given, {}) == {"gpus": 2, "thinking_token_budget": inference.THINKING_BUDGET, "kv_cache_dtype": "fp8"}
    assert inference.judge_defaults("VLLM/qwen3", given, {"thinking_token_budget": 5})["thinking_token_budget"] == 5


def test_one_order_resolves_without_a_second(spark):
    got = TT.resolve_one(spark.createDataFrame([("[[A]]",), ("[[B]]",), ("[[C]]",), ("?",)], "judge_completion string")).select("winner", F.col("pref"), "inconsistent").collect()
    assert [tuple(r) for r in got] == [("model_a", 0.0, False), ("model_b", 1.0, False), ("tie", 0.5, False), ("error", None, False)]
