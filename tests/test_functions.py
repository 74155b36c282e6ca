import pytest
from pyspark.sql import functions as F

from duelgrid.functions import prefs as P
from duelgrid.functions import text as T


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(column(F.col("x"))).collect()]


# golden judge texts: text, score preference, verdict
JUDGED = [
    ("Score_a: 0\nScore_b: 1", 0.5744425168116589, "error"),
    ("score A: 10\nscore B: -5", 0.010986942630593188, "error"),
    ("Score of Assistant A: 0\nScore of Assistant B: 1", 0.5744425168116589, "error"),
    ("<think>score_A: 2 score_B: 3</think> so score_A: 0\nscore_B: 10", 0.9525741268224333, "error"),
    ("<think>scores [[A]]</think>Concise [[B]]", None, "B"),
    ("Explanation [[A]]", None, "A"),
    ("[[C]]", None, "tie"),
    ("[[B]] or [[A]]", None, "A"),
    ("score\ra: 5 score b: 5", 0.5, "error"),
    ("score_a = 8 score_b = 9", None, "error"),
    ("score a: 7.5 score b: 7.9", 0.5, "error"),
    (None, None, "error"),
    ("", None, "error"),
]


def test_judge_texts(spark):
    got = values(spark, [t for t, _, _ in JUDGED], P.parsed_preference)
    assert [g if g is None else pytest.approx(w, abs=1e-12) for g, (_, w, _) in zip(got, JUDGED)] == got
    assert [g is None for g in got] == [w is None for _, w, _ in JUDGED]
    assert values(spark, [t for t, _, _ in JUDGED], T.verdict) == [v for _, _, v in JUDGED]


def test_strip_thinking(spark):
    cases = {
        "<think>a</think>\n b": ("b", True), "x<THINK>\n</Think>y": ("xy", True), "draft</think>  Final answer.": ("Final answer.", True),
        "<think>open": ("<think>open", False), "plain": ("plain", False), "<think>a</think><think>b</think>c": ("c", True), None: ("", False), "": ("", False),
    }
    assert values(spark, list(cases), T.strip_thinking) == [v for v, _ in cases.values()]
    assert values(spark, list(cases), T.had_thinking) == [f for _, f in cases.values()]


def test_truncate_counts_code_points(spark):
    assert values(spark, ["a😀bc", None, "x"], lambda c: T.truncate(c, 2)) == ["a😀", "", "x"]
    assert values(spark, [123456, None], lambda c: T.safe_text(c, 3), "int") == ["123", ""]


def test_slug_spec_criteria(spark):
    assert values(spark, ["GPT-4 / turbo!", "___", None], T.slugify) == ["gpt-4-turbo", "model", "model"]
    assert values(spark, ["Dummy/a/b", "alone"], T.model_of) == ["a/b", ""]
    assert values(spark, ["[1, 2, 6] [9]", "none", "[a, 3.5, 4]", None], T.criteria_numbers) == [[1, 2, 6], [], [4], []]
    assert values(spark, ["org/Qwen3-8B", "SmolLM3", "x/Olmo-3-7B-Think", "gpt"], T.reasoning_parser) == ["qwen3", "qwen3", "olmo3", None]


def test_categories(spark):
    assert values(spark, ["math", "writing", "new", None], T.category_temperature) == [0.0, 0.7, 0.7, 0.7]
    assert values(spark, ["math", "stem", None], T.needs_reference) == [True, False, False]


def test_preferences_do_not_overflow(spark):
    df = spark.createDataFrame([(1e6, 0.0), (0.0, 1e6), (3.0, 3.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(P.preference(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.5, None]


def test_conservative_winner(spark):
    rows = [("model_a", "model_b", "tie", True), ("error", "model_b", "error", False), ("model_a", "model_a", "model_a", False), ("tie", "model_a", "tie", True)]
    df = spark.createDataFrame(rows, "a string, b string, w string, i boolean")
    assert df.where((P.conservative_winner(F.col("a"), F.col("b")) != F.col("w")) | (P.inconsistent(F.col("a"), F.col("b")) != F.col("i"))).count() == 0


def test_swapped_verdict(spark):
    df = spark.createDataFrame([("A", True, "model_b"), ("B", True, "model_a"), ("A", False, "model_a"), ("tie", True, "tie"), ("error", False, "error")], "v string, s boolean, w string")
    assert df.where(P.verdict_winner(F.col("v"), F.col("s")) != F.col("w")).count() == 0
    assert values(spark, ["model_a", "model_b", "tie", "tie (bothbad)", "error", None], P.winner_preference) == [0.0, 1.0, 0.5, 0.5, None, None]
