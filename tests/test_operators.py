import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.operators import battles as B
from duelgrid.operators import calibration as C
from duelgrid.operators import completions as O
from duelgrid.operators import ratings as R
from duelgrid.operators import summary as S
from duelgrid.operators import twoturn as TT


def test_summary(spark):
    df = spark.createDataFrame([(0.1, "x"), (0.9, "x"), (0.5, "y"), (None, "y"), (0.2, None)], "pref double, k string")
    assert tuple(S.pref_summary(df).head()) == (5, 2, 1, 1, 1, 0.625)
    by = {r.k: tuple(r)[1:] for r in S.pref_summary(df, by=["k"]).collect()}
    assert by == {"x": (2, 1, 1, 0, 0, 0.5), "y": (2, 0, 0, 1, 1, 0.5)}
    each = {(r.key, r.value): r.num_battles for r in S.pref_summary_each(df, ["k"]).collect()}
    assert each == {("", ""): 5, ("k", "x"): 2, ("k", "y"): 2}
    empty = S.pref_summary(df.where("pref > 2")).head()
    assert empty.num_battles == 0 and empty.winrate is None


def test_order_bias_cancels(spark):
    df = spark.createDataFrame([(k, 1.0, 1.0) for k in range(8)] + [(9, None, None)], "k int, pref double, pref_swapped double")
    stacked = S.stack_swapped(df)
    assert stacked.count() == 18 and stacked.agg(F.avg("pref")).head()[0] == 0.5
    assert stacked.where("pref is null").count() == 2


def battle(a, b, pref, n):
    return [(a, b, pref)] * n


def frame(spark, rows):
    return spark.createDataFrame(rows, "model_a string, model_b string, pref double")


def test_two_models_have_a_closed_form(spark):
    df = frame(spark, battle("a", "b", 0.0, 7) + battle("a", "b", 1.0, 3) + battle("b", "a", 0.5, 2) + [("a", "b", None)])
    got = R.fit_bradley_terry(df)
    assert got["a"] == pytest.approx(1000 + 200 * np.log10(2), abs=1e-6) and got["b"] == pytest.approx(1000 - 200 * np.log10(2), abs=1e-6)
    anchored = R.fit_bradley_terry(df, baseline="b")
    assert anchored["b"] == pytest.approx(1000) and anchored["a"] > 1000
    assert R.fit_bradley_terry(df, baseline="absent") == got


def test_three_models(spark):
    got = R.solve([("0", "1", 8, 4), ("1", "2", 5, 3), ("0", "2", 9, 2)])
    assert [got[k] for k in "012"] == pytest.approx([1124.82529167, 991.29678377, 883.87792456], abs=1e-5)


def test_ties_separation_components_empty(spark):
    assert R.fit_bradley_terry(frame(spark, [])) == {}
    tied = R.fit_bradley_terry(frame(spark, battle("a", "b", 0.5, 20)))
    assert abs(tied["a"] - tied["b"]) < 1e-6
    won = R.fit_bradley_terry(frame(spark, battle("a", "b", 0.0, 10)))
    assert won["a"] > won["b"]
    apart = R.solve([("a", "b", 3, 1), ("c", "d", 1, 1)])
    assert apart["a"] + apart["b"] == pytest.approx(2000) and apart["c"] == pytest.approx(1000)


def test_score_equations_hold(spark):
    rng = np.random.default_rng(0)
    pairs = [(f"m{i}", f"m{j}", *rng.integers(1, 30, 2).tolist()) for i in range(6) for j in range(i)]
    got = R.solve(pairs)
    left = dict.fromkeys(got, 0.0)
    for a, b, x, y in pairs:
        p = 1 / (1 + 10 ** ((got[b] - got[a]) / 400))
        left[a] += x - (x + y) * p
        left[b] += y - (x + y) * (1 - p)
    assert max(map(abs, left.values())) < 1e-6


def test_bootstrap_is_reproducible_and_centred(spark):
    df = frame(spark, battle("a", "b", 0.0, 60) + battle("b", "a", 0.0, 30) + battle("b", "c", 0.25, 40))
    one = R.leaderboard(R.bootstrap(df, 12, 5), B.battles_per_model(df), "a").collect()
    two = R.leaderboard(R.bootstrap(df.repartition(3), 12, 5), B.battles_per_model(df), "a").collect()
    assert one == two and [r.rounds for r in one] == [12] * 3
    exact = R.fit_bradley_terry(df)
    assert all(abs(r["mean"] - exact[r.model]) < 60 for r in one)
    # every round draws as many battles as there are, in proportion to the cells
    points = R.bootstrap(df.where("model_b = 'c'").union(df.where("model_b = 'b'")), 3, 1)
    assert {r.b for r in points.collect()} == {0, 1, 2} and R.bootstrap(df.limit(0), 3, 1).count() == 0
    error = R.mean_absolute_error(R.ratings_frame(spark, {"a": 1010.0, "b": 990.0, "z": 1.0}), R.ratings_frame(spark, {"a": 1000.0, "b": 1000.0}), "b").head()
    assert tuple(error) == (10.0, 1)


def test_bootstrap_has_the_multinomial_law_at_any_chunk(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"m{a}", f"m{b}", round(float(p), 3)) for a, b, p in zip(rng.integers(0, 4, 3000), rng.integers(4, 7, 3000), rng.random(3000)) if a != b]
    df = spark.createDataFrame(rows, "model_a string, model_b string, pref double")
    points = R.bootstrap_points(df, 200, 3).toPandas()
    assert np.allclose(points.groupby("b")[["points_a", "points_b"]].sum().sum(1), len(rows)) and points.b.nunique() == 200
    exact = {(r.model_a, r.model_b): r for r in R.sufficient_statistics(df).collect()}
    squares = {(r.model_a, r.model_b): r.v for r in df.groupBy("model_a", "model_b").agg(F.sum(F.pow(1 - F.col("pref"), 2)).alias("v")).collect()}
    for pair, x in points.groupby(["model_a", "model_b"])["points_a"]:
        variance = squares[pair] - exact[pair].points_a ** 2 / len(rows)
        assert abs(x.mean() - exact[pair].points_a) < 5 * np.sqrt(variance / 200) and 0.6 < x.var() / variance < 1.6


def test_sparse_and_spark_solvers_are_the_dense_one(spark):
    rng = np.random.default_rng(5)
    strength = rng.normal(0, 1, 60)
    pairs = []
    for a in range(60):
        for b in rng.choice(60, 6, replace=False):
            if a != b and (a < 40) == (b < 40):  # two sets that never meet
                n = int(rng.integers(2, 30))
                won = min(n - 0.5, max(0.5, rng.binomial(n, 1 / (1 + np.exp(strength[b] - strength[a])))))
                pairs.append((f"m{a:02d}", f"m{int(b):02d}", float(won), float(n - won)))
    models = sorted({m for p in pairs for m in p[:2]})
    dense, sparse = R._dense(models, pairs), R._sparse(models, pairs)
    assert np.abs(dense - sparse).max() * R.SCALE / np.log(10) < 1e-6
    points = spark.createDataFrame(pairs, "model_a string, model_b string, points_a double, points_b double")
    local, table = R.rated(points), R.rated(points, most=5)
    assert local.keys() == table.keys() and max(abs(local[m] - table[m]) for m in local) < 1e-6


def test_more_models_than_a_dense_solver_takes():
    rng = np.random.default_rng(6)
    n = 7000
    strength = rng.normal(0, 1, n)
    i, j = rng.integers(0, n, 70_000), rng.integers(0, n, 70_000)
    games = rng.integers(20, 60, 70_000)
    won = rng.binomial(games, 1 / (1 + np.exp(strength[j] - strength[i])))
    got = R.solve((f"m{a:05d}", f"m{b:05d}", float(w) + 0.5, float(g - w) + 0.5) for a, b, w, g in zip(i, j, won, games))
    at = [int(m[1:]) for m in got]
    assert np.corrcoef(list(got.values()), strength[at])[0, 1] > 0.97


def test_calibration(spark):
    rng = np.random.default_rng(2)
    delta = rng.integers(-10, 11, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-0.4 * delta))).astype(float)
    df = spark.createDataFrame([(float(d), float(v)) for d, v in zip(delta, y)] + [(1.0, 0.5), (None, 1.0)], "delta double, y double")
    t = C.calibrate_temperature(df)
    assert t == pytest.approx(0.4, abs=0.05)
    rows = C.agreement_histogram(df).collect()
    assert abs(sum(r.n * r.z / (1 + np.exp(t * r.z)) for r in rows)) < 1e-6
    assert C.calibrate_temperature(df.limit(3), default=0.3) == 0.3
    # more distinct differences than one process takes are summed in Spark
    assert C.calibrate_temperature(df, most=4) == pytest.approx(t, abs=1e-6)
    with pytest.raises(ValueError, match="tie"):
        C.calibrate_temperature(df.where("y = 0.5"))
    with pytest.raises(ValueError):
        C.best_temperature(np.zeros(0), np.zeros(0))


def test_sampling(spark):
    df = spark.createDataFrame([(k, f"l{k % 3}", f"m{k % 4}", f"m{(k + 1) % 4}") for k in range(100)], "battle_id int, lang string, model_a string, model_b string")
    one = {r.battle_id for r in B.seeded_sample(df, 10, "battle_id", 1).collect()}
    assert len(one) == 10 and one == {r.battle_id for r in B.seeded_sample(df.repartition(7), 10, "battle_id", 1).collect()}
    assert one != {r.battle_id for r in B.seeded_sample(df, 10, "battle_id", 2).collect()}
    assert B.seeded_sample(df, 1000, "battle_id", 1).count() == 100
    per = B.head_per_group(df, 2, "lang", "battle_id").collect()
    assert sorted(r.battle_id for r in per) == [0, 1, 2, 3, 4, 5]
    placed = B.assign_opponents(df, 3)
    assert 20 < placed.where("opponent_is_a").count() < 80
    assert placed.where("opponent <> case when opponent_is_a then model_a else model_b end").count() == 0
    assert B.sampling_mode(5, None, None) == "seeded_random" and B.sampling_mode(None, 5, 5) == "head"
    with pytest.raises(ValueError, match="neither"):
        B.sampling_mode(5, 5, None)


def test_battle_results(spark):
    df = spark.createDataFrame([(True, "x", 0.2), (False, "x", 0.2), (True, "y", None), (True, "y", 0.5)], "ours_is_a boolean, opponent string, pref double")
    got = [tuple(r) for r in B.battle_results(df, "me").collect()]
    assert got == [("me", "x", "model_a", 0.2, 0.0), ("x", "me", "model_a", 0.2, 0.0), ("me", "y", "tie", None, 0.5), ("me", "y", "tie", 0.5, 0.5)]
    assert [r.pref_ours for r in B.in_our_frame(df).collect()] == [0.2, 0.8, None, 0.5]


def test_well_represented(spark):
    df = spark.createDataFrame([("a", "b")] * 5 + [("a", "c")] * 2, "model_a string, model_b string")
    assert B.well_represented(df, 5).count() == 5
    assert {r.model: r.battles for r in B.battles_per_model(df).collect()} == {"a": 7, "b": 5, "c": 2}


def test_completions(spark):
    ins = spark.createDataFrame([("1",), ("2",)], "instruction_index string")
    out = spark.createDataFrame([("1", "m", "old", 1), ("1", "m", "new", 2), ("2", "m", None, 3), ("1", "n", "n1", 4)], "instruction_index string, model string, output string, ord int")
    assert {r[0]: r[1] for r in O.model_outputs(out, "m").collect()} == {"1": "new", "2": ""}
    assert O.pair(ins, O.model_outputs(out, "m"), O.model_outputs(out, "m")).count() == 2
    with pytest.raises(ValueError, match=r"all but 1 .*First missing ids: 2"):
        O.align(ins, O.model_outputs(out, "n"), "n")
    named = ins.withColumn("model_b", F.when(F.col("instruction_index") == "1", "n").otherwise("m"))
    assert {r.instruction_index: r.completion_b for r in O.per_row_baseline(named, out).collect()} == {"1": "n1", "2": ""}
    assert O.first_rows(out, "instruction_index", "ord").orderBy("instruction_index").select("output").collect()[0][0] == "old"


def test_two_turn_items(spark):
    q = spark.createDataFrame([("1", "math", "q", "r"), ("2", "stem", "q", ""), ("3", None, "q", None)], "instruction_index string, category string, turn_1 string, turn_2 string")
    got = {(r.instruction_index, r.turn, r.prompt_name) for r in TT.judge_items(q).collect()}
    assert got == {("1", 1, "pair-math-v1"), ("1", 2, "pair-math-v1-multi-turn"), ("2", 1, "pair-v2"), ("3", 1, "pair-v2")}
    assert TT.judge_items(q, "multi").count() == 1
    with pytest.raises(ValueError):
        TT.turn_flags("none")
    both = TT.swapped_items(q.select("instruction_index", F.lit("a").alias("completion_a_1"), F.lit("b").alias("completion_b_1")))
    assert {(r.swapped, r.completion_a_1, r.completion_b_1) for r in both.collect()} == {(False, "a", "b"), (True, "b", "a")}


def test_references_join_by_id(spark):
    q = spark.createDataFrame([("01", "own1", "own2"), ("x", "a", "b")], "instruction_index string, reference_turn_1 string, reference_turn_2 string")
    r = spark.createDataFrame([("1", "r1", "r2")], "instruction_index string, reference_turn_1 string, reference_turn_2 string")
    assert {tuple(x) for x in TT.joined_questions(q, r).collect()} == {("01", "r1", "r2"), ("x", None, None)}
    assert TT.joined_questions(q).head().reference_turn_1 == "own1"
