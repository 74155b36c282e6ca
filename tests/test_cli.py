import json

from pyspark.sql import functions as F

from duelgrid.__main__ import main


def test_pairwise(spark, tmp_path, capsys):
    ins = spark.createDataFrame([(f"{k}", f"q{k}", "coding" if k % 2 else "creative_writing") for k in range(6)], "instruction_index string, instruction string, category string")
    ins.write.parquet(f"{tmp_path}/i.parquet")
    models = F.array(*(F.lit(m) for m in ("mine", "o3-mini-2025-01-31", "gemini-2.0-flash-001")))
    ins.select("instruction_index", F.explode(models).alias("model"), F.lit("text").alias("output")).write.parquet(f"{tmp_path}/o.parquet")
    argv = ["--instructions", f"{tmp_path}/i.parquet", "--outputs", f"{tmp_path}/o.parquet", "--csv"]
    settings = {"task": "arena-hard-v2.0", "models.model_a": "mine", "judge.model": "'Dummy/score_A: 9 score_B: 1'", "judge.swap_mode": "both", "result_folder": f"{tmp_path}/out"}
    for k, v in settings.items():
        argv += ["--set", f"{k}={v}"]
    assert main(argv, spark) == 0
    assert "all: 12 battles, 6 wins, 6 losses" in capsys.readouterr().out
    found = json.loads((tmp_path / "out/results.json").read_text())
    assert {(r["key"], r["value"]) for r in found["summary"]} == {("", ""), ("category", "coding"), ("category", "creative_writing")}
    meta = json.loads((tmp_path / "out/run-metadata.json").read_text())
    assert meta["dataset_statistics"] == {"annotations": 12}
    assert spark.read.csv(f"{tmp_path}/out/annotations-csv", header=True, multiLine=True, escape='"').count() == 12


def test_ratings(spark, tmp_path, capsys):
    flat = "array<struct<role:string,content:string>>"
    talk = [("user", "u"), ("assistant", "a")]
    rows = [(str(k), 5, f"m{k % 2}", f"m{(k + 1) % 2}", f"m{k % 3 % 2}", False, talk, talk) for k in range(12)]
    kind = f"id string, tstamp long, model_a_name string, model_b_name string, chosen_model_name string, both_equal boolean, conversation_a {flat}, conversation_b {flat}"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/arenas/comparia")
    spark.createDataFrame([(str(k), "x") for k in range(12)], "battle_id string, completion string").write.parquet(f"{tmp_path}/a.parquet")
    argv = ["--arena", f"{tmp_path}/arenas", "--answers", f"{tmp_path}/a.parquet"]
    for s in ("task=elo-comparia", "models.model_a=My Model", "judge.model='Dummy/score_A: 1 score_B: 1'", "elo.least_battles=2", "elo.bootstraps=3", f"result_folder={tmp_path}/out"):
        argv += ["--set", s]
    assert main(argv, spark) == 0
    assert "My Model" in capsys.readouterr().out
    found = json.loads((tmp_path / "out/elo-comparia-my-model/results-my-model.json").read_text())
    assert found["summary"]["num_ties"] == 12 and len(found["leaderboard"]) == 3


def test_bad_configuration(capsys):
    assert main(["--set", "judge.swap_mode=sideways", "--set", "models.model_a=m"]) == 2
    assert "swap_mode" in capsys.readouterr().err
