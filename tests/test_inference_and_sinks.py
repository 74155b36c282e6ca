"""Asynchronous inference with bounded windows, and what runs leave behind in any file system."""

import asyncio
import json
import time

import pytest

from duelgrid.__main__ import main
from duelgrid.plans import inference, repro
from duelgrid.sources import files


class Clock:
    """A coroutine of one prompt that notes how many are under way, and fails as often as a prompt says."""

    def __init__(self, error="429 rate limit"):
        self.now = self.most = 0
        self.asked, self.error = [], error

    async def __call__(self, prompt):
        self.now += 1
        self.most = max(self.most, self.now)
        self.asked.append(prompt)
        await asyncio.sleep(0.001 * (len(prompt) % 3))
        self.now -= 1
        if self.asked.count(prompt) <= int(prompt.rpartition("fails ")[2] or 0):
            raise RuntimeError(self.error)
        return prompt.upper()


@pytest.mark.parametrize("window", [1, 3, 50])
def test_at_most_a_window_is_asked_and_answers_keep_their_order(window):
    model, waited = Clock(), []

    async def sleep(seconds):
        waited.append(seconds)

    prompts = [f"p{k} {'x' * (k % 7)} fails {2 if k % 10 == 0 else 0}" for k in range(40)]
    assert asyncio.run(inference.ask_each(model, prompts, window, sleep=sleep)) == [p.upper() for p in prompts]
    assert model.most <= window and (window > 40 or model.most == window)
    # only what failed is asked again, twice each
    assert sorted(model.asked) == sorted(prompts + [p for k, p in enumerate(prompts) if k % 10 == 0] * 2)
    assert sorted(waited) == [1.0] * 4 + [2.0] * 4


def test_a_lasting_failure_ends_all():
    async def nothing(seconds):
        return None

    model = Clock("401 no such key")
    with pytest.raises(ExceptionGroup):
        asyncio.run(inference.ask_each(model, ["a fails 1", *(f"b{k} fails 0" for k in range(1000))], 2, sleep=nothing))
    assert model.asked.count("a fails 1") == 1 and len(model.asked) < 1000
    asker = inference.Asker(2)
    with pytest.raises(RuntimeError, match="401"):
        asker(Clock("401 no such key"), ["a fails 1"])
    asker.close()


def test_a_provider_of_coroutines_in_tasks(spark, monkeypatch):
    def make(name, options):
        async def answer(prompt):
            await asyncio.sleep(0.05)
            return f"{name} {prompt} {options.get('temperature')}"

        return answer

    monkeypatch.setitem(inference.PROVIDERS, "Slow", make)
    df = spark.createDataFrame([(k, f"p{k}", k % 2 / 2) for k in range(60)], "k int, prompt string, t double").repartition(2)
    began = time.time()
    got = {r.k: r.completion for r in inference.complete(df, "Slow/m", window=30).collect()}
    assert got == {k: f"m p{k} None" for k in range(60)} and time.time() - began < 60 * 0.05 + 20
    warm = inference.complete(df, "Slow/m", heat="t", window=30).collect()
    assert {r.k: r.completion for r in warm} == {k: f"m p{k} {k % 2 / 2}" for k in range(60)}


def test_batches_rarely_mix_temperatures(spark, monkeypatch, tmp_path):
    folder = str(tmp_path)

    def make(name, options):
        def answer(prompts):
            from pathlib import Path
            from uuid import uuid4

            Path(folder, uuid4().hex).write_text(str(len(prompts)))
            return prompts

        return answer

    monkeypatch.setitem(inference.PROVIDERS, "Counting", make)
    df = spark.createDataFrame([(f"p{k}", k % 4 / 4) for k in range(400)], "prompt string, t double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    inference.complete(df, "Counting/m", heat="t").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list(tmp_path.iterdir())) == 8  # not one for each of four temperatures in eight batches


def test_a_shared_folder_gets_every_file(spark, tmp_path, capsys):
    ins = spark.createDataFrame([(f"{k}", f"q{k}") for k in range(5)], "instruction_index string, instruction string")
    ins.write.parquet(f"{tmp_path}/i.parquet")
    out = f"file://{tmp_path}/deep/out"
    (tmp_path / "c.yaml").write_text(f"task: alpaca-eval\nresult_folder: {out}\nmodels: {{model_a: Dummy/a, model_b: Dummy/b}}\njudge: {{model: 'Dummy/score_A: 9 score_B: 1'}}\n")
    assert main(["--config", f"file://{tmp_path}/c.yaml", "--instructions", f"{tmp_path}/i.parquet", "--csv"], spark) == 0
    assert "all: 5 battles, 5 wins" in capsys.readouterr().out
    assert files.entries(spark, out) == ["annotations", "annotations-csv", "config.yaml", "results.json", "run-metadata.json"]
    record = json.loads(files.read_text(spark, f"{out}/run-metadata.json"))
    assert record["environment"]["python_version"] and record["dependencies"]["pyspark"].startswith("4.") and len(record["git_hash"]) == 40
    assert record["key_set_sha256"] == repro.sha256_text('["0","1","2","3","4"]') and len(record["template_sha256"]) == 64 and record["config"]["models"]["model_a"] == "Dummy/a"
    paths = {a["path"] for a in record["artifacts"]}
    assert {"results.json", "config.yaml"} <= paths and any(p.startswith("annotations/part-") for p in paths) and "run-metadata.json" not in paths
    # a config that a run has left starts the same run
    assert main(["--config", f"{out}/config.yaml", "--instructions", f"{tmp_path}/i.parquet"], spark) == 0


def test_texts_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    files.write_text(spark, path, "é" * 1000)
    files.write_text(spark, path, "short 中")
    assert files.read_text(spark, path) == "short 中" and files.entries(spark, f"file://{tmp_path}/a") == ["b.json"]
    assert not files.exists(spark, f"file://{tmp_path}/none") and files.entries(spark, f"file://{tmp_path}/none") == []


def test_revision_of_a_checkout(tmp_path):
    git = tmp_path / ".git"
    (git / "refs" / "heads").mkdir(parents=True)
    here = tmp_path / "x" / "y.py"
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack\nabc refs/heads/main\n")
    assert repro.source_revision(here) == "abc"
    (git / "refs" / "heads" / "main").write_text("def\n")
    assert repro.source_revision(here) == "def"
    (git / "HEAD").write_text("123\n")
    assert repro.source_revision(here) == "123"
