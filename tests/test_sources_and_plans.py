import json
import zipfile

import pytest
from pyspark.sql import functions as F

from duelgrid.operators.ratings import solve
from duelgrid.plans import baselines, cache, config, criteria, inference, pipelines, prompts, repro
from duelgrid.sources import arenas, tables
from duelgrid.streaming.ratings import running_statistics


def test_arena_shapes(spark):
    a = spark.createDataFrame(
        [("1", "m", "n", "p", "x", "y", 1, 0, 1), ("2", "m", "n", "p", "x", "y", 0, 1, 0), ("3", "m", "n", "p", "x", "y", 0, 0, 0)],
        "id string, model_a string, model_b string, prompt string, response_a string, response_b string, winner_model_a int, winner_model_b int, winner_tie int",
    )
    got = arenas.arena_55k(a)
    assert got.columns == list(arenas.COLUMNS)
    assert [(r.question_id, r.winner, r.turns, r.conversation_a[1].content) for r in got.orderBy("question_id").collect()] == [("1", "tie", 1, "x"), ("2", "model_b", 1, "x")]
    talk = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"
    rows = [("q", "2024-01-01 00:00:10", "m", "n", "both_bad", [("user", [("text", "a"), ("image", "z"), ("text", "b")]), ("assistant", [("text", "c")])], [], "EN")]
    b = spark.createDataFrame(rows, f"id string, t string, model_a string, model_b string, winner string, conversation_a {talk}, conversation_b {talk}, language string")
    b = arenas.arena_parquet(b.withColumn("timestamp", F.to_timestamp("t")), "LMArena-140k", single_turn=True).head()
    assert (b.winner, b.tstamp, b.lang, b.conversation_a[0].content) == ("tie (bothbad)", 1704067210, "en", "a b")
    flat = "array<struct<role:string,content:string>>"
    c = [("1", 5, "m", "n", "m", None, [("user", "u")], []), ("2", 5, "m", "n", "zz", False, [], []), ("3", 5, "m", "n", "m", True, [], [])]
    c = spark.createDataFrame(c, f"id string, tstamp long, model_a_name string, model_b_name string, chosen_model_name string, both_equal boolean, conversation_a {flat}, conversation_b {flat}")
    assert [(r.question_id, r.winner) for r in arenas.arena_comparia(c).orderBy("question_id").collect()] == [("1", "model_a"), ("3", "tie")]
    union = got.unionByName(arenas.arena_comparia(c))
    assert union.count() == 4


def test_load_arena(spark, tmp_path):
    flat = "array<struct<role:string,content:string>>"
    c = [("1", 5, "m", "n", "m", None, [("user", "u")], [])]
    spark.createDataFrame(c, f"id string, tstamp long, model_a_name string, model_b_name string, chosen_model_name string, both_equal boolean, conversation_a {flat}, conversation_b {flat}").write.parquet(f"{tmp_path}/comparia")
    assert arenas.load_arena(spark, str(tmp_path), "ComparIA").head().benchmark == "ComparIA"
    with pytest.raises(ValueError, match="unknown arena"):
        arenas.load_arena(spark, str(tmp_path), "none")
    filled = arenas.with_language(arenas.load_arena(spark, str(tmp_path), "ComparIA"), lambda: lambda texts: ["FR"] * len(texts))
    assert filled.head().lang == "fr"


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n001,"x, ""y""\nz"\n')
    assert tuple(tables.read_table(spark, f"{tmp_path}/a.csv").head()) == ("001", 'x, "y"\nz')
    with zipfile.ZipFile(tmp_path / "a.csv.zip", "w") as z:
        z.write(tmp_path / "a.csv", "a.csv")
    assert tuple(tables.read_table(spark, f"{tmp_path}/a.csv.zip").head()) == ("001", 'x, "y"\nz')
    assert tuple(tables.read_table(spark, f"{tmp_path}/a.csv.zip", "id int, text string").head()) == (1, 'x, "y"\nz')
    with pytest.raises(ValueError):
        tables.read_table(spark, "a.txt")


def test_instructions_and_outputs(spark):
    raw = spark.createDataFrame([("q1", "hi", "c", 1), ("q1", "again", "c", 2), ("q2", None, "c", 3), (None, "x", "c", 4)], "question_id string, prompt string, category string, o int")
    assert [tuple(r) for r in tables.instructions(raw, "o").collect()] == [("q1", "hi", "c")]
    kind = "array<struct<role:string,content:struct<answer:string,reasoning:string>>>"
    out = spark.createDataFrame([("q1", "m", "flat", None), ("q2", "m", "", [("user", ("no", "")), ("assistant", ("nested", "r"))]), ("q3", "m", None, None)], f"uid string, model string, output string, messages {kind}")
    assert {r.instruction_index: r.output for r in tables.model_outputs_long(out).collect()} == {"q1": "flat", "q2": "nested"}
    text = spark.createDataFrame([("1", "m", [("a", "plain")]), ("2", "m", [("a", '{"answer": "n"}')]), ("3", "m", [("a", '{"other": 1}')])], "uid string, model string, messages array<struct<role:string,content:string>>")
    assert {r.instruction_index: r.output for r in tables.model_outputs_long(text).collect()} == {"1": "plain", "2": "n"}
    turns = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, turns array<string>")
    assert [r.instruction for r in tables.instructions(turns, "id").orderBy("instruction_index").collect()] == ["a", ""]


def test_multilingual_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("10", "p", "en"), ("2", "p", "en"), ("1", "p", "ja")], "question_id string, prompt string, lang string")
    df.write.partitionBy("lang").parquet(f"{tmp_path}/m")
    got = tables.multilingual(spark, f"{tmp_path}/m", ("en",))
    assert [r.instruction_index for r in got.orderBy("instruction_index").collect()] == ["10-en", "2-en"]
    assert all("/lang=en/" in f for f in got.inputFiles())


def test_two_turn_tables(spark):
    q = spark.createDataFrame([("01", ["Q1"], None), ("2", ["Q2", "Q3"], ["R", "S"])], "question_id string, turns array<string>, reference array<string>")
    got = {r.instruction_index: r for r in tables.two_turn_questions(q).collect()}
    assert got["1"].turn_2 is None and got["2"].reference_turn_2 == "S"
    kind = "question_id string, choices array<struct<turns:array<string>>>"
    a = spark.createDataFrame([("2", [(["A2", "B2"],)]), ("10", [(["A1"],)])], kind)
    assert [tuple(r) for r in tables.two_turn_answers(a).collect()] == [("2", "A2", "B2"), ("10", "A1", "")]
    assert {r.instruction_index: r.reference_turn_1 for r in tables.two_turn_questions(q, a).collect()} == {"1": None, "2": "A2"}
    with pytest.raises(Exception, match="no answer turns"):
        tables.two_turn_answers(spark.createDataFrame([("2", [])], kind)).collect()


def test_prompts(spark):
    df = spark.createDataFrame([("{completion_A}", "a {completion_B}", "b")], "q string, a string, b string")
    text = df.select(prompts.render_pair(F.col("q"), F.col("a"), F.col("b"))).head()[0]
    assert text.count("a {completion_B}") == 1 and text.startswith("<|User Prompt|>\n{completion_A}\n") and text.endswith(prompts.SCORES)
    assert prompts.output_section(prompts.TEMPLATE).startswith("# Your output")
    with pytest.raises(ValueError):
        prompts.output_section("none")


def test_prompt_resolution(tmp_path):
    assert prompts.resolve("mt-bench").delegated and prompts.resolve("fluency-fr").name == "fluency" and prompts.resolve("alpaca-eval", "default_with_explanation").explain
    (tmp_path / "t.txt").write_text("{completion_A} vs {completion_B}")
    assert prompts.resolve(template_file=str(tmp_path / "t.txt")).template == "{completion_A} vs {completion_B}"
    (tmp_path / "t.txt").write_text("{completion_A}")
    for kwargs in ({"preset": "nope"}, {"template_file": str(tmp_path / "t.txt")}):
        with pytest.raises(ValueError):
            prompts.resolve(**kwargs)
    assert len(prompts.resolve().metadata()["template_sha256"]) == 64


def test_baselines(spark):
    df = spark.createDataFrame([("1", "hard_prompt"), ("2", "creative_writing")], "instruction_index string, category string")
    got = baselines.with_baseline(df, "arena-hard-v2.0")
    assert baselines.display_name(got) == "gemini-2.0-flash-001+o3-mini-2025-01-31"
    assert baselines.with_baseline(df, "alpaca-eval").head().model_b == "gpt4_1106_preview"
    with pytest.raises(Exception, match="no baseline for category brand_new"):
        baselines.with_baseline(df.withColumn("category", F.lit("brand_new")), "arena-hard-v2.0").collect()
    with pytest.raises(ValueError):
        baselines.with_baseline(df, "unknown")
    assert baselines.split_multilingual("m-arena-hard-v2.0-fr") == ("m-arena-hard-v2.0", ("fr",))
    assert len(baselines.split_multilingual("m-arena-hard-v0.1")[1]) == 23 and baselines.split_multilingual("m-arena-hard-v0.1-xx") is None


def test_criteria(tmp_path, spark):
    (tmp_path / "c.yaml").write_text("criteria:\n- {name: ' clear ', description: d, score_references: {1: low, 10: high}}\n")
    (found,) = criteria.load(str(tmp_path / "c.yaml"))
    assert found.name == "clear" and found.prompt_block().splitlines() == ["- clear: d", "    10: high", "    1: low"]
    with pytest.raises(ValueError):
        criteria.Criterion("x", "d", {11: "too high"})
    with pytest.raises(ValueError):
        criteria.load("c.json")
    df = spark.sql("select map('clarity', 2.0D) as s")
    assert df.select(criteria.scores_in_order(F.col("s"), list(criteria.DEFAULT))).head()[0] == [0.0, 0.0, 0.0, 0.0, 2.0, 0.0]


def test_repro(spark, tmp_path):
    df = spark.createDataFrame([(9,), (1,), (5,), (9,)], "i int")
    again = spark.createDataFrame([(5,), (9,), (1,)], "i int")
    assert repro.set_hash(df, "i").head() == repro.set_hash(again, "i").head()
    rows = spark.createDataFrame([(2, "q\"2", "a", "b"), (1, "q1", "c", "d")], "index int, question_id string, model_a string, model_b string")
    want = [{"index": 1, "question_id": "q1", "model_a": "c", "model_b": "d"}, {"index": 2, "question_id": 'q"2', "model_a": "a", "model_b": "b"}]
    assert repro.sample_fingerprint(rows).head().fingerprint == repro.sha256_text(json.dumps(want, sort_keys=True))
    made = repro.run_metadata("x", {"a": {3, 1}}, {"w": float("nan")}, {"rows": df}, ["b", "a"])
    assert made["results"] == {"w": None} and made["config"] == {"a": [1, 3]} and made["dataset_statistics"] == {"rows": 4} and made["artifacts"] == ["a", "b"]
    repro.write_json(tmp_path / "deep" / "r.json", made)
    assert json.loads((tmp_path / "deep" / "r.json").read_text())["schema"] == 1


def test_cache_keeps_texts(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([("NA", ""), ("0001", None)], "a string, b string")

    path = f"{tmp_path}/{cache.cache_token(model='m', seed=1)}"
    for _ in range(2):
        assert {tuple(r) for r in cache.cached(spark, path, make).collect()} == {("NA", ""), ("0001", None)}
    assert len(calls) == 1 and cache.cache_token(a=1, b=2) == cache.cache_token(b=2, a=1) != cache.cache_token(a=1, b=3)


def test_config(tmp_path):
    made = config.build(**{"models.model_a": "m", "judge.swap_mode": "both", "elo.n_head": 3})
    config.dump(made, tmp_path / "c.yaml")
    assert config.build(str(tmp_path / "c.yaml")) == made
    assert config.build(str(tmp_path / "c.yaml"), **{"judge.swap_mode": "fixed"}).judge.swap_mode == "fixed"
    for bad in ({}, {"models.model_a": "m", "judge.swap_mode": "x"}, {"models.model_a": "m", "task": "elo-none"}, {"nope": 1}):
        with pytest.raises(ValueError):
            config.build(**bad)
    both = config.ModelConfig(temperature=0.1, seed=3, baseline={"temperature": 0.9})
    assert both.generation_kwargs()["temperature"] == 0.1 and both.generation_kwargs(True) == {"max_tokens": 32768, "temperature": 0.9, "seed": 3}


def test_ask_retries_only_what_is_left():
    seen = []

    def model(batch):
        seen.append(list(batch))
        if len(batch) > 2:
            raise RuntimeError("429 rate limit")
        return [p.upper() for p in batch]

    waits = []
    assert inference.ask(model, ["a", "b", "c", "d", "e"], sleep=waits.append) == ["A", "B", "C", "D", "E"]
    assert waits == [1.0] and seen[0] == ["a", "b", "c", "d", "e"]
    with pytest.raises(ValueError):
        inference.ask(lambda b: (_ for _ in ()).throw(ValueError("cannot generate")), ["a"], sleep=waits.append)
    with pytest.raises(ValueError, match="unknown provider"):
        inference.make_model("None/x")


def pairs(spark):
    ins = spark.createDataFrame([(str(k), f"q{k}", f"c{k % 2}") for k in range(10)], "instruction_index string, instruction string, category string")
    out = ins.select("instruction_index", F.concat(F.lit("answer "), "instruction_index").alias("completion"))
    return ins, out


@pytest.mark.parametrize(("mode", "rate", "rows"), [("fixed", 0.0, 10), ("both", 0.5, 20)])
def test_pairwise_run(spark, mode, rate, rows):
    ins, out = pairs(spark)
    made = config.build(**{"models.model_a": "m", "judge.model": "Dummy/score_A: 0 score_B: 10", "judge.swap_mode": mode})
    judged, summary = pipelines.evaluate(ins, out, out, made, ["category"])
    overall = summary.where("key = ''").head()
    assert judged.count() == rows == overall.num_battles and overall.winrate == rate
    assert pipelines.with_preferences(judged, 0.0).where("pref <> 0.5").count() == 0


def test_unparseable_run(spark):
    ins, out = pairs(spark)
    made = config.build(**{"models.model_a": "m", "judge.model": "Dummy/no scores", "judge.swap_mode": "both", "n_instructions": 4})
    _, summary = pipelines.evaluate(ins, out, out, made)
    assert tuple(summary.head()) == (8, 0, 0, 0, 8, None)


def test_rating_run(spark):
    winners = ["model_a", "model_b", "tie", "model_a"]
    rows = [(f"b{k}", f"m{k % 3}", f"m{(k + 1) % 3}", winners[k % 4], "en" if k % 2 else "fr", [("user", f"q{k}"), ("assistant", "x")], [("user", f"q{k}"), ("assistant", "y")]) for k in range(30)]
    kind = "array<struct<role:string,content:string>>"
    arena = spark.createDataFrame(rows, f"battle_id string, model_a string, model_b string, winner string, lang string, conversation_a {kind}, conversation_b {kind}")
    ours = arena.select("battle_id", F.lit("mine").alias("completion"))
    made = config.build(**{"task": "elo-comparia", "models.model_a": "me", "judge.model": "Dummy/score_A: 1 score_B: 1", "elo.least_battles": 5, "elo.n_per_language": 5, "elo.bootstraps": 4})
    got = pipelines.rate(arena, ours, made)
    board = got.leaderboard.collect()
    assert {r.model for r in board} == {"me", "m0", "m1", "m2"} and got.summary.head().num_ties == 10
    assert got.error.head().models == 3 and set(got.human) == {"m0", "m1", "m2"}


def test_two_turn_run(spark):
    q = spark.createDataFrame([("1", "math", "q", "r", "x", "y"), ("2", "stem", "q", None, None, None)], "instruction_index string, category string, turn_1 string, turn_2 string, reference_turn_1 string, reference_turn_2 string")
    done = inference.complete_two_turns(q, "Dummy/hello").select("instruction_index", "completion_turn_1", "completion_turn_2")
    assert {tuple(r)[1:] for r in done.collect()} == {("hello", "hello")}
    made = config.build(**{"task": "mt-bench", "models.model_a": "m", "judge.model": "Dummy/[[A]]", "judge.swap_mode": "both"})
    items, summary = pipelines.judge_two_turns(q, done, done, made)
    assert items.count() == 3 and items.where("inconsistent and winner = 'tie'").count() == 3
    assert {(r.key, r.value): r.num_ties for r in summary.collect()} == {("", ""): 3, ("category", "math"): 2, ("category", "stem"): 1, ("turn", "1"): 2, ("turn", "2"): 1}


def test_streaming_statistics_equal_batch(spark, tmp_path):
    rows = [(f"m{k % 3}", f"m{(k + 1) % 3}", [0.0, 1.0, 0.5, None][k % 4]) for k in range(60)]
    df = spark.createDataFrame(rows, "model_a string, model_b string, pref double")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = running_statistics(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("running").collect()}
    assert got == {tuple(r) for r in running_statistics(df).collect()}
    assert len(solve((a, b, x, y) for a, b, x, y, _ in got)) == 3


def test_published_layouts(spark, tmp_path):
    root = tmp_path / "hard"
    (root / "model_answer").mkdir(parents=True)
    (root / "question.jsonl").write_text('{"uid": "q1", "prompt": "ask", "category": "c"}\n{"uid": "q2", "prompt": "more", "category": "d"}\n')
    for m in ("m1", "m2"):
        (root / "model_answer" / f"{m}.jsonl").write_text(f'{{"uid": "q1", "model": "{m}", "messages": [{{"role": "user", "content": "ask"}}, {{"role": "assistant", "content": {{"answer": "{m} says"}}}}]}}\n')
    for _ in range(2):  # the second time from the written tables
        asked, told = tables.arena_hard_tables(spark, f"file://{root}", f"file://{tmp_path}/tables")
        assert {tuple(r) for r in asked.select("instruction_index", "instruction").collect()} == {("q1", "ask"), ("q2", "more")}
        assert {(r.instruction_index, r.model, r.output) for r in told.collect()} == {("q1", "m1", "m1 says"), ("q1", "m2", "m2 says")}
    with pytest.raises(FileNotFoundError):
        tables.arena_hard(spark, f"file://{tmp_path}/none")
    for name in ("de", "lang=fr", "pl"):
        spark.createDataFrame([(1, f"p {name}")], "question_id int, prompt string").write.parquet(f"file://{tmp_path}/many/{name}")
    many = tables.multilingual(spark, f"file://{tmp_path}/many", ("de", "fr", "el"))
    assert {(r.instruction_index, r.instruction) for r in many.collect()} == {("1-de", "p de"), ("1-fr", "p lang=fr")}
    (tmp_path / "french-contexts.csv").write_text('instruction,x\n"un, deux\ntrois",1\nquatre,2\n')
    assert [tuple(r) for r in tables.contexts(spark, f"file://{tmp_path}", "fluency-french").collect()] == [("0", "un, deux\ntrois"), ("1", "quatre")]
    (tmp_path / "mine.csv").write_text("instruction_index,completion\n0001,yes\nNA,\n")
    assert [tuple(r) for r in tables.completion_file(spark, f"file://{tmp_path}/mine.csv").collect()] == [("0001", "yes"), ("NA", "")]


def test_fingerprint_is_that_of_ascii_json(spark):
    import hashlib
    import json

    rows = [(3, "é\"\\", "b\n", "中😀"), ("x1", "a", "b", "q")]
    rows = [{"index": str(i), "model_a": a, "model_b": b, "question_id": q} for i, a, b, q in rows]
    listed = [dict(r, index=int(r["index"]) if r["index"].isdigit() else r["index"]) for r in rows]
    want = hashlib.sha256(json.dumps(listed).encode()).hexdigest()
    df = spark.createDataFrame([(k, *r.values()) for k, r in enumerate(rows)], "place int, index string, model_a string, model_b string, question_id string").repartition(3)
    assert tuple(repro.sample_fingerprint(df, "place").head()) == (want, 2)
    assert tuple(repro.sample_fingerprint(df.limit(0), "place").head()) == (hashlib.sha256(b"[]").hexdigest(), 0)


def test_digests_stream_any_number_of_rows(spark):
    import hashlib
    import json

    df = spark.range(0, 1_200_000, numPartitions=6).select(F.concat(F.lit("k"), F.pmod(F.col("id") * 7919, F.lit(1_100_000))).alias("key"))
    keys = sorted({f"k{k * 7919 % 1_100_000}" for k in range(1_200_000)})
    want = hashlib.sha256(json.dumps(keys, separators=(",", ":")).encode()).hexdigest()
    made = repro.set_hash(df, "key")
    assert tuple(made.head()) == (want, len(keys))
    plan = made._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "rangepartitioning" in plan


def test_a_half_written_cache_is_made_again(spark, tmp_path):
    from duelgrid.plans import cache

    path, made = f"{tmp_path}/t", []
    make = lambda: made.append(1) or spark.range(3)
    assert cache.cached(spark, path, make).count() == cache.cached(spark, path, make).count() == 3 and len(made) == 1
    next((tmp_path / "t").glob("v-*/_SUCCESS")).unlink()
    assert cache.cached(spark, path, make).count() == 3 and len(made) == 2
