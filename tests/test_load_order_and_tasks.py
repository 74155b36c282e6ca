"""Load order, languages, content of caches, and runs over published folders."""

import json
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from duelgrid.__main__ import main
from duelgrid.operators import battles as B
from duelgrid.operators.completions import first_rows
from duelgrid.plans import cache, inference, pipelines
from duelgrid.plans.config import build
from duelgrid.plans.tasks import TASKS, task_of
from duelgrid.sources import arenas, files, language, tables
from duelgrid.sources.order import in_load_order

TALK = "array<struct<role:string,content:string>>"


@pytest.fixture
def uneven(tmp_path, spark):
    """Files of very different sizes, the first by name the smallest: Spark reads the largest first."""
    rng = random.Random(0)
    duckdb.sql("create or replace temp table t (k int, v int)")
    for f, n in enumerate((3, 40, 9000, 500)):
        duckdb.sql(f"create or replace temp table t as select (random() * 60)::int as k, {f} * 100000 + i as v from range({n}) r(i)")
        duckdb.sql(f"copy t to '{tmp_path}/f{f}.parquet' (format parquet, row_group_size 2048)")
        duckdb.sql(f"copy t to '{tmp_path}/f{f}.json' (format json)")
    del rng
    return str(tmp_path)


@pytest.mark.parametrize("bytes_", ["4k", "128m"])
@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_first_rows_and_heads_are_those_of_the_files(spark, uneven, kind, bytes_):
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    try:
        read = spark.read.parquet(*(f"{uneven}/f{k}.parquet" for k in range(4))) if kind == "parquet" else spark.read.json(f"{uneven}/*.json")
        df = in_load_order(read)
        firsts = {(r.k, r.v) for r in first_rows(df, "k", "ord").collect()}
        head = [r.v for r in B.head(df.repartition(7), 100, "ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # values count up along the files, so the least one is the first
    want = duckdb.sql(f"select k, min(v) from '{uneven}/*.parquet' group by k").fetchall()
    assert firsts == set(want)
    assert head == [r[0] for r in duckdb.sql(f"select v from '{uneven}/*.parquet' order by v limit 100").fetchall()]


def test_a_table_without_files_keeps_its_running_order(spark):
    df = in_load_order(spark.range(10).repartition(1).sortWithinPartitions(F.desc("id")))
    assert [r.id for r in df.orderBy("ord").collect()] == list(range(9, -1, -1))


def test_instructions_keep_the_first_of_the_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"uid": "q", "prompt": "first"}\n')
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"uid": "q" if k else "r", "prompt": f"later {k}"}) for k in range(5000)))
    got = tables.instructions(spark.read.json(f"file://{tmp_path}/*.jsonl"))
    assert {r.instruction_index: r.instruction for r in got.collect()} == {"q": "first", "r": "later 0"}


# --- languages
def counting(folder):
    """A loader whose detector notes what it is made for and asked."""

    def load():
        from pathlib import Path
        from uuid import uuid4

        Path(folder, f"made-{uuid4().hex}").touch()

        def detect(texts):
            Path(folder, f"asked-{uuid4().hex}").write_text("\n".join(texts))
            return [t[:2].upper() if t else None for t in texts]

        return detect

    return load


def test_only_rows_without_a_language_reach_the_detector(spark, tmp_path):
    rows = [(k, f"fr text {k}" if k % 3 else None, "DE" if k % 2 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, text string, lang string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    got = {r.k: r.lang for r in language.with_language(df, F.col("text"), counting(str(tmp_path))).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: "DE" if k % 2 else "fr" if t else None for k, t, _ in rows}
    asked = [line for f in tmp_path.glob("asked-*") for line in f.read_text().split("\n")]
    assert sorted(asked) == sorted(t for k, t, lang in rows if t and lang is None)
    assert 1 <= len(list(tmp_path.glob("made-*"))) <= 2


def test_function_words():
    detect = language.load(language.DEFAULT)
    texts = ["The cat and the dog", "le chat et les chiens", "der Hund und das Haus", "los perros y las casas", "это дом", "これは本です", "中文", "xyz", "", "한국어", "por que non"]
    assert detect(texts) == ["en", "fr", "de", "es", "ru", "ja", "zh", "und", "und", "ko", "es"]
    assert language.load(language.DEFAULT) is detect


def arena_folder(spark, root):
    talk = lambda q: [("user", q), ("assistant", "a")]
    texts = ["the cat and the dog", "le chat et les chiens", "der Hund und das Haus"]
    rows = [(str(k), 5, f"m{k % 2}", f"m{(k + 1) % 2}", f"m{k % 3 % 2}", False, talk(texts[k % 3]), talk(texts[k % 3])) for k in range(12)]
    kind = f"id string, tstamp long, model_a_name string, model_b_name string, chosen_model_name string, both_equal boolean, conversation_a {TALK}, conversation_b {TALK}"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/comparia")
    csv = "id,model_a,model_b,prompt,response_a,response_b,winner_model_a,winner_model_b,winner_tie\n" + "".join(f'{k},m0,m1,"{texts[k % 3]}",a,b,1,0,0\n' for k in range(9))
    (root / "lmarena-55k").mkdir()
    (root / "lmarena-55k" / "train.csv").write_text(csv)


def test_arenas_get_their_languages_and_order(spark, tmp_path):
    arena_folder(spark, tmp_path)
    for name, n in (("ComparIA", 12), ("LMArena-55k", 9)):
        bare = arenas.load_arena(spark, f"file://{tmp_path}", name)
        assert bare.where("lang is not null").count() == 0
        with pytest.raises(Exception, match="give load_arena a detector"):
            B.languages(bare, ["fr"], strict=True).collect()
        full = arenas.load_arena(spark, f"file://{tmp_path}", name, language.DEFAULT)
        rows = full.orderBy("ord").collect()
        assert [int(r.question_id) for r in rows] == list(range(n)) and [r.lang for r in rows] == [("en", "fr", "de")[k % 3] for k in range(n)]


def test_heads_compose_in_load_order(spark):
    df = spark.createDataFrame([(f"q{k}", "ab"[k % 3 == 0], k) for k in range(30)], "battle_id string, lang string, ord int")
    got = lambda *a: sorted(int(r.battle_id[1:]) for r in B.panel(df, *a, "battle_id", "ord").collect())
    assert got(None, 12, None) == list(range(12))  # not q0, q1, q10, q11
    assert got(None, None, 4) == [0, 1, 2, 3, 4, 5, 6, 9]
    assert got(None, 5, 4) == [0, 1, 2, 3, 4]
    assert len(got(7, None, None)) == 7 and len(got(None, None, None)) == 30
    for bad in ((7, 1, None), (7, None, 1)):
        with pytest.raises(ValueError):
            got(*bad)
    with pytest.raises(ValueError):
        build(**{"task": "elo-comparia", "models.model_a": "m", "elo.n_random": 5, "n_instructions": 3})


# --- caches
def test_content_counts_rows_whatever_their_order(spark):
    rows = [(k, f"t{k}", [k], {"a": k}, bytes([k])) for k in range(50)] + [(None, None, None, None, None)]
    kind = "k int, text string, list array<int>, map map<string,int>, raw binary"
    df = spark.createDataFrame(rows, kind)
    same = [df.repartition(5), df.orderBy(F.desc("k")), df.select("text", "k", "raw", "map", "list")]
    other = [df.limit(50), df.union(df.limit(1)), df.withColumn("text", F.coalesce("text", F.lit("-"))), df.withColumnRenamed("text", "txt"), df.withColumn("k", F.col("k").cast("long"))]
    digest = cache.content(df)
    assert {cache.content(x) for x in same} == {digest} and digest not in {cache.content(x) for x in other} and len({cache.content(x) for x in other}) == 5
    a, b = (spark.createDataFrame([r], "a string, b string") for r in (("x1:y", "z"), ("x", "1:yz")))
    assert cache.content(a) != cache.content(b) and cache.content(a.limit(0)) == cache.content(b.limit(0))


def test_two_writers_leave_whole_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = cache.cached(spark, path, lambda: spark.range(3))
    second = cache.cached(spark, path, lambda: spark.range(5), ignore=True)
    assert first.count() == 3 and second.count() == 5 and cache.cached(spark, path, lambda: 1 / 0).count() == 5
    assert len(files.entries(spark, path)) == 2


def judged(spark, tmp_path, monkeypatch, said):
    """The names of completions in what the judge was asked, under one configuration and folder."""
    asked = tmp_path / "asked"
    asked.mkdir(exist_ok=True)
    folder = str(asked)

    def make(name, options):
        def answer(prompts):
            from pathlib import Path
            from uuid import uuid4

            Path(folder, uuid4().hex).write_text("\n".join(prompts))
            return ["score_A: 9 score_B: 1"] * len(prompts)

        return answer

    monkeypatch.setitem(inference.PROVIDERS, "Noting", make)
    ins = spark.createDataFrame([(str(k), f"do {k}") for k in range(4)], "instruction_index string, instruction string")
    given = lambda s: spark.createDataFrame([(str(k), f"{s} {k}") for k in range(4)], "instruction_index string, completion string")
    config = build(**{"models.model_a": "a", "models.model_b": "b", "judge.model": "Noting/x", "cache_folder": f"file://{tmp_path}/cache"})
    before = len(list(asked.iterdir()))
    rows, _ = pipelines.evaluate(ins, given(said), given("other"), config)
    return rows.collect(), len(list(asked.iterdir())) - before


def test_other_completions_under_one_configuration_are_judged_anew(spark, tmp_path, monkeypatch):
    rows, asked = judged(spark, tmp_path, monkeypatch, "first")
    assert asked and all("first" in r.judge_input for r in rows)
    rows, asked = judged(spark, tmp_path, monkeypatch, "second")
    assert asked and all("second" in r.judge_input for r in rows)
    rows, asked = judged(spark, tmp_path, monkeypatch, "first")
    assert not asked and all("first" in r.judge_input for r in rows)


# --- published folders
def test_every_task_has_a_row():
    found = {n: task_of(n).run for n in ("elo-comparia", "mt-bench", "arena-hard-v2.0", "m-arena-hard-v2.0-EU", "fluency-french", "alpaca-eval")}
    assert found == {"elo-comparia": "ratings", "mt-bench": "two_turns", "arena-hard-v2.0": "pairs", "m-arena-hard-v2.0-EU": "pairs", "fluency-french": "pairs", "alpaca-eval": "pairs"}
    assert len({t.pattern for t in TASKS}) == len(TASKS)


def run(spark, capsys, tmp_path, data, **settings):
    argv = ["--data", f"file://{data}"]
    for k, v in ({"judge.model": "'Dummy/score_A: 9 score_B: 1 [[A]]'", "result_folder": f"{tmp_path}/out"} | settings).items():
        argv += ["--set", f"{k}={v}"]
    assert main(argv, spark) == 0
    return capsys.readouterr().out


def test_arena_hard_as_published(spark, tmp_path, capsys):
    root = tmp_path / "arena"
    (root / "model_answer").mkdir(parents=True)
    (root / "question.jsonl").write_text("".join(json.dumps({"uid": f"q{k}", "prompt": f"ask {k}", "category": ("coding", "creative_writing")[k % 2]}) + "\n" for k in range(6)))
    for m in ("mine", "o3-mini-2025-01-31", "gemini-2.0-flash-001"):
        line = lambda k: {"uid": f"q{k}", "model": m, "messages": [{"role": "user", "content": "ask"}, {"role": "assistant", "content": {"answer": f"{m} {k}"}}]}  # noqa: B023, E731
        (root / "model_answer" / f"{m}.jsonl").write_text("".join(json.dumps(line(k)) + "\n" for k in range(6)))
    assert "all: 6 battles, 6 wins" in run(spark, capsys, tmp_path, root, task="arena-hard-v2.0", **{"models.model_a": "mine"})
    found = {r.instruction_index: r.judge_input for r in spark.read.parquet(f"{tmp_path}/out/annotations").collect()}
    assert "o3-mini-2025-01-31 0" in found["q0"] and "gemini-2.0-flash-001 1" in found["q1"] and "mine 1" in found["q1"]
    # a model that no file holds is asked; a lost baseline is an error
    assert "all: 6 battles" in run(spark, capsys, tmp_path, root, task="arena-hard-v2.0", **{"models.model_a": "Dummy/new", "models.model_b": "mine"})
    (root / "model_answer" / "gemini-2.0-flash-001.jsonl").unlink()
    with pytest.raises(ValueError, match="all but 3"):
        run(spark, capsys, tmp_path, root, task="arena-hard-v2.0", **{"models.model_a": "mine"})


def test_multilingual_as_published_and_nested(spark, tmp_path, capsys):
    for folder in ("data/v2/de", "data/v2/lang=fr", "data/ja", "de/deep/pl", "data/notes"):
        spark.createDataFrame([(1, f"p {folder}")], "question_id int, prompt string").write.parquet(f"file://{tmp_path}/m/{folder}")
    known = ("de", "fr", "ja", "pl", "el")
    many = tables.multilingual(spark, f"file://{tmp_path}/m", ("de", "fr"), known)
    assert {(r.instruction_index, r.instruction) for r in many.collect()} == {("1-de", "p data/v2/de"), ("1-fr", "p data/v2/lang=fr")}
    assert {f.split("/m/")[1].rsplit("/", 1)[0] for f in many.inputFiles()} == {"data/v2/de", "data/v2/lang=fr"}
    entered = []
    list(files.files_below(spark, f"file://{tmp_path}/m", lambda f: entered.append(f) or f != "ja"))
    assert "ja" in entered and "pl" in entered
    out = run(spark, capsys, tmp_path, tmp_path / "m", task="m-arena-hard-v2.0-fr", **{"models.model_a": "Dummy/a", "models.model_b": "Dummy/b"})
    assert "all: 1 battles" in out
    with pytest.raises(FileNotFoundError):
        tables.multilingual(spark, f"file://{tmp_path}/m", ("el",), known)


def test_two_turns_as_published(spark, tmp_path, capsys):
    root = tmp_path / "data" / "mt_bench"
    (root / "model_answer").mkdir(parents=True)
    (tmp_path / "reference_answer").mkdir()
    line = lambda k, name: json.dumps({"question_id": k, "choices": [{"turns": [f"{name} one {k}", f"{name} two {k}"]}]}) + "\n"
    (root / "question.jsonl").write_text("".join(json.dumps({"question_id": k, "category": ("math", "writing")[k % 2], "turns": [f"q{k}", f"r{k}"]}) + "\n" for k in range(81, 85)))
    (tmp_path / "reference_answer" / "gpt-4.jsonl").write_text("".join(line(k, "ref") for k in range(81, 85)))
    for m in ("mine", "gpt-4"):
        (root / "model_answer" / f"{m}.jsonl").write_text("".join(line(k, m) for k in range(81, 85)))
    out = run(spark, capsys, tmp_path, tmp_path, task="mt-bench", **{"models.model_a": "mine"})
    assert "all: 8 battles, 8 wins" in out and "category math: 4 battles" in out
    asked = run(spark, capsys, tmp_path, tmp_path, task="mt-bench", **{"models.model_a": "Dummy/x", "n_instructions": 2})
    assert "all: 4 battles" in asked


def test_tables_as_published(spark, tmp_path, capsys):
    for folder in ("instructions", "model_outputs"):
        (tmp_path / "tables" / folder).mkdir(parents=True)
    (tmp_path / "tables" / "instructions" / "alpaca-eval.csv").write_text("instruction_index,instruction\n" + "".join(f"{k},do {k}\n" for k in range(12)))
    rows = [(k, m, f"{m} {k}") for m in ("mine", "gpt4_1106_preview") for k in range(12)] + [(3, "mine", "mine again")]
    with zipfile.ZipFile(tmp_path / "tables" / "model_outputs" / "alpaca-eval.csv.zip", "w") as z:
        z.writestr("a.csv", "instruction_index,model,output\n" + "".join(f"{k},{m},{o}\n" for k, m, o in rows))
    assert "all: 12 battles" in run(spark, capsys, tmp_path, tmp_path, task="alpaca-eval", **{"models.model_a": "mine"})
    found = {r.instruction_index: r.judge_input for r in spark.read.parquet(f"{tmp_path}/out/annotations").collect()}
    assert "mine again" in found["3"] and "gpt4_1106_preview 11" in found["11"]
    run(spark, capsys, tmp_path, tmp_path, task="alpaca-eval", **{"models.model_a": "mine", "n_instructions": 4})
    assert {r.instruction_index for r in spark.read.parquet(f"{tmp_path}/out/annotations").collect()} == {"0", "1", "2", "3"}
