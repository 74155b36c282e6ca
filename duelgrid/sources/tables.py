"""Readers by suffix and the instruction, output and benchmark tables built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelgrid.sources.archives import read_zip
from duelgrid.sources.files import entries, files_below
from duelgrid.sources.order import ORD, in_load_order, place

INDEX_NAMES = ("instruction_index", "uid", "question_id", "id")
TEXT_NAMES = ("instruction", "prompt", "question", "turns")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """.parquet, .jsonl, .csv or .csv.zip; CSV columns are text unless a schema says otherwise, so ids keep their zeros."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".json")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if path.endswith(".csv"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.csv(path, header=True, multiLine=True, escape='"')
    if path.endswith(".csv.zip"):
        return read_zip(spark, path, schema)
    raise ValueError(f"no reader for {path!r}")


def read_ordered(spark: SparkSession, path: str, order: str = ORD) -> DataFrame:
    """A table with the place of each row, unless it has a column of that name."""
    raw = read_table(spark, path)
    if order in raw.columns:
        return raw
    return read_zip(spark, path, order=order) if path.endswith(".csv.zip") else in_load_order(raw, order)


def choose(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first of the names that exists; existence decides, not whether a row has a value."""
    return next((n for n in names if n in columns), None)


def first_turn(column: Column, kind: str) -> Column:
    """Text of a prompt given as text, as a list of texts or of structs; an empty list is ''."""
    if kind.startswith("array<string"):
        return F.coalesce(F.get(column, F.lit(0)), F.lit(""))
    if kind.startswith("array<struct"):
        names = [n for n in ("content", "text", "prompt") if f"{n}:" in kind]
        return F.coalesce(*(F.get(column, F.lit(0))[n].cast("string") for n in names), F.lit(""))
    if kind.startswith("struct"):
        return F.coalesce(*(column[n].cast("string") for n in ("content", "text", "prompt") if f"{n}:" in kind), F.lit(""))
    return column.cast("string")


def instructions(raw: DataFrame, order: str | None = None, question_rows: bool = True) -> DataFrame:
    """instruction_index, instruction and the category and language where they exist, each index once, the first row winning.

    First is by the column `order`, or by load order where raw is a scan of files.
    """
    types = dict(raw.dtypes)
    index, text = choose(raw.columns, INDEX_NAMES), choose(raw.columns, TEXT_NAMES)
    if text is None or (index is None and order is None):
        raise ValueError("neither an instruction nor a way to number it was found")
    ordinal = F.col(order) if order else place(raw)
    if not order:
        raw, ordinal = raw.withColumn("_place", ordinal), F.col("_place")
    if question_rows and "prompt" in types:
        raw = raw.where("prompt is not null")
    key = F.col(index).cast("string") if index else F.col(order).cast("string")
    out = raw.select(
        key.alias("instruction_index"), first_turn(F.col(text), types[text]).alias("instruction"),
        *(c for c in ("category", "lang") if c in types), ordinal.alias("_ord"),
    ).where("instruction_index is not null and instruction is not null")
    rank = F.row_number().over(Window.partitionBy("instruction_index").orderBy("_ord"))
    return out.withColumn("_r", rank).where("_r = 1").drop("_r", "_ord")


def assistant_output(columns: dict[str, str]) -> Column:
    """The flat output, else the last message's answer, whether it is a struct with `answer` or a text; '' counts as missing."""
    filled = lambda c: F.when(c != "", c)
    tries = [filled(F.col("output"))] if "output" in columns else []
    kind = columns.get("messages", "")
    if kind:
        last = F.try_element_at(F.col("messages"), F.lit(-1))["content"]
        if "content:struct" in kind:
            tries += [last["answer"].cast("string")] if "answer:" in kind else []
        elif "content:variant" in kind:
            tries += [F.try_variant_get(last, "$.answer", "string"), filled(F.try_variant_get(last, "$", "string"))]
        else:
            parsed = F.from_json(last, "answer string")["answer"]
            looks_nested = F.coalesce(last.rlike(r"^\s*\{"), F.lit(False))
            tries += [F.when(looks_nested, parsed).otherwise(filled(last))]
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def model_outputs_long(raw: DataFrame) -> DataFrame:
    """instruction_index, model and output of rows that have all three, and their order where there is one."""
    types = dict(raw.dtypes)
    index = choose(raw.columns, INDEX_NAMES)
    out = raw.select(F.col(index).cast("string").alias("instruction_index"), F.col("model").cast("string").alias("model"), assistant_output(types).alias("output"), *(c for c in (ORD,) if c in types))
    return out.dropna(subset=["instruction_index", "model", "output"])


def arena_hard(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """Instructions and model outputs (None without any) of a folder with question.jsonl and model_answer/*.jsonl."""
    names, answers = entries(spark, folder), [n for n in entries(spark, f"{folder}/model_answer") if n.endswith(".jsonl")]
    paths = [f"{folder}/question.jsonl"] if "question.jsonl" in names else []
    if not paths and not answers:
        raise FileNotFoundError(f"neither question.jsonl nor model_answer/*.jsonl below {folder}")
    outputs = model_outputs_long(in_load_order(spark.read.json([f"{folder}/model_answer/{n}" for n in answers]))) if answers else None
    questions = spark.read.json(paths or [f"{folder}/model_answer/{n}" for n in answers])
    return instructions(questions), outputs


def arena_hard_tables(spark: SparkSession, folder: str, tables_folder: str) -> tuple[DataFrame, DataFrame | None]:
    """The tables of arena_hard(), written once below tables_folder and read from there."""
    from duelgrid.plans.cache import cached, latest

    paths = [f"{tables_folder}/{n}" for n in ("instructions", "model_outputs")]
    made = [None, None] if latest(spark, paths[0]) else arena_hard(spark, folder)
    if made[1] is not None:
        cached(spark, paths[1], lambda: made[1])
    found = cached(spark, paths[0], lambda: made[0])
    outputs = latest(spark, paths[1])
    return found, spark.read.parquet(outputs) if outputs else None


LANGUAGE_FOLDER = r"/(?:lang=)?([^/]+)/[^/]+$"


def multilingual(spark: SparkSession, root: str, languages: tuple[str, ...], known: tuple[str, ...] = ()) -> DataFrame:
    """Parquet in folders xx or lang=xx of the asked languages, at any depth below root. Keys become id-lang.

    Folders of other languages of `known` are not entered, and files outside folders of asked languages are not opened.
    """
    name = lambda folder: folder.removeprefix("lang=")
    found = files_below(spark, root, lambda folder: name(folder) in languages or not (folder.startswith("lang=") or name(folder) in known))
    wanted = [path for path, _ in found if path.endswith(".parquet") and name(path.rsplit("/", 2)[-2]) in languages]
    if not wanted:
        raise FileNotFoundError(f"no language of {', '.join(languages)} below {root}")
    raw = spark.read.option("mergeSchema", True).parquet(*wanted)
    df = raw.withColumn("lang", F.regexp_extract(F.col("_metadata.file_path"), LANGUAGE_FOLDER, 1))
    return df.withColumn("instruction_index", F.concat_ws("-", F.col("question_id").cast("string"), F.col("lang"))).withColumnRenamed("prompt", "instruction").drop("question_id")


def contexts(spark: SparkSession, root: str, task: str) -> DataFrame:
    """instruction_index and instruction of a fluency task: the texts to go on with, of root/<language>-contexts.csv, numbered from 0."""
    raw = read_table(spark, f"{root}/{task.split('-')[-1]}-contexts.csv")
    # a file of records over several lines is one partition, whose rows are numbered as they stand
    return raw.select(F.monotonically_increasing_id().cast("string").alias("instruction_index"), "instruction")


def completion_file(spark: SparkSession, path: str) -> DataFrame:
    """instruction_index and completion of a table that stands for a model: its column completion, or output."""
    raw = read_table(spark, path)
    index, text = choose(raw.columns, INDEX_NAMES), choose(raw.columns, ("completion", "output"))
    if index is None or text is None:
        raise ValueError(f"{path!r} has no index or no completion")
    return raw.select(F.col(index).cast("string").alias("instruction_index"), F.coalesce(F.col(text), F.lit("")).alias("completion"))


def normalized_id(column: Column) -> Column:
    """Integer-like ids in one spelling."""
    return F.coalesce(column.cast("string").try_cast("bigint").cast("string"), column.cast("string"))


def two_turn_questions(questions: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """question rows (question_id, category, turns, reference) with the references of another model's answers, else their own."""
    turn = lambda c, k: F.get(F.col(c), F.lit(k))
    own = "reference" in questions.columns
    out = questions.select(
        normalized_id(F.col("question_id")).alias("instruction_index"), "category" if "category" in questions.columns else F.lit(None).cast("string").alias("category"),
        F.coalesce(turn("turns", 0), F.lit("")).alias("turn_1"), turn("turns", 1).alias("turn_2"),
        *((turn("reference", k) if own else F.lit(None).cast("string")).alias(f"reference_turn_{k + 1}") for k in (0, 1)),
    )
    if references is None:
        return out
    right = references.select(
        normalized_id(F.col("question_id")).alias("instruction_index"),
        *(F.get(F.get("choices", F.lit(0))["turns"], F.lit(k)).alias(f"reference_turn_{k + 1}") for k in (0, 1)),
    )
    return out.drop("reference_turn_1", "reference_turn_2").join(right, "instruction_index", "left")


def two_turn_answers(answers: DataFrame, n: int | None = None) -> DataFrame:
    """completion_turn_1 and _2 of answer rows (question_id, choices), by id; a missing turn is ''."""
    turns = F.get("choices", F.lit(0))["turns"]
    bad = F.raise_error(F.concat(F.lit("no answer turns for question "), F.coalesce(F.col("question_id").cast("string"), F.lit("NULL")))).cast("string")
    out = answers.select(
        normalized_id(F.col("question_id")).alias("instruction_index"),
        F.when(turns.isNull() | (F.size(turns) == 0), bad).otherwise(F.coalesce(F.get(turns, F.lit(0)), F.lit(""))).alias("completion_turn_1"),
        F.coalesce(F.get(turns, F.lit(1)), F.lit("")).alias("completion_turn_2"),
    ).orderBy(F.col("instruction_index").try_cast("bigint"), "instruction_index")
    return out.limit(n) if n is not None else out
