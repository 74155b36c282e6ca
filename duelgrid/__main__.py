"""python -m duelgrid --config run.yaml (--data FOLDER | --instructions PATH --outputs PATH) [--answers PATH] [--arena ROOT] [--set key=value ...]"""

from __future__ import annotations

import argparse
import sys

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.operators.completions import per_row_baseline
from duelgrid.plans import pipelines, results
from duelgrid.plans.baselines import ARENAS, native_baseline, with_baseline
from duelgrid.plans.config import RunConfig, build
from duelgrid.plans.tasks import Data, outputs_of, task_of, with_files
from duelgrid.sources.arenas import load_arena
from duelgrid.sources.files import read_text
from duelgrid.sources.tables import contexts, read_ordered, read_table


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="duelgrid", description=__doc__)
    p.add_argument("--config", help="a YAML file; --set goes before it, it goes before defaults")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a setting, nested ones with dots")
    p.add_argument("--data", help="the task's data as published: instructions, and completions where there are any")
    p.add_argument("--instructions", help="table of instruction_index, instruction and, as the task needs, category or turns; for fluency tasks the folder of contexts")
    p.add_argument("--outputs", help="table of instruction_index, model, output; without it the models are asked")
    p.add_argument("--answers", help="for ratings: table of battle_id, completion of the evaluated model")
    p.add_argument("--arena", help="for ratings: folder of the arenas")
    p.add_argument("--csv", action="store_true", help="annotations as CSV too")
    return p.parse_args(argv)


def _data(spark: SparkSession, args: argparse.Namespace, config: RunConfig) -> Data:
    """Published data, or tables in columns of ours."""
    task = task_of(config.task)
    if args.data:
        return with_files(spark, task.read(spark, args.data, config.task))
    asked = contexts(spark, args.instructions, config.task) if "fluency" in config.task else read_table(spark, args.instructions)
    outputs = read_ordered(spark, args.outputs) if args.outputs else None
    if task.run == "two_turns":
        of = lambda m: None if outputs is None or outputs.where(F.col("model") == m).isEmpty() else outputs.where(F.col("model") == m)
        return Data(asked, of, outputs)
    return with_files(spark, Data(asked, outputs_of(outputs), outputs))


def _pairs(data: Data, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """Judge a model against one other, or against each row's own baseline where a task has several."""
    instructions, models = data.instructions, config.models
    by = ["category"] if "category" in instructions.columns else []
    baseline = models.model_b or native_baseline(config.task)
    if isinstance(baseline, str) or baseline is None:
        models.model_b = baseline
        theirs = data.completions(baseline) if baseline else None
    else:
        if data.outputs is None:
            raise ValueError(f"task {config.task!r} has a baseline by category, whose completions are not there; name a model")
        instructions = with_baseline(instructions, config.task)
        theirs = per_row_baseline(instructions, data.outputs, strict=True).select("instruction_index", F.col("completion_b").alias("completion"))
    return pipelines.evaluate(instructions, data.completions(models.model_a), theirs, config, by)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    try:
        text = None
        if args.config and "://" in args.config:
            spark = spark or SparkSession.builder.appName("duelgrid").getOrCreate()
            text = read_text(spark, args.config)
        config = build(args.config, text, **{k: yaml.safe_load(v) for k, _, v in (x.partition("=") for x in args.set)})
    except (ValueError, OSError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("duelgrid").getOrCreate()
    task = task_of(config.task)
    if task.run == "ratings":
        arena = load_arena(spark, args.arena, ARENAS[config.task], config.elo.detector).withColumn("battle_id", F.col("question_id"))
        made = pipelines.rate(arena, read_table(spark, args.answers), config)
        print(results.report(made.summary), results.leaderboard_report(made.leaderboard), results.save_ratings(config.result_folder, config, made), sep="\n")
        return 0
    data = _data(spark, args, config)
    if task.run == "two_turns":
        config.models.model_b = config.models.model_b or native_baseline(config.task)
        judged, summary = pipelines.judge_two_turns(data.instructions, data.completions(config.models.model_a), data.completions(config.models.model_b), config)
    else:
        judged, summary = _pairs(data, config)
    results.save_run(config.result_folder, config, judged, summary, csv=args.csv)
    print(results.report(summary))
    return 0


if __name__ == "__main__":
    sys.exit(main())
