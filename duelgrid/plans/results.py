"""What a run leaves behind: annotations as a table, results and metadata as JSON, the configuration as YAML, a report."""

from __future__ import annotations

import re
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame

from duelgrid.plans.config import RunConfig, dumped
from duelgrid.plans.pipelines import preset_of
from duelgrid.plans.prompts import TEMPLATE
from duelgrid.plans.repro import METADATA, inventory, run_metadata, to_jsonable, write_json
from duelgrid.sources.files import write_text


def slug(name: str, default: str = "model") -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or default


def rows(df: DataFrame) -> list[dict]:
    """A small result as plain rows."""
    return [to_jsonable(r.asDict(recursive=True)) for r in df.collect()]


def save_run(folder: str, config: RunConfig, annotations: DataFrame, summary: DataFrame, entry: str = "pairwise", started: datetime | None = None, csv: bool = False) -> dict:
    """annotations/ (Parquet, CSV where asked for), results.json, config.yaml and run-metadata.json below folder; gives the results.

    All of them go through the file systems that Spark knows, each written beside its place and then renamed.
    """
    spark = annotations.sparkSession
    annotations.write.mode("overwrite").parquet(f"{folder}/annotations")
    if csv:
        annotations.write.mode("overwrite").option("escape", '"').csv(f"{folder}/annotations-csv", header=True)
    results = {"task": config.task, "model_a": config.models.model_a, "model_b": config.models.model_b, "judge": config.judge.model, "summary": rows(summary)}
    write_json(f"{folder}/results.json", results, spark)
    write_text(spark, f"{folder}/config.yaml", dumped(config))
    preset, payloads = preset_of(config), {"annotations": spark.read.parquet(f"{folder}/annotations")}
    record = run_metadata(entry, asdict(config), results, payloads, inventory(spark, folder), started, preset.system, preset.template or TEMPLATE)
    write_json(f"{folder}/{METADATA}", record, spark)
    return results


def save_ratings(folder: str, config: RunConfig, ratings) -> str:
    """elo-{arena}-{model}/results-{model}.json below folder; gives its path. num_judgments counts both orders, num_battles one."""
    from duelgrid.plans.baselines import ARENAS

    model = slug(config.models.model_a or "")
    path = f"{folder}/elo-{slug(ARENAS.get(config.task, config.task))}-{model}/results-{model}.json"
    summary = ratings.summary.head().asDict()
    orders = 2 if config.judge.swap_mode == "both" else 1
    write_json(path, {
        "task": config.task, "model": config.models.model_a, "temperature": ratings.temperature, "human_ratings": ratings.human,
        "summary": summary | {"num_judgments": summary["num_battles"], "num_battles": summary["num_battles"] // orders},
        "leaderboard": rows(ratings.leaderboard), "error": rows(ratings.error)[0],
    }, ratings.summary.sparkSession)
    return path


def report(summary: DataFrame) -> str:
    """A few lines for a console."""
    out = []
    for r in rows(summary):
        name = " ".join(str(r[k]) for k in ("key", "value") if r.get(k)) or "all"
        rate = "-" if r["winrate"] is None else f"{100 * r['winrate']:.1f} %"
        out.append(f"{name}: {r['num_battles']} battles, {r['num_wins']} wins, {r['num_losses']} losses, {r['num_ties']} ties, {r['num_missing']} unparsed, win rate {rate}")
    return "\n".join(out)


def leaderboard_report(board: DataFrame) -> str:
    lines = []
    for k, r in enumerate(rows(board), 1):
        mark = " <" if r.get("evaluated") else ""
        lines.append(f"{k:3d}. {r['model']}: {r['mean']:.1f} +- {r['std']:.1f} ({r.get('battles', '-')} battles){mark}")
    return "\n".join(lines)
