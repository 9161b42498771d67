"""The five stages of the batch run, and a command line for them.

Stages read and write folders under one root: ``daily`` and ``history`` are the
inputs, ``monthly``, ``season_features``, ``weather_harvest``, ``panel`` and ``comparison``
the results. A failing stage stops the run; its error is not swallowed.

Each stage leaves a manifest in ``_runs``: its state, what its inputs and outputs were (a digest of the
files' names, sizes and times), the rows of its outputs, and its error. A run skips
the stages whose inputs and outputs are as their manifests say, so a run after a failure goes on
where it stopped, and one after a change does what depends on it.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..functions.formats import elapsed
from ..operators import features, ranking, rollup
from ..sources import shared, sinks

RUNS = "_runs"


@dataclass(frozen=True)
class Stage:
    """``inputs`` and ``outputs`` are folders below the root; the outputs are Parquet."""

    name: str
    function: Callable[[SparkSession, str], None]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()


def _monthly(spark: SparkSession, root: str) -> None:
    sinks.save_parquet(features.build_monthly(spark.read.parquet(f"{root}/daily")), f"{root}/monthly")


def _season_features(spark: SparkSession, root: str) -> None:
    daily = features.with_calendar(spark.read.parquet(f"{root}/daily"))
    sinks.save_parquet(features.growing_season_features(daily), f"{root}/season_features")


def _weather_harvest(spark: SparkSession, root: str) -> None:
    weather = rollup.weather_summary(spark.read.parquet(f"{root}/monthly"))
    harvest = rollup.harvest_summary(spark.read.parquet(f"{root}/history"))
    sinks.save_parquet(rollup.weather_harvest(weather, harvest), f"{root}/weather_harvest")


def _panel(spark: SparkSession, root: str) -> None:
    sinks.save_parquet(ranking.season_panel(spark.read.parquet(f"{root}/weather_harvest")), f"{root}/panel")


def _comparison(spark: SparkSession, root: str) -> None:
    complete = spark.read.parquet(f"{root}/weather_harvest").where("has_complete_growing_season")
    for name, make in (("table", ranking.season_table), ("ranks", ranking.rank_panel), ("trend", ranking.trend)):
        sinks.save_parquet(make(complete), f"{root}/comparison/{name}")


STAGES = (
    Stage("monthly weather", _monthly, ("daily",), ("monthly",)),
    Stage("growing-season features", _season_features, ("daily",), ("season_features",)),
    Stage("weather and harvest", _weather_harvest, ("monthly", "history"), ("weather_harvest",)),
    Stage("season panel", _panel, ("weather_harvest",), ("panel",)),
    Stage("season comparison", _comparison, ("weather_harvest",), ("comparison/table", "comparison/ranks", "comparison/trend")),
)


def state_of(root: str, folder: str) -> str | None:
    """A digest of a folder's files by name, size and time; None for no such folder."""
    system, path = shared.located(f"{root}/{folder}")
    if system.get_file_info(path).type != fs.FileType.Directory:
        return None
    found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(".")]
    return hashlib.sha256("\n".join(sorted(f"{f.path[len(path):]} {f.size} {f.mtime_ns}" for f in found)).encode()).hexdigest()


def manifest(root: str, stage: Stage) -> dict | None:
    """What the last run of a stage left."""
    system, path = shared.located(f"{root}/{RUNS}/{stage.name}.json")
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as file:
        return json.loads(file.read())


def _leave(root: str, stage: Stage, **told) -> None:
    system, folder = shared.located(f"{root}/{RUNS}")
    system.create_dir(folder, recursive=True)
    staged = f"{folder}/.{uuid4().hex}"
    with system.open_output_stream(staged) as out:
        out.write(json.dumps({"stage": stage.name} | told, indent=1).encode())
    system.move(staged, f"{folder}/{stage.name}.json")


def unchanged(root: str, stage: Stage) -> bool:
    """Whether a stage is done and its inputs and outputs are as they were then."""
    left = manifest(root, stage)
    if left is None or left["state"] != "done" or not stage.outputs:
        return False
    return all(now is not None and now == was for kind in ("inputs", "outputs") for name, was in left[kind].items() for now in [state_of(root, name)]) and set(left["inputs"]) == set(stage.inputs) and set(left["outputs"]) == set(stage.outputs)


def manifests(spark: SparkSession, root: str, stages: tuple[Stage, ...] = STAGES) -> DataFrame:
    """One row ``(place, stage, state, runs, error, output, rows)`` for each output of a stage that has run; of a failed one the row has no output."""
    rows = []
    for k, stage in enumerate(stages, 1):
        if left := manifest(root, stage):
            told = list(left["rows"].items()) or [(None, None)]
            rows += [(k, stage.name, left["state"], left["runs"], left["error"], output, n) for output, n in told]
    return spark.createDataFrame(rows, "place bigint, stage string, state string, runs bigint, error string, output string, rows bigint")


def run(spark: SparkSession, root: str, stages: tuple[Stage, ...] = STAGES, say: Callable[[str], None] = print, resume: bool = True) -> dict[str, float]:
    """Seconds by stage; a stage that was skipped has none. ``resume=False`` runs every stage anew."""
    times: dict[str, float] = {}
    for k, stage in enumerate(stages, 1):
        head = f"[{k}/{len(stages)}] {stage.name}"
        if resume and unchanged(root, stage):
            times[stage.name] = 0.0
            say(f"{head}: unchanged")
            continue
        spark.sparkContext.setJobGroup(stage.name, stage.name)
        began, runs = time.perf_counter(), ((manifest(root, stage) or {}).get("runs") or 0) + 1
        inputs = {n: state_of(root, n) for n in stage.inputs}
        left = {"runs": runs, "inputs": inputs, "outputs": {}, "rows": {}, "error": None}
        _leave(root, stage, state="running", **left)
        try:
            stage.function(spark, root)
            left["rows"] = {n: spark.read.parquet(f"{root}/{n}").count() for n in stage.outputs}
        except Exception as failed:
            _leave(root, stage, state="failed", **left | {"error": str(failed).splitlines()[0] if str(failed) else type(failed).__name__})
            say(f"{head}: failed after {elapsed(time.perf_counter() - began)}: {failed}")
            raise
        times[stage.name] = time.perf_counter() - began
        _leave(root, stage, state="done", **left | {"outputs": {n: state_of(root, n) for n in stage.outputs}, "seconds": times[stage.name]})
        say(f"{head}: {elapsed(times[stage.name])}")
    say(f"total: {elapsed(sum(times.values()))}")
    return times


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("root", help="folder of the inputs and results")
    parser.add_argument("--again", action="store_true", help="run every stage, changed or not")
    parser.add_argument("--verbose", action="store_true", help="show the results")
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.appName("fieldloom").getOrCreate()
    run(spark, chosen.root, resume=not chosen.again)
    if chosen.verbose:
        spark.read.parquet(f"{chosen.root}/weather_harvest").show(truncate=False)


if __name__ == "__main__":
    main()
