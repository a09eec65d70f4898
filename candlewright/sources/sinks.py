"""Sinks: results of a scan in one commit, reports of decisions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..storage import children, create, delete, exists, read_text


def save_results(path: str, run_ts: int, tables: dict[str, DataFrame], wipe: bool = False) -> None:
    """Tables of a run under path/name/run_ts=N, published by one mark once all are whole; wipe: earlier runs go.

    Readers (read_results) see marked runs only, so a run that fails between tables is invisible, and one that is written
    again replaces what it had left.  A wipe is part of the mark: earlier runs vanish with it, their files follow.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run_ts={run_ts}")
    delete(spark, f"{path}/_published/{run_ts}")
    create(spark, f"{path}/_published/{run_ts}", json.dumps({"tables": sorted(tables), "wipe": wipe}))
    if wipe:
        for name in children(spark, path):
            for run in children(spark, f"{path}/{name}"):
                if not name.startswith("_") and run.startswith("run_ts=") and run != f"run_ts={run_ts}":
                    delete(spark, f"{path}/{name}/{run}")
        for run in children(spark, f"{path}/_published"):
            if run != str(run_ts):
                delete(spark, f"{path}/_published/{run}")


def published(spark: SparkSession, path: str) -> list[int]:
    """Runs that readers see, oldest first: those from the last wipe on."""
    out: list[int] = []
    for run in sorted(int(x) for x in children(spark, f"{path}/_published") if x.isdigit()):
        mark = json.loads(read_text(spark, f"{path}/_published/{run}"))
        out = [run] if mark["wipe"] else [*out, run]
    return out


def read_results(spark: SparkSession, path: str, name: str, runs: int | None = None) -> DataFrame | None:
    """A table of the published runs (the last so many) with their run_ts; none if no run has it."""
    found = [r for r in published(spark, path)[-runs if runs else None :] if exists(spark, f"{path}/{name}/run_ts={r}")]
    parts = [f"{path}/{name}/run_ts={r}" for r in found]
    if not parts:
        return None
    schema = reduce(lambda a, b: a if len(a) >= len(b) else b, (spark.read.parquet(parts[i]).schema for i in {0, len(parts) - 1}))
    return spark.read.option("basePath", f"{path}/{name}").schema(schema.add("run_ts", "long")).parquet(*parts)


def write_report(decisions: DataFrame, path: str) -> None:
    """Decisions as lines of JSON, null fields included."""
    decisions.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
