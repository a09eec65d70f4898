"""Samples of processes as CSV files: one row a process and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLE = "ts long, pid long, tgid long, comm string, cmd string, rss_kb long, swap_kb long"


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").option("escape", '"').csv(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of processes; threads that do not lead their group, and rows that do not parse, are left out."""
    rows = spark.read.schema(SAMPLE).option("header", "true").option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return rows.where("pid IS NOT NULL AND (tgid IS NULL OR tgid = pid)")
