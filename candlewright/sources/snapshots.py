"""Snapshots of small tables with the time they were saved, served only while they are young enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAVED = "saved_at"


def save(df: DataFrame, path: str, now: int) -> None:
    df.withColumn(SAVED, F.lit(now).cast("long")).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, now: int, max_age_sec: int) -> DataFrame:
    """The rows of a snapshot; none where it is older than the limit or from a time ahead."""
    df = spark.read.parquet(path)
    return df.where(F.col(SAVED).between(now - max_age_sec, now)).drop(SAVED)
