"""Backward as-of join of events to bars: a bar takes the last event at or after it and before the next bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .series import PAIR


def asof_last(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(ticker, exchange, ts, rate, event_ts) of bars that got an event; events before the first bar are dropped.

    Bars and events go through one shuffle as a union; the bar before each event is the running last bar.
    """
    none = F.lit(None)
    both = bars.select(*PAIR, F.col("ts").alias("at"), F.col("ts").alias("bar"), none.cast("double").alias("rate"), none.cast("long").alias("id")).unionByName(
        events.select(*PAIR, F.col("ts").alias("at"), none.cast("long").alias("bar"), "rate", F.col("event_id").alias("id"))
    )
    w = W.partitionBy(*PAIR).orderBy("at", F.col("bar").isNull(), "id").rowsBetween(W.unboundedPreceding, 0)
    hit = both.withColumn("ts", F.last("bar", ignorenulls=True).over(w)).where("bar IS NULL AND ts IS NOT NULL")
    return hit.groupBy(*PAIR, "ts").agg(F.max_by("rate", F.struct("at", "id")).alias("rate"), F.max("at").alias("event_ts"))
