"""Tape, book and tier metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .series import PAIR, tail_closed


def tier(bars: DataFrame, now: int, step: int, n: int, floor: float, current: DataFrame | None = None) -> DataFrame:
    """HIGH or LOW by the least volume x low over exactly n closed bars (null as 0); with fewer bars a pair keeps its
    current tier (current: pair, tier), null without one."""
    tail = tail_closed(bars, now, step, n)
    least = F.min(F.coalesce("volume", F.lit(0.0)) * F.coalesce("low", F.lit(0.0)))
    out = tail.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("bars"), least.alias("least"))
    known = F.lit(None).cast("string")
    if current is not None:
        out = out.join(current.select(*PAIR, F.col("tier").alias("_current")), PAIR, "left")
        known = F.col("_current")
    return out.withColumn("tier", F.when(F.col("bars") < n, known).when(F.col("least") >= floor, "HIGH").otherwise("LOW")).drop("_current")


def min_volume_usd(bars: DataFrame, now: int, step: int, n: int = 7) -> DataFrame:
    """Least volume x low over up to n closed bars, unknown values skipped."""
    x = F.col("volume") * F.col("low")
    return tail_closed(bars, now, step, n).groupBy(*PAIR).agg(F.round(F.min(F.when(~F.isnan(x), x)), 2).alias("min_volume_usd"))


def tape_stats(trades: DataFrame, now_us: int, window_sec: int) -> DataFrame:
    """Trades a minute, buy share, age of the last trade, signed flow in total and in the window, barcode flag."""
    recent = F.col("t") > now_us - window_sec * 1_000_000
    money = (F.col("price") * F.col("amount")).cast("decimal(18,4)")
    signed = F.when(F.col("side") == "buy", money).when(F.col("side") == "sell", -money).otherwise(F.lit(0).cast("decimal(18,4)"))
    return trades.groupBy(*PAIR).agg(
        (F.count_if(recent) / (window_sec / 60.0)).alias("tpm"),
        F.coalesce(F.count_if(F.col("side") == "buy") * 100.0 / F.nullif(F.count_if(F.col("side").isin("buy", "sell")), F.lit(0)), F.lit(50.0)).alias("buy_pct"),
        F.coalesce((F.lit(now_us) - F.max("t")) / 1e6, F.lit(999.0)).alias("last_trade_age"),
        F.sum(signed).cast("double").alias("cvd"),
        F.coalesce(F.sum(F.when(recent, signed)), F.lit(0)).cast("double").alias("cvd_window"),
        ((F.count(F.lit(1)) >= 30) & (F.count_distinct(F.when(F.col("price") != 0, F.col("price"))) <= 4)).alias("barcode"),
    )


def book(levels: DataFrame, depth_pct: float = 1.0) -> DataFrame:
    """Depth within depth_pct of the mid price, imbalance and spread of books (key, side, price, amount)."""
    w = W.partitionBy("key")  # the aggregation after it needs no other shuffle
    levels = levels.withColumns({"bid": F.max(F.when(F.col("side") == "bid", F.col("price"))).over(w), "ask": F.min(F.when(F.col("side") == "ask", F.col("price"))).over(w)})
    mid = (F.col("bid") + F.col("ask")) / 2
    near = F.abs(F.col("price") - mid) <= mid * depth_pct / 100
    money = (F.col("price") * F.col("amount")).cast("decimal(24,4)")
    usd = lambda side: F.coalesce(F.sum(F.when(near & (F.col("side") == side), money)), F.lit(0)).cast("double")
    out = levels.groupBy("key", "bid", "ask").agg(usd("bid").alias("bid_usd"), usd("ask").alias("ask_usd"))
    return out.select(
        "key", "bid", "ask", "bid_usd", "ask_usd", F.round(F.col("bid_usd") + F.col("ask_usd"), 4).alias("total_usd"),
        F.when(F.col("ask_usd") > 0, F.round(F.col("bid_usd") / F.col("ask_usd"), 4)).otherwise(99.0).alias("imbalance"),
        F.round((F.col("ask") - F.col("bid")) / F.col("bid") * 100, 6).alias("spread_pct"),
    )


def vitality(metrics: DataFrame) -> DataFrame:
    score = S.vitality_score(F.col("tpm"), F.col("total_depth_usd"), F.col("spread_pct"), F.col("barcode"))
    return metrics.withColumn("score", score).withColumn("grade", S.vitality_grade(F.col("score")))
