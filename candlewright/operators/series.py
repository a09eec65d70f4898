"""Series repair: buckets, upserts, duplicates, gaps, filling, roll-ups, retention. One shuffle by pair each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import DAY

PAIR = ["ticker", "exchange"]


def by_pair(*order):
    return W.partitionBy(*PAIR).orderBy(*(order or ["ts"]))


def newest(bars: DataFrame, n: int = 1) -> DataFrame:
    """Newest n rows a pair; the rank filter is pushed below the shuffle."""
    return bars.withColumn("rn", F.row_number().over(by_pair(F.desc("ts")))).where(F.col("rn") <= n).drop("rn")


def dedup(bars: DataFrame, step: int) -> DataFrame:
    """One row a bucket: most volume (null as 0), then newest."""
    w = W.partitionBy(*PAIR, F.floor(F.col("ts") / step)).orderBy(F.coalesce("volume", F.lit(0.0)).desc(), F.desc("ts"))
    return bars.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def upsert(stored: DataFrame, incoming: DataFrame, step: int) -> DataFrame:
    """Stored rows outside the incoming buckets, and the incoming rows, deduplicated by bucket."""
    b = F.floor(F.col("ts") / step)
    touched = incoming.select(*PAIR, b.alias("b")).distinct()
    rest = stored.withColumn("b", b).join(touched, [*PAIR, "b"], "left_anti").drop("b")
    return dedup(rest.unionByName(incoming), step)


def gaps(bars: DataFrame, step: int) -> DataFrame:
    """(ticker, exchange, first_missing, last_missing, missing) runs of missing buckets; one row for each hole."""
    b = bars.select(*PAIR, F.floor(F.col("ts") / step).alias("b")).distinct()
    b = b.withColumn("next", F.lead("b").over(by_pair("b")))
    return b.where("next > b + 1").select(*PAIR, (F.col("b") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"), (F.col("next") - F.col("b") - 1).alias("missing"))


def gap_summary(bars: DataFrame, step: int) -> DataFrame:
    """Stored, missing, widest hole and the first bucket before it; pairs with holes only."""
    b = bars.select(*PAIR, F.floor(F.col("ts") / step).alias("b")).distinct()
    b = b.withColumn("hole", F.coalesce(F.lead("b").over(by_pair("b")) - F.col("b") - 1, F.lit(0)))
    out = b.groupBy(*PAIR).agg(F.count("b").alias("stored"), F.sum("hole").alias("missing"), F.max("hole").alias("biggest"), F.max_by("b", F.struct("hole", -F.col("b"))).alias("before_biggest"))
    return out.where("missing > 0")


def tolerant_gaps(bars: DataFrame, tolerance: int) -> DataFrame:
    """Neighbours more than `tolerance` seconds apart."""
    return bars.withColumn("next_ts", F.lead("ts").over(by_pair())).where(F.col("next_ts") - F.col("ts") > tolerance).select(*PAIR, "ts", "next_ts")


def flat_fill(bars: DataFrame, step: int, most: int = 2000) -> DataFrame:
    """Missing buckets filled with the close before them and no volume; pairs with more than `most` missing stay."""
    b = bars.withColumn("b", F.floor(F.col("ts") / step))
    b = b.withColumn("hole", F.coalesce(F.lead("b").over(by_pair("b")) - F.col("b") - 1, F.lit(0))).withColumn("total", F.sum("hole").over(W.partitionBy(*PAIR)))
    new = b.where(f"hole > 0 AND total <= {most}").select(*PAIR, F.explode(F.sequence(F.col("b") + 1, F.col("b") + F.col("hole"))).alias("b"), "close")
    filled = new.select(*PAIR, (F.col("b") * step).cast("long").alias("ts"), F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.lit(0.0).alias("volume"), F.lit(True).alias("filled"))
    return b.select(*PAIR, "ts", "open", "high", "low", "close", "volume", F.lit(False).alias("filled")).unionByName(filled)


def continuity(bars: DataFrame, step: int, percent: float) -> DataFrame:
    """Bars that open `percent` or more away from the close before."""
    w = by_pair()
    out = bars.withColumn("prev_close", F.lag("close").over(w)).withColumn("prev_ts", F.lag("ts").over(w))
    out = out.withColumn("jump_pct", F.abs(F.col("open") - F.col("prev_close")) / F.col("prev_close") * 100)
    return out.where((F.col("prev_close") > 0) & (F.col("jump_pct") >= percent)).select(*PAIR, "ts", F.round("jump_pct", 6).alias("jump_pct"), (F.floor(F.col("ts") / step) - F.floor(F.col("prev_ts") / step) - 1).alias("missing_between"))


def roll_up_day(daily: DataFrame, intraday: DataFrame) -> DataFrame:
    """The newest UTC day of the intraday bars as one daily bar in place of daily rows of that day or later."""
    last = intraday.withColumn("day", (F.floor(F.max("ts").over(W.partitionBy(*PAIR)) / DAY) * DAY).cast("long")).where("ts >= day")
    rolled = last.groupBy(*PAIR, "day").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum(F.coalesce("volume", F.lit(0.0)).cast("decimal(18,2)")).cast("double").alias("volume"),
    ).withColumnRenamed("day", "ts")
    behind = daily.groupBy(*PAIR).agg(F.max("ts").alias("newest"))
    rolled = rolled.join(behind, PAIR, "left").where("newest IS NULL OR ts >= newest").drop("newest")
    kept = daily.join(rolled.select(*PAIR, F.col("ts").alias("day")), PAIR, "left").where("day IS NULL OR ts < day").drop("day")
    return kept.unionByName(rolled)


def retain(bars: DataFrame, now: int, days: int) -> DataFrame:
    return bars.where(F.col("ts") >= now - days * DAY)


def tail_closed(bars: DataFrame, now: int, step: int, n: int) -> DataFrame:
    """The newest n bars a pair that had ended by `now`."""
    return newest(bars.where(F.col("ts") <= now - step), n)
