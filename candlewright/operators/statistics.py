"""Statistics of a scan: months, sizes, thresholds, price sources and exchanges.

A pump is a (base, day of the peak), counted once however many exchanges show it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import materialise
from . import order

MONTH_DAYS = 30.44
AGE_EDGES = (7, 30, 90, 180, 365)


def month_of(day: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM")


def unique_pumps(events: DataFrame) -> DataFrame:
    """(base, day, peak_ts: the newest, pump_pct: the greatest)."""
    return events.groupBy("base", F.floor(F.col("peak_ts") / 86400).alias("day")).agg(F.max("peak_ts").alias("peak_ts"), F.max("pump_pct").alias("pump_pct"))


def by_month(pumps: DataFrame) -> DataFrame:
    return pumps.groupBy(month_of(F.col("day")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def top_months(pumps: DataFrame, most: int = 8) -> DataFrame:
    """The months with most pumps; ties by the earlier month."""
    return by_month(pumps).orderBy(F.desc("n"), "month").limit(most)


def per_coin(pumps: DataFrame) -> DataFrame:
    """(times, coins): how many coins pumped so often."""
    return pumps.groupBy("base").agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("coins"))


def by_weekday(pumps: DataFrame) -> DataFrame:
    """(weekday: Monday is 0, n)."""
    return pumps.groupBy(F.weekday(F.date_from_unix_date(F.col("day").cast("int"))).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


def by_age(pumps: DataFrame, now: int, edges=AGE_EDGES) -> DataFrame:
    """(age, n) by days since the peak; an edge belongs to the bucket below it."""
    days = (F.lit(now) - F.col("peak_ts")) / 86400.0
    label = F.lit(f">{edges[-1]}")
    for edge in reversed(edges):
        label = F.when(days <= edge, f"<={edge}").otherwise(label)
    return pumps.groupBy(label.alias("age")).agg(F.count(F.lit(1)).alias("n"))


def rates(pumps: DataFrame, *by: str) -> DataFrame:
    """Pumps, coins, the days they span, and rates a day and a month, of all rows or by columns."""
    span = F.max("day") - F.min("day") + 1
    rows = pumps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("base").alias("coins"), span.alias("days"))
    return rows.withColumns({"a_coin": F.col("n") / F.col("coins"), "a_day": F.col("n") / F.col("days"), "a_month": F.col("n") / (F.col("days") / MONTH_DAYS)})


def thresholds(events: DataFrame, main: float) -> DataFrame:
    """Of events by threshold: pumps, coins, times the main threshold's pumps, and rates."""
    pumps = events.groupBy("threshold", "base", F.floor(F.col("peak_ts") / 86400).alias("day")).agg(F.max("pump_pct").alias("pump_pct"))
    rows = rates(pumps, "threshold")
    base = F.max(F.when(F.col("threshold") == main, F.col("n"))).over(W.partitionBy(F.lit(1)))  # one row a threshold
    return rows.withColumn("times_main", F.col("n") / F.greatest(F.coalesce(base, F.lit(1)), F.lit(1)))


def months_by_threshold(events: DataFrame, levels: list[float], most: int = 24) -> DataFrame:
    """Pumps by month, a column for each threshold, of the newest months."""
    pumps = events.select("threshold", "base", F.floor(F.col("peak_ts") / 86400).alias("day")).distinct()
    wide = pumps.groupBy(month_of(F.col("day")).alias("month")).pivot("threshold", levels).agg(F.count(F.lit(1)))
    return wide.orderBy(F.desc("month")).limit(most).select("month", *(F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(f"over_{x:g}") for x in levels))


def size_edges(start: float = 100.0, step: float = 10.0, linear_to: float = 500.0, factor: float = 1.5, end: float = 30_000.0) -> list[float]:
    """Edges of the size histogram: even steps, then a geometric part; the last bucket is open."""
    edges, at = [], start
    while at < linear_to:
        edges.append(at)
        at += step
    edges.append(linear_to)
    while edges[-1] < end:
        edges.append(min(edges[-1] * factor, end))
    return edges


def size_histogram(pumps: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """(bucket, low, high, n, percent, cumulative) of sizes: every bucket, empty ones too; smaller sizes are in no bucket
    but count for the percentages.  The running sum goes over buckets."""
    edges = edges or size_edges()
    spark = pumps.sparkSession
    bucket = F.aggregate(F.array(*map(F.lit, edges)), F.lit(-1), lambda n, e: n + F.when(F.col("pump_pct") >= e, 1).otherwise(0))
    counts = pumps.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.createDataFrame([(-1, None, edges[0])] + [(i, e, edges[i + 1] if i + 1 < len(edges) else None) for i, e in enumerate(edges)], "bucket int, low double, high double")
    rows = frame.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = W.partitionBy(F.lit(1))  # a row a bucket
    rows = rows.withColumn("total", F.sum("n").over(whole)).where("bucket >= 0")
    running = F.sum("n").over(whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("bucket", "low", "high", "n", (F.col("n") / F.col("total") * 100).alias("percent"), (running / F.col("total") * 100).alias("cumulative"))


def size_quantiles(pumps: DataFrame) -> DataFrame:
    """(n, coins, least, p10, p25, p50, p75, p90, p99, most): interpolated percentiles of sizes, by counted ranges."""
    shares = {f"p{round(q * 100)}": q for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)}
    found = order.quantiles(pumps, [], "pump_pct", shares).drop("n").withColumn("k", F.lit(0))
    whole = pumps.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("base").alias("coins"), F.min("pump_pct").alias("least"), F.max("pump_pct").alias("most"))
    return whole.withColumn("k", F.lit(0)).join(found, "k", "left").select("n", "coins", "least", *shares, "most")


def sources(main: DataFrame, other: DataFrame) -> DataFrame:
    """(source, n, coins, median_pct, events) of two price sources' events."""
    rows = main.withColumn("source", F.lit("main")).unionByName(other.withColumn("source", F.lit("other")))
    pumps = rows.groupBy("source", "base", F.floor(F.col("peak_ts") / 86400).alias("day")).agg(F.max("pump_pct").alias("pct"), F.count(F.lit(1)).alias("k"))
    return pumps.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("base").alias("coins"), F.median("pct").alias("median_pct"), F.sum("k").alias("events"))


def _both(main: DataFrame, other: DataFrame) -> DataFrame:
    """(base, day, main_pct, other_pct, exchange of the other's greatest): one aggregation in place of a full join."""
    rows = main.select("base", "peak_ts", "exchange", F.col("pump_pct").alias("m"), F.lit(None).cast("double").alias("o")).unionByName(
        other.select("base", "peak_ts", "exchange", F.lit(None).cast("double").alias("m"), F.col("pump_pct").alias("o"))
    )
    return rows.groupBy("base", F.floor(F.col("peak_ts") / 86400).alias("day")).agg(F.max("m").alias("main_pct"), F.max("o").alias("other_pct"), F.max_by("exchange", F.when(F.col("o").isNotNull(), F.struct("o", "exchange"))).alias("exchange"))


def source_overlap(main: DataFrame, other: DataFrame) -> DataFrame:
    """(common, common_coins, only_main, only_main_coins, only_other, only_other_coins): coins of one side without a common pump."""
    pumps = _both(main, other)
    both, m, o = F.col("main_pct").isNotNull() & F.col("other_pct").isNotNull(), F.col("other_pct").isNull(), F.col("main_pct").isNull()
    coins = pumps.groupBy("base").agg(F.count_if(both).alias("c"), F.count_if(m).alias("m"), F.count_if(o).alias("o"))
    return coins.agg(
        F.sum("c").alias("common"), F.count_if(F.col("c") > 0).alias("common_coins"), F.sum("m").alias("only_main"), F.count_if((F.col("m") > 0) & (F.col("c") == 0)).alias("only_main_coins"),
        F.sum("o").alias("only_other"), F.count_if((F.col("o") > 0) & (F.col("c") == 0)).alias("only_other_coins"),
    )


def top_wicks(main: DataFrame, other: DataFrame, most: int = 25, days: int = 3) -> DataFrame:
    """The greatest pumps that only the other source shows, with the main one's greatest of the same coin at most `days` away.

    The list is cut first; only its coins are looked up.
    """
    pumps = _both(main, other)
    wicks = pumps.where("main_pct IS NULL").orderBy(F.desc("other_pct"), "base", "day").limit(most).select("base", "day", "exchange", F.col("other_pct").alias("pump_pct"))
    close = pumps.where("main_pct IS NOT NULL").select(F.col("base").alias("b"), F.col("day").alias("d"), "main_pct")
    near = wicks.join(close, (F.col("base") == F.col("b")) & F.col("d").between(F.col("day") - days, F.col("day") + days), "left")
    return near.groupBy("base", "day", "exchange", "pump_pct").agg(F.max("main_pct").alias("close_pct"))


def shared_pumps(events: DataFrame) -> DataFrame:
    """(base, day, exchange, pump_pct: of the pump anywhere, width: exchanges that share it), names of exchanges unified."""
    one = events.groupBy("base", F.floor(F.col("peak_ts") / 86400).alias("day"), S.canonical_exchange(F.col("exchange")).alias("exchange")).agg(F.max("pump_pct").alias("own"))
    w = W.partitionBy("base", "day")
    return one.select("base", "day", "exchange", F.max("own").over(w).alias("pump_pct"), F.count(F.lit(1)).over(w).alias("width"))


def exchanges(shared: DataFrame) -> DataFrame:
    """(exchange, pumps, share_pct, solo, shared, median_pct: the upper median), from shared_pumps.

    The median is read at its place in the order of an exchange's pumps, found by counted ranges: an exchange may have most
    of the pumps, and no task sorts them.
    """
    shared = materialise(shared, "shared-pumps")
    out = shared.groupBy("exchange").agg(F.count(F.lit(1)).alias("pumps"), F.count_if(F.col("width") == 1).alias("solo"), F.count_if(F.col("width") > 1).alias("shared"), F.sum(1 / F.col("width")).alias("weight"))
    middle = order.at_places(shared, ["exchange"], "pump_pct", lambda n: F.array(F.floor(n / 2)))
    out = out.join(middle.select("exchange", F.map_values("at")[0].alias("median_pct")), "exchange")
    # a pump counts 1 / width on each of its exchanges, so that the weights sum to the number of pumps
    total = F.round(F.sum("weight").over(W.partitionBy(F.lit(1))))
    return out.withColumn("share_pct", F.col("pumps") / total * 100).drop("weight")


def widths(shared: DataFrame) -> DataFrame:
    """(width, pumps): on how many exchanges pumps are at once."""
    return shared.select("base", "day", "width").distinct().groupBy("width").agg(F.count(F.lit(1)).alias("pumps"))


def exchange_pairs(shared: DataFrame, most: int | None = None) -> DataFrame:
    """(one, two, n): exchanges that share pumps; a pump has at most as many rows as there are exchanges."""
    a = shared.where("width > 1").select("base", "day", F.col("exchange").alias("one"))
    out = a.join(a.withColumnRenamed("one", "two"), ["base", "day"]).where("one < two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"))
    return out if most is None else out.orderBy(F.desc("n"), "one", "two").limit(most)


def best_exchanges(stats: DataFrame) -> DataFrame:
    """(most_pumps, pumps, most_solo, solo): where most pumps are, and most that no other exchange shows."""
    top = lambda x: F.max_by("exchange", F.struct(F.col(x), F.col("tie")))
    rows = stats.withColumn("tie", -F.dense_rank().over(W.partitionBy(F.lit(1)).orderBy("exchange")))  # a row an exchange
    return rows.agg(top("pumps").alias("most_pumps"), F.max("pumps").alias("pumps"), top("solo").alias("most_solo"), F.max("solo").alias("solo"))
