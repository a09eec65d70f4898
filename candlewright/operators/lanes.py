"""Rows for watch lists, panels and reports: published pairs, metric points, older slices, snapshots, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.display import significant
from .series import PAIR, by_pair

EARLIEST = 1262304000  # 2010-01-01 UTC


def published(rows: DataFrame, most: int = 12) -> DataFrame:
    """The first `most` different pairs of a publication (place, exchange, symbol), blanks trimmed, no-pairs left out."""
    rows = rows.select("place", F.trim(F.coalesce("exchange", F.lit(""))).alias("exchange"), F.trim(F.coalesce("symbol", F.lit(""))).alias("symbol"))
    rows = rows.where((F.col("exchange") != "") & F.contains("symbol", F.lit("/")))
    return rows.groupBy("exchange", "symbol").agg(F.min("place").alias("place")).orderBy("place", "exchange", "symbol").limit(most)


def fresh(rows: DataFrame, ttl_sec: float = 90.0, most: int = 12) -> DataFrame:
    """Published pairs (place, exchange, symbol, age) no older than the limit, at most so many; unknown ages are not fresh."""
    named = (F.coalesce("exchange", F.lit("")) != "") & (F.coalesce("symbol", F.lit("")) != "")
    return rows.where(named & (F.col("age") <= ttl_sec)).orderBy("place", "exchange", "symbol").limit(most)


def due(pairs: DataFrame, last_run: DataFrame, key: list[str], now: float, interval_sec: float) -> DataFrame:
    """Rows whose key was never run (last_run: key, ran) or last ran at least the interval ago.

    Also the cooldown of rechecks: last_run is then the audit table of attempts, in which a key may repeat.
    """
    recent = last_run.groupBy(*key).agg(F.max("ran").alias("ran")).where(F.lit(now) - F.col("ran") < interval_sec)
    return pairs.join(recent.select(*key), key, "left_anti")


def metric_points(rows: DataFrame, now: int, value: str = "value") -> DataFrame:
    """Points with a time and a value, times in seconds, from 2010 to a quarter of an hour ahead."""
    rows = rows.withColumn("ts", S.epoch_sec(F.col("ts")))
    return rows.where(F.col("ts").between(EARLIEST, now + 900) & F.col(value).isNotNull())


def older_slice(batch: DataFrame, oldest: DataFrame, floor: int) -> DataFrame:
    """Fetched bars strictly before a pair's oldest stored one (pair, oldest) and not before the floor; the last arrival of a time wins."""
    rest = [x for x in batch.columns if x not in (*PAIR, "ts", "arrival")]
    part = batch.where(F.col("ts") >= floor).join(oldest, PAIR).where(F.col("ts") < F.col("oldest"))
    return part.groupBy(*PAIR, "ts").agg(F.max_by(F.struct(*rest), "arrival").alias("v")).select(*PAIR, "ts", "v.*")


def with_snapshot(bars: DataFrame, snapshot: DataFrame, names: list[str]) -> DataFrame:
    """Bars with a pair's snapshot columns on its two newest rows, so that a rewrite of the newest one loses nothing."""
    rank = F.row_number().over(by_pair(F.desc("ts")))
    out = bars.withColumn("rank", rank).join(snapshot.select(*PAIR, *names), PAIR, "left")
    return out.select(*bars.columns, *(F.when(F.col("rank") <= 2, F.col(x)).alias(x) for x in names))


def compact_series(bars: DataFrame) -> DataFrame:
    """(candles: [[ts, open, high, low, close]], volumes: [[ts, value, 1 or -1]]) of each pair, by time.

    A pair's series meets in one row, as a chart needs it; cut the bars to the chart's span first.
    """
    candle = F.array(F.col("ts").cast("double"), *(significant(F.col(x)) for x in ("open", "high", "low", "close")))
    known = F.when(F.isnan("volume"), 0.0).otherwise(F.coalesce("volume", F.lit(0.0)))
    volume = F.array(F.col("ts").cast("double"), F.round(known, 2), F.when(F.col("close") >= F.col("open"), 1.0).otherwise(-1.0))
    return bars.groupBy(*PAIR).agg(F.array_sort(F.collect_list(candle)).alias("candles"), F.array_sort(F.collect_list(volume)).alias("volumes"))


def family(comm: Column, cmd: Column, tokens: dict[str, list[str]]) -> Column:
    """The first family with a token in the command line (small letters); otherwise the command, or unknown."""
    line = F.lower(F.coalesce(F.nullif(cmd, F.lit("")), comm, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, marks in tokens.items():
        out = out.when(S.any_of(*(F.contains(line, F.lit(x)) for x in marks)), name)
    return out.otherwise(F.coalesce(F.nullif(F.substring(comm, 1, 32), F.lit("")), F.lit("unknown")))


def family_usage(samples: DataFrame) -> DataFrame:
    """Memory and processes by sample and family, and the change since the family's last sample (null for its first)."""
    out = samples.groupBy("ts", "family").agg(F.sum("rss_kb").alias("rss_kb"), F.sum("swap_kb").alias("swap_kb"), F.count(F.lit(1)).alias("pids"))
    w = W.partitionBy("family").orderBy("ts")
    return out.withColumn("d_rss_kb", F.col("rss_kb") - F.lag("rss_kb").over(w)).withColumn("d_swap_kb", F.col("swap_kb") - F.lag("swap_kb").over(w))


def with_book(events: DataFrame, books: DataFrame) -> DataFrame:
    """Events with the grade and score of their pair's newest book (pair, ts, grade, score), null without one."""
    newest = books.groupBy(*PAIR).agg(F.max_by(F.struct("grade", "score"), "ts").alias("b")).select(*PAIR, "b.grade", "b.score")
    return events.join(newest, PAIR, "left")


def scan_reason(excluded: Column, now: int, below: float, max_age_days: float, earliest: int, least: str | None = None) -> Column:
    """Why an event of a scan is left out, the first rule that holds, or kept; with a least grade, events with_book:
    a dead book rejects, none leaves the event unverified."""
    sane = ~F.coalesce(excluded, F.lit(False)) & (F.col("peak_ts") >= earliest)
    low_before = F.col("pre_max").isNull() | (F.col("pre_max") < F.col("peak_price") * below)
    out = F.when(~sane, "data_sanity").when(~low_before, "prepump").when((F.lit(now) - F.col("peak_ts")) / 86400.0 > max_age_days, "age")
    if least:
        out = out.when(F.col("score").isNull(), "ob_unverified").when(~S.vitality_ok(F.col("grade"), least), "ob_dead")
    return out.otherwise("kept")


def funnel(histories: DataFrame, events: DataFrame, least_bars: int, short_from: int | None = None) -> DataFrame:
    """(reason, n): pairs by history length (histories: bars) and events by their reason, one pass over each."""
    length = F.when(F.col("bars") >= least_bars, "scanned")
    if short_from is not None:
        length = length.when(F.col("bars") >= short_from, "short_history")
    pairs = histories.groupBy(length.otherwise("too_short").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.unionByName(events.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
