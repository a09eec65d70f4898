"""Candles as charts and collectors need them: cleaning, paging, stitching from a second source, fetch plans, decoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import scalars as S
from .series import PAIR, by_pair

PAGE_LIMIT = 3000
PRICES = ["open", "high", "low", "close"]


def in_seconds(bars: DataFrame) -> DataFrame:
    """Times in seconds: a pair whose median time is too large for seconds is in milliseconds as a whole."""
    milli = F.median("ts").over(W.partitionBy(*PAIR)) > 1e11
    return bars.withColumn("_milli", milli).withColumn("ts", F.when(F.col("_milli"), F.floor(F.col("ts") / 1000)).otherwise(F.col("ts")).cast("long")).drop("_milli")


def sanitize(bars: DataFrame, now: int) -> DataFrame:
    """Bars from 2013 to two days ahead, the unit of times found by pair; a row in another unit than its pair's goes."""
    return in_seconds(bars).where(S.sane_bar(F.col("ts"), now))


def sane_rows(bars: DataFrame, now: int) -> DataFrame:
    """Bars fit for JSON: the unit found by row, sane times, finite prices to ten digits, volumes to two (unknown: 0)."""
    out = bars.withColumn("ts", S.epoch_sec(F.col("ts"))).withColumns({x: S.finite(F.col(x)) for x in [*PRICES, "volume"]})
    out = out.where(S.sane_bar(F.col("ts"), now)).dropna(subset=PRICES)
    return out.withColumns({x: D.significant(F.col(x)) for x in PRICES} | {"volume": F.round(F.coalesce("volume", F.lit(0.0)), 2)})


def sane_summary(rows: DataFrame, now: int, ts: str = "max_ts") -> DataFrame:
    """Summary rows with a sane newest time; one median over the frame tells the unit of all, so it is one number to join."""
    median = rows.agg(F.median(F.when(~F.isnan(F.col(ts).cast("double")), F.col(ts)))).scalar()
    seconds = F.when(median > 1e11, F.floor(F.col(ts) / 1000)).otherwise(F.col(ts))
    return rows.where(S.sane_bar(seconds, now))


def page(bars: DataFrame, before: int, limit: int) -> DataFrame:
    """Of each pair, the newest rows strictly older than a time in seconds, whichever unit rows have; 1 to 3000 rows."""
    older = (F.col("ts") < before) | ((F.col("ts") >= 100_000_000_000) & (F.col("ts") < before * 1000))
    rank = F.row_number().over(by_pair(F.desc("ts")))
    return bars.where(older).withColumn("_rank", rank).where(F.col("_rank") <= max(1, min(limit, PAGE_LIMIT))).drop("_rank")


def bounds(bars: DataFrame) -> DataFrame:
    """(pair, first_day, last_day) as dates, for a page that came back empty."""
    day = lambda x: F.date_format(F.timestamp_seconds(S.epoch_sec(x)), "yyyy-MM-dd")
    return bars.groupBy(*PAIR).agg(day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"))


def empty_pages(bars: DataFrame, before: int) -> DataFrame:
    """Pairs without rows before a time, with their bounds."""
    return bounds(bars).join(page(bars, before, 1).select(*PAIR), PAIR, "left_anti")


def requests(bars: DataFrame, step: int, now: int, most: int = 2000, most_tail: int = 40_000) -> DataFrame:
    """(pair, first, end: exclusive, tail): bucket ranges to ask a second source for.

    Holes of up to `most` buckets, and the closed buckets after the last bar up to now, of up to `most_tail`.
    """
    b = bars.select(*PAIR, F.floor(F.col("ts") / step).alias("b")).distinct().withColumn("next", F.lead("b").over(by_pair("b")))
    last, here = F.col("next").isNull(), now // step
    hole = ~last & (F.col("next") > F.col("b") + 1) & (F.col("next") - F.col("b") - 1 <= most)
    tail = last & (F.col("b") < here) & (F.lit(here) - F.col("b") <= most_tail)
    return b.where(hole | (tail & (F.col("b") + 1 < here))).select(*PAIR, (F.col("b") + 1).alias("first"), F.coalesce("next", F.lit(here)).alias("end"), last.alias("tail"))


def stitch(stored: DataFrame, source: DataFrame, step: int, now: int, most: int = 2000, most_tail: int = 40_000) -> DataFrame:
    """Stored bars and the source's bars of missing buckets (as in requests); of equal times the stored row stays.

    Stored and source bars pass one shuffle: a source bar looks at the stored buckets before and after it.
    source: (pair, ts, prices, volume, arrival); of equal times the first arrival counts, an unknown volume is 0.
    """
    cols = [*PAIR, "ts", *PRICES, "volume"]
    none = F.lit(None).cast("long")
    bucket = F.floor(F.col("ts") / step)
    rows = stored.select(*cols, bucket.alias("b"), none.alias("arrival")).unionByName(
        source.select(*PAIR, "ts", *PRICES, F.coalesce("volume", F.lit(0.0)).alias("volume"), bucket.alias("b"), F.col("arrival").cast("long").alias("arrival"))
    )
    mine = F.when(F.col("arrival").isNull(), F.col("b"))
    # both frames begin at the partition's first row and grow, so a running value serves each row
    whole = lambda order: by_pair(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("before", F.max(mine).over(whole(F.asc("b")))).withColumn("after", F.min(mine).over(whole(F.desc("b"))))
    here = now // step
    hole = F.col("after").isNotNull() & (F.col("before") < F.col("b")) & (F.col("after") > F.col("b")) & (F.col("after") - F.col("before") - 1 <= most)
    tail = F.col("after").isNull() & (F.col("b") < here) & (F.lit(here) - F.col("before") <= most_tail)
    rows = rows.where(F.col("arrival").isNull() | F.coalesce(hole | tail, F.lit(False)))
    first = F.row_number().over(W.partitionBy(*PAIR, "ts").orderBy(F.asc_nulls_first("arrival")))
    return rows.withColumn("_rn", first).where(F.col("arrival").isNull() | (F.col("_rn") == 1)).select(*cols, F.col("arrival").isNotNull().alias("added"))


def answers(asked: DataFrame, source: DataFrame, failed: DataFrame, step: int) -> DataFrame:
    """(pair, first, end, bars, status) of requested ranges: failed (failed: pair, first), empty, or filled.

    An error and an exchange without bars look alike in the bars; here they do not.  Ranges and bars meet by a running
    range start in one window.
    """
    b = F.floor(F.col("ts") / step)
    points = asked.select(*PAIR, F.col("first").alias("at"), "first", "end").unionByName(source.select(*PAIR, b.alias("at")).distinct(), allowMissingColumns=True)
    w = by_pair("at", F.asc_nulls_last("first")).rowsBetween(W.unboundedPreceding, 0)
    hit = points.withColumn("r", F.last(F.when(F.col("first").isNotNull(), F.struct("first", "end")), ignorenulls=True).over(w))
    n = hit.where("first IS NULL AND at < r.end").groupBy(*PAIR, F.col("r.first").alias("first")).agg(F.count(F.lit(1)).alias("bars"))
    out = asked.join(n, [*PAIR, "first"], "left").join(failed.select(*PAIR, "first").distinct().withColumn("bad", F.lit(True)), [*PAIR, "first"], "left")
    status = F.when(F.col("bad"), "failed").when(F.col("bars").isNull(), "empty").otherwise("filled")
    return out.select(*PAIR, "first", "end", F.coalesce("bars", F.lit(0)).alias("bars"), status.alias("status"))


def catch_up(pages: DataFrame) -> DataFrame:
    """The bars of fetched pages (pair, page, place, ts_ms, prices, volume), times in seconds; of equal times the first counts."""
    ts = F.floor(F.col("ts_ms") / 1000).cast("long")
    first = F.row_number().over(W.partitionBy(*PAIR, "ts_ms").orderBy("page", "place"))
    return pages.withColumn("_rn", first).where("_rn = 1").select(*PAIR, ts.alias("ts"), *PRICES, "volume")


def reachable(gaps: DataFrame, now: int, step: int) -> DataFrame:
    """Gaps (pair, ts, next_ts) that their exchange still serves; a gap that begins earlier begins at the limit."""
    floor = S.lookback_floor(F.col("exchange"), now, step)
    return gaps.withColumn("_floor", floor).where("_floor IS NULL OR next_ts >= _floor").withColumn("ts", F.greatest("ts", "_floor")).drop("_floor")


def frozen(quarter: DataFrame, daily: DataFrame, now: int, limit_sec: int = 48 * 3600) -> DataFrame:
    """(pair, frozen) of summary rows (pair, max_ts) of both bar lengths: the newest bar of either is older than the limit."""
    newest = quarter.select(*PAIR, "max_ts").unionByName(daily.select(*PAIR, "max_ts")).groupBy(*PAIR).agg(F.max(F.coalesce("max_ts", F.lit(0))).alias("ts"))
    return newest.select(*PAIR, ((F.col("ts") <= 0) | (F.lit(now) - S.epoch_sec(F.col("ts")) > limit_sec)).alias("frozen"))


def decorate(rows: DataFrame) -> DataFrame:
    """Fetched rows (pair, ts_ms, prices, volume) as stored: seconds, money columns, kind, addresses, clocks of two zones."""
    swap, spot = S.is_perp(F.col("ticker")), F.lower(F.col("exchange"))
    made = lambda templates: D.url(spot, S.base_of(F.col("ticker")), S.quote_of(F.col("ticker")), templates)
    clock = lambda zone: F.date_format(F.from_utc_timestamp(F.timestamp_seconds("ts"), zone), "yyyy-MM-dd HH:mm:ss")
    out = rows.withColumn("ts", F.floor(F.col("ts_ms") / 1000).cast("long"))
    return out.select(
        *PAIR, "ts", *PRICES, "volume", (F.col("volume") * F.col("low")).alias("volume_x_low"), (F.col("volume") * F.col("close")).alias("volume_x_close"),
        F.when(swap, "swap").otherwise("spot").alias("asset_type"), F.when(swap, made(D.SWAP)).otherwise(made(D.SPOT)).alias("url_of_trading_pair"),
        F.when(~swap, made(D.SWAP)).alias("url_of_swap_contract_if_it_exists"), clock("Europe/Moscow").alias("open_time_msk"), clock("Asia/Almaty").alias("open_time_almaty"),
    )


def first_of(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key in an order, which makes the choice defined."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def lane_start(last: Column, now: int, step: int, most: int = 2000, tail: int = 3) -> tuple[Column, Column]:
    """(since, want) of a pair that is watched: one bar before its last row if the hole is small enough, else the tail only."""
    tail = max(1, tail)
    hole = F.greatest(F.lit(0), F.floor((F.lit(now) - last) / step))
    near = F.coalesce((last > 1) & (hole <= max(0, most)), F.lit(False))
    return F.when(near, last - step).otherwise(now - (tail + 1) * step).cast("long"), F.when(near, hole + tail + 1).otherwise(tail + 2).cast("long")


def prefill_needed(oldest: Column, floor: int, slack: int = 1800) -> Column:
    """Whether a table starts noticeably later than wanted; an empty one does not."""
    return F.coalesce((oldest != 0) & (oldest > floor + slack), F.lit(False))


def prefill_since(oldest: Column, step: int, limit: int, exchange_floor: Column, floor: int) -> Column:
    """Where the next older page begins, in milliseconds: a page back, not before what the exchange serves or what is
    kept; null where nothing is left."""
    oldest, exchange_floor = oldest.cast("long"), exchange_floor.cast("long")
    since = F.greatest(oldest * 1000 - limit * step * 1000, exchange_floor * 1000, F.lit(floor * 1000))
    return F.when((exchange_floor.isNull() | (exchange_floor < oldest)) & (since < oldest * 1000), since)


def empty_page_action(first_ms: Column, oldest: Column, step: int, span: Column) -> Column:
    """struct(action, span) after a page without older rows: terminal if it ran up to the table's start (first_ms: its
    earliest row, null for an empty page) or was one bar long; else shrink to half."""
    reached = F.coalesce(first_ms <= (oldest.cast("long") + 2 * step) * 1000, F.lit(False))
    shrink = ~reached & (span > 1)
    return F.struct(F.when(shrink, "shrink").otherwise("terminal").alias("action"), F.when(shrink, F.greatest(F.lit(1), F.floor(span / 2))).cast("long").alias("span"))


def prefill_due(latched_oldest: Column, attempted: Column, oldest: Column, now: int, wait_sec: int = 4 * 3600) -> Column:
    """Whether to try again: never tried, the table got deeper since, or the last attempt is old enough."""
    return attempted.isNull() | F.coalesce(latched_oldest != oldest, F.lit(False)) | (F.lit(now) - attempted >= wait_sec)


def pulse(watch: DataFrame, now: int, window_sec: int, ttl_sec: int) -> DataFrame:
    """Counts over watched pairs (updated, served, served_15m, served_1d: seconds, null if never) that are still published.

    Ages are null, not zero, where nothing was served.
    """
    live = watch.where(F.col("updated") > now - ttl_sec)
    recent = lambda x: F.count_if(F.col(x) > now - window_sec)
    return live.agg(
        F.count(F.lit(1)).alias("watched"), recent("served").alias("served"), (F.lit(now) - F.max("served")).alias("idle"), recent("served_15m").alias("served_15m"),
        recent("served_1d").alias("served_1d"), (F.lit(now) - F.max("served_15m")).alias("idle_15m"), (F.lit(now) - F.max("served_1d")).alias("idle_1d"),
    )
