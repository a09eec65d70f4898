"""Queries of cleaning, paging, stitching, fetch plans and decoration of candles, with odd rows planted in the bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import candles, lanes, liquidity, series, summary, volatility
from ..sources import recorded, tables
from ..storage import fresh_path
from . import catalog as C
from .catalog import BARS, DAY, NOW, PERP, QUARTER, bars
from .registry import query

# by the number of a bar: no close, a NaN high, milliseconds, a NaN or no volume, a time long past, one ten years ahead;
# all times of one exchange are milliseconds
MESSY = f"(SELECT ticker, exchange, CASE WHEN exchange = 'okx' OR k = 2 THEN ts * 1000 WHEN k = 5 THEN 1000 WHEN k = 6 THEN ts + 315360000 ELSE ts END AS ts, open, CASE WHEN k = 1 THEN CAST('nan' AS DOUBLE) ELSE high END AS high, low, CASE WHEN k = 0 THEN NULL ELSE close END AS close, CASE WHEN k = 3 THEN CAST('nan' AS DOUBLE) WHEN k = 4 THEN NULL ELSE volume END AS volume FROM (SELECT *, ts // 900 % 13 AS k FROM {BARS(QUARTER)}))"


def messy(spark, sf_dir):
    k = F.floor(F.col("ts") / 900) % 13
    ts = F.when((F.col("exchange") == "okx") | (k == 2), F.col("ts") * 1000).when(k == 5, 1000).when(k == 6, F.col("ts") + 315_360_000).otherwise(F.col("ts"))
    volume = F.when(k == 3, float("nan")).when(k != 4, F.col("volume"))
    return bars(spark, sf_dir, QUARTER).select("ticker", "exchange", ts.cast("long").alias("ts"), "open", F.when(k == 1, float("nan")).otherwise(F.col("high")).alias("high"), "low", F.when(k != 0, F.col("close")).alias("close"), volume.alias("volume"))


SANE = f"BETWEEN 1356998400 AND {NOW} + 172800"


@query(f"SELECT ticker, exchange, s AS ts, open, low FROM (SELECT *, CASE WHEN median(ts) OVER (PARTITION BY ticker, exchange) > 1e11 THEN ts // 1000 ELSE ts END AS s FROM {MESSY}) WHERE s {SANE}")
def candle_sanity(spark, sf_dir):
    return candles.sanitize(messy(spark, sf_dir), NOW).select("ticker", "exchange", "ts", "open", "low")


ROWS = f"(SELECT ticker, exchange, s AS ts, open, high, low, close, CASE WHEN volume IS NULL OR isnan(volume) THEN 0.0 ELSE round(volume, 2) END AS volume FROM (SELECT *, CASE WHEN ts > 100000000000 THEN ts // 1000 ELSE ts END AS s FROM {MESSY}) WHERE s {SANE} AND NOT isnan(high) AND close IS NOT NULL)"


@query(f"SELECT * FROM {ROWS}")
def sane_candles(spark, sf_dir):
    return candles.sane_rows(messy(spark, sf_dir), NOW)


FRAME = f"(SELECT ticker, exchange, CASE WHEN exchange = 'okx' THEN NULL WHEN n % 3 = 0 THEN m * 1000 WHEN n % 7 = 0 THEN m + 864000 ELSE m END AS max_ts FROM (SELECT ticker, exchange, max(ts) AS m, count(*) AS n FROM {BARS(QUARTER)} GROUP BY 1, 2))"


def frame(spark, sf_dir):
    rows = bars(spark, sf_dir, QUARTER).groupBy("ticker", "exchange").agg(F.max("ts").alias("m"), F.count(F.lit(1)).alias("n"))
    ts = F.when(F.col("exchange") == "okx", None).when(F.col("n") % 3 == 0, F.col("m") * 1000).when(F.col("n") % 7 == 0, F.col("m") + 864_000).otherwise(F.col("m"))
    return rows.select("ticker", "exchange", ts.alias("max_ts"))


@query(f"SELECT ticker, exchange, max_ts FROM (SELECT *, CASE WHEN (SELECT median(max_ts) FROM {FRAME}) > 1e11 THEN max_ts // 1000 ELSE max_ts END AS s FROM {FRAME}) WHERE s {SANE}")
def sane_summary(spark, sf_dir):
    return candles.sane_summary(frame(spark, sf_dir), NOW)


CURSOR = 1705276800  # 2024-01-15


@query(f"SELECT ticker, exchange, ts, open, low FROM {MESSY} WHERE ts < {CURSOR} OR (ts >= 100000000000 AND ts < {CURSOR}000) QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC, open, low) <= 5")
def candle_page(spark, sf_dir):
    return candles.page(messy(spark, sf_dir).where("ts <> 1000"), CURSOR, 5).select("ticker", "exchange", "ts", "open", "low")


EARLY = 1704074400  # 2024-01-01 02:00


@query(f"SELECT ticker, exchange, strftime(make_timestamp(min(ts) * 1000000), '%Y-%m-%d') AS first_day, strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%d') AS last_day FROM {BARS(QUARTER)} GROUP BY 1, 2 HAVING min(ts) >= {EARLY}")
def empty_pages(spark, sf_dir):
    ms = bars(spark, sf_dir, QUARTER).withColumn("ts", F.col("ts") * F.when(F.col("exchange") == "okx", 1000).otherwise(1))
    return candles.empty_pages(ms, EARLY)


HOLES = f"(SELECT ticker, exchange, b, lead(b) OVER (PARTITION BY ticker, exchange ORDER BY b) AS n FROM (SELECT DISTINCT ticker, exchange, ts // 900 AS b FROM {BARS(QUARTER)} WHERE ts // 900 % 3 <> 0 AND ts < {NOW} - 86400))"
ASKED = f"(SELECT ticker, exchange, b + 1 AS first, coalesce(n, {NOW // 900}) AS end, n IS NULL AS tail FROM {HOLES} WHERE (n > b + 1 AND n - b - 1 <= 30) OR (n IS NULL AND b + 1 < {NOW // 900} AND {NOW // 900} - b <= 150))"


def _stored(spark, sf_dir):
    return bars(spark, sf_dir, QUARTER).where(f"ts div 900 % 3 <> 0 AND ts < {NOW} - 86400")


def _source(spark, sf_dir):
    """Every bar once more at ten times the volume, and again later at a hundred times."""
    b = bars(spark, sf_dir, QUARTER)
    return b.withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("volume", F.when((F.col("arrival") == 1) & (F.floor(F.col("ts") / 900) % 5 == 0), None).otherwise(F.col("volume") * F.pow(F.lit(10.0), "arrival")))


@query(f"SELECT ticker, exchange, first, \"end\", tail FROM {ASKED}")
def stitch_requests(spark, sf_dir):
    return candles.requests(_stored(spark, sf_dir), QUARTER, NOW, 30, 150)


@query(f"SELECT ticker, exchange, ts, open, high, low, close, volume, false AS added FROM {BARS(QUARTER)} WHERE ts // 900 % 3 <> 0 AND ts < {NOW} - 86400 UNION ALL SELECT s.ticker, s.exchange, ts, open, high, low, close, CASE WHEN ts // 900 % 5 = 0 THEN 0.0 ELSE volume * 10 END, true FROM {BARS(QUARTER)} s JOIN {ASKED} a ON s.ticker = a.ticker AND s.exchange = a.exchange AND ts // 900 >= a.first AND ts // 900 < a.\"end\"")
def stitched(spark, sf_dir):
    return candles.stitch(_stored(spark, sf_dir), _source(spark, sf_dir), QUARTER, NOW, 30, 150)


@query(f"SELECT a.ticker, a.exchange, first, \"end\", count(s.ts) AS bars, CASE WHEN first % 11 = 0 THEN 'failed' WHEN count(s.ts) = 0 THEN 'empty' ELSE 'filled' END AS status FROM {ASKED} a LEFT JOIN {BARS(QUARTER)} s ON s.ticker = a.ticker AND s.exchange = a.exchange AND ts // 900 >= a.first AND ts // 900 < a.\"end\" GROUP BY 1, 2, 3, 4")
def stitch_answers(spark, sf_dir):
    asked = candles.requests(_stored(spark, sf_dir), QUARTER, NOW, 30, 150)
    return candles.answers(asked, bars(spark, sf_dir, QUARTER), asked.where("first % 11 = 0"), QUARTER)


@query(f"SELECT ticker, exchange, ts, open, high, low, close, volume FROM {BARS(QUARTER)}")
def recorded_pages(spark, sf_dir):
    """Pages of fetched bars as recorded JSON, each bar on two pages; the later one is wrong."""
    b = bars(spark, sf_dir, QUARTER).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    row = F.array(F.col("ts") * 1000.0, "open", "high", "low", "close", F.col("volume") + F.col("again"))
    pages = b.groupBy("ticker", "exchange", (F.floor(F.col("ts") / DAY) * 2 + F.col("again")).alias("page")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("payload"))
    return candles.catch_up(recorded.ohlcv(pages))


@query(f"SELECT ticker, exchange, greatest(ts, coalesce(f, ts)) AS ts, next_ts FROM (SELECT *, CASE WHEN exchange = 'gateio' THEN {NOW} - 9900 * 900 + 86400 * 95 END AS f FROM (SELECT ticker, exchange, ts, lead(ts) OVER (PARTITION BY ticker, exchange ORDER BY ts) AS next_ts FROM {BARS(QUARTER)}) WHERE next_ts - ts > 1800) WHERE f IS NULL OR next_ts >= f")
def reachable_gaps(spark, sf_dir):
    return candles.reachable(series.tolerant_gaps(bars(spark, sf_dir, QUARTER), 1800), NOW + 95 * DAY, QUARTER)


@query(f"SELECT ticker, exchange, ts, CASE exchange WHEN 'gateio' THEN greatest(ts, {NOW} + 8200000 - 9900 * 900) ELSE ts END AS since_15m, CASE exchange WHEN 'okx' THEN greatest(ts, {NOW} + 31500000 - 379 * 86400) ELSE ts END AS since_1d FROM {BARS(DAY)}")
def clamped_since(spark, sf_dir):
    renamed = F.when(F.col("exchange") == "okx", "bingx").otherwise(F.col("exchange"))
    return bars(spark, sf_dir).select("ticker", "exchange", "ts", S.clamp_since(F.col("ts"), F.col("exchange"), NOW + 8_200_000, QUARTER).alias("since_15m"), S.clamp_since(F.col("ts"), renamed, NOW + 31_500_000, DAY).alias("since_1d"))


@query(f"SELECT ticker, exchange, ts, CASE WHEN first_ms <= (ts + 1800) * 1000 OR span <= 1 THEN 'terminal' ELSE 'shrink' END AS action, CASE WHEN NOT coalesce(first_ms <= (ts + 1800) * 1000, false) AND span > 1 THEN greatest(1, span // 2) END AS span FROM (SELECT *, CASE WHEN ts // 900 % 4 = 0 THEN NULL ELSE (ts + ts // 900 % 4 * 900) * 1000 END AS first_ms, ts // 900 % 6 AS span FROM {BARS(QUARTER)})")
def prefill_actions(spark, sf_dir):
    b = bars(spark, sf_dir, QUARTER).withColumn("n", F.floor(F.col("ts") / 900))
    first_ms = F.when(F.col("n") % 4 != 0, (F.col("ts") + F.col("n") % 4 * 900) * 1000)
    return b.select("ticker", "exchange", "ts", candles.empty_page_action(first_ms, F.col("ts"), QUARTER, F.col("n") % 6).alias("a")).select("ticker", "exchange", "ts", "a.action", "a.span")


@query(f"SELECT ticker, exchange, n % 3 = 0 OR n % 5 = 0 OR n % 4 >= 2 AS due FROM (SELECT ticker, exchange, count(*) AS n FROM {BARS(QUARTER)} GROUP BY 1, 2)")
def prefill_due(spark, sf_dir):
    """Never tried, deeper than when it was latched, or tried long ago."""
    n = F.col("bars")
    rows = C.last_rows(spark, sf_dir).withColumn("oldest", F.col("last_ts") - 900 * n)
    attempted = F.when(n % 3 != 0, NOW - 7200 * (n % 4))
    return rows.select("ticker", "exchange", candles.prefill_due(F.when(n % 3 != 0, F.col("oldest") + F.when(n % 5 == 0, 900).otherwise(0)), attempted, F.col("oldest"), NOW).alias("due"))


@query(f"SELECT ticker, exchange, m <= 0 OR {NOW} - (CASE WHEN m > 100000000000 THEN m // 1000 ELSE m END) > 7200 AS frozen FROM (SELECT ticker, exchange, max(CASE WHEN k = 0 THEN 0 ELSE ts * k END) AS m FROM (SELECT *, CASE exchange WHEN 'okx' THEN 1000 WHEN 'bybit' THEN 1 ELSE CASE WHEN contains(ticker, 'ERROR') THEN 0 ELSE 1 END END AS k FROM (SELECT ticker, exchange, max(ts) AS ts FROM {BARS(QUARTER)} GROUP BY 1, 2 UNION ALL SELECT ticker, exchange, max(ts) FROM {BARS(DAY)} GROUP BY 1, 2)) GROUP BY 1, 2)")
def frozen_pairs(spark, sf_dir):
    def newest(step):
        unit = F.when(F.col("exchange") == "okx", F.max("ts") * 1000).when((F.col("exchange") == "gateio") & F.contains(F.col("ticker"), F.lit("ERROR")), None).otherwise(F.max("ts"))
        return bars(spark, sf_dir, step).groupBy("ticker", "exchange").agg(unit.alias("max_ts"))

    return candles.frozen(newest(QUARTER), newest(DAY), NOW, 7200)



@query(f"SELECT ticker, exchange, ts, open, high, low, close, volume, volume * low AS volume_x_low, volume * close AS volume_x_close, CASE WHEN {PERP} THEN 'swap' ELSE 'spot' END AS asset_type, CASE WHEN {PERP} THEN {C.SWAP_SQL} ELSE {C.SPOT_SQL} END AS url_of_trading_pair, CASE WHEN NOT {PERP} THEN {C.SWAP_SQL} END AS url_of_swap_contract_if_it_exists, strftime(make_timestamp((ts + 10800) * 1000000), '%Y-%m-%d %H:%M:%S') AS open_time_msk, strftime(make_timestamp((ts + 21600) * 1000000), '%Y-%m-%d %H:%M:%S') AS open_time_almaty FROM (SELECT *, split_part(ticker, '/', 1) AS base FROM {BARS(QUARTER)})")
def decorated(spark, sf_dir):
    return candles.decorate(bars(spark, sf_dir, QUARTER).withColumn("ts_ms", F.col("ts") * 1000 + 999))


@query(f"SELECT event_id, CASE WHEN k = 0 THEN NULL WHEN k = 4 THEN NULL ELSE round({NOW} - t / 1e6, 3) END AS idle, round({NOW} - t / 1e6, 6) AS idle_of_time FROM (SELECT *, event_id % 5 AS k FROM {C.TAPE}) ")
def idle_ages(spark, sf_dir):
    """Ages of times in seconds, in milliseconds, of zero and of two years ahead; and of timestamps."""
    k = F.col("event_id") % 5
    sec = F.col("t") / 1e6
    ts = F.when(k == 0, 0.0).when(k == 4, sec + 2 * 366 * 86400).when(k == 1, sec * 1000).otherwise(sec)
    rows = C.tape(spark, sf_dir)
    return rows.select("event_id", F.round(S.idle_sec(ts, NOW), 3).alias("idle"), F.round(S.idle_sec(F.timestamp_micros("t"), NOW, True), 6).alias("idle_of_time"))


@query(f"SELECT ticker, exchange, round(({NOW} + 86400 - m) / 3600.0, 6) AS hours, ({NOW} + 86400 - m) / 3600.0 > 1 AS stale_15m, ({NOW} + 86400 - m) / 3600.0 > 49 AS stale_1d FROM (SELECT ticker, exchange, max(ts) AS m FROM {BARS(QUARTER)} GROUP BY 1, 2) UNION ALL SELECT 'EMPTY/USDT', 'okx', NULL, false, false")
def staleness(spark, sf_dir):
    ts = F.when(F.col("exchange") == "okx", F.col("last_ts") * 1000).otherwise(F.col("last_ts"))
    rows, now = C._with_empty(C.last_rows(spark, sf_dir)), NOW + 86400
    return rows.select("ticker", "exchange", F.round(S.behind_hours(ts, now), 6).alias("hours"), S.is_stale(ts, now, QUARTER).alias("stale_15m"), S.is_stale(ts, now, DAY).alias("stale_1d"))


BOOKS = f"(SELECT key, CASE WHEN key % 7 = 0 THEN 0 ELSE bid END AS bid, CASE WHEN key % 7 = 0 THEN 0 ELSE ask END AS ask, 100.0 AS close, CASE WHEN key % 5 = 0 THEN 0.0 ELSE key % 11 END AS atr FROM {C.BOOK} WHERE bid IS NOT NULL AND ask IS NOT NULL)"


def _books(spark, sf_dir):
    b = liquidity.book(C.levels(spark, sf_dir)).where("bid IS NOT NULL AND ask IS NOT NULL")
    zero = lambda x: F.when(F.col("key") % 7 == 0, 0.0).otherwise(F.col(x)).alias(x)
    return b.select("key", zero("bid"), zero("ask"), F.lit(100.0).alias("close"), F.when(F.col("key") % 5 == 0, 0.0).otherwise((F.col("key") % 11).cast("double")).alias("atr"))


@query(f"SELECT key, round(CASE WHEN bid + ask <> 0 THEN (bid + ask) / 2 ELSE close END, 6) AS mid, round(ask - bid, 6) AS spread_abs, round(CASE WHEN bid > 0 THEN (ask - bid) / bid * 100 ELSE 0 END, 6) AS of_bid, round(CASE WHEN bid + ask > 0 THEN (ask - bid) / ((bid + ask) / 2) * 100 ELSE 0 END, 6) AS of_mid, round(CASE WHEN atr > 0 THEN (ask - bid) / atr * 100 ELSE 0 END, 6) AS of_atr FROM {BOOKS}")
def book_spreads(spark, sf_dir):
    bid, ask = F.col("bid"), F.col("ask")
    six = lambda x, name: F.round(x, 6).alias(name)
    return _books(spark, sf_dir).select("key", six(S.mid_price(bid, ask, F.col("close")), "mid"), six(ask - bid, "spread_abs"), six(S.spread_of(bid, ask, bid), "of_bid"), six(S.spread_of(bid, ask, (bid + ask) / 2), "of_mid"), six(S.spread_of(bid, ask, F.col("atr")), "of_atr"))


@query(f"SELECT ticker, exchange, ts, CASE WHEN NOT isnan(high) THEN high END AS high, close, CASE WHEN NOT isnan(volume) THEN volume END AS volume FROM {MESSY} WHERE ts <> 1000")
def finite_fields(spark, sf_dir):
    return messy(spark, sf_dir).where("ts <> 1000").select("ticker", "exchange", "ts", S.finite(F.col("high")).alias("high"), "close", S.finite(F.col("volume")).alias("volume"))


@query(f"SELECT ticker, exchange, arg_min(ts, t) AS ts, count(*) AS n FROM (SELECT *, t // 86400000000 AS d, t // 900000000 * 900 AS ts FROM {C.TAPE}) GROUP BY ticker, exchange, d")
def first_bar_of_day(spark, sf_dir):
    rows = C.tape(spark, sf_dir).withColumn("d", F.floor(F.col("t") / 86_400_000_000)).withColumn("ts", (F.floor(F.col("t") / 900_000_000) * 900).cast("long"))
    n = rows.groupBy("ticker", "exchange", "d").agg(F.count(F.lit(1)).alias("n"))
    return candles.first_of(rows, ["ticker", "exchange", "d"], "t", "event_id").join(n, ["ticker", "exchange", "d"]).select("ticker", "exchange", "ts", "n")


@query(f"SELECT ticker, exchange, min(ts) AS oldest, max(ts) AS newest, CASE WHEN exchange = 'okx' THEN 1 ELSE 0 END AS place FROM {BARS(QUARTER)} GROUP BY 1, 2 UNION ALL SELECT 'EMPTY/USDT', 'okx', 0, 1, 0")
def stored_bounds(spark, sf_dir):
    """Pairs in two places: one exchange only in the second and in milliseconds, the others in both; one table is empty."""
    from ..operators.selection import stored_bounds as found

    b = bars(spark, sf_dir, QUARTER).select("ticker", "exchange", "ts")
    first = b.where("exchange <> 'okx'").withColumn("place", F.lit(0))
    second = b.withColumn("place", F.lit(1)).withColumn("ts", F.when(F.col("exchange") == "okx", F.col("ts") * 1000).otherwise(F.col("ts") - 900))
    empty = spark.sql("SELECT 'EMPTY/USDT' AS ticker, 'okx' AS exchange, CAST(NULL AS LONG) AS ts, 0 AS place")
    return found(first.unionByName(second).unionByName(empty))


@query(f"SELECT ticker, exchange, ts // 900 AS bucket FROM {BARS(QUARTER)}")
def stored_buckets(spark, sf_dir):
    b = C.tape(spark, sf_dir).select("ticker", "exchange", S.bucket(F.floor(F.col("t") / 1_000_000), QUARTER).alias("bucket"))
    return b.distinct()


@query(f"SELECT ticker, exchange, ts, round(j, 6) AS jump_pct, mb AS missing_between FROM (SELECT *, abs(open - pc) / pc * 100 AS j, ts // 86400 - pt // 86400 - 1 AS mb FROM (SELECT *, lag(close) OVER w AS pc, lag(ts) OVER w AS pt FROM (SELECT * FROM {BARS(DAY)} QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) <= 12) WINDOW w AS (PARTITION BY ticker, exchange ORDER BY ts))) WHERE pc > 0 AND j >= 50")
def continuity_newest(spark, sf_dir):
    return series.continuity(series.newest(bars(spark, sf_dir), 12), DAY, 50.0)


@query(f"SELECT ticker, exchange, ts, tr FROM (SELECT ticker, exchange, ts, CASE WHEN high IS NULL OR isnan(high) OR pc IS NULL THEN 0.0 ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker, exchange ORDER BY ts), close) AS pc FROM (SELECT ticker, exchange, ts // 86400 AS ts, open, CASE WHEN ts // 86400 % 4 = 0 THEN CAST('nan' AS DOUBLE) WHEN ts // 86400 % 4 = 1 THEN NULL ELSE high END AS high, low, CASE WHEN ts // 86400 % 6 = 0 THEN NULL ELSE close END AS close FROM {BARS(DAY)})))")
def true_range_odd(spark, sf_dir):
    """True ranges of bars with NaN and unknown highs and unknown closes."""
    k = F.floor(F.col("ts") / DAY)
    high = F.when(k % 4 == 0, float("nan")).when(k % 4 != 1, F.col("high"))
    odd = bars(spark, sf_dir).select("ticker", "exchange", k.alias("ts"), "open", high.alias("high"), "low", F.when(k % 6 != 0, F.col("close")).alias("close"))
    return volatility.true_range(odd).select("ticker", "exchange", "ts", "tr")


@query(f"SELECT b.ticker, b.exchange, b.ts, CASE WHEN rn <= 2 THEN s.oi END AS open_interest, CASE WHEN rn <= 2 THEN s.rate END AS funding_rate, CASE WHEN rn <= 2 THEN s.at END AS funding_ts FROM (SELECT *, row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) AS rn FROM {BARS(QUARTER)}) b LEFT JOIN (SELECT ticker, exchange, arg_max(value, t) AS rate, max(t) // 1000000 AS at, count(*) * 1.0 AS oi FROM {C.TAPE} WHERE event_type = 'purchase' GROUP BY 1, 2) s ON b.ticker = s.ticker AND b.exchange = s.exchange")
def funding_snapshot(spark, sf_dir):
    """Recorded funding and open interest onto the two newest bars of a pair."""
    t = C.tape(spark, sf_dir).where(F.col("ticker").startswith("PURCHASE"))
    rate = t.select("ticker", "exchange", F.to_json(F.struct(F.floor(F.col("t") / 1000).alias("timestamp"), F.col("price").alias("fundingRate"))).alias("payload"))
    oi = t.groupBy("ticker", "exchange").agg(F.to_json(F.struct(F.count(F.lit(1)).cast("double").alias("openInterestAmount"), F.lit(NOW * 1000).alias("timestamp"))).alias("payload"))
    last = recorded.funding(rate).groupBy("ticker", "exchange").agg(F.max_by(F.struct("rate", "ts"), "ts_ms").alias("f"))
    snapshot = last.join(recorded.open_interest(oi), ["ticker", "exchange"], "left").select("ticker", "exchange", "open_interest", F.col("f.rate").alias("funding_rate"), F.col("f.ts").alias("funding_ts"))
    return lanes.with_snapshot(bars(spark, sf_dir, QUARTER), snapshot, ["open_interest", "funding_rate", "funding_ts"]).select("ticker", "exchange", "ts", "open_interest", "funding_rate", "funding_ts")


@query(f"SELECT * FROM {C.BOOK}")
def recorded_books(spark, sf_dir):
    """Books as recorded JSON, read back to levels."""
    side = lambda name: F.collect_list(F.when(F.col("side") == name, F.array("price", "amount")))
    rows = C.levels(spark, sf_dir).groupBy("key").agg(F.to_json(F.struct(side("bid").alias("bids"), side("ask").alias("asks"))).alias("payload"))
    return liquidity.book(recorded.levels(rows))


@query(f"SELECT * FROM {BARS(DAY)} WHERE exchange = 'bybit' AND ticker NOT LIKE '%:%'")
def exchange_partition(spark, sf_dir):
    """Spot bars of one exchange from candle files that are partitioned by exchange: the others' files are not read."""
    path = fresh_path(spark, "candles")
    tables.write_candles(bars(spark, sf_dir), path)
    return tables.read_candles(spark, path).where("exchange = 'bybit' AND NOT contains(ticker, ':')")


@query(f"SELECT ticker, exchange, count(*) AS n, sum(CAST(volume AS DECIMAL(18,2)))::DOUBLE AS volume FROM {BARS(DAY)} GROUP BY 1, 2")
def candle_files(spark, sf_dir):
    """Candles written and read back as CSV, JSON, ORC and Parquet, a quarter of the bars each."""
    out = None
    for i, kind in enumerate(("csv", "json", "orc", "parquet")):
        path = fresh_path(spark, f"candles-{kind}")
        bars(spark, sf_dir).where(f"ts div 86400 % 4 = {i}").write.format(kind).save(path)
        part = tables.read_candles(spark, path, kind)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("ticker", "exchange").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("volume").cast("decimal(18,2)")).cast("double").alias("volume"))


@query(f"SELECT ticker, exchange, close, low, CASE WHEN close > 0 AND low > 0 THEN round((close - low) / low * 100, 6) END AS growth_pct FROM (SELECT ticker, exchange, arg_max(close, ts) AS close, min(low) FILTER (WHERE ts >= {NOW} - 864000) AS low FROM {BARS(DAY)} GROUP BY 1, 2) WHERE low > 0 AND (close - low) / low * 100 >= 150")
def growth_filter(spark, sf_dir):
    """Growth of pairs, those of one exchange with times in milliseconds, and only the grown ones."""
    from ..operators.selection import grown

    b = bars(spark, sf_dir).withColumn("ts", F.col("ts") * F.when(F.col("exchange") == "okx", 1000).otherwise(1))
    return grown(summary.growth(b, NOW, 10), 150.0)
