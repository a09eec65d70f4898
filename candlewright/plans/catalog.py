"""The registered queries of the market-data operators, each with the SQL that must give the same rows.

Bars, trades, tables and books are derived from the driver's tables: a pair is an event type and a user's parity, an
exchange is a user modulo three.  The clock is fixed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import scalars as S
from ..operators import candles, funding, lanes, liquidity, pumps, series, summary, volatility
from ..sources import tables
from .registry import query

NOW = 1706659200  # 2024-01-31 00:00 UTC
DAY, QUARTER = 86400, 900
SCAN = pumps.Scan(window=5, merge_gap=5, ratio=8.0, pre=5)
WICK = pumps.Scan(window=5, merge_gap=5, ratio=8.0, pre=5, source="high_low")

def tape(spark, sf_dir):
    return tables.trades(tables.events(spark, sf_dir))


def bars(spark, sf_dir, step=DAY):
    return tables.candles(tape(spark, sf_dir), step)


TAPE = "(SELECT upper(event_type) || '/USDT' || CASE WHEN user_id % 2 = 0 THEN ':USDT' ELSE '' END AS ticker, CASE user_id % 3 WHEN 0 THEN 'bybit' WHEN 1 THEN 'gateio' ELSE 'okx' END AS exchange, epoch_us(ts) AS t, value, event_type, event_id, user_id FROM events)"


def BARS(step):
    return f"(SELECT ticker, exchange, t // {1000000 * step} * {step} AS ts, arg_min(value, t) AS open, max(value) AS high, min(value) AS low, arg_max(value, t) AS close, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM {TAPE} GROUP BY 1, 2, 3)"


BASE = "split_part(ticker, '/', 1)"
PERP = "contains(ticker, ':')"


@query(f"SELECT * FROM {BARS(DAY)}")
def candles_1d(spark, sf_dir):
    return bars(spark, sf_dir)


@query(f"SELECT * FROM {BARS(QUARTER)}")
def candles_15m(spark, sf_dir):
    return bars(spark, sf_dir, QUARTER)


TR = f"(SELECT *, row_number() OVER w AS rn, greatest(high - low, abs(high - coalesce(lag(close) OVER w, close)), abs(low - coalesce(lag(close) OVER w, close))) AS tr FROM {BARS(DAY)} WINDOW w AS (PARTITION BY ticker, exchange ORDER BY ts))"


def ATR(step=DAY, seed="median"):
    """The filter written out round by round."""
    tr = TR if step == DAY else TR.replace(BARS(DAY), BARS(step))
    avg = "list_sum({0}) / len({0})"
    start = avg.format("win") if seed == "mean" else f"CASE WHEN list_median(win) > 0 THEN list_median(win) ELSE {avg.format('win')} END"
    out = f"WITH s0 AS (SELECT *, {start} AS a, ({start}) <= 0 AS done FROM (SELECT *, array_agg(tr) OVER (PARTITION BY ticker, exchange ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS win FROM {tr}))"
    for i in range(10):
        out += f", k{i} AS (SELECT *, list_filter(win, lambda x: x >= 0.5 * a AND x <= 1.8 * a) AS v FROM s{i}), m{i} AS (SELECT *, CASE WHEN len(v) > 0 THEN {avg.format('v')} END AS m FROM k{i}), s{i + 1} AS (SELECT * EXCLUDE (a, done, v, m), CASE WHEN done OR m IS NULL OR m <= 0 THEN a ELSE m END AS a, done OR m IS NULL OR m <= 0 OR abs(m - a) / greatest(abs(a), 1e-12) < 0.01 AS done FROM m{i})"
    return out + ", atr AS (SELECT ticker, exchange, ts, close, tr, rn, round(CASE WHEN rn <= 2 THEN 0.0 ELSE greatest(a, 0.0) END, 6) AS atr FROM s10) "


@query(f"SELECT ticker, exchange, ts, tr FROM {TR}")
def true_range(spark, sf_dir):
    return volatility.true_range(bars(spark, sf_dir)).select("ticker", "exchange", "ts", "tr")


def _atr(df):
    return df.select("ticker", "exchange", "ts", F.round("atr", 6).alias("atr"))


@query(ATR() + "SELECT ticker, exchange, ts, atr FROM atr")
def robust_atr(spark, sf_dir):
    return _atr(volatility.robust_atr(bars(spark, sf_dir)))


@query(ATR(QUARTER, "mean") + "SELECT ticker, exchange, ts, atr FROM atr")
def robust_atr_mean_seed(spark, sf_dir):
    return _atr(volatility.robust_atr(bars(spark, sf_dir, QUARTER), seed="mean"))


@query(ATR() + "SELECT ticker, exchange, ts, close, atr FROM atr QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) = 1")
def robust_atr_latest(spark, sf_dir):
    return series.newest(volatility.robust_atr(bars(spark, sf_dir))).select("ticker", "exchange", "ts", "close", F.round("atr", 6).alias("atr"))


@query(f"SELECT * FROM {BARS(DAY)} QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) = 1")
def latest_per_pair(spark, sf_dir):
    return series.newest(bars(spark, sf_dir))


@query(f"SELECT * FROM {BARS(QUARTER)} QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) <= 2")
def newest_two(spark, sf_dir):
    return series.newest(bars(spark, sf_dir, QUARTER), 2)


@query(f"SELECT * FROM {BARS(QUARTER)} QUALIFY row_number() OVER (PARTITION BY ticker, exchange, ts // 86400 ORDER BY coalesce(volume, 0) DESC, ts DESC) = 1")
def dedup_bars(spark, sf_dir):
    return series.dedup(bars(spark, sf_dir, QUARTER), DAY)


UPSERT = f"WITH b AS (SELECT * FROM {BARS(QUARTER)}), new AS (SELECT ticker, exchange, ts, open, high, low, close, volume * 2 AS volume FROM b WHERE (ts // 900) % 7 = 0), old AS (SELECT * FROM b o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.ticker = o.ticker AND n.exchange = o.exchange AND n.ts // 900 = o.ts // 900)) SELECT * FROM old UNION ALL SELECT * FROM new"


@query(UPSERT)
def upsert_buckets(spark, sf_dir):
    b = bars(spark, sf_dir, QUARTER)
    return series.upsert(b, b.where("(ts div 900) % 7 = 0").withColumn("volume", F.col("volume") * 2), QUARTER)


GAPS = f"(SELECT ticker, exchange, ts // 900 AS b, lead(ts // 900) OVER (PARTITION BY ticker, exchange ORDER BY ts) AS n FROM {BARS(QUARTER)})"


@query(f"SELECT ticker, exchange, b + 1 AS first_missing, n - 1 AS last_missing, n - b - 1 AS missing FROM {GAPS} WHERE n > b + 1")
def gap_ranges(spark, sf_dir):
    return series.gaps(bars(spark, sf_dir, QUARTER), QUARTER)


@query(f"SELECT ticker, exchange, count(*) AS stored, CAST(sum(hole) AS BIGINT) AS missing, max(hole) AS biggest, min(b) FILTER (WHERE hole = top) AS before_biggest FROM (SELECT *, coalesce(n - b - 1, 0) AS hole, max(coalesce(n - b - 1, 0)) OVER (PARTITION BY ticker, exchange) AS top FROM {GAPS}) GROUP BY 1, 2 HAVING sum(hole) > 0")
def gap_summary(spark, sf_dir):
    return series.gap_summary(bars(spark, sf_dir, QUARTER), QUARTER)


@query(f"SELECT * FROM (SELECT ticker, exchange, ts, lead(ts) OVER (PARTITION BY ticker, exchange ORDER BY ts) AS next_ts FROM {BARS(QUARTER)}) WHERE next_ts - ts > 1800")
def gap_tolerance(spark, sf_dir):
    return series.tolerant_gaps(bars(spark, sf_dir, QUARTER), 1800)


def FILL(most):
    return f"WITH g AS (SELECT *, coalesce(lead(ts // 900) OVER (PARTITION BY ticker, exchange ORDER BY ts) - ts // 900 - 1, 0) AS hole FROM {BARS(QUARTER)}), t AS (SELECT *, sum(hole) OVER (PARTITION BY ticker, exchange) AS total FROM g) SELECT ticker, exchange, ts, open, high, low, close, volume, false AS filled FROM t UNION ALL SELECT ticker, exchange, (b + 1) * 900, close, close, close, close, 0.0, true FROM (SELECT ticker, exchange, close, unnest(range(ts // 900, ts // 900 + hole)) AS b FROM t WHERE hole > 0 AND total <= {most})"


@query(FILL(5000))
def flat_fill(spark, sf_dir):
    return series.flat_fill(bars(spark, sf_dir, QUARTER), QUARTER, 5000)


@query(FILL(2000))
def flat_fill_guarded(spark, sf_dir):
    return series.flat_fill(bars(spark, sf_dir, QUARTER), QUARTER)


@query(f"SELECT ticker, exchange, ts, round(j, 6) AS jump_pct, ts // 86400 - pt // 86400 - 1 AS missing_between FROM (SELECT *, abs(open - pc) / pc * 100 AS j FROM (SELECT *, lag(close) OVER w AS pc, lag(ts) OVER w AS pt FROM {BARS(DAY)} WINDOW w AS (PARTITION BY ticker, exchange ORDER BY ts))) WHERE pc > 0 AND j >= 50")
def continuity_breaks(spark, sf_dir):
    return series.continuity(bars(spark, sf_dir), DAY, 50.0)


ROLL = f"WITH d AS (SELECT * FROM {BARS(DAY)} WHERE ts < {NOW} - 86400), q AS (SELECT *, max(ts) OVER (PARTITION BY ticker, exchange) // 86400 * 86400 AS day FROM {BARS(QUARTER)}), r0 AS (SELECT ticker, exchange, day AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(CAST(volume AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM q WHERE q.ts >= day GROUP BY ticker, exchange, day), n AS (SELECT ticker, exchange, max(ts) AS newest FROM d GROUP BY 1, 2), r AS (SELECT r0.* FROM r0 LEFT JOIN n ON r0.ticker = n.ticker AND r0.exchange = n.exchange WHERE newest IS NULL OR r0.ts >= newest) SELECT d.* FROM d LEFT JOIN r ON d.ticker = r.ticker AND d.exchange = r.exchange WHERE r.ts IS NULL OR d.ts < r.ts UNION ALL SELECT * FROM r"


@query(ROLL)
def daily_rollup(spark, sf_dir):
    return series.roll_up_day(bars(spark, sf_dir).where(F.col("ts") < NOW - DAY), bars(spark, sf_dir, QUARTER))


@query(f"SELECT * FROM {BARS(DAY)} WHERE ts >= {NOW} - 10 * 86400")
def retention(spark, sf_dir):
    return series.retain(bars(spark, sf_dir), NOW, 10)


@query(f"SELECT *, CASE WHEN bars < 7 THEN NULL WHEN least >= 20 THEN 'HIGH' ELSE 'LOW' END AS tier FROM (SELECT ticker, exchange, count(*) AS bars, min(coalesce(volume, 0) * coalesce(low, 0)) AS least FROM (SELECT * FROM {BARS(DAY)} WHERE ts <= {NOW} - 86400 QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) <= 7) GROUP BY 1, 2)")
def tier_assignment(spark, sf_dir):
    return liquidity.tier(bars(spark, sf_dir), NOW, DAY, 7, 20.0)


@query(f"SELECT ticker, exchange, CASE WHEN n < 27 THEN CASE WHEN exchange <> 'okx' THEN 'HIGH' END WHEN least >= 20 THEN 'HIGH' ELSE 'LOW' END AS tier FROM (SELECT ticker, exchange, count(*) AS n, min(coalesce(volume, 0) * coalesce(low, 0)) AS least FROM (SELECT * FROM {BARS(DAY)} WHERE ts <= {NOW} - 86400 QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) <= 27) GROUP BY 1, 2)")
def tier_kept(spark, sf_dir):
    """Pairs with too few bars keep their tier."""
    current = last_rows(spark, sf_dir).where("exchange <> 'okx'").select("ticker", "exchange", F.lit("HIGH").alias("tier"))
    return liquidity.tier(bars(spark, sf_dir), NOW, DAY, 27, 20.0, current).select("ticker", "exchange", "tier")


@query(f"SELECT ticker, exchange, round(min(volume * low), 2) AS min_volume_usd FROM (SELECT * FROM {BARS(DAY)} WHERE ts <= {NOW} - 86400 QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) <= 7) GROUP BY 1, 2")
def min7d_volume(spark, sf_dir):
    return liquidity.min_volume_usd(bars(spark, sf_dir), NOW, DAY)


WINDOW = 6 * 3600
STATS = f"(SELECT ticker, exchange, count(*) FILTER (WHERE t > {NOW}000000 - {WINDOW}000000) / {WINDOW / 60} AS tpm, coalesce(count(*) FILTER (WHERE side = 'buy') * 100.0 / nullif(count(*) FILTER (WHERE side IN ('buy', 'sell')), 0), 50.0) AS buy_pct, CAST(({NOW}000000 - max(t)) / 1e6 AS DOUBLE) AS last_trade_age, CAST(sum(signed) AS DOUBLE) AS cvd, CAST(coalesce(sum(signed) FILTER (WHERE t > {NOW}000000 - {WINDOW}000000), 0) AS DOUBLE) AS cvd_window, count(*) >= 30 AND count(DISTINCT nullif(value, 0)) <= 4 AS barcode FROM (SELECT *, CASE side WHEN 'buy' THEN CAST(value * value AS DECIMAL(18,4)) WHEN 'sell' THEN -CAST(value * value AS DECIMAL(18,4)) ELSE 0 END AS signed FROM (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' WHEN event_type = 'error' THEN 'sell' ELSE 'none' END AS side FROM {TAPE})) GROUP BY 1, 2)"


@query(f"SELECT * FROM {STATS}")
def tape_stats(spark, sf_dir):
    return liquidity.tape_stats(tape(spark, sf_dir), NOW * 1_000_000, WINDOW)


LEVELS = "(SELECT o_custkey AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN l_linenumber % 2 = 0 THEN 100 - l_discount * 10 - l_linenumber / 100.0 ELSE 100 + l_tax * 10 + l_linenumber / 100.0 END AS price, l_quantity AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def levels(spark, sf_dir):
    """Books by customer: order lines as bids and asks around 100."""
    line, order = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    bid = F.col("l_linenumber") % 2 == 0
    price = F.when(bid, 100 - F.col("l_discount") * 10 - F.col("l_linenumber") / 100.0).otherwise(100 + F.col("l_tax") * 10 + F.col("l_linenumber") / 100.0)
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("key"), F.when(bid, "bid").otherwise("ask").alias("side"), price.alias("price"), F.col("l_quantity").alias("amount"))


BOOK = f"(WITH l AS (SELECT * FROM {LEVELS}), best AS (SELECT key, max(price) FILTER (WHERE side = 'bid') AS bid, min(price) FILTER (WHERE side = 'ask') AS ask FROM l GROUP BY key), s AS (SELECT l.key, bid, ask, CAST(coalesce(sum(CAST(price * amount AS DECIMAL(24,4))) FILTER (WHERE abs(price - (bid + ask) / 2) <= (bid + ask) / 2 * 1.0 / 100 AND side = 'bid'), 0) AS DOUBLE) AS bid_usd, CAST(coalesce(sum(CAST(price * amount AS DECIMAL(24,4))) FILTER (WHERE abs(price - (bid + ask) / 2) <= (bid + ask) / 2 * 1.0 / 100 AND side = 'ask'), 0) AS DOUBLE) AS ask_usd FROM l JOIN best ON l.key = best.key GROUP BY 1, 2, 3) SELECT *, round(bid_usd + ask_usd, 4) AS total_usd, CASE WHEN ask_usd > 0 THEN round(bid_usd / ask_usd, 4) ELSE 99.0 END AS imbalance, round((ask - bid) / bid * 100, 6) AS spread_pct FROM s)"


@query(f"SELECT * FROM {BOOK}")
def orderbook_depth(spark, sf_dir):
    return liquidity.book(levels(spark, sf_dir))


@query(f"SELECT *, CASE WHEN score >= 8 THEN 'A' WHEN score >= 6 THEN 'B' WHEN score >= 4 THEN 'C' WHEN score >= 2 THEN 'D' ELSE 'F' END AS grade FROM (SELECT ticker, exchange, tpm, CASE WHEN barcode THEN 0.0 ELSE CASE WHEN t >= 120 THEN 4.0 WHEN t >= 45 THEN 3.0 WHEN t >= 15 THEN 2.0 WHEN t >= 3 THEN 1.0 ELSE 0.0 END + CASE WHEN abs(cvd) >= 50000 THEN 3.0 WHEN abs(cvd) >= 10000 THEN 2.0 WHEN abs(cvd) >= 1000 THEN 1.0 ELSE 0.0 END + CASE WHEN buy_pct / 100 < 0.1 THEN 3.0 WHEN buy_pct / 100 < 0.3 THEN 2.0 WHEN buy_pct / 100 < 1.0 THEN 1.0 ELSE 0.0 END END AS score FROM (SELECT *, tpm * 500 AS t FROM {STATS}))")
def vitality(spark, sf_dir):
    stats = tape_stats(spark, sf_dir).withColumn("raw", F.col("tpm")).withColumn("tpm", F.col("tpm") * 500)
    stats = stats.withColumn("total_depth_usd", F.abs("cvd")).withColumn("spread_pct", F.col("buy_pct") / 100)
    return liquidity.vitality(stats).select("ticker", "exchange", F.col("raw").alias("tpm"), "score", "grade")


@query(f"SELECT key, score, CASE WHEN score >= 8 THEN 'A' WHEN score >= 6 THEN 'B' WHEN score >= 4 THEN 'C' WHEN score >= 2 THEN 'D' ELSE 'F' END AS grade FROM (SELECT key, CASE WHEN key % 9 = 0 THEN 0.0 ELSE CASE WHEN key % 150 >= 120 THEN 4.0 WHEN key % 150 >= 45 THEN 3.0 WHEN key % 150 >= 15 THEN 2.0 WHEN key % 150 >= 3 THEN 1.0 ELSE 0.0 END + CASE WHEN total_usd >= 50000 THEN 3.0 WHEN total_usd >= 10000 THEN 2.0 WHEN total_usd >= 1000 THEN 1.0 ELSE 0.0 END + CASE WHEN spread_pct < 0.1 THEN 3.0 WHEN spread_pct < 0.3 THEN 2.0 WHEN spread_pct < 1.0 THEN 1.0 ELSE 0.0 END END AS score FROM {BOOK})")
def book_vitality(spark, sf_dir):
    """Scores of books by their own depth and spread; those with one side only have neither."""
    books = liquidity.book(levels(spark, sf_dir)).withColumnRenamed("total_usd", "total_depth_usd").withColumn("tpm", F.col("key") % 150).withColumn("barcode", F.col("key") % 9 == 0)
    return liquidity.vitality(books).select("key", "score", "grade")


@query(f"SELECT ticker, exchange, round(greatest(0.0, least(1.0, tpm * 200 / 120.0)), 6) AS tpm_score, round(CASE WHEN abs(cvd) > 0 THEN greatest(0.0, least(1.0, (log10(abs(cvd)) - log10(1000.0)) / (log10(50000.0) - log10(1000.0)))) ELSE 0.0 END, 6) AS depth_score, CASE WHEN buy_pct / 4 <= 5 THEN 1.0 WHEN buy_pct / 4 >= 15 THEN 0.0 ELSE round((15 - buy_pct / 4) / 10, 6) END AS spread_score FROM {STATS}")
def health_scores(spark, sf_dir):
    return tape_stats(spark, sf_dir).select("ticker", "exchange", F.round(S.score_tpm(F.col("tpm") * 200), 6).alias("tpm_score"), F.round(S.score_log(F.abs("cvd"), 1000.0, 50000.0), 6).alias("depth_score"), F.round(S.score_spread(F.col("buy_pct") / 4), 6).alias("spread_score"))


@query(f"SELECT exchange, {BASE} AS base, coalesce(max(ticker) FILTER (WHERE {PERP}), max(ticker) FILTER (WHERE NOT {PERP})) AS ticker FROM {BARS(DAY)} WHERE NOT regexp_matches(split_part(ticker, ':', 1), '(3L|3S|5L|5S|2L|2S|4L|4S|UP|DOWN|BULL|BEAR)/USDT$') GROUP BY 1, 2")
def perp_first(spark, sf_dir):
    return summary.perp_first(bars(spark, sf_dir).select("ticker", "exchange").distinct())


NAMES = "(SELECT p_partkey, upper(split_part(p_name, ' ', 1)) || CASE p_partkey % 9 WHEN 0 THEN '3L' WHEN 1 THEN 'UP' WHEN 2 THEN 'USD' WHEN 3 THEN 'STOCK' WHEN 4 THEN '_OLD' ELSE '' END || '/USDT' || CASE WHEN p_partkey % 2 = 0 THEN ':USDT' ELSE '' END AS symbol, CASE p_partkey % 3 WHEN 0 THEN 'bitget' WHEN 1 THEN 'bg' ELSE 'okex' END AS exchange FROM part)"


@query(rf"SELECT symbol, exchange, CASE exchange WHEN 'okex' THEN 'okx' WHEN 'bg' THEN 'bitget' ELSE exchange END AS canonical, lower(translate(symbol, '/-', '__')) || '_on_' || exchange AS table_name, (contains(b, 'USD') AND b <> 'USDT') OR regexp_matches(split_part(symbol, ':', 1), '(?i)(3L|3S|5L|5S|2L|2S|4L|4S|UP|DOWN|BULL|BEAR)/USDT$') OR b LIKE '%STOCK' OR b LIKE '$%' OR ends_with(b, '_OLD') OR (exchange IN ('bitget', 'bg') AND b LIKE 'R%' AND b NOT IN ('RARE', 'RAY', 'RAMP', 'RAU', 'RAVE', 'RNDR', 'RSR', 'RUNE', 'RVN', 'ROSE', 'REQ')) AS skip FROM (SELECT *, split_part(symbol, '/', 1) AS b FROM {NAMES})")
def skip_pairs(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    tail = F.element_at(F.array(*map(F.lit, ("3L", "UP", "USD", "STOCK", "_OLD", "", "", "", ""))), (F.col("p_partkey") % 9 + 1).cast("int"))
    symbol = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), tail, F.lit("/USDT"), F.when(F.col("p_partkey") % 2 == 0, ":USDT").otherwise(""))
    exchange = F.element_at(F.array(F.lit("bitget"), F.lit("bg"), F.lit("okex")), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = p.select(symbol.alias("symbol"), exchange.alias("exchange"))
    return p.select("symbol", "exchange", S.canonical_exchange(F.col("exchange")).alias("canonical"), S.table_name(F.col("symbol"), F.col("exchange")).alias("table_name"), S.skip_pair(F.col("symbol"), F.col("exchange")).alias("skip"))


LAST = f"(SELECT ticker, exchange, count(*) AS bars, max(ts) AS last_ts FROM {BARS(QUARTER)} GROUP BY 1, 2)"


def last_rows(spark, sf_dir):
    return bars(spark, sf_dir, QUARTER).groupBy("ticker", "exchange").agg(F.count(F.lit(1)).alias("bars"), F.max("ts").alias("last_ts"))


@query(f"SELECT ticker, exchange, ts FROM (SELECT *, last_ts AS ts, max(last_ts) FILTER (WHERE {PERP}) OVER (PARTITION BY exchange, {BASE}) AS p FROM {LAST}) WHERE {PERP} OR p IS NULL OR ts >= p - 3600")
def stale_spot(spark, sf_dir):
    return summary.drop_stale_spot(last_rows(spark, sf_dir).select("ticker", "exchange", F.col("last_ts").alias("ts")), 3600)


ZOMBIE = f"(SELECT p.base, p.exchange, p.bars AS perp_bars, s.ticker AS spot, s.bars AS spot_bars, CAST({NOW} - s.last_ts AS DOUBLE) AS idle, CASE WHEN s.bars >= p.bars THEN 'keep' WHEN {NOW} - s.last_ts < 7200 THEN 'keep' ELSE 'prune' END AS verdict FROM (SELECT *, {BASE} AS base FROM {LAST} WHERE {PERP}) p JOIN (SELECT *, {BASE} AS base FROM {LAST} WHERE NOT {PERP}) s ON p.base = s.base AND p.exchange = s.exchange)"


def _zombies(spark, sf_dir):
    plan = summary.zombie_plan(last_rows(spark, sf_dir), NOW)
    return plan.withColumn("verdict", S.zombie_verdict(F.col("spot_bars"), F.col("perp_bars"), F.col("idle"), 7200.0))


@query(f"SELECT * FROM {ZOMBIE}")
def zombie_plan(spark, sf_dir):
    return _zombies(spark, sf_dir)


@query(f"SELECT spot, exchange, gain, row_number() OVER (ORDER BY gain DESC, spot, exchange) AS place FROM (SELECT *, greatest(0, perp_bars - spot_bars) AS gain FROM {ZOMBIE} WHERE verdict = 'prune')")
def prune_order(spark, sf_dir):
    return summary.prune_order(_zombies(spark, sf_dir)).select("spot", "exchange", "gain", "place")


@query(f"SELECT verdict, count(*) AS n FROM {ZOMBIE} GROUP BY 1")
def verdict_counts(spark, sf_dir):
    return _zombies(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def PUMPS(low="close", peak="close", ratio=8.0):
    return f"""(WITH b AS (SELECT *, row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts) - 1 AS idx FROM {BARS(DAY)}),
m AS (SELECT *, min({low}) OVER (PARTITION BY ticker, exchange ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mn FROM b),
s AS (SELECT m.*, (SELECT min(c.idx) FROM b c WHERE c.ticker = m.ticker AND c.exchange = m.exchange AND c.idx BETWEEN m.idx - 4 AND m.idx AND c.{low} = m.mn) AS si FROM m),
r AS (SELECT *, CASE WHEN mn > 0 THEN {peak} / mn ELSE 0 END AS ratio FROM s),
h AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY ticker, exchange ORDER BY idx) <= 5 THEN 0 ELSE 1 END AS fresh FROM r WHERE ratio > {ratio}),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker, exchange ORDER BY idx) AS island FROM h),
e AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY ticker, exchange, island ORDER BY ratio DESC, idx) = 1)
SELECT e.ticker, e.exchange, split_part(e.ticker, '/', 1) AS base, e.ts AS peak_ts, st.ts AS start_ts, e.mn AS min_price, e.{peak} AS peak_price,
  (SELECT max(p.{peak}) FROM b p WHERE p.ticker = e.ticker AND p.exchange = e.exchange AND p.idx BETWEEN e.si - 5 AND e.si - 1) AS pre_max,
  round((e.ratio - 1) * 100, 6) AS pump_pct, (e.ts - st.ts) / 86400.0 AS span_days
FROM e JOIN b st ON st.ticker = e.ticker AND st.exchange = e.exchange AND st.idx = e.si)"""


def events(spark, sf_dir, scan=SCAN):
    return pumps.detect(bars(spark, sf_dir), scan)


@query(f"SELECT * FROM {PUMPS()}")
def pump_events(spark, sf_dir):
    return events(spark, sf_dir)


@query(f"SELECT * FROM {PUMPS('low', 'high')}")
def pump_high_low(spark, sf_dir):
    return events(spark, sf_dir, WICK)


@query(f"SELECT * FROM {PUMPS()} WHERE pre_max IS NULL OR pre_max < peak_price * 1.0")
def prepump_filter(spark, sf_dir):
    return pumps.prepump(events(spark, sf_dir), 1.0)


SUMMARY = "base, min(pump_pct) AS min_pump_pct, max(pump_pct) AS max_pump_pct, min(peak_ts) AS peak_ts_min, max(peak_ts) AS peak_ts_max, min(min_price) AS min_price, max(peak_price) AS peak_price, max(pre_max) AS pre_max, string_agg(DISTINCT exchange, ',' ORDER BY exchange) AS exchanges, count(DISTINCT exchange) AS n_exchanges"


@query(f"SELECT {SUMMARY} FROM (SELECT * FROM {PUMPS()} QUALIFY row_number() OVER (PARTITION BY base, exchange ORDER BY pump_pct DESC, peak_ts, ticker) = 1) GROUP BY base HAVING count(DISTINCT exchange) >= 2")
def coins_any(spark, sf_dir):
    return pumps.coins_any(events(spark, sf_dir), 2)


@query(f"WITH e AS (SELECT * FROM {PUMPS()}), n AS (SELECT base, exchange, max(peak_ts) AS newest FROM e GROUP BY 1, 2), c AS (SELECT {BASE} AS base, count(DISTINCT exchange) AS need FROM {BARS(DAY)} GROUP BY 1), md AS (SELECT n.base, list_sort(list(newest))[count(*) // 2 + 1] AS median FROM n GROUP BY n.base), ok AS (SELECT md.* FROM md JOIN c ON md.base = c.base WHERE (SELECT count(*) FROM n WHERE n.base = md.base) = need), near AS (SELECT e.* FROM e JOIN ok ON e.base = ok.base QUALIFY row_number() OVER (PARTITION BY e.base, exchange ORDER BY abs(peak_ts - median), peak_ts, ticker) = 1) SELECT {SUMMARY} FROM near GROUP BY base HAVING (max(peak_ts) - min(peak_ts)) / 86400.0 <= 10")
def coins_all(spark, sf_dir):
    catalog = bars(spark, sf_dir).select(S.base_of(F.col("ticker")).alias("base"), "exchange").distinct()
    return pumps.coins_all(events(spark, sf_dir), catalog, 10.0)


@query(f"SELECT base, peak_ts // 86400 AS day, max(pump_pct) AS pump_pct, count(DISTINCT exchange) AS width FROM {PUMPS()} GROUP BY 1, 2")
def pumps_by_day(spark, sf_dir):
    return pumps.by_day(events(spark, sf_dir))


DAYS = f"(SELECT base, peak_ts // 86400 AS day, max(pump_pct) AS pump_pct FROM {PUMPS()} GROUP BY 1, 2)"


@query(f"SELECT ticker, exchange, close, low, CASE WHEN close > 0 AND low > 0 THEN round((close - low) / low * 100, 6) END AS growth_pct FROM (SELECT ticker, exchange, arg_max(close, ts) AS close, min(low) FILTER (WHERE ts >= {NOW} - 864000) AS low FROM {BARS(DAY)} GROUP BY 1, 2)")
def growth(spark, sf_dir):
    return summary.growth(bars(spark, sf_dir), NOW, 10)


@query(f"WITH b AS (SELECT ticker, exchange, ts FROM {BARS(DAY)}), e AS (SELECT ticker, exchange, t // 1000000 AS sec, t, value, event_id FROM {TAPE} WHERE event_type = 'purchase'), j AS (SELECT e.ticker, e.exchange, e.sec, e.t, e.value, b.ts FROM e ASOF JOIN b ON e.ticker = b.ticker AND e.exchange = b.exchange AND e.sec >= b.ts) SELECT ticker, exchange, ts, arg_max(value, t) AS rate, max(sec) AS event_ts FROM j GROUP BY 1, 2, 3")
def funding_asof(spark, sf_dir):
    t = tape(spark, sf_dir).where(F.col("ticker").startswith("PURCHASE"))
    return funding.asof_last(bars(spark, sf_dir), t.select("ticker", "exchange", F.floor(F.col("t") / 1_000_000).cast("long").alias("ts"), F.col("price").alias("rate"), "event_id"))


@query(f"WITH new AS (SELECT * FROM {LAST} WHERE exchange <> 'okx'), old AS (SELECT ticker, exchange, bars - 1 AS bars, last_ts FROM {LAST}) SELECT * FROM new UNION ALL SELECT * FROM old WHERE exchange = 'okx'")
def carry_merge(spark, sf_dir):
    rows = last_rows(spark, sf_dir)
    return summary.carry(rows.withColumn("bars", F.col("bars") - 1), rows.where("exchange <> 'okx'"), ["ticker", "exchange"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, s_acctbal, NULL FROM supplier")
def union_text_cast(spark, sf_dir):
    c, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    one = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    two = s.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return summary.union_stable([one, two])


@query(f"SELECT exchange, count(*) AS tables, count(*) FILTER (WHERE {PERP}) AS perps, CAST(sum(bars) AS BIGINT) AS bars, max(last_ts) AS newest FROM {LAST} GROUP BY 1")
def summary_counts(spark, sf_dir):
    return last_rows(spark, sf_dir).groupBy("exchange").agg(F.count(F.lit(1)).alias("tables"), F.count_if(S.is_perp(F.col("ticker"))).alias("perps"), F.sum("bars").alias("bars"), F.max("last_ts").alias("newest"))


def _with_empty(rows):
    """One pair without bars beside the stored ones."""
    return rows.unionByName(rows.sparkSession.sql("SELECT 'EMPTY/USDT' AS ticker, 'okx' AS exchange, 0L AS bars, CAST(NULL AS LONG) AS last_ts"))


@query(f"SELECT ticker, exchange, CASE WHEN hole <= 20 THEN last_ts - 900 ELSE {NOW} - 3600 END AS since, CASE WHEN hole <= 20 THEN hole + 4 ELSE 5 END AS want FROM (SELECT *, greatest(0, ({NOW} - last_ts) // 900) AS hole FROM {LAST}) UNION ALL SELECT 'EMPTY/USDT', 'okx', {NOW} - 3600, 5")
def lane_anchor(spark, sf_dir):
    since, want = candles.lane_start(F.col("last_ts"), NOW, QUARTER, most=20)
    return _with_empty(last_rows(spark, sf_dir)).select("ticker", "exchange", since.alias("since"), want.alias("want"))


PAGE_FLOOR = NOW - 20 * DAY


@query(f"SELECT ticker, exchange, coalesce(oldest > {PAGE_FLOOR} + 1800, false) AS needed, CASE WHEN f < oldest OR f IS NULL THEN CASE WHEN since < oldest * 1000 THEN since END END AS since_ms FROM (SELECT *, greatest(oldest * 1000 - 300 * 900000, f * 1000, CAST({PAGE_FLOOR} AS BIGINT) * 1000) AS since FROM (SELECT *, CASE exchange WHEN 'gateio' THEN CAST({NOW} - 9900 * 900 AS BIGINT) END AS f FROM (SELECT ticker, exchange, min(ts) + (CASE WHEN exchange = 'okx' THEN 864000 ELSE 0 END) AS oldest FROM {BARS(QUARTER)} GROUP BY 1, 2)))")
def prefill_plan(spark, sf_dir):
    b = bars(spark, sf_dir, QUARTER).groupBy("ticker", "exchange").agg(F.min("ts").alias("oldest"))
    b = b.withColumn("oldest", F.col("oldest") + F.when(F.col("exchange") == "okx", 864_000).otherwise(0))
    floor = S.lookback_floor(F.col("exchange"), NOW, QUARTER)
    return b.select("ticker", "exchange", candles.prefill_needed(F.col("oldest"), PAGE_FLOOR).alias("needed"), candles.prefill_since(F.col("oldest"), QUARTER, 300, floor, PAGE_FLOOR).alias("since_ms"))


WATCH = f"(SELECT ticker, exchange, last_ts AS updated, CASE WHEN bars % 3 <> 0 THEN last_ts - 1000 END AS served, CASE WHEN bars % 2 = 0 THEN last_ts - 500 END AS served_15m, CAST(NULL AS BIGINT) AS served_1d FROM {LAST})"


@query(f"SELECT count(*) AS watched, count(*) FILTER (WHERE served > {NOW} - 7200) AS served, {NOW} - max(served) AS idle, count(*) FILTER (WHERE served_15m > {NOW} - 7200) AS served_15m, count(*) FILTER (WHERE served_1d > {NOW} - 7200) AS served_1d, {NOW} - max(served_15m) AS idle_15m, {NOW} - max(served_1d) AS idle_1d FROM {WATCH} WHERE updated > {NOW} - 20000")
def lane_pulse(spark, sf_dir):
    last = last_rows(spark, sf_dir)
    watch = last.select("ticker", "exchange", F.col("last_ts").alias("updated"), F.when(F.col("bars") % 3 != 0, F.col("last_ts") - 1000).alias("served"), F.when(F.col("bars") % 2 == 0, F.col("last_ts") - 500).alias("served_15m"), F.lit(None).cast("long").alias("served_1d"))
    return candles.pulse(watch, NOW, 7200, 20_000)


# fixed values: trading addresses of the exchanges that occur here, as SQL
SPOT_SQL = "CASE exchange WHEN 'bybit' THEN 'https://www.bybit.com/trade/spot/' || upper(base) || '/USDT' WHEN 'gateio' THEN 'https://www.gate.io/trade/' || upper(base) || '_USDT' WHEN 'okx' THEN 'https://www.okx.com/en/trade-spot/' || lower(base) || '-usdt' WHEN 'bitget' THEN 'https://www.bitget.com/en/spot/' || upper(base) || 'USDT_SPBL?type=spot' ELSE '' END"
SWAP_SQL = "CASE exchange WHEN 'bybit' THEN 'https://www.bybit.com/trade/usdt/' || upper(base) || 'USDT' WHEN 'gateio' THEN 'https://www.gate.com/futures/USDT/' || upper(base) || '_USDT' WHEN 'okx' THEN 'https://www.okx.com/en/trade-swap/' || lower(base) || '-usdt-swap' WHEN 'bitget' THEN 'https://www.bitget.com/en/futures/usdt/' || upper(base) || 'USDT' ELSE '' END"
SCAN_SPOT_SQL = "CASE exchange WHEN 'bybit' THEN 'https://www.bybit.com/ru-RU/trade/spot/' || upper(base) || '/USDT' WHEN 'gateio' THEN 'https://www.gate.io/trade/' || upper(base) || '_USDT' WHEN 'okx' THEN 'https://www.okx.com/ru/trade-spot/' || lower(base) || '-usdt' WHEN 'bitget' THEN 'https://www.bitget.com/ru/spot/' || upper(base) || 'USDT_SPBL?type=spot' ELSE '' END"
SCAN_SWAP_SQL = "CASE exchange WHEN 'bybit' THEN 'https://www.bybit.com/trade/usdt/' || upper(base) || 'USDT' WHEN 'gateio' THEN 'https://www.gate.io/futures_trade/USDT/' || upper(base) || '_USDT' WHEN 'okx' THEN 'https://www.okx.com/ru/trade-swap/' || lower(base) || '-usdt-swap' WHEN 'bitget' THEN 'https://www.bitget.com/ru/futures/usdt/' || upper(base) || 'USDT' ELSE '' END"


PLACES = f"(SELECT DISTINCT {BASE} AS base, CASE WHEN exchange = 'gateio' THEN 'bitget' WHEN exchange = 'okx' THEN 'elsewhere' ELSE exchange END AS exchange FROM {TAPE} UNION SELECT DISTINCT {BASE}, exchange FROM {TAPE})"


@query(f"SELECT exchange, base, {SPOT_SQL} AS spot, {SWAP_SQL} AS swap, {SCAN_SPOT_SQL} AS scan_spot, {SCAN_SWAP_SQL} AS scan_swap FROM {PLACES}")
def pair_urls(spark, sf_dir):
    e = F.col("exchange")
    one = tape(spark, sf_dir).select(S.base_of(F.col("ticker")).alias("base"), "exchange").distinct()
    rows = one.unionByName(one.withColumn("exchange", F.when(e == "gateio", "bitget").when(e == "okx", "elsewhere").otherwise(e))).distinct()
    made = lambda templates, aliases=False: D.url(e, F.col("base"), F.lit("USDT"), templates, aliases)
    return rows.select("exchange", "base", made(D.SPOT).alias("spot"), made(D.SWAP).alias("swap"), made(D.SCAN_SPOT, True).alias("scan_spot"), made(D.SCAN_SWAP, True).alias("scan_swap"))


def _usd_sql(v):
    return f"CASE WHEN {v} IS NULL THEN '—' WHEN abs({v}) >= 1e6 THEN printf('%.2fM$', round({v} / 1e6, 2)) WHEN abs({v}) >= 1e3 THEN printf('%.1fk$', round({v} / 1e3, 1)) ELSE printf('%.0f$', round({v}, 0)) END"


def _compact_sql(v):
    return f"CASE WHEN {v} IS NULL THEN 'n/a' WHEN {v} >= 1e6 THEN printf('$%.1fM', round({v} / 1e6, 1)) WHEN {v} >= 1e3 THEN printf('$%.0fK', round({v} / 1e3, 0)) ELSE printf('$%.0f', round({v}, 0)) END"


SHOWN = "(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice * (o_orderkey % 20) END AS v, o_orderkey % 9000 AS seconds FROM orders)"


@query(f"SELECT o_orderkey, {_usd_sql('v')} AS usd, {_compact_sql('v')} AS compact, CASE WHEN v IS NULL THEN '–' ELSE printf('%.10g', v / 977) END AS price, CASE WHEN seconds >= 3600 THEN printf('%dh%02dm', seconds // 3600, seconds % 3600 // 60) ELSE printf('%dm%02ds', seconds // 60, seconds % 60) END AS eta, strftime(make_timestamp((1700000000 + seconds * 977 + 10800) * 1000000), '%Y-%m-%d %H:%M') AS stamp FROM {SHOWN}")
def shown_values(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") * (F.col("o_orderkey") % 20))
    seconds = F.col("o_orderkey") % 9000
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select("o_orderkey", D.usd(v).alias("usd"), D.usd_compact(v).alias("compact"), D.price(v / 977).alias("price"), D.eta(seconds.cast("double")).alias("eta"), D.stamp(1700000000 + seconds * 977, 3).alias("stamp"))


@query(f"SELECT ticker, exchange, count(*) AS n, min(ts) AS first_ts, arg_max(close, ts) AS last_close, round(sum(open), 2) AS opens, round(sum(high), 2) AS highs, round(sum(low), 2) AS lows, round(sum(close), 2) AS closes, count(*) FILTER (WHERE close >= open) AS ups, round(sum(volume), 2) AS volume FROM {BARS(QUARTER)} GROUP BY 1, 2")
def compact_candles(spark, sf_dir):
    made = lanes.compact_series(bars(spark, sf_dir, QUARTER))
    total = lambda i, of="candles": F.round(F.aggregate(of, F.lit(0.0), lambda a, x: a + x[i]), 2)
    return made.select(
        "ticker", "exchange", F.size("candles").cast("long").alias("n"), F.col("candles")[0][0].cast("long").alias("first_ts"), F.element_at(F.element_at("candles", -1), 5).alias("last_close"),
        *(total(i).alias(x) for i, x in enumerate(("opens", "highs", "lows", "closes"), 1)), F.size(F.filter("volumes", lambda x: x[2] > 0)).cast("long").alias("ups"), total(1, "volumes").alias("volume"),
    )


AGED = f"(SELECT exchange, ticker AS symbol, -max(t) AS place, ({NOW} - max(t) // 1000000) AS age FROM {TAPE} GROUP BY 1, 2)"


def _aged(spark, sf_dir):
    newest = F.max("t")
    return tape(spark, sf_dir).groupBy("exchange", F.col("ticker").alias("symbol")).agg((-newest).alias("place"), (F.lit(NOW) - F.floor(newest / 1_000_000)).alias("age"))


@query(f"SELECT exchange, symbol, age FROM {AGED} WHERE age <= 36000 ORDER BY place, exchange, symbol LIMIT 12")
def fresh_pairs(spark, sf_dir):
    return lanes.fresh(lanes.published(_aged(spark, sf_dir), 1000).join(_aged(spark, sf_dir).select("exchange", "symbol", "age"), ["exchange", "symbol"]), 36000.0).select("exchange", "symbol", "age")


@query(f"SELECT exchange, symbol FROM {AGED} WHERE age >= 7200 OR exchange = 'okx'")
def due_pairs(spark, sf_dir):
    rows = _aged(spark, sf_dir)
    ran = rows.where("exchange <> 'okx'").select("exchange", "symbol", (F.lit(NOW) - F.col("age")).alias("ran"))
    return lanes.due(rows, ran, ["exchange", "symbol"], NOW, 7200).select("exchange", "symbol")


@query(f"SELECT event_id, t // 1000000 AS ts, value FROM {TAPE} WHERE event_type <> 'error' AND event_id % 5 <> 0 AND t // 1000000 <= {NOW} - 864000 + 900")
def metric_points(spark, sf_dir):
    odd = F.col("event_id") % 5
    value = F.when(~F.col("ticker").startswith("ERROR"), F.col("price"))
    ts = F.when(odd == 0, 400_000_000).when(odd == 1, F.floor(F.col("t") / 1000)).otherwise(F.floor(F.col("t") / 1_000_000))
    return lanes.metric_points(tape(spark, sf_dir).select("event_id", ts.alias("ts"), value.alias("value")), NOW - 864_000)


@query(f"WITH b AS (SELECT * FROM {BARS(QUARTER)}), o AS (SELECT ticker, exchange, max(ts) - 864000 AS oldest FROM b GROUP BY 1, 2) SELECT b.ticker, b.exchange, ts, close * 2 AS close FROM b JOIN o ON b.ticker = o.ticker AND b.exchange = o.exchange WHERE ts >= {NOW} - 20 * 86400 AND ts < oldest")
def prefill_slice(spark, sf_dir):
    b = bars(spark, sf_dir, QUARTER)
    twice = b.withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2)))).select("ticker", "exchange", "ts", "arrival", (F.col("close") * F.col("arrival")).alias("close"))
    return lanes.older_slice(twice, b.groupBy("ticker", "exchange").agg((F.max("ts") - 864_000).alias("oldest")), NOW - 20 * DAY)


@query(f"SELECT b.ticker, b.exchange, b.ts, CASE WHEN row_number() OVER (PARTITION BY b.ticker, b.exchange ORDER BY b.ts DESC) <= 2 THEN s.n END AS n FROM {BARS(QUARTER)} b LEFT JOIN (SELECT ticker, exchange, count(*) AS n FROM {TAPE} WHERE exchange <> 'okx' GROUP BY 1, 2) s ON b.ticker = s.ticker AND b.exchange = s.exchange")
def snapshot_rows(spark, sf_dir):
    snapshot = tape(spark, sf_dir).where("exchange <> 'okx'").groupBy("ticker", "exchange").agg(F.count(F.lit(1)).alias("n"))
    return lanes.with_snapshot(bars(spark, sf_dir, QUARTER), snapshot, ["n"]).select("ticker", "exchange", "ts", "n")


@query("WITH g AS (SELECT epoch_us(ts) // 86400000000 AS ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'money' WHEN event_type = 'error' THEN 'trouble' ELSE event_type END AS family, CAST(sum(user_id) AS BIGINT) AS rss_kb, CAST(sum(event_id % 10) AS BIGINT) AS swap_kb, count(*) AS pids FROM events GROUP BY 1, 2) SELECT *, rss_kb - lag(rss_kb) OVER w AS d_rss_kb, swap_kb - lag(swap_kb) OVER w AS d_swap_kb FROM g WINDOW w AS (PARTITION BY family ORDER BY ts)")
def process_families(spark, sf_dir):
    name = lanes.family(F.col("event_type"), F.col("event_type"), {"money": ["purchase", "signup"], "trouble": ["err"]})
    rows = tables.events(spark, sf_dir).select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("ts"), name.alias("family"), F.col("user_id").alias("rss_kb"), (F.col("event_id") % 10).alias("swap_kb"))
    return lanes.family_usage(rows)


@query(f"WITH h AS (SELECT count(*) AS bars FROM {BARS(DAY)} GROUP BY ticker, exchange) SELECT CASE WHEN bars < 28 THEN 'too_short' ELSE 'scanned' END AS reason, count(*) AS n FROM h GROUP BY 1 UNION ALL SELECT CASE WHEN base = 'SIGNUP' OR peak_ts < {NOW} - 25 * 86400 THEN 'data_sanity' WHEN pre_max >= peak_price * 0.9 THEN 'prepump' WHEN ({NOW} - peak_ts) / 86400.0 > 14 THEN 'age' ELSE 'kept' END, count(*) FROM {PUMPS()} GROUP BY 1")
def scan_funnel(spark, sf_dir):
    reason = lanes.scan_reason(F.col("base") == "SIGNUP", NOW, 0.9, 14.0, NOW - 25 * DAY)
    histories = bars(spark, sf_dir).groupBy("ticker", "exchange").agg(F.count(F.lit(1)).alias("bars"))
    return lanes.funnel(histories, events(spark, sf_dir).withColumn("reason", reason), 28)
