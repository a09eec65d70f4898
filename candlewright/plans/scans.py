"""Queries of a scan's selection, gates, reports and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lanes, pumps, statistics
from ..storage import materialise
from . import catalog as C
from .catalog import BARS, BASE, DAY, NOW, PUMPS, SCAN, SUMMARY, bars, events
from .registry import query

LEVELS = (4.0, 8.0, 12.0, 20.0)
ONE = f"(SELECT base, peak_ts // 86400 AS day, max(peak_ts) AS peak_ts, max(pump_pct) AS pump_pct FROM {PUMPS()} GROUP BY 1, 2)"
MONTH = "strftime(make_timestamp(day * 86400000000), '%Y-%m')"


def pump_days(spark, sf_dir):
    return statistics.unique_pumps(events(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT {t} AS threshold, count(*) AS n, count(DISTINCT base) AS coins FROM {PUMPS(ratio=t)}" for t in LEVELS))
def pump_thresholds(spark, sf_dir):
    return pumps.detect_at(bars(spark, sf_dir), SCAN, LEVELS).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("base").alias("coins"))


EACH = " UNION ALL ".join(f"SELECT {t} AS threshold, base, peak_ts // 86400 AS day FROM {PUMPS(ratio=t)}" for t in LEVELS)


@query(f"WITH e AS (SELECT DISTINCT * FROM ({EACH})), r AS (SELECT threshold, count(*) AS n, count(DISTINCT base) AS coins, max(day) - min(day) + 1 AS days FROM e GROUP BY 1) SELECT threshold, n, coins, days, n / coins AS a_coin, n / days AS a_day, n / (days / 30.44) AS a_month, n / (SELECT n FROM r WHERE threshold = 8) AS times_main FROM r")
def threshold_comparison(spark, sf_dir):
    return statistics.thresholds(pumps.detect_at(bars(spark, sf_dir), SCAN, LEVELS), 8.0)


@query(f"SELECT {MONTH} AS month, {', '.join(f'count(*) FILTER (WHERE threshold = {t}) AS over_{t:g}' for t in LEVELS)} FROM (SELECT DISTINCT * FROM ({EACH})) GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def months_by_threshold(spark, sf_dir):
    return statistics.months_by_threshold(pumps.detect_at(bars(spark, sf_dir), SCAN, LEVELS), list(LEVELS))


@query(f"SELECT {MONTH} AS month, count(*) AS n FROM {ONE} GROUP BY 1")
def pumps_by_month(spark, sf_dir):
    return statistics.by_month(pump_days(spark, sf_dir))


@query(f"SELECT {MONTH} AS month, count(*) AS n FROM {ONE} GROUP BY 1 ORDER BY n DESC, month LIMIT 8")
def top_months(spark, sf_dir):
    return statistics.top_months(pump_days(spark, sf_dir))


@query(f"SELECT times, count(*) AS coins FROM (SELECT base, count(*) AS times FROM {ONE} GROUP BY 1) GROUP BY 1")
def pumps_per_coin(spark, sf_dir):
    return statistics.per_coin(pump_days(spark, sf_dir))


@query(f"SELECT CAST((day + 3) % 7 AS INTEGER) AS weekday, count(*) AS n FROM {ONE} GROUP BY 1")
def pump_by_weekday(spark, sf_dir):
    return statistics.by_weekday(pump_days(spark, sf_dir))


@query(f"SELECT CASE WHEN age <= 7 THEN '<=7' WHEN age <= 14 THEN '<=14' WHEN age <= 21 THEN '<=21' ELSE '>21' END AS age, count(*) AS n FROM (SELECT ({NOW} - peak_ts) / 86400.0 AS age FROM {ONE}) GROUP BY 1")
def pump_age_buckets(spark, sf_dir):
    return statistics.by_age(pump_days(spark, sf_dir), NOW, (7, 14, 21))


@query(f"SELECT *, n / coins AS a_coin, n / days AS a_day, n / (days / 30.44) AS a_month FROM (SELECT count(*) AS n, count(DISTINCT base) AS coins, max(day) - min(day) + 1 AS days FROM {ONE})")
def pump_rates(spark, sf_dir):
    return statistics.rates(pump_days(spark, sf_dir))


@query(f"SELECT count(*) AS n, count(DISTINCT base) AS coins, min(pump_pct) AS least, {', '.join(f'quantile_cont(pump_pct, {q}) AS p{round(q * 100)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))}, max(pump_pct) AS most FROM {ONE}")
def pump_size_percentiles(spark, sf_dir):
    return statistics.size_quantiles(pump_days(spark, sf_dir))


EDGES = "(SELECT row_number() OVER (ORDER BY low) - 1 AS bucket, low, lead(low) OVER (ORDER BY low) AS high FROM (SELECT CAST(100 + 10 * i AS DOUBLE) AS low FROM range(0, 41) t(i) UNION ALL SELECT 500 * pow(1.5, i) FROM range(1, 11) t(i) UNION ALL SELECT 30000.0))"


@query(f"WITH h AS (SELECT bucket, low, high, count(base) AS n FROM {EDGES} LEFT JOIN {ONE} ON pump_pct >= low AND (high IS NULL OR pump_pct < high) GROUP BY 1, 2, 3), t AS (SELECT count(*) AS total FROM {ONE}) SELECT bucket, low, high, n, n / total * 100 AS percent, sum(n) OVER (ORDER BY bucket) / total * 100 AS cumulative FROM h, t")
def pump_size_hist(spark, sf_dir):
    return statistics.size_histogram(pump_days(spark, sf_dir))


KEYS = "SELECT DISTINCT base, peak_ts // 86400 AS day FROM "


def sides(spark, sf_dir):
    """Pumps by closes and by lows and highs: one scan of the bars, whose few pumps are kept."""
    both = materialise(pumps.detect_sources(bars(spark, sf_dir), SCAN), "pumps-by-source")
    return tuple(both.where(F.col("source") == x).drop("source") for x in ("close", "high_low"))


def _keys(df):
    return df.select("base", F.floor(F.col("peak_ts") / 86400).alias("day"))


@query(f"{KEYS}{PUMPS()} INTERSECT {KEYS}{PUMPS('low', 'high')}")
def source_intersect(spark, sf_dir):
    main, other = sides(spark, sf_dir)
    return _keys(main).intersect(_keys(other))


@query(f"{KEYS}{PUMPS('low', 'high')} EXCEPT {KEYS}{PUMPS()}")
def source_except(spark, sf_dir):
    main, other = sides(spark, sf_dir)
    return _keys(other).subtract(_keys(main))


SIDES = f"(SELECT 'main' AS source, * FROM {PUMPS()} UNION ALL SELECT 'other', * FROM {PUMPS('low', 'high')})"


@query(f"SELECT source, count(*) AS n, count(DISTINCT base) AS coins, median(pct) AS median_pct, CAST(sum(k) AS BIGINT) AS events FROM (SELECT source, base, peak_ts // 86400 AS day, max(pump_pct) AS pct, count(*) AS k FROM {SIDES} GROUP BY 1, 2, 3) GROUP BY 1")
def source_comparison(spark, sf_dir):
    return statistics.sources(*sides(spark, sf_dir))


@query(f"WITH m AS ({KEYS}{PUMPS()}), o AS ({KEYS}{PUMPS('low', 'high')}), c AS (SELECT * FROM m INTERSECT SELECT * FROM o), a AS (SELECT * FROM m EXCEPT SELECT * FROM o), b AS (SELECT * FROM o EXCEPT SELECT * FROM m) SELECT (SELECT count(*) FROM c) AS common, (SELECT count(DISTINCT base) FROM c) AS common_coins, (SELECT count(*) FROM a) AS only_main, (SELECT count(DISTINCT base) FROM a WHERE base NOT IN (SELECT base FROM c)) AS only_main_coins, (SELECT count(*) FROM b) AS only_other, (SELECT count(DISTINCT base) FROM b WHERE base NOT IN (SELECT base FROM c)) AS only_other_coins")
def source_overlap(spark, sf_dir):
    return statistics.source_overlap(*sides(spark, sf_dir))


@query(f"WITH c AS ({KEYS}{PUMPS()}), w AS ({KEYS}{PUMPS('low', 'high')}) SELECT w.base, w.day, count(*) AS near FROM w JOIN c ON w.base = c.base AND abs(w.day - c.day) <= 3 GROUP BY 1, 2")
def wick_nearby(spark, sf_dir):
    main, other = sides(spark, sf_dir)
    w, c = _keys(other).distinct(), _keys(main).distinct().withColumnRenamed("day", "other")
    return w.join(c, "base").where(F.abs(F.col("day") - F.col("other")) <= 3).groupBy("base", "day").agg(F.count(F.lit(1)).alias("near"))


@query(f"WITH m AS (SELECT base, peak_ts // 86400 AS day, max(pump_pct) AS pct FROM {PUMPS()} GROUP BY 1, 2), w AS (SELECT base, peak_ts // 86400 AS day, max(pump_pct) AS pump_pct, max(exchange) FILTER (WHERE pump_pct = top) AS exchange FROM (SELECT *, max(pump_pct) OVER (PARTITION BY base, peak_ts // 86400) AS top FROM {PUMPS('low', 'high')}) GROUP BY 1, 2), x AS (SELECT w.* FROM w LEFT JOIN m ON w.base = m.base AND w.day = m.day WHERE m.day IS NULL ORDER BY pump_pct DESC, base, day LIMIT 25) SELECT x.base, x.day, x.exchange, x.pump_pct, max(m.pct) AS close_pct FROM x LEFT JOIN m ON x.base = m.base AND abs(m.day - x.day) <= 3 GROUP BY 1, 2, 3, 4".replace("w.base, w.day", "w.base, w.day"))
def top_wicks(spark, sf_dir):
    return statistics.top_wicks(*sides(spark, sf_dir))


SHARED = f"(SELECT *, count(*) OVER (PARTITION BY base, day) AS width, max(own) OVER (PARTITION BY base, day) AS pct FROM (SELECT base, peak_ts // 86400 AS day, exchange, max(pump_pct) AS own FROM {PUMPS()} GROUP BY 1, 2, 3))"


def shared(spark, sf_dir):
    return statistics.shared_pumps(events(spark, sf_dir))


STATS = f"(SELECT exchange, count(*) AS pumps, count(*) FILTER (WHERE width = 1) AS solo, count(*) FILTER (WHERE width > 1) AS shared, list_sort(list(pct))[count(*) // 2 + 1] AS median_pct, count(*) / (SELECT count(*) FROM {ONE}) * 100 AS share_pct FROM {SHARED} GROUP BY 1)"


@query(f"SELECT * FROM {STATS}")
def exchange_stats(spark, sf_dir):
    return statistics.exchanges(shared(spark, sf_dir))


@query(f"SELECT (SELECT exchange FROM {STATS} ORDER BY pumps DESC, exchange LIMIT 1) AS most_pumps, (SELECT max(pumps) FROM {STATS}) AS pumps, (SELECT exchange FROM {STATS} ORDER BY solo DESC, exchange LIMIT 1) AS most_solo, (SELECT max(solo) FROM {STATS}) AS solo")
def best_exchanges(spark, sf_dir):
    return statistics.best_exchanges(statistics.exchanges(shared(spark, sf_dir)))


@query(f"SELECT width, count(*) AS pumps FROM (SELECT DISTINCT base, day, width FROM {SHARED}) GROUP BY 1")
def exchange_widths(spark, sf_dir):
    return statistics.widths(shared(spark, sf_dir))


PAIRS = f"(SELECT a.exchange AS one, b.exchange AS two, count(*) AS n FROM {SHARED} a JOIN {SHARED} b ON a.base = b.base AND a.day = b.day AND a.exchange < b.exchange GROUP BY 1, 2)"


@query(f"SELECT * FROM {PAIRS}")
def exchange_pairs(spark, sf_dir):
    return statistics.exchange_pairs(shared(spark, sf_dir))


@query(f"SELECT * FROM {PAIRS} ORDER BY n DESC, one, two LIMIT 2")
def top_exchange_pairs(spark, sf_dir):
    return statistics.exchange_pairs(shared(spark, sf_dir), 2)


HISTORY = f"(SELECT ticker, exchange, count(*) - CASE WHEN exchange = 'okx' THEN 25 ELSE 0 END AS bars FROM {BARS(DAY)} GROUP BY 1, 2)"


def histories(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("ticker", "exchange").agg((F.count(F.lit(1)) - F.when(F.col("exchange") == "okx", 25).otherwise(0)).alias("bars"))


TOP = f"(SELECT * FROM {PUMPS()} QUALIFY row_number() OVER (PARTITION BY base, exchange ORDER BY pump_pct DESC, peak_ts, ticker) = 1)"


@query(f"SELECT {SUMMARY.replace('min(', 'min(e.').replace('max(', 'max(e.').replace('base,', 'e.base,', 1).replace('DISTINCT exchange', 'DISTINCT e.exchange').replace('ORDER BY exchange', 'ORDER BY e.exchange')}, bool_or(h.bars < 10) AS short_history, string_agg(e.exchange || ':' || e.ticker || ':' || e.peak_ts, ' ' ORDER BY e.exchange, e.ticker) AS events, (max(e.peak_ts) - min(e.peak_ts)) / 86400.0 AS align_span_days, ({NOW} - max(e.peak_ts)) / 86400.0 AS age_days FROM {TOP} e JOIN {HISTORY} h ON e.ticker = h.ticker AND e.exchange = h.exchange GROUP BY e.base")
def coin_report(spark, sf_dir):
    top = pumps.with_history(pumps.strongest(events(spark, sf_dir)), histories(spark, sf_dir), SCAN)
    listed = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e.exchange, e.ticker, e.peak_ts)), " ")
    return pumps.report(top, NOW).withColumn("events", listed)


@query(f"SELECT ticker, exchange, peak_ts, ({NOW} - peak_ts) / 86400.0 AS age_days FROM {PUMPS()} WHERE ({NOW} - peak_ts) / 86400.0 <= 14")
def pump_ages(spark, sf_dir):
    return pumps.aged(events(spark, sf_dir), NOW).where("age_days <= 14").select("ticker", "exchange", "peak_ts", "age_days")


@query(f"SELECT ticker, exchange, bars, bars >= 10 AS full, bars >= 10 OR bars >= 4 AS with_short FROM {HISTORY}")
def history_lengths(spark, sf_dir):
    n, scan = F.col("bars"), pumps.Scan.of(700.0, 5, 1, 5, 5, short_days=4)
    return histories(spark, sf_dir).select("ticker", "exchange", "bars", pumps.long_enough(n, scan).alias("full"), pumps.long_enough(n, scan, True).alias("with_short"))


@query(f"SELECT ticker, exchange, ts, close FROM {BARS(DAY)} b WHERE ts < (SELECT max(ts) FROM {BARS(DAY)} m WHERE m.ticker = b.ticker AND m.exchange = b.exchange) OR ts + 86400 <= {NOW} - 3600")
def finished_bars(spark, sf_dir):
    return pumps.finished(bars(spark, sf_dir), NOW - 3600, DAY).select("ticker", "exchange", "ts", "close")


BOOKED = f"(SELECT ticker, exchange, ts // 86400 AS ts, CASE (ts // 86400 + length(ticker)) % 6 WHEN 0 THEN 'A' WHEN 1 THEN ' b' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN '' END AS grade, CASE WHEN exchange <> 'gateio' OR {BASE} <> 'ERROR' THEN 5.0 END AS score FROM {BARS(DAY)} WHERE exchange <> 'okx' AND ts // 86400 % 4 <> length(ticker) % 4)"


def _booked(spark, sf_dir):
    d, n = F.floor(F.col("ts") / 86400), F.length("ticker")
    k = (d + n) % 6
    grade = F.when(k == 0, "A").when(k == 1, " b").when(k == 2, "C").when(k == 3, "D").when(k == 4, "")
    rows = bars(spark, sf_dir).where("exchange <> 'okx'").where(d % 4 != n % 4)
    return rows.select("ticker", "exchange", d.alias("ts"), grade.alias("grade"), F.when((F.col("exchange") != "gateio") | (S.base_of(F.col("ticker")) != "ERROR"), 5.0).alias("score"))


@query(f"SELECT e.ticker, e.exchange, e.peak_ts, grade AS ob_grade, grade IS NULL AND score IS NULL AS ob_unverified FROM {PUMPS()} e LEFT JOIN (SELECT * FROM (SELECT * FROM {BOOKED} QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) = 1) WHERE score IS NOT NULL) b ON e.ticker = b.ticker AND e.exchange = b.exchange WHERE score IS NULL OR upper(trim(grade)) IN ('A', 'B', 'C')")
def book_gate(spark, sf_dir):
    return pumps.gated(events(spark, sf_dir), _booked(spark, sf_dir), "C").select("ticker", "exchange", "peak_ts", "ob_grade", "ob_unverified")


COINS = f"(SELECT {SUMMARY} FROM {TOP} GROUP BY base)"


def _coins(spark, sf_dir):
    return pumps.summary(pumps.strongest(events(spark, sf_dir)))


@query(f"SELECT base, min_pump_pct FROM {COINS} WHERE base IN (SELECT base FROM {PUMPS()} WHERE ({NOW} - start_ts) / 86400.0 <= 20)")
def fresh_coins(spark, sf_dir):
    return pumps.fresh_coins(_coins(spark, sf_dir), events(spark, sf_dir), NOW, 20.0).select("base", "min_pump_pct")


@query(f"SELECT base, peak_ts_max FROM {COINS} WHERE ({NOW} - peak_ts_max) / 86400.0 <= 30 ORDER BY peak_ts_max DESC, base LIMIT 3")
def recent_coins(spark, sf_dir):
    return pumps.recent_coins(_coins(spark, sf_dir), NOW, most=3).select("base", "peak_ts_max")


@query(f"SELECT base, min_pump_pct FROM {COINS} ORDER BY min_pump_pct DESC, base LIMIT 3")
def top_coins(spark, sf_dir):
    return pumps.top_coins(_coins(spark, sf_dir), 3).select("base", "min_pump_pct")


LISTED = f"(SELECT DISTINCT {BASE} AS base, exchange FROM {BARS(DAY)} UNION ALL SELECT 'ALONE', 'okx' UNION ALL SELECT 'QUIET', e FROM (VALUES ('okx'), ('bybit')) AS t(e))"


def _listed(spark, sf_dir):
    more = spark.sql("SELECT * FROM VALUES ('ALONE', 'okx'), ('QUIET', 'okx'), ('QUIET', 'bybit') AS t(base, exchange)")
    return bars(spark, sf_dir).select(S.base_of(F.col("ticker")).alias("base"), "exchange").distinct().unionByName(more)


@query(f"SELECT CASE WHEN need < 2 OR coalesce(have, 0) < 2 THEN 'min_exch' ELSE 'kept' END AS outcome, count(*) AS n FROM (SELECT base, count(DISTINCT exchange) AS need FROM {LISTED} GROUP BY 1) c LEFT JOIN (SELECT base AS b, count(DISTINCT exchange) AS have FROM {PUMPS()} GROUP BY 1) e ON c.base = e.b GROUP BY 1")
def selection_any(spark, sf_dir):
    return pumps.selection_counts(events(spark, sf_dir), _listed(spark, sf_dir), 2)


@query(f"WITH e AS (SELECT * FROM {PUMPS()}), n AS (SELECT base, exchange, max(peak_ts) AS newest FROM e GROUP BY 1, 2), md AS (SELECT base, list_sort(list(newest))[count(*) // 2 + 1] AS median, count(*) AS have FROM n GROUP BY base), near AS (SELECT e.* FROM e JOIN md ON e.base = md.base QUALIFY row_number() OVER (PARTITION BY e.base, exchange ORDER BY abs(peak_ts - median), peak_ts, ticker) = 1), s AS (SELECT base, (max(peak_ts) - min(peak_ts)) / 86400.0 AS span FROM near GROUP BY 1) SELECT CASE WHEN need < 2 THEN 'min_exch' WHEN coalesce(have, 0) < need THEN 'not_all' WHEN span > 3 THEN 'align' ELSE 'kept' END AS outcome, count(*) AS n FROM (SELECT base, count(DISTINCT exchange) AS need FROM {LISTED} GROUP BY 1) c LEFT JOIN md ON c.base = md.base LEFT JOIN s ON c.base = s.base GROUP BY 1")
def selection_all(spark, sf_dir):
    return pumps.selection_counts(events(spark, sf_dir), _listed(spark, sf_dir), 2, 3.0)


@query(f"WITH e AS (SELECT p.*, b.grade, b.score FROM {PUMPS()} p LEFT JOIN (SELECT * FROM (SELECT * FROM {BOOKED} QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) = 1) WHERE score IS NOT NULL) b ON p.ticker = b.ticker AND p.exchange = b.exchange) SELECT CASE WHEN pre_max >= peak_price * 0.9 THEN 'prepump' WHEN ({NOW} - peak_ts) / 86400.0 > 25 THEN 'age' WHEN score IS NULL THEN 'ob_unverified' WHEN upper(trim(grade)) IN ('A', 'B', 'C') THEN 'kept' ELSE 'ob_dead' END AS reason, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT CASE WHEN bars >= 10 THEN 'scanned' WHEN bars >= 4 THEN 'short_history' ELSE 'too_short' END, count(*) FROM {HISTORY} GROUP BY 1")
def scan_reasons(spark, sf_dir):
    found = lanes.with_book(events(spark, sf_dir), _booked(spark, sf_dir))
    reason = lanes.scan_reason(F.lit(False), NOW, 0.9, 25.0, 0, least="C")
    return lanes.funnel(histories(spark, sf_dir), found.withColumn("reason", reason), 10, 4)
