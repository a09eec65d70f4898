"""Queries of pair lists: names, filters, drop plans, lookups, diagnosis, tables, options, snapshots, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lanes, selection, summary
from ..sources import samples, snapshots, tables
from ..storage import fresh_path
from . import catalog as C
from .catalog import BARS, BASE, DAY, LAST, NAMES, NOW, PERP, QUARTER, bars, last_rows
from .registry import query

# table names: some without the mark, some with blanks, capitals or a doubled quote
TABLES = "(SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN b || '_usdt_on_bybit' WHEN 1 THEN ' ' || upper(b) || '_usdt:usdt_on_bingx ' WHEN 2 THEN b || '_usdt' WHEN 3 THEN b || '_usdt_usdt_on_okx' WHEN 4 THEN b || '_usdc_usdt_on_okx' ELSE b || 'xonxme' END AS table_name FROM (SELECT *, split_part(p_name, ' ', 1) AS b FROM part))"


def table_names(spark, sf_dir):
    b = F.split_part("p_name", F.lit(" "), F.lit(1))
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, F.concat(b, F.lit("_usdt_on_bybit"))).when(k == 1, F.concat(F.lit(" "), F.upper(b), F.lit("_usdt:usdt_on_bingx "))).when(k == 2, F.concat(b, F.lit("_usdt"))).when(k == 3, F.concat(b, F.lit("_usdt_usdt_on_okx"))).when(k == 4, F.concat(b, F.lit("_usdc_usdt_on_okx"))).otherwise(F.concat(b, F.lit("xonxme")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), name.alias("table_name"))


@query(f"SELECT k, CASE WHEN contains(n, '_on_') THEN upper(replace(regexp_extract(n, '^(.*)_on_([^_]*)$', 1), '_', '/')) ELSE upper(n) END AS ticker, CASE WHEN contains(n, '_on_') THEN regexp_extract(n, '^(.*)_on_([^_]*)$', 2) ELSE '' END AS exchange, CASE WHEN NOT contains(n, '_on_') THEN 'unknown' WHEN contains(n, ':') THEN 'swap' ELSE 'spot' END AS kind FROM (SELECT k, lower(trim(table_name)) AS n FROM {TABLES})")
def parsed_tables(spark, sf_dir):
    return table_names(spark, sf_dir).select("k", S.parse_table(F.col("table_name")).alias("p")).select("k", "p.*")


@query(f"SELECT k, table_name FROM {TABLES} WHERE table_name LIKE '%\\_on\\_%' ESCAPE '\\'")
def catalog_like(spark, sf_dir):
    return selection.pair_tables(table_names(spark, sf_dir))


@query(f"SELECT k, CASE WHEN contains(table_name, '_usdt_usdt_on_') THEN replace(table_name, '_usdt_usdt_on_', '_usdt_on_') WHEN contains(table_name, ':usdt') THEN replace(lower(trim(table_name)), ':usdt', '') END AS spot FROM {TABLES}")
def perp_to_spot(spark, sf_dir):
    name = F.col("table_name")
    rows = table_names(spark, sf_dir).withColumn("table_name", F.when(F.contains(name, F.lit(":")), F.replace(F.lower(F.trim(name)), F.lit("_usdt:usdt"), F.lit("_usdt:usdt"))).otherwise(name))
    return rows.select("k", S.perp_to_spot(F.col("table_name")).alias("spot"))


@query(f"SELECT p_partkey, CASE WHEN contains(symbol, '/') THEN 'USDT' END AS quote FROM {NAMES}")
def quotes(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", S.quote_of(F.col("symbol")).alias("quote"))


def _names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    tail = F.element_at(F.array(*map(F.lit, ("3L", "UP", "USD", "STOCK", "_OLD", "", "", "", ""))), (F.col("p_partkey") % 9 + 1).cast("int"))
    symbol = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), tail, F.lit("/USDT"), F.when(F.col("p_partkey") % 2 == 0, ":USDT").otherwise(""))
    exchange = F.element_at(F.array(F.lit("bitget"), F.lit("bg"), F.lit("okex")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", symbol.alias("symbol"), exchange.alias("exchange"))


MADE = "(SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'TEST' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 1 THEN 'TEST' || CAST(p_partkey AS VARCHAR) || 'A' WHEN 2 THEN 'RCOIN' WHEN 3 THEN 'RUNE' ELSE 'BTC' END AS base, CASE p_partkey % 2 WHEN 0 THEN 'bitget' ELSE 'okx' END AS exchange FROM part)"


@query(f"SELECT k, base, exchange FROM {MADE} WHERE NOT regexp_matches(base, '^TEST[0-9]{{6}}$') AND NOT (exchange = 'bitget' AND base = 'RCOIN')")
def excluded_bases(spark, sf_dir):
    k = F.col("p_partkey")
    base = F.when(k % 5 == 0, F.concat(F.lit("TEST"), F.lpad(k.cast("string"), 6, "0"))).when(k % 5 == 1, F.concat(F.lit("TEST"), k.cast("string"), F.lit("A"))).when(k % 5 == 2, "RCOIN").when(k % 5 == 3, "RUNE").otherwise("BTC")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), base.alias("base"), F.when(k % 2 == 0, "bitget").otherwise("okx").alias("exchange"))
    return rows.where(~S.excluded_base(F.col("base"), F.col("exchange")))


@query(f"SELECT DISTINCT ticker, exchange FROM {C.TAPE} WHERE exchange = 'okx'")
def allowed_exchanges(spark, sf_dir):
    """Three exchanges allowed, as a JSON list; one of them denied, one not stored."""
    pairs = C.tape(spark, sf_dir).select("ticker", "exchange").distinct()
    return pairs.where(S.exchange_allowed(F.col("exchange"), ' ["OKX", "bybit", "mexc"] ', "bybit, "))


# summary rows of quarter-hour bars: tier, grade and score by the number of bars
VIEW = f"(SELECT ticker, exchange, bars, last_ts, CASE WHEN bars % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS volume_tier, CASE bars % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'F' END AS grade, CASE WHEN bars % 10 < 9 THEN bars % 10 END * 1.0 AS score FROM {LAST})"


def view(spark, sf_dir):
    n = F.col("bars")
    grade = F.when(n % 6 < 5, F.element_at(F.array(*map(F.lit, "ABCDF")), F.least(n % 6 + 1, F.lit(5)).cast("int")))
    return last_rows(spark, sf_dir).select("ticker", "exchange", "bars", "last_ts", F.when(n % 2 == 0, "HIGH").otherwise("LOW").alias("volume_tier"), grade.alias("grade"), F.when(n % 10 < 9, (n % 10).cast("double")).alias("score"))


@query(f"SELECT ticker, exchange, why FROM (SELECT *, CASE WHEN exchange = 'bybit' THEN 'exchange' WHEN bars % 4 = 0 THEN 'delisted' END AS why FROM {LAST}) WHERE why IS NOT NULL UNION ALL SELECT 'RNVD/USDT', 'bitget', 'stock'")
def drop_plan(spark, sf_dir):
    rows = last_rows(spark, sf_dir)
    more = spark.sql("SELECT * FROM VALUES ('RNVD/USDT', 'bitget'), ('RUNE/USDT', 'bitget') AS t(ticker, exchange)")
    gone = rows.where("bars % 4 = 0").select("ticker", "exchange").unionByName(spark.sql("SELECT 'GONE/USDT' AS ticker, 'okx' AS exchange"))
    return selection.drop_plan(rows.select("ticker", "exchange").unionByName(more), None, "bybit", gone)


@query(f"SELECT l.ticker, l.exchange, CASE WHEN z.spot IS NULL THEN 'live' ELSE 'parked' END AS status FROM {LAST} l LEFT JOIN (SELECT spot, exchange FROM {C.ZOMBIE} WHERE verdict = 'prune') z ON l.ticker = z.spot AND l.exchange = z.exchange UNION ALL SELECT 'OLD/USDT', 'okx', 'dropped'")
def parked_tables(spark, sf_dir):
    before = spark.sql("SELECT 'OLD/USDT' AS ticker, 'okx' AS exchange")
    return selection.parked(last_rows(spark, sf_dir), C._zombies(spark, sf_dir), "trash", before, purge=True)


@query(f"SELECT count(*) AS pruned, (SELECT count(*) FROM {LAST}) AS tables, count(*) > 0.2 * (SELECT count(*) FROM {LAST}) AS too_many FROM {C.ZOMBIE} WHERE verdict = 'prune'")
def prune_guard(spark, sf_dir):
    plan = C._zombies(spark, sf_dir).agg(F.count_if(F.col("verdict") == "prune").alias("pruned"))
    return plan.withColumn("tables", last_rows(spark, sf_dir).agg(F.count(F.lit(1))).scalar()).withColumn("too_many", summary.over_prune(F.col("pruned"), F.col("tables"), 0.2))


ASKED = f"(SELECT DISTINCT {BASE} AS base, e.exchange FROM {LAST}, (VALUES ('okx'), ('bybit'), ('mexc')) AS e(exchange))"


@query(f"SELECT a.base, a.exchange, max(l.ticker) AS perp FROM {ASKED} a LEFT JOIN {LAST} l ON split_part(l.ticker, '/', 1) = a.base AND l.exchange = a.exchange AND ends_with(l.ticker, ':USDT') GROUP BY 1, 2")
def perp_lookup(spark, sf_dir):
    rows = last_rows(spark, sf_dir)
    asked = rows.select(S.base_of(F.col("ticker")).alias("base"), F.explode(F.array(*map(F.lit, ("okx", "bybit", "mexc")))).alias("exchange")).distinct()
    return selection.find_perp(rows.withColumn("rank", F.lit(0)), asked)


@query(f"SELECT a.ticker, a.wanted, r.exchange, r.volume_tier FROM (SELECT DISTINCT ticker, w AS wanted FROM {LAST}, (VALUES ('okx'), ('mexc'), (NULL)) AS t(w) UNION ALL SELECT 'NONE/USDT', 'okx') a LEFT JOIN LATERAL (SELECT v.exchange, v.volume_tier FROM {VIEW} v WHERE v.ticker = a.ticker ORDER BY v.exchange IS NOT DISTINCT FROM a.wanted DESC, v.volume_tier, v.exchange LIMIT 1) r ON true")
def row_lookup(spark, sf_dir):
    rows = view(spark, sf_dir)
    asked = rows.select("ticker", F.explode(F.array(F.lit("okx"), F.lit("mexc"), F.lit(None).cast("string"))).alias("wanted")).distinct()
    return selection.find_row(rows, asked.unionByName(spark.sql("SELECT 'NONE/USDT' AS ticker, 'okx' AS wanted")))


@query(f"SELECT l.ticker, l.exchange, CASE WHEN {PERP} THEN 'perp' WHEN p.ticker IS NOT NULL THEN 'perp ' || p.ticker ELSE 'none' END AS badge FROM {LAST} l LEFT JOIN (SELECT ticker, exchange FROM {LAST} WHERE {PERP} AND exchange <> 'okx') p ON split_part(p.ticker, '/', 1) = split_part(l.ticker, '/', 1) AND p.exchange = l.exchange".replace("CASE WHEN contains(ticker", "CASE WHEN contains(l.ticker"))
def short_badges(spark, sf_dir):
    rows = last_rows(spark, sf_dir).select("ticker", "exchange", S.base_of(F.col("ticker")).alias("base"))
    found = selection.find_perp(rows.where("exchange <> 'okx'").withColumn("rank", F.lit(0)), rows.select("base", "exchange").distinct())
    return rows.join(found, ["base", "exchange"]).select("ticker", "exchange", S.short_badge(F.col("ticker"), F.col("perp")).alias("badge"))


@query(f"SELECT ticker, exchange, CASE WHEN bars % 3 = 0 THEN bars * 100.0 WHEN exchange = 'okx' THEN bars * 10.0 ELSE bars * 1.0 END AS depth, CASE WHEN bars % 4 = 0 THEN NULL ELSE last_ts * 1.0 END AS bid FROM {LAST}")
def best_sources(spark, sf_dir):
    """A field from the live row, else the feed, else the stored row; NaN does not count as a value."""
    rows = last_rows(spark, sf_dir)
    n = F.col("bars")
    pair = lambda depth, bid: rows.select("ticker", "exchange", depth.alias("depth"), bid.alias("bid"))
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    stored = pair(n.cast("double"), F.when(n % 4 == 0, nan).otherwise(F.col("last_ts").cast("double")))
    return selection.best_sources(stored, pair(n * 10.0, none).where("exchange = 'okx'"), pair(F.when(n % 3 == 0, n * 100.0).otherwise(nan), none), ["depth", "bid"])


@query(f"SELECT place, ticker, bars, first, last, round(({NOW} - last) / 3600.0, 6) AS behind, ({NOW} - last) / 3600.0 > 6 AS red, {PERP} AS selected FROM (SELECT 'daily' AS place, ticker, count(*) AS bars, min(ts) AS first, max(ts) AS last FROM {BARS(DAY)} WHERE exchange = 'okx' GROUP BY ticker UNION ALL SELECT 'quarter', ticker, count(*), min(ts), max(ts) FROM {BARS(QUARTER)} WHERE exchange = 'okx' GROUP BY ticker) WHERE {BASE} = 'CLICK'")
def pair_diagnosis(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("place", F.lit("daily")).unionByName(bars(spark, sf_dir, QUARTER).withColumn("place", F.lit("quarter")).withColumn("ts", F.col("ts") * 1000))
    return selection.diagnose(rows, "click", "okx", NOW, 6.0).withColumn("behind", F.round("behind", 6))


@query(f"SELECT (SELECT count(*) FROM (SELECT DISTINCT ticker, exchange FROM {BARS(DAY)} WHERE exchange <> 'okx')) AS pairs_15m, count(*) AS pairs_1d, count(*) FILTER (WHERE volume_tier = 'HIGH') AS high, count(DISTINCT exchange) AS exchanges, count(*) FILTER (WHERE grade IN ('A', 'B')) AS lively FROM {VIEW}")
def kpi_tiles(spark, sf_dir):
    return selection.tiles(view(spark, sf_dir), last_rows(spark, sf_dir).where("exchange <> 'okx'"))


@query(f"SELECT exchange, bool_or(bars % 7 = 0) AS partial, max(bars % 13 * 1.0) AS seconds, CAST(sum(bars) AS BIGINT) AS rows, count(*) AS tables, CAST(sum(bars % 5) AS BIGINT) AS carried, CAST(sum(bars % 3) AS BIGINT) AS answered, CAST(sum(bars % 4) AS BIGINT) AS chunks, max(bars % 6) AS start FROM {LAST} GROUP BY 1")
def scan_meta(spark, sf_dir):
    n = F.col("bars")
    scans = last_rows(spark, sf_dir).select("exchange", (n % 7 == 0).alias("partial"), (n % 13).cast("double").alias("seconds"), n.alias("rows"), F.lit(1).alias("tables"), (n % 5).alias("carried"), (n % 3).alias("answered"), (n % 4).alias("chunks"), (n % 6).alias("start"))
    return selection.scan_roll_up(scans, "exchange")


@query(f"SELECT ticker, exchange, volume_tier, grade, score FROM {VIEW} WHERE exchange IN ('okx', 'bybit') AND volume_tier IN ('HIGH', 'LOW') AND grade IN ('A', 'B', 'C') ORDER BY score DESC NULLS LAST, ticker, exchange LIMIT 7")
def liquidity_table(spark, sf_dir):
    return selection.table_view(view(spark, sf_dir), ["okx", "bybit"], ["HIGH", "LOW"], ["A", "B", "C"], 7).select("ticker", "exchange", "volume_tier", "grade", "score")


@query(f"SELECT ticker, exchange, stored, missing FROM (SELECT ticker, exchange, count(*) AS stored, CAST(sum(coalesce(n - b - 1, 0)) AS BIGINT) AS missing FROM {C.GAPS} GROUP BY 1, 2) WHERE missing > 0 ORDER BY missing DESC, ticker, exchange LIMIT 10")
def top_gaps(spark, sf_dir):
    from ..operators import series

    rows = series.gap_summary(bars(spark, sf_dir, QUARTER), QUARTER).select("ticker", "exchange", "stored", "missing")
    return selection.most_of(rows, 10, F.desc("missing"), F.asc("ticker"), F.asc("exchange"))


@query("SELECT event_id, user_id AS rss_kb, event_id % 10 AS swap_kb FROM events WHERE event_id % 10 > 0 OR user_id > 0 ORDER BY swap_kb DESC, rss_kb DESC, event_id LIMIT 15")
def top_processes(spark, sf_dir):
    rows = tables.events(spark, sf_dir).select("event_id", F.col("user_id").alias("rss_kb"), (F.col("event_id") % 10).alias("swap_kb")).where("swap_kb > 0 OR rss_kb > 0")
    return selection.most_of(rows, 15, F.desc("swap_kb"), F.desc("rss_kb"), F.asc("event_id"))


@query(f"SELECT option, coalesce(lag(option) OVER (ORDER BY option), max(option) OVER ()) AS previous, coalesce(lead(option) OVER (ORDER BY option), min(option) OVER ()) AS next FROM (SELECT DISTINCT ticker AS option FROM {LAST})")
def pair_options(spark, sf_dir):
    return selection.options(last_rows(spark, sf_dir))


@query(f"SELECT DISTINCT ticker FROM {BARS(QUARTER)} WHERE exchange = 'okx' AND ticker NOT LIKE 'E%'")
def only_quarter(spark, sf_dir):
    q = bars(spark, sf_dir, QUARTER).where("exchange = 'okx' AND ticker NOT LIKE 'E%'")
    return selection.listed(bars(spark, sf_dir), q, True)


@query(f"SELECT DISTINCT ticker FROM {BARS(DAY)}")
def only_quarter_none(spark, sf_dir):
    """A filter that would leave nothing is not applied."""
    return selection.listed(bars(spark, sf_dir), bars(spark, sf_dir, QUARTER).where("false"), True)


@query(f"SELECT {BASE} AS base FROM {LAST} WHERE NOT {PERP} AND exchange = 'okx' UNION SELECT {BASE} FROM {LAST} WHERE {PERP} AND bars % 2 = 0")
def base_union(spark, sf_dir):
    rows = last_rows(spark, sf_dir)
    return selection.bases(rows.where("exchange = 'okx'").where(~S.is_perp(F.col("ticker"))), rows.where("bars % 2 = 0").where(S.is_perp(F.col("ticker"))))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 5 = 0 THEN 'n/k' ELSE CAST(c_nationkey AS VARCHAR) END AS nation, c_custkey % 3 = 0 AS barcode, CAST(NULL AS DOUBLE) AS open_interest FROM customer")
def retyped(spark, sf_dir):
    """Numbers kept as text come back as numbers, a column with one other word stays text, flags become booleans, and a
    column that the table lacks is added."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.when(k % 9 != 0, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).otherwise(F.when(k % 2 == 0, "").otherwise("NaN")).alias("balance"),
        F.when(k % 5 == 0, "n/k").otherwise(F.col("c_nationkey").cast("string")).alias("nation"), F.when(k % 3 == 0, F.when(k % 2 == 0, "True").otherwise("1.0")).when(k % 3 == 1, "no").alias("barcode"),
    )
    return summary.with_columns(summary.retype(rows, ["balance", "nation"], ["barcode"]), {"open_interest": "double", "balance": "string"})


@query(f"SELECT 'fresh' AS which, ticker, exchange, bars FROM {LAST}")
def snapshot_age(spark, sf_dir):
    """A snapshot that is young enough is served; one that is too old, or from a time ahead, is not."""
    out = None
    for which, saved in (("fresh", NOW - 600), ("old", NOW - 7200), ("ahead", NOW + 7200)):
        path = fresh_path(spark, f"snapshot-{which}")
        snapshots.save(last_rows(spark, sf_dir).select("ticker", "exchange", "bars"), path, saved)
        part = snapshots.load(spark, path, NOW, 3600).select(F.lit(which).alias("which"), "ticker", "exchange", "bars")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT CAST(event_id AS BIGINT) AS pid, CASE WHEN event_type = 'error' THEN 'err' ELSE event_type END AS comm, user_id AS rss_kb FROM events WHERE event_id % 10 > 0")
def process_samples(spark, sf_dir):
    """Samples of processes as CSV files; rows without a process number, and threads that are not a group's first, go."""
    path = fresh_path(spark, "samples")
    rows = tables.events(spark, sf_dir).select(
        F.lit(NOW).alias("ts"), F.when(F.col("event_id") % 10 > 0, F.col("event_id").cast("string")).otherwise("?").alias("pid"), F.col("event_id").alias("tgid"),
        F.when(F.col("event_type") == "error", "err").otherwise(F.col("event_type")).alias("comm"), F.lit("a, \"b\"").alias("cmd"), F.col("user_id").alias("rss_kb"), F.lit(0).alias("swap_kb"),
    )
    thread = rows.where("pid <> '?'").limit(50).withColumn("tgid", F.lit(-5))
    samples.write(rows.unionByName(thread), path)
    return samples.read(spark, path).select("pid", "comm", "rss_kb")


ATR = "bid * (1 + key % 9) / 400.0"


@query("SELECT key, round(CASE WHEN total_usd > 0 THEN greatest(0, least(1, (log10(total_usd) - log10(500)) / (log10(50000) - log10(500)))) ELSE 0 END, 6) AS depth, round(1 - greatest(0, least(1, CASE WHEN bid > 0 THEN (ask - bid) / (" + ATR + ") * 100 ELSE 0 END / 5)), 6) AS spread, round(CASE WHEN imbalance > 0 THEN greatest(0, least(1, (imbalance - 0.25) / 0.75)) * greatest(0, least(1, (4 - imbalance) / 3)) ELSE 0 END, 6) AS imbalance, CASE WHEN key % 3 = 0 THEN 0.0 ELSE key % 11 / 10.0 END AS vitality, least(1.0, key % 7 / 5.0) AS tpm, round(CASE WHEN key % 4 = 0 THEN 0.0 ELSE key * 13 % 101 / 100.0 END, 6) AS buy, round(least(1.0, greatest(0.0, ((key % 5 - 2) * 7000 + 10000) / 20000.0)), 6) AS cvd, round(1 - least(1.0, key * 37 % 900 / 600.0), 6) AS last_trade FROM " + C.BOOK + " WHERE bid IS NOT NULL AND ask IS NOT NULL")
def book_goodness(spark, sf_dir):
    """All eight scores of a book and its tape; the spread counts against the pair's volatility."""
    from ..operators import liquidity

    k, bid = F.col("key"), F.col("bid")
    b = liquidity.book(C.levels(spark, sf_dir)).where("bid IS NOT NULL AND ask IS NOT NULL")
    spread = S.spread_of(bid, F.col("ask"), bid * (1 + k % 9) / 400.0)
    g = S.goodness(k % 11, k % 3 == 0, F.col("total_usd"), spread, F.col("imbalance"), k % 7, F.when(k % 4 != 0, k * 13 % 101), (k % 5 - 2) * 7000, k * 37 % 900)
    return b.select("key", g.alias("g")).select("key", *(F.round(f"g.{x}", 6).alias(x) for x in ("depth", "spread", "imbalance", "vitality", "tpm", "buy", "cvd", "last_trade")))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal * 60 > 0 THEN greatest(0, least(1, (log10(c_acctbal * 60) - log10(100000)) / (log10(500000) - log10(100000)))) ELSE 0 END, 6) AS volume_score FROM customer")
def volume_scores(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.round(S.score_log(F.col("c_acctbal") * 60, 100_000.0, 500_000.0), 6).alias("volume_score"))


@query(f"SELECT ticker, exchange, ts FROM (SELECT ticker, exchange, last_ts * k AS ts, last_ts AS s, k, max(last_ts) FILTER (WHERE {PERP}) OVER (PARTITION BY exchange, {BASE}) AS p FROM (SELECT *, CASE WHEN bars % 2 = 0 THEN 1000 ELSE 1 END AS k FROM {LAST})) WHERE {PERP} OR p IS NULL OR s >= p - 3600")
def stale_spot_units(spark, sf_dir):
    """Stale spot rows where some times are in milliseconds."""
    rows = last_rows(spark, sf_dir).select("ticker", "exchange", (F.col("last_ts") * F.when(F.col("bars") % 2 == 0, 1000).otherwise(1)).alias("ts"))
    return summary.drop_stale_spot(rows, 3600)
