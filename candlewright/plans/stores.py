"""Queries of what is kept: the candle store and its jobs, results in one commit, paged answers, unions of many tables.

The driver's events cover a month, so the store's bars are spread over half a year: a day becomes six.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import candles, selection, summary
from ..sources import paged, recorded, sinks, store
from ..storage import fresh_path
from ..streaming import live
from . import catalog as C
from .catalog import BARS, DAY, NOW, QUARTER, bars
from .registry import query

START = 1704067200  # 2024-01-01
ENDS = START + 180 * DAY
SPREAD = f"(SELECT ticker, exchange, {START} + (ts - {START}) * 6 AS ts, open, high, low, close, volume FROM {BARS(DAY)})"


def spread(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("ts", F.lit(START) + (F.col("ts") - START) * 6)


def kept(spark, sf_dir):
    """A store of the spread bars."""
    path = fresh_path(spark, "store")
    store.put(spread(spark, sf_dir), path)
    return path


@query(f"SELECT * FROM {SPREAD} WHERE ts >= {ENDS - 100 * DAY}")
def retention_store(spark, sf_dir):
    """Bars older than a hundred days deleted from the store; a second run on the same day is not due."""
    path = kept(spark, sf_dir)
    store.retain(spark, path, ENDS, 100)
    store.retain(spark, path, ENDS + 3600, 50)
    return store.read(spark, path).drop("month")


@query(f"SELECT ticker, exchange, ts, open, high, low, close, volume * 2 AS volume FROM {SPREAD} WHERE ts >= {ENDS - 60 * DAY}")
def swept_store(spark, sf_dir):
    """Bars stored twice, the second time at twice the volume: one row a bucket is left, in one file a folder."""
    path = kept(spark, sf_dir)
    store.put(spread(spark, sf_dir).withColumn("volume", F.col("volume") * 2), path)
    store.sweep(spark, path, ENDS, DAY, days=60)
    store.sweep(spark, path, ENDS + 7200, DAY, days=60)
    return store.read(spark, path).drop("month")


PLAN = f"(SELECT spot AS ticker, exchange FROM {C.ZOMBIE} WHERE verdict = 'prune')"


@query(f"SELECT l.ticker, l.exchange, CASE WHEN p.ticker IS NULL OR l.exchange = 'okx' THEN 'live' ELSE 'parked' END AS place, count(*) AS bars FROM {SPREAD} l LEFT JOIN {PLAN} p ON l.ticker = p.ticker AND l.exchange = p.exchange WHERE p.ticker IS NULL OR l.exchange <> 'gateio' GROUP BY 1, 2, 3")
def parked_store(spark, sf_dir):
    """Zombies parked; of those, pairs of one exchange come back and those of another are purged.  Moves that are made
    again change nothing."""
    path = kept(spark, sf_dir)
    plan = C._zombies(spark, sf_dir).where("verdict = 'prune'").select(F.col("spot").alias("ticker"), "exchange")
    for exchange, action in ((None, "park"), ("okx", "restore"), ("gateio", "purge")):
        part = plan if exchange is None else plan.where(F.col("exchange") == exchange)
        store.apply(spark, path, part.withColumn("action", F.lit(action)), ENDS)
        store.repair(spark, path)
    count = lambda place: store.read(spark, path, place).groupBy("ticker", "exchange").agg(F.count(F.lit(1)).alias("bars")).withColumn("place", F.lit(place))
    return count("live").unionByName(count("parked"))


@query(f"SELECT ticker, exchange, count(*) AS bars FROM {SPREAD} WHERE exchange <> 'bybit' GROUP BY 1, 2")
def dropped_store(spark, sf_dir):
    """Pairs of an exchange that is not served are dropped from the store."""
    path = kept(spark, sf_dir)
    rows = store.read(spark, path).select("ticker", "exchange").distinct()
    store.apply(spark, path, selection.drop_plan(rows, None, "bybit").select("ticker", "exchange", F.lit("drop").alias("action")), ENDS)
    return store.read(spark, path).groupBy("ticker", "exchange").agg(F.count(F.lit(1)).alias("bars"))


DEEP = START + 130 * DAY


@query(f"SELECT * FROM {SPREAD} WHERE ts < {DEEP} QUALIFY row_number() OVER (PARTITION BY ticker, exchange ORDER BY ts DESC) <= 5")
def stored_page(spark, sf_dir):
    """Five bars a pair before a time in May, from the months that hold them."""
    return store.page(spark, kept(spark, sf_dir), DEEP, 5).drop("month")


@query(f"SELECT run_ts, base, n FROM (SELECT split_part(ticker, '/', 1) AS base, count(*) AS n FROM {BARS(DAY)} GROUP BY 1), (VALUES (20), (40)) AS t(run_ts)")
def published_results(spark, sf_dir):
    """Results of runs: one was wiped, one broke off before its last table, and two are there."""
    path = fresh_path(spark, "results")
    coins = bars(spark, sf_dir).groupBy(F.split_part("ticker", F.lit("/"), F.lit(1)).alias("base")).agg(F.count(F.lit(1)).alias("n"))
    events = bars(spark, sf_dir).select("ticker", "ts")
    sinks.save_results(path, 10, {"coins": coins, "events": events})
    sinks.save_results(path, 20, {"coins": coins, "events": events}, wipe=True)
    try:
        sinks.save_results(path, 30, {"coins": coins, "events": events.select(F.raise_error(F.lit("broken off")).alias("x"))})
    except Exception as e:  # as a job that is lost half-way
        if "broken off" not in str(e):
            raise
    sinks.save_results(path, 40, {"coins": coins, "events": events})
    return sinks.read_results(spark, path, "coins")


@query(f"SELECT spot, exchange, verdict, idle IS NULL AS unknown_age FROM {C.ZOMBIE}")
def decision_report(spark, sf_dir):
    """Decisions written as lines of JSON and read back."""
    path = fresh_path(spark, "report")
    sinks.write_report(C._zombies(spark, sf_dir).select("spot", "exchange", "verdict", "idle"), path)
    return spark.read.schema("spot string, exchange string, verdict string, idle double").json(path).select("spot", "exchange", "verdict", F.isnull("idle").alias("unknown_age"))


MIDDLE, LAST = START + 12 * DAY, START + 20 * DAY


def _answers(spark, sf_dir, path, stream=False, until=LAST):
    paged.record(bars(spark, sf_dir, QUARTER).where("exchange <> 'okx'"), path)
    return _asked(spark, sf_dir, path, stream, until)


def _asked(spark, sf_dir, path, stream, until):
    pairs = bars(spark, sf_dir).select("ticker", "exchange").distinct().orderBy("ticker", "exchange")
    names = json.dumps([list(r) for r in pairs.collect()])  # the catalog of pairs
    return paged.reader(spark, stream, pairs=names, since=START + DAY, until=until, step=QUARTER, limit=20, span=300, pages=path).load()


@query(f"SELECT ticker, exchange, ts, open, high, low, close, volume, false AS failed FROM {BARS(QUARTER)} WHERE exchange <> 'okx' AND ts >= {START + DAY} AND ts < {LAST} UNION ALL SELECT ticker, exchange, {START + DAY} + i * 270000, NULL, NULL, NULL, NULL, NULL, true FROM (SELECT DISTINCT ticker, exchange FROM {BARS(DAY)} WHERE exchange = 'okx'), (SELECT unnest(range(0, {(LAST - START - DAY + 269999) // 270000})) AS i)")
def paged_candles(spark, sf_dir):
    """Bars in pages of twenty that overlap; an exchange that does not answer gives a row for each range asked for."""
    found = _answers(spark, sf_dir, fresh_path(spark, "pages"))
    return found.select("ticker", "exchange", "ts", "open", "high", "low", "close", "volume", F.isnotnull("error").alias("failed"))


@query(f"SELECT ticker, exchange, ts, close FROM {BARS(QUARTER)} WHERE exchange <> 'okx' AND ts >= {START + DAY} AND ts < {LAST}")
def paged_stream(spark, sf_dir):
    """The same as a stream that was stopped half-way and goes on from its offsets."""
    path = fresh_path(spark, "pages")
    first = _answers(spark, sf_dir, f"{path}/recorded", True, MIDDLE)
    for stream in (first, _asked(spark, sf_dir, f"{path}/recorded", True, LAST)):
        live.log_sink(stream, "append", path).awaitTermination()
    return live.read_log(spark, path, first.schema).where("error IS NULL").select("ticker", "exchange", "ts", "close")


@query("SELECT 'customer' AS kind, CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS VARCHAR) AS amount, c_mktsegment AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, CAST(s_acctbal AS VARCHAR), NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_type, p_brand FROM part")
def union_manifest(spark, sf_dir):
    """Many small tables of three schemas as one: amounts are numbers in some and words in others, so they are text."""
    path = fresh_path(spark, "tables")
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for name, rows in {
        "customer": read("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("name")),
        "supplier": read("supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").alias("amount")),
        "part": read("part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_type").alias("amount"), F.col("p_brand").alias("name")),
    }.items():
        rows.repartition(12, "id").write.parquet(f"{path}/kind={name}")
    found = summary.union_files(spark, path)
    return found.select(F.regexp_extract("file", "kind=([^/]*)", 1).alias("kind"), "id", "amount", "name")


@query(f"SELECT ticker, exchange, ts, open, high, low, close, volume FROM {BARS(QUARTER)}")
def recorded_answers(spark, sf_dir):
    """Fetched pages as lines of JSON, read as a stream of files; a page that is no JSON gives no bars."""
    path = fresh_path(spark, "answers")
    row = F.array(F.col("ts") * 1000.0, "open", "high", "low", "close", "volume")
    pages = bars(spark, sf_dir, QUARTER).groupBy("ticker", "exchange", F.floor(F.col("ts") / DAY).alias("page")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("payload"))
    broken = pages.limit(1).withColumns({"payload": F.lit("<html>busy</html>"), "page": F.lit(-1).cast("long")})
    pages.unionByName(broken).withColumns({"kind": F.lit("ohlcv"), "fetched": F.lit(NOW)}).repartition(3, "page").write.json(path)
    found = live.run_to_end(recorded.ohlcv(recorded.read_answers(spark, path, stream=True)))
    return candles.catch_up(found)
