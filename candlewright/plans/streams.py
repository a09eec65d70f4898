"""Queries of streams, run to their end over the recorded events: several micro-batches, some rows late."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables
from ..storage import delete, fresh_path
from ..streaming import live
from . import catalog as C
from .catalog import BARS, NOW, QUARTER, TAPE
from .registry import query

TRADE = ["ticker", "exchange"]


@query(f"SELECT * FROM {BARS(QUARTER)}")
def stream_candles(spark, sf_dir):
    """The bars of an event stream, each emitted once, when the watermark has passed it."""
    return live.run_to_end(live.bars(tables.replay(spark, sf_dir), QUARTER))


@query(f"SELECT ticker, exchange, ts, open2 AS open, greatest(high, open2) AS high, least(low, open2) AS low, close, volume FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker, exchange ORDER BY ts), open) AS open2 FROM {BARS(QUARTER)})")
def stream_live_bars(spark, sf_dir):
    """Forming bars that open at the close before; the last version of each, after late trades have changed some."""
    return live.run_to_end(live.live_bars(tables.replay(spark, sf_dir), QUARTER), "update", [*TRADE, "ts"], keyed=True)


@query(f"WITH RECURSIVE e AS (SELECT ticker, exchange, t FROM {TAPE}), r AS (SELECT ticker, exchange, min(t) AS t FROM e GROUP BY 1, 2 UNION ALL SELECT e.ticker, e.exchange, min(e.t) FROM r JOIN e ON r.ticker = e.ticker AND r.exchange = e.exchange AND e.t >= r.t + 43200000000 GROUP BY 1, 2) SELECT ticker, exchange, t FROM r")
def stream_cooldown(spark, sf_dir):
    """Trades that pass a cooldown of twelve hours a pair."""
    return live.run_to_end(live.latch(tables.replay(spark, sf_dir), 43_200), keyed=True)


@query(C.UPSERT)
def stream_upsert(spark, sf_dir):
    """Stored bars, and later bars of some of their buckets, through the upserting sink: a batch each, one stream."""
    b = C.bars(spark, sf_dir, QUARTER)
    path = fresh_path(spark, "upserts")
    for rows in (b, b.where("(ts div 900) % 7 = 0").withColumn("volume", F.col("volume") * 2)):
        rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    live.upsert_sink(stream, f"{path}/bars", f"{path}/state", QUARTER, 10 * 86_400).awaitTermination()
    return spark.read.schema(b.schema).parquet(f"{path}/bars").drop("folder")


#: The stream's time at the end of a replay without its closing row: the watermark, in milliseconds.
ENDS = "(SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)"


@query(f"SELECT ticker, exchange, arg_max(value, t) AS price, max(t) AS t, ({NOW}000000 - max(t)) / 1e6 AS age, {NOW}000000 - max(t) > 3600000000 AS stale FROM {TAPE} GROUP BY 1, 2 HAVING max(t) // 1000 + 3600000 >= {ENDS}")
def stream_ticks(spark, sf_dir):
    """Newest ticks; those went that the stream's own time had left behind by four times the TTL."""
    path = fresh_path(spark, "ticks")
    stream = live.ticks(tables.replay(spark, sf_dir, closing=False), ttl_sec=900)
    live.log_sink(stream, "update", path, keyed=True).awaitTermination()
    live.compact(spark, path, stream.schema, through=3)
    delete(spark, f"{path}/state")
    return live.live_rows(live.tick_table(spark, path, stream.schema), NOW * 1_000_000, 3_600_000_000)


@query(f"SELECT ticker, exchange, \"end\", count(*) / 60.0 AS tpm, CAST(sum(CASE side WHEN 'buy' THEN CAST(value * value AS DECIMAL(18,4)) WHEN 'sell' THEN -CAST(value * value AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS cvd FROM (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' WHEN event_type = 'error' THEN 'sell' ELSE 'none' END AS side, unnest(range(t // 900000000 * 900 + 900, t // 900000000 * 900 + 900 + 3600, 900)) AS \"end\" FROM {TAPE}) GROUP BY 1, 2, 3")
def stream_trailing(spark, sf_dir):
    """Trades a minute and signed flow of the hour before each quarter of an hour."""
    return live.run_to_end(live.trailing(tables.replay(spark, sf_dir), 3600, 900))


def timeframe():
    return F.when(F.col("event_id") % 3 == 0, "1d").otherwise("15m")


RUNS = f"(SELECT ticker, exchange, timeframe, min(t) AS first, max(t) + 7200000000 AS expires, count(*) AS beats FROM (SELECT *, sum(fresh) OVER w AS island FROM (SELECT *, CASE WHEN t - lag(t) OVER w < 7200000000 THEN 0 ELSE 1 END AS fresh FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '1d' ELSE '15m' END AS timeframe FROM {TAPE}) WINDOW w AS (PARTITION BY ticker, exchange, timeframe ORDER BY t)) WINDOW w AS (PARTITION BY ticker, exchange, timeframe ORDER BY t)) GROUP BY ticker, exchange, timeframe, island)"


@query(f"SELECT ticker, exchange, timeframe, 'enter' AS kind, first AS at, CAST(NULL AS BIGINT) AS beats FROM {RUNS} UNION ALL SELECT ticker, exchange, timeframe, 'leave', expires, beats FROM {RUNS}")
def stream_watch_list(spark, sf_dir):
    """When pairs enter and leave a watch list with a TTL of two hours, by timeframe."""
    return live.run_to_end(live.watch_list(tables.replay(spark, sf_dir), 7200, timeframe()), keyed=True)


@query(f"SELECT timeframe, count(*) AS watched FROM {RUNS} WHERE first <= {NOW - 10 * 86400}000000 AND expires > {NOW - 10 * 86400}000000 GROUP BY 1")
def stream_pulse(spark, sf_dir):
    """How many pairs were watched at a time, by timeframe, from the list's events."""
    events = live.run_to_end(live.watch_list(tables.replay(spark, sf_dir), 7200, timeframe()), keyed=True)
    return live.watched_at(events, (NOW - 10 * 86_400) * 1_000_000).groupBy("timeframe").agg(F.count(F.lit(1)).alias("watched"))
