"""Streams over several micro-batches: state that carries over, late rows, expiry, restarts."""

import datetime

import pytest
from pyspark.sql import functions as F

from candlewright.sources import tables
from candlewright.storage import children
from candlewright.streaming import live

EVENT = "event_id long, ts timestamp_ntz, event_type string, user_id long, value double"
START = datetime.datetime(2024, 1, 1)
PAIR = ["ticker", "exchange"]


@pytest.fixture()
def feed(spark, tmp_path):
    """Files of (event_id, minutes, value[, user]) rows, one a micro-batch; the folder, to add files to, and the stream."""
    path = f"file://{tmp_path}/in"

    def add(*batches):
        for rows in batches:
            full = [(r[0], START + datetime.timedelta(minutes=r[1]), "view", r[3] if len(r) > 3 else 1, float(r[2])) for r in rows]
            spark.createDataFrame(full, EVENT).coalesce(1).write.mode("append").parquet(path)
        return tables.stream_of(spark, path, EVENT)

    return add


def versions(spark, path, stream, *columns):
    return sorted(tuple(r) for r in live.read_log(spark, path, stream.schema).select("batch", *columns).collect())


def at(minutes):
    return int((START - datetime.datetime(1970, 1, 1)).total_seconds()) + 60 * minutes


def test_live_bars_open_at_the_close_before_and_change_with_late_trades(spark, feed, tmp_path):
    path = f"file://{tmp_path}/out"
    stream = live.live_bars(feed([(1, 1, 10), (2, 5, 12)], [(3, 16, 20)], [(4, 14, 8)], [(5, 31, 9)]), 900, "1 hour")
    live.log_sink(stream, "update", path, keyed=True).awaitTermination()
    got = versions(spark, path, stream, "ts", "open", "high", "low", "close")
    assert got == [
        (0, at(0), 10.0, 12.0, 10.0, 12.0),
        (1, at(15), 12.0, 20.0, 12.0, 20.0),  # opens at the close of the batch before: state
        (2, at(0), 10.0, 12.0, 8.0, 8.0),  # a late trade is the last of its bar
        (2, at(15), 8.0, 20.0, 8.0, 20.0),  # so the next bar opens elsewhere
        (3, at(30), 20.0, 20.0, 9.0, 9.0),
    ]


def test_live_bars_drop_what_the_watermark_has_passed_and_go_on_after_a_restart(spark, feed, tmp_path):
    path = f"file://{tmp_path}/out"
    stream = live.live_bars(feed([(1, 1, 10)], [(2, 300, 30)], [(3, 2, 99)]), 900, "1 hour")
    live.log_sink(stream, "update", path, keyed=True).awaitTermination()
    stream = live.live_bars(feed([(4, 316, 31)]), 900, "1 hour")
    live.log_sink(stream, "update", path, keyed=True).awaitTermination()
    got = [x[1:] for x in versions(spark, path, stream, "ts", "open", "close")]
    assert got == [(at(0), 10.0, 10.0), (at(300), 10.0, 30.0), (at(315), 30.0, 31.0)]


def test_ticks_expire_as_the_stream_goes_on(spark, feed, tmp_path):
    path = f"file://{tmp_path}/out"
    # user 1 stops trading, user 3 goes on; an older trade that comes late changes nothing
    stream = live.ticks(feed([(1, 0, 1, 1), (2, 0, 2, 3)], [(3, 10, 5, 3), (4, 5, 7, 3)], [(5, 600, 6, 3)], [(6, 601, 8, 3)]), ttl_sec=900, late="1 minute")
    live.log_sink(stream, "update", path, keyed=True).awaitTermination()
    got = versions(spark, path, stream, "exchange", "live", "price")
    assert ("gateio", False, 1.0) in [x[1:] for x in got if x[0] >= 3] and ("bybit", True, 5.0) in [x[1:] for x in got if x[0] == 1]
    assert [tuple(r) for r in live.tick_table(spark, path, stream.schema).select("exchange", "price").collect()] == [("bybit", 8.0)]
    before = {x for x in children(spark, f"{path}/rows") if x.startswith("batch=")}
    live.compact(spark, path, stream.schema, through=2)
    assert len([x for x in children(spark, f"{path}/rows") if x.startswith("batch=")]) == len(before) - 2
    assert [tuple(r) for r in live.tick_table(spark, path, stream.schema).select("exchange", "price").collect()] == [("bybit", 8.0)]


def test_a_batch_writes_the_pairs_that_it_changed(spark, feed, tmp_path):
    path = f"file://{tmp_path}/out"
    stream = live.ticks(feed([(1, 0, 1, 1), (2, 0, 2, 3)], [(3, 1, 5, 3)]), ttl_sec=900)
    live.log_sink(stream, "update", path, keyed=True).awaitTermination()
    assert [x[:2] for x in versions(spark, path, stream, "exchange")] == [(0, "bybit"), (0, "gateio"), (1, "bybit")]


def test_watch_list_enters_merges_late_runs_and_leaves(spark, feed):
    # 0 and 100 are apart until 60 comes late; 400 begins anew
    rows = [(1, 0, 1)], [(2, 100, 1)], [(3, 60, 1)], [(4, 400, 1)], [(5, 2000, 1)], [(6, 9000, 1)]
    stream = live.watch_list(feed(*rows), 4200, F.lit("15m"), "1 hour")
    found = live.run_to_end(stream, keyed=True)
    got = sorted(((r.at // 1_000_000 - at(0)) // 60, r.kind, r.beats) for r in found.collect())
    assert got == [(0, "enter", None), (170, "leave", 3), (400, "enter", None), (470, "leave", 1), (2000, "enter", None), (2070, "leave", 1)]
    watched = lambda minute: live.watched_at(found, (at(0) + minute * 60) * 1_000_000).count()
    assert [watched(m) for m in (-1, 0, 169, 170, 450)] == [0, 1, 1, 0, 1]


def test_cooldown_counts_late_rows_in_order_of_time(spark, feed):
    rows = [(1, 0, 1), (2, 30, 1)], [(3, 70, 1)], [(4, 61, 1)], [(5, 125, 1)], [(6, 5000, 1)], [(7, 9000, 1)]
    found = live.run_to_end(live.latch(feed(*rows), 3600, "1 hour"), keyed=True)
    assert sorted((r.t // 1_000_000 - at(0)) // 60 for r in found.collect()) == [0, 61, 125, 5000]


def test_windows_are_emitted_once_and_too_late_rows_are_left_out(spark, feed):
    stream = live.bars(feed([(1, 1, 10)], [(2, 300, 30)], [(6, 301, 31)], [(3, 2, 99)], [(4, 900, 1)], [(5, 2000, 1)]), 900, "1 hour")
    assert sorted((r.ts, r.close) for r in live.run_to_end(stream).collect()) == [(at(0), 10.0), (at(300), 31.0), (at(900), 1.0)]


def test_odd_trades(spark, tmp_path):
    """Without a time or a price, without a number, of no pair."""
    path = f"file://{tmp_path}/in"
    rows = [(1, None, "view", 1, 5.0), (2, START, "view", 1, None), (None, START, "view", 1, 7.0), (4, START, None, None, 8.0), (5, START + datetime.timedelta(minutes=1), "view", 1, 9.0)]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(path)
    stream = lambda: tables.stream_of(spark, path, EVENT)
    found = live.run_to_end(live.live_bars(stream(), 900), "update", [*PAIR, "ts"], keyed=True)
    assert sorted((r.ticker or "", r.open, r.close, r.volume) for r in found.collect()) == [("", 8.0, 8.0, 8.0), ("VIEW/USDT", 7.0, 9.0, 16.0)]
    found = live.run_to_end(live.ticks(stream(), 900), "update", PAIR, keyed=True)
    assert sorted((r.ticker or "", r.price) for r in found.collect()) == [("", 8.0), ("VIEW/USDT", 9.0)]


def test_replay_delivers_late_rows_and_a_closing_row(spark):
    path = tables.deliver(spark.createDataFrame([(i, START + datetime.timedelta(minutes=i), "view", 1, 1.0) for i in range(100)], EVENT), 4, late_sec=3000)
    rows = spark.read.schema(EVENT).parquet(path)
    assert rows.count() == 101 and rows.where("event_id IS NULL").count() == 1
    assert len([x for x in children(spark, path) if x.endswith(".parquet")]) == 5
    assert tables.deliver(spark.createDataFrame([], EVENT), 4)
