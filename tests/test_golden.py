"""Small inputs with known results: repair, volatility, pumps, selection, rules, and rows with nulls, NaN and milliseconds."""

import math

import pytest
from pyspark.sql import functions as F

from candlewright.functions import scalars as S
from candlewright.operators import candles, pumps, selection, series, statistics, summary, volatility
from candlewright.plans import scans
from candlewright.sources import recorded, snapshots
from candlewright.streaming import live

BAR = "ticker string, exchange string, ts long, open double, high double, low double, close double, volume double"
DAY, QUARTER = 86400, 900
NAN = float("nan")


@pytest.fixture(scope="module")
def make(spark):
    def bars(rows, ticker="A/USDT", exchange="x"):
        """rows: (ts, open, high, low, close, volume), or (ts, close)."""
        full = [(ticker, exchange, r[0], *(r[1:] if len(r) == 6 else (r[1], r[1], r[1], r[1], 1.0))) for r in rows]
        return spark.createDataFrame(full, BAR)

    return bars


def col(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_robust_atr(make):
    base = [(i * DAY, 100.0 + i, 105.0 + i, 95.0 + i, 100.0 + i, 1.0) for i in range(6)]
    assert col(volatility.robust_atr(make(base), 5), "atr")[-1] == pytest.approx(10, abs=1)
    spike = [r if i != 4 else (r[0], r[1], 200.0, 100.0, r[4], 1.0) for i, r in enumerate(base)]
    assert 5 < col(volatility.robust_atr(make(spike), 5), "atr")[-1] < 20
    assert col(volatility.robust_atr(make(base[:1]), 5), "atr") == [0.0]
    flat = [(i * DAY, 100.0, 101.0 + (80 if i == 15 else 0), 99.0, 100.0, 1.0) for i in range(30)]
    atr = col(volatility.robust_atr(make(flat)), "atr")
    assert atr[:2] == [0.0, 0.0] and atr[-1] < 5


def test_true_range_of_odd_bars(make):
    rows = [(0, 1.0, NAN, 1.0, 1.0, 1.0), (1, 1.0, 3.0, 1.0, None, 1.0), (2, 1.0, None, 1.0, 2.0, 1.0), (3, 1.0, math.inf, 1.0, 2.0, 1.0), (4, 1.0, 5.0, 1.0, 2.0, 1.0)]
    assert col(volatility.true_range(make(rows)), "tr") == [0.0, 2.0, 0.0, 0.0, 4.0]


def test_gaps_and_fill(make):
    days = make([(d * DAY, 1.0) for d in (100, 101, 102, 105, 106, 110)])
    assert [(r.first_missing, r.last_missing) for r in series.gaps(days, DAY).orderBy("first_missing").collect()] == [(103, 104), (107, 109)]
    t = make([(0, 1.0), (QUARTER, 129.46), (4 * QUARTER, 2.0)])
    filled = series.flat_fill(t, QUARTER).where("filled").orderBy("ts").collect()
    assert [(r.ts, r.open, r.high, r.low, r.close, r.volume) for r in filled] == [(n * QUARTER, *(129.46,) * 4, 0.0) for n in (2, 3)]
    assert series.flat_fill(make([(0, 1.0), (5000 * QUARTER, 1.0)]), QUARTER).where("filled").isEmpty()


def test_dedup_and_upsert(make):
    rows = [(0, 1.0, 1.0, 1.0, 1.0, 5.0), (10, 1.0, 1.0, 1.0, 2.0, None), (20, 1.0, 1.0, 1.0, 3.0, 5.0)]
    assert col(series.dedup(make(rows), QUARTER), "close") == [3.0]
    merged = series.upsert(make([(0, 1.0), (QUARTER, 2.0), (2 * QUARTER, 3.0)]), make([(QUARTER + 5, 9.0)]), QUARTER)
    assert col(merged, "close") == [1.0, 9.0, 3.0]


def test_daily_roll_up(make):
    day = 20_000 * DAY
    quarter = make([(day, 1.5, 2.5, 1.4, 1.8, 3.0), (day + QUARTER, 1.5, 2.5, 1.4, 1.8, 3.0)])
    got = series.roll_up_day(make([(day - DAY, 1.5)]), quarter).orderBy("ts").collect()
    assert len(got) == 2 and tuple(got[1])[2:] == (day, 1.5, 2.5, 1.4, 1.8, 6.0)
    late = make([(day + QUARTER, 1.0, 2.1, 1.0, 1.0, 2.0), (day + 2 * QUARTER, 1.0, 2.2, 1.0, 1.0, 2.0)])
    (row,) = series.roll_up_day(make([(day, 1.0)]), late).collect()
    assert (row.high, row.volume) == (2.2, 4.0)
    old = series.roll_up_day(make([(day + DAY, 1.5)]), quarter).collect()
    assert [(r.ts, r.close) for r in old] == [(day + DAY, 1.5)]


def test_units_of_times(make, spark):
    now = 1_790_000_000
    assert col(candles.sanitize(make([(1_700_000_000, 1.0), (1_940_000_000, 1.0), (1000, 1.0)]), now), "ts") == [1_700_000_000]
    assert col(candles.sanitize(make([(1_780_000_000, 1.0), (1_780_086_000, 1.0), (1_786_000_000_000, 1.0)]), now), "ts") == [1_780_000_000, 1_780_086_000]
    assert col(candles.sanitize(make([(1_780_000_000_000, 1.0), (1_780_086_000_999, 1.0)]), now), "ts") == [1_780_000_000, 1_780_086_000]
    assert col(candles.sane_rows(make([(1_780_000_000_000, 1.0), (1_780_086_000, NAN), (1_780_086_001, None), (1_780_086_002, 1.0, math.inf, 1.0, 1.0, 1.0), (1_780_086_003, 1.0, 1.0, 1.0, 1 / 3, NAN)]), now), "volume") == [1.0, 0.0]
    rows = spark.createDataFrame([(x,) for x in (now - 900, now + DAY, now + 10 * DAY, 1_234_567_890, now * 1000, None)], "max_ts long")
    assert sorted(r.max_ts for r in candles.sane_summary(rows, now).collect()) == [now - 900, now + DAY]
    assert candles.sane_summary(rows.limit(0), now).count() == 0


def test_stale_spot(spark):
    now = 1_780_000_000
    rows = [("0G/USDT:USDT", "bybit", now), ("0G/USDT", "bybit", now - 41 * DAY), ("BTC/USDT", "bybit", now - 90 * DAY), ("ETH/USDT", "bybit", now), ("ETH/USDT:USDT", "bybit", now), ("0G/USDT", "gateio", now - 41 * DAY)]
    for unit in (1, 1000):
        mixed = [(t, e, ts * (unit if i % 2 else 1)) for i, (t, e, ts) in enumerate(rows)] + [("N/USDT:USDT", "bybit", None), ("N/USDT", "bybit", 5)]
        kept = summary.drop_stale_spot(spark.createDataFrame(mixed, "ticker string, exchange string, ts long"), 3 * DAY).collect()
        assert {(r.ticker, r.exchange) for r in kept} == {(t, e) for t, e, _ in mixed} - {("0G/USDT", "bybit")}


def test_stitch_tail(make):
    now = 1_780_000_450
    last = now - 30 * DAY
    source = make([((last // QUARTER + i) * QUARTER, 2.0) for i in range(5000)]).withColumn("arrival", F.lit(0))
    got = candles.stitch(make([(last, 1.0)]), source, QUARTER, now)
    assert got.where("added").count() == now // QUARTER - last // QUARTER - 1
    assert got.where(f"ts >= {now // QUARTER * QUARTER}").isEmpty() and col(got.where("NOT added"), "close") == [1.0]
    empty = make([]).withColumn("arrival", F.lit(0))
    assert candles.stitch(make([(last, 1.0)]), empty, QUARTER, now).count() == 1 and candles.requests(make([]), QUARTER, now).count() == 0


F7 = [1.0] * 6 + [5.0, 5.5, 4.0, 3.0]


def test_pumps(make):
    start = 1_750_000_000
    daily = lambda closes, highs=None: make([(start + i * DAY, c, (highs or closes)[i], c, c, 1.0) for i, c in enumerate(closes)])
    (event,) = pumps.detect(daily(F7), pumps.Scan(ratio=4.0)).collect()
    assert event.pump_pct > 300 and event.pre_max == 1.0 and event.min_price == 1.0
    assert pumps.detect(daily([1.0] * 10), pumps.Scan(ratio=4.0)).isEmpty()
    wick = [1.0] * 10
    wick[6] = 6.0
    assert pumps.detect(daily([1.0] * 10, wick), pumps.Scan(ratio=4.0)).isEmpty()
    assert pumps.detect(daily([1.0] * 10, wick), pumps.Scan(ratio=4.0, source="high_low")).count() == 1
    assert pumps.detect(daily([1.0] * 6 + [4.0] * 4), pumps.Scan(ratio=4.0)).isEmpty()
    holes = F7[:4] + [NAN] + F7[5:]
    assert pumps.detect(daily(holes), pumps.Scan(ratio=4.0)).isEmpty() and pumps.detect(daily([0.0] * 6 + F7[6:]), pumps.Scan(ratio=4.0)).isEmpty()


def test_pumps_at_several_thresholds_equal_single_scans(spark):
    bars = scans.bars(spark, "/root/testdata/sf0.001")
    many = pumps.detect_at(bars, pumps.Scan(), [4.0, 20.0])
    for t in (4.0, 20.0):
        one = pumps.detect(bars, pumps.Scan(ratio=t))
        assert sorted(map(str, one.collect())) == sorted(map(str, many.where(F.col("threshold") == t).drop("threshold").collect()))


def test_prepump(spark):
    rows = spark.createDataFrame([(1, 1.0, 4.0), (2, 4.0, 4.0), (3, None, 4.0)], "k int, pre_max double, peak_price double")
    assert sorted(r.k for r in pumps.prepump(rows, 1.0).collect()) == [1, 3]


def test_scan_configuration():
    scan = pumps.Scan.of(200, 7, 96, 1, 0.001)
    assert (scan.window, scan.ratio, scan.merge_gap, scan.pre) == (672, 3.0, 1, 96)
    assert pumps.Scan.of(300, 0.5, 1, 0.2, 5).window == 2


EVENT = "ticker string, base string, exchange string, pump_pct double, peak_ts long, start_ts long, min_price double, peak_price double, pre_max double"


def test_coin_selection(spark):
    event = lambda e, pct, ts=100 * DAY: ("A/USDT", "A", e, pct, ts, ts - DAY, 1.0, 4.0, None)
    catalog = spark.createDataFrame([("A", "bybit"), ("A", "okx")], "base string, exchange string")
    one = spark.createDataFrame([event("bybit", 350.0)], EVENT)
    assert pumps.coins_all(one, catalog, 2).isEmpty() and pumps.coins_any(one, 1).count() == 1
    assert [tuple(r) for r in pumps.selection_counts(one, catalog, 1, 2.0).collect()] == [("not_all", 1)]
    both = spark.createDataFrame([event("bybit", 350.0), event("okx", 320.0)], EVENT)
    assert pumps.coins_any(both, 2).first().min_pump_pct == 320.0 and pumps.coins_all(both, catalog, 2).count() == 1
    apart = spark.createDataFrame([event("bybit", 350.0), event("okx", 320.0, 110 * DAY)], EVENT)
    assert [tuple(r) for r in pumps.selection_counts(apart, catalog, 1, 2.0).collect()] == [("align", 1)]


def test_scores(spark):
    pick = lambda *cols: tuple(spark.range(1).select(*cols).first())
    lit = F.lit
    assert pick(*(S.score_tpm(lit(x)) for x in (0.0, 60.0, 500.0, None))) == (0.0, 0.5, 1.0, 0.0)
    assert pick(*(S.score_spread(lit(x)) for x in (3.0, 5.0, 10.0, 25.0, None))) == (1.0, 1.0, 0.5, 0.0, 0.0)
    depth = pick(*(S.score_log(lit(x), 1000.0, 50_000.0) for x in (500.0, 50_000.0, 2e6, 0.0, None)))
    assert depth == pytest.approx((0.0, 1.0, 1.0, 0.0, 0.0))
    assert pick(S.score_lerp(lit(3.0), 1.0, 5.0), S.score_lerp(lit(3.0), 1.0, 1.0)) == (0.5, 1.0)
    unknown = pick(S.goodness(*(lit(None).cast("double"),) * 1, lit(None).cast("boolean"), *(lit(None).cast("double"),) * 7))[0]
    assert tuple(unknown) == (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.5, 1.0)
    assert pick(S.growth_pct(lit(150.0), lit(100.0)), S.growth_pct(lit(100.0), lit(200.0)), S.growth_pct(lit(0.0), lit(1.0)), S.growth_pct(lit(None).cast("double"), lit(1.0))) == (50.0, -50.0, None, None)
    assert pick(S.finite(lit(NAN)), S.finite(lit(math.inf)), S.finite(lit(-math.inf)), S.finite(lit(1.5))) == (None, None, None, 1.5)
    assert pick(S.idle_sec(lit(NAN), 10)) == (None,)


def test_names(spark):
    rows = spark.createDataFrame([("btc_usdt_on_bybit",), ("btc_usdt:usdt_on_bingx",), ("btc_usdt",), (None,)], "n string")
    got = [tuple(r.p) if r.p else None for r in rows.select(S.parse_table(F.col("n")).alias("p")).collect()]
    assert got[:3] == [("BTC/USDT", "bybit", "spot"), ("BTC/USDT:USDT", "bingx", "swap"), ("BTC_USDT", "", "unknown")]
    rows = spark.createDataFrame([("btc_usdt_usdt_on_bybit",), ("doge_usdc_usdt_on_bybit",), ("a_usdt:usdt_on_okx",)], "n string")
    assert [r[0] for r in rows.select(S.perp_to_spot(F.col("n"))).collect()] == ["btc_usdt_on_bybit", None, "a_usdt_on_okx"]
    assert S.exchange_list('["OKX", " "]') == ["okx"] and S.exchange_list(" a, B,,") == ["a", "b"] and S.exchange_list("[x") == [] == S.exchange_list(None)


def test_fetch_plans(spark):
    now, step = 1_780_000_000, QUARTER
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    last = lambda behind: F.lit(now - behind * step)
    assert one(*candles.lane_start(last(2), now, step)) == (now - 3 * step, 6)
    assert one(*candles.lane_start(last(134), now, step)) == (now - 135 * step, 138)
    assert one(*candles.lane_start(last(70_000), now, step)) == one(*candles.lane_start(F.lit(None).cast("long"), now, step)) == (now - 4 * step, 5)
    assert one(*candles.lane_start(last(2), now, step, most=0)) == (now - 4 * step, 5)
    oldest, none = now - 5 * DAY, F.lit(None).cast("long")
    since = lambda o, floor, exchange=none: one(candles.prefill_since(F.lit(o), step, 100, exchange, floor))[0]
    assert since(oldest, now - 180 * DAY) == (oldest - 100 * step) * 1000
    assert since(oldest, oldest - 50 * step) == (oldest - 50 * step) * 1000 and since(oldest, oldest) is None
    assert since(oldest, 0, F.lit(oldest - step)) == (oldest - step) * 1000 and since(oldest, 0, F.lit(oldest)) is None
    assert one(candles.prefill_needed(none, 0), candles.prefill_needed(F.lit(2000), 0), candles.prefill_needed(F.lit(1800), 0)) == (False, True, False)
    action = lambda first, span: tuple(one(candles.empty_page_action(first, F.lit(10_000), step, F.lit(span)))[0])
    assert action(none, 5) == ("shrink", 2) and action(none, 1) == ("terminal", None) and action(F.lit(10_000_000), 5) == ("terminal", None) and action(F.lit(99_999_999), 3) == ("shrink", 1)


def test_retype(spark):
    rows = spark.createDataFrame([("1", "a", "True"), (" 2.5 ", "1", None), ("-", None, "0"), (None, "", "1.0")], "n string, t string, f string")
    got = summary.retype(rows, ["n", "t"], ["f"])
    assert got.dtypes == [("n", "double"), ("t", "string"), ("f", "boolean")]
    assert [r.n for r in got.collect()] == [1.0, 2.5, None, None] and [r.f for r in got.collect()] == [True, False, False, True]
    assert summary.retype(rows.limit(0), ["n", "t"], ["f"]).count() == 0


def test_recorded_answers(spark):
    rows = spark.createDataFrame([("A", "x", 0, 1, "[[1000,1,2,0.5,1.5,null],[2000,1,2,0.5,1.5,7]]"), ("A", "x", 1, 1, "[[2000,9,9,9,9,9]]"), ("A", "x", 2, 1, "not json"), ("A", "x", 3, 1, None)], "ticker string, exchange string, page long, key long, payload string")
    assert [(r.ts, r.close, r.volume) for r in candles.catch_up(recorded.ohlcv(rows)).orderBy("ts").collect()] == [(1, 1.5, None), (2, 1.5, 7.0)]
    book = rows.limit(1).withColumn("payload", F.lit('{"bids": [[1.5, 2]], "asks": null}'))
    assert [tuple(r) for r in recorded.levels(book).collect()] == [(1, "bid", 1.5, 2.0)]
    tape = rows.limit(1).withColumn("payload", F.lit('[{"timestamp": 5, "price": 1, "amount": 2, "side": "buy"}, {"timestamp": 6, "price": 1, "amount": 2}]'))
    assert [(r.t, r.side) for r in recorded.trades(tape).collect()] == [(5000, "buy"), (6000, "none")]


def test_options_and_listings(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "ticker string")
    assert sorted(tuple(r) for r in selection.options(rows).collect()) == [("a", "c", "b"), ("b", "a", "c"), ("c", "b", "a")]
    assert selection.options(rows.limit(0)).count() == 0
    assert [tuple(r) for r in selection.options(rows.limit(1)).collect()] == [("b", "b", "b")]


def test_ranked(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 5), ("c", 3), ("d", None)], "n string, v int")
    assert {r.n: r.place for r in summary.ranked(rows, "v", "n").collect()} == {"b": 1, "a": 2, "c": 3, "d": 4}


def test_size_edges():
    edges = statistics.size_edges()
    assert edges[:3] == [100.0, 110.0, 120.0] and edges[40] == 500.0 and edges[41] == 750.0 and edges[-1] == 30_000.0


def test_snapshot_without_rows(spark, tmp_path):
    snapshots.save(spark.range(0), f"file://{tmp_path}/s", 5)
    assert snapshots.load(spark, f"file://{tmp_path}/s", 5, 10).columns == ["id"] and snapshots.load(spark, f"file://{tmp_path}/s", 5, 10).count() == 0


def test_vitality_gate(spark):
    rows = spark.sql("SELECT * FROM VALUES ('A'), ('b'), (' C '), ('D'), ('F'), (''), (NULL) AS t(grade)")
    found = [tuple(r) for r in rows.select("grade", S.vitality_ok(F.col("grade"), "c"), S.vitality_ok(F.col("grade"), "")).collect()]
    assert found == [(g, g is not None and g.strip().upper() in ("A", "B", "C"), True) for g in ("A", "b", " C ", "D", "F", "", None)]


def test_zombie_verdicts(spark):
    """The rule's every branch, unknown counts and ages among them."""
    rows = spark.sql("SELECT * FROM VALUES ('prune', 10, 50, 144000D), ('keep', 90, 40, 1D), ('unknown', NULL, 5, 1D), ('unknown', 1, NULL, 1D), ('unknown', -1, 5, 1e9D), ('prune', 0, 5, NULL), ('unknown', 3, 5, NULL), ('unknown', 1, 5, double('nan')), ('keep', 5, 5, NULL), ('keep', 1, 5, 86399D) AS t(want, spot, perp, idle)")
    for r in rows.select("want", S.zombie_verdict(F.col("spot"), F.col("perp"), F.col("idle")).alias("verdict")).collect():
        assert r.want == r.verdict


def test_derived_scan():
    scan = pumps.Scan.of(200, 7, 96, 1, 0.001, short_days=2)
    assert (scan.history, scan.short) == (7 * 96 + 96, 192)
    assert pumps.Scan.of(200, 7, 1, 1, 1).short == 2


def test_stitch_grows_with_its_rows(spark):
    """200,000 bars of one pair: frames that end at a partition's end would take their square."""
    import time

    n = 200_000
    rows = spark.range(n).select(F.lit("A").alias("ticker"), F.lit("x").alias("exchange"), (F.col("id") * QUARTER).alias("ts"), *(F.lit(1.0).alias(x) for x in ("open", "high", "low", "close", "volume")), F.lit(1).alias("arrival"))
    began = time.time()
    found = candles.stitch(rows.where(f"ts div {QUARTER} % 3 > 0"), rows, QUARTER, n * QUARTER)
    got = found.groupBy("added").count().collect()
    assert {r.added: r["count"] for r in got} == {False: n - (n + 2) // 3, True: (n + 2) // 3 - 1}
    assert time.time() - began < 30
