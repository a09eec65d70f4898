"""The candle store and its jobs, results in one commit, paged answers, unions of many tables."""

import json

import pytest
from pyspark.sql import functions as F

from candlewright.operators import summary
from candlewright.sources import paged, sinks, store
from candlewright.storage import children, create, exists, listed, move, purge
from candlewright.streaming import live

DAY = 86400
START = 1704067200  # 2024-01-01
BAR = "ticker string, exchange string, ts long, open double, high double, low double, close double, volume double"


def rows(spark, *pairs, days=range(100)):
    return spark.createDataFrame([(t, e, START + d * DAY, 1.0, 1.0, 1.0, 1.0, float(d)) for t, e in pairs for d in days], BAR)


@pytest.fixture()
def kept(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.put(rows(spark, ("A/USDT", "okx"), ("A/USDT:USDT", "okx"), ("B%5/USDT", "bybit")), path)
    return path


def files(spark, path, *where):
    return {name for folder in store.months(spark, path).where(*where).collect() for name, _, _ in listed(spark, f"{path}/live/{folder.folder}")}


def count(spark, path, where="live"):
    return {(r.ticker, r.exchange): r["count"] for r in store.read(spark, path, where).groupBy("ticker", "exchange").count().collect()}


def test_folders_have_the_pairs_names(spark, kept):
    found = store.months(spark, kept)
    assert {(r.ticker, r.exchange) for r in found.collect()} == {("A/USDT", "okx"), ("A/USDT:USDT", "okx"), ("B%5/USDT", "bybit")}
    for r in found.collect():
        assert r.folder == f"{store.folder_of(r.ticker, r.exchange)}/month={r.month}"
    assert set(count(spark, kept)) == {("A/USDT", "okx"), ("A/USDT:USDT", "okx"), ("B%5/USDT", "bybit")}


def test_retention_touches_the_border_only(spark, kept):
    before = files(spark, kept, "month > 202402")
    now = START + 120 * DAY
    assert store.retain(spark, kept, now, 75)  # the cut is in the middle of February
    assert store.read(spark, kept).agg(F.min("ts")).first()[0] == now - 75 * DAY
    assert files(spark, kept, "month > 202402") == before
    assert {r.month for r in store.months(spark, kept).collect()} == {202402, 202403, 202404}
    border = files(spark, kept, "month = 202402")
    assert not store.retain(spark, kept, now + 3600, 10)  # not due
    assert store.retain(spark, kept, now + DAY, 76) and files(spark, kept, "month = 202402") == border  # nothing older there


def test_a_rewrite_that_broke_off_is_finished_by_the_next(spark, kept, monkeypatch):
    calls = []

    def breaks(s, old, new):
        calls.append(old)
        if len(calls) == 2:
            raise OSError("lost")
        return move(s, old, new)

    monkeypatch.setattr(store, "move", breaks)
    with pytest.raises(OSError):
        store.retain(spark, kept, START + 120 * DAY, 75)
    monkeypatch.setattr(store, "move", move)
    assert store.retain(spark, kept, START + 120 * DAY, 75)
    assert set(count(spark, kept).values()) == {55}
    assert not children(spark, f"{kept}/aside")


def test_sweep_rewrites_what_changed(spark, kept):
    assert store.sweep(spark, kept, START, DAY, days=10_000)["folders"] == 12
    store.put(rows(spark, ("A/USDT", "okx"), days=range(40, 42)).withColumn("volume", F.lit(0.0)), kept)
    before = files(spark, kept, "month <> 202402 OR exchange <> 'okx'")
    assert store.sweep(spark, kept, START + 60, DAY) == {"ran": False, "folders": 0}
    assert store.sweep(spark, kept, START + 7200, DAY, days=10_000)["folders"] == 1
    assert files(spark, kept, "month <> 202402 OR exchange <> 'okx'") >= before - files(spark, kept, "month = 202402")
    assert store.months(spark, kept).where("files > 1").count() == 0 and set(count(spark, kept).values()) == {100}
    assert store.sweep(spark, kept, START + 20_000, DAY, days=10_000)["folders"] == 0


def test_park_restore_purge_and_drop(spark, kept):
    plan = lambda action, *pairs: spark.createDataFrame([(*p, action) for p in pairs], "ticker string, exchange string, action string")
    a, b = ("A/USDT", "okx"), ("B%5/USDT", "bybit")
    store.apply(spark, kept, plan("park", a, b, ("NONE", "okx")), START)
    assert set(count(spark, kept)) == {("A/USDT:USDT", "okx")} and set(count(spark, kept, "parked")) == {a, b}
    store.apply(spark, kept, plan("restore", a), START)
    store.apply(spark, kept, plan("purge", b), START)
    store.apply(spark, kept, plan("purge", a), START)  # it is not parked any more
    assert count(spark, kept)[a] == 100 and b not in count(spark, kept) and not count(spark, kept, "parked")
    assert store.repair(spark, kept) == 0
    store.apply(spark, kept, plan("drop", a), START)
    assert a not in count(spark, kept)
    assert store.ledger(spark, kept).where("done").count() == 7


def test_a_plan_that_broke_off_is_repaired(spark, kept, monkeypatch):
    a, b = ("A/USDT", "okx"), ("B%5/USDT", "bybit")
    monkeypatch.setattr(store, "move", lambda s, old, new: move(s, old, new) if "okx" in old else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.apply(spark, kept, spark.createDataFrame([(*a, "park"), (*b, "park")], "ticker string, exchange string, action string"), START)
    assert store.ledger(spark, kept).where("NOT done").count() == 2
    monkeypatch.setattr(store, "move", move)
    assert store.repair(spark, kept) == 2 and set(count(spark, kept, "parked")) == {a, b}


def test_a_page_opens_the_months_it_needs(spark, kept):
    found = store.page(spark, kept, START + 70 * DAY, 5)  # March has ten days before that
    assert {tuple(r) for r in found.groupBy("ticker").agg(F.count("*"), F.max("ts")).select("count(1)", "max(ts)").collect()} == {(5, START + 69 * DAY)}
    assert {f.rsplit("month=")[1][:6] for f in found.inputFiles()} == {"202403"}
    deep = store.page(spark, kept, START + 70 * DAY, 30)
    assert {f.rsplit("month=")[1][:6] for f in deep.inputFiles()} == {"202403", "202402", "202401"} and deep.count() == 90
    assert store.page(spark, kept, START, 30).count() == 0 and store.page(spark, f"{kept}-none", START, 5).count() == 0


def test_results_are_published_at_once(spark, tmp_path):
    path, one, two = f"file://{tmp_path}/results", spark.range(3), spark.range(2)
    assert sinks.read_results(spark, path, "coins") is None
    sinks.save_results(path, 1, {"coins": one, "events": two})
    with pytest.raises(Exception, match="lost"):
        sinks.save_results(path, 2, {"coins": one, "events": two.select(F.raise_error(F.lit("lost")).alias("id"))})
    assert exists(spark, f"{path}/coins/run_ts=2") and sinks.published(spark, path) == [1]
    sinks.save_results(path, 2, {"coins": two, "events": two})
    assert sorted(map(tuple, sinks.read_results(spark, path, "coins").groupBy("run_ts").count().collect())) == [(1, 3), (2, 2)]
    assert sinks.read_results(spark, path, "coins", runs=1).count() == 2
    create(spark, f"{path}/_published/3", json.dumps({"tables": [], "wipe": True}))  # a wipe whose files have not followed
    assert sinks.published(spark, path) == [3] and sinks.read_results(spark, path, "coins") is None


def pages(rows, limit):
    """A fetcher over rows that counts what it was asked."""
    asked = []

    def fetch(ticker, exchange, since, n):
        asked.append(since)
        if ticker == "BAD" and len(asked) > 1:
            raise TimeoutError("slow")
        return [[ts * 1000, 1, 2, 0.5, 1, None] for ts in rows if ts >= since][:n]

    return fetch, asked


def test_pages_overlap_and_fail():
    times = [100, 200, 300, 400, 900]
    fetch, asked = pages(times, 2)
    got = list(paged.pages(paged.Span("A", "x", 100, 1000), fetch, 100, 2))
    assert [r[2] for r in got] == times and asked == [100, 200, 300, 400, 900]
    fetch, asked = pages(times, 3)
    got = list(paged.pages(paged.Span("BAD", "x", 100, 1000), fetch, 100, 3))
    assert [(r[2], r[-1]) for r in got] == [(100, None), (200, None), (300, None), (300, "TimeoutError: slow")]
    fetch, asked = pages(times, 1)  # pages of one bar
    assert [r[2] for r in paged.pages(paged.Span("A", "x", 150, 400), fetch, 100, 1)] == [200, 300]


def test_paged_source_needs_one_way_to_fetch(spark):
    with pytest.raises(ValueError):
        paged.Reader({"pairs": "[]", "since": "0", "until": "1"})
    with pytest.raises(ValueError):
        paged.Reader({"pairs": "[]", "since": "0", "pages": "x"}).partitions()
    assert len(paged.Reader({"pairs": '[["A", "x"]]', "since": "0", "until": "1000", "step": "10", "span": "30", "pages": "x"}).partitions()) == 4


def test_paged_stream_goes_on_from_its_offset(spark, tmp_path):
    recorded, out = f"file://{tmp_path}/pages", f"file://{tmp_path}/out"
    paged.record(rows(spark, ("A", "okx"), ("B", "okx"), days=range(30)), recorded)
    options = {"pairs": json.dumps([["A", "okx"], ["B", "okx"]]), "since": START, "step": DAY, "limit": 4, "span": 7, "pages": recorded}
    for until in (START + 10 * DAY, START + 10 * DAY, START + 20 * DAY):
        stream = paged.reader(spark, True, until=until, **options).load()
        live.log_sink(stream, "append", out).awaitTermination()
    found = live.read_log(spark, out, stream.schema)
    assert found.count() == 40 and found.select("ticker", "ts").distinct().count() == 40


def test_union_of_many_small_tables(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "tables").mkdir()
    for i in range(2000):
        amount = pa.array([float(i)]) if i % 3 else pa.array([f"n/a {i}"])
        columns = {"id": pa.array([i]), "amount": amount} | ({"name": pa.array(["x"])} if i % 2 else {})
        pq.write_table(pa.table(columns), tmp_path / f"tables/t{i}.parquet")
    found = summary.union_files(spark, f"file://{tmp_path}/tables")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 4 and len([x for x in plan.split("\n") if x.strip()]) < 20
    assert dict(found.dtypes)["amount"] == "string"
    got = found.agg(F.count("*"), F.sum("id"), F.count("name"), F.count_if(F.col("amount").startswith("n/a"))).first()
    assert tuple(got) == (2000, 1999 * 1000, 1000, 667)


def test_purge_deletes_scratch_tables(spark):
    from candlewright.storage import fresh_path, materialise

    path = fresh_path(spark, "x")
    spark.range(1).write.parquet(path)
    materialise(spark.range(2), "y")
    purge(spark)
    assert not exists(spark, path)
