from pyspark.sql import functions as F

from candlewright.functions import display as D
from candlewright.sources import sinks


def test_formatters(spark):
    x = F.col("x")
    rows = spark.createDataFrame([(None,), (0.0,), (float("nan"),), (950.0,), (-1234.0,), (1234567.891,), (2.5e9,), (0.00001234,), (123456789012.0,)], "x double")
    usd, compact, price = zip(*((r.a, r.b, r.c) for r in rows.select(D.usd(x).alias("a"), D.usd_compact(x).alias("b"), D.price(x).alias("c")).collect()))
    assert [usd[i] for i in (0, 1, 3, 4, 5, 6)] == ["—", "0$", "950$", "-1.2k$", "1.23M$", "2500.00M$"]
    assert list(compact) == ["n/a", "$0", "n/a", "$950", "$-1,234", "$1.2M", "$2.5B", "$0", "$123.5B"]
    assert price[0] == "–" and list(price[3:]) == [f"{v:.10g}" for v in (950.0, -1234.0, 1234567.891, 2.5e9, 0.00001234, 123456789012.0)]


def test_clocks_and_labels(spark):
    row = spark.range(1).select(D.eta(F.lit(3900.0)).alias("a"), D.eta(F.lit(1333.0), False).alias("b"), D.eta(F.lit(None).cast("double")).alias("c"), D.stamp(F.lit(-60)).alias("d")).first()
    assert tuple(row) == ("1h05m", "22:13", "?", "1969-12-31 23:59")
    assert [D.atr_label("1d", 5), D.atr_label("15m", 14, "G"), D.atr_label(None, 0)] == ["1D_ATR(5)", "15m_ATR(14)·G", "?_ATR(?)"]


def test_results_and_report(spark, tmp_path):
    one, two = spark.range(3), spark.range(2)
    path = f"file://{tmp_path}/results"
    sinks.save_results(path, 1, {"coins": one})
    sinks.save_results(path, 2, {"coins": two})
    sinks.save_results(path, 2, {"coins": two})
    assert sorted((r.run_ts, r["count"]) for r in spark.read.parquet(f"{path}/coins").groupBy("run_ts").count().collect()) == [(1, 3), (2, 2)]
    sinks.save_results(path, 3, {"coins": one}, wipe=True)
    assert spark.read.parquet(f"{path}/coins").select("run_ts").distinct().collect()[0].run_ts == 3
    sinks.write_report(spark.createDataFrame([("a", None)], "pair string, verdict string"), f"file://{tmp_path}/report")
    assert "verdict" in spark.read.json(f"file://{tmp_path}/report").columns
