"""Sources: candle files, candles derived from an event table, trades, and an event replay as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path

CANDLE = "ticker string, exchange string, ts long, open double, high double, low double, close double, volume double"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def read_candles(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Candle files as Parquet, CSV, JSON or ORC with the candle schema; columns that a file lacks are null."""
    return spark.read.format(kind).options(**options).schema(CANDLE).load(path)


def write_candles(candles: DataFrame, path: str) -> None:
    """Candles partitioned by exchange, so that readers of one exchange read only its folders."""
    candles.write.mode("overwrite").partitionBy("exchange").parquet(path)


def trades(event_rows: DataFrame) -> DataFrame:
    """Trade tape (ticker, exchange, t in microseconds, price, amount, side, event_id) of an event table."""
    side = F.when(F.col("event_type").isin("purchase", "signup"), "buy").when(F.col("event_type") == "error", "sell").otherwise("none")
    return event_rows.select(
        F.concat(F.upper("event_type"), F.lit("/USDT"), F.when(F.col("user_id") % 2 == 0, ":USDT").otherwise("")).alias("ticker"),
        F.element_at(F.array(F.lit("bybit"), F.lit("gateio"), F.lit("okx")), (F.col("user_id") % 3 + 1).cast("int")).alias("exchange"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("value").alias("price"),
        F.col("value").alias("amount"),
        side.alias("side"),
        "event_id",
    )


def candles(tape: DataFrame, step: int) -> DataFrame:
    """Tumbling bars of a tape: one aggregation, partial first; volumes are summed as decimals, so order cannot matter."""
    at = F.struct("t", "event_id")
    ts = (F.floor(F.col("t") / F.lit(1_000_000 * step)) * step).cast("long")
    return tape.groupBy("ticker", "exchange", ts.alias("ts")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("volume"),
    )


CLOSING = "2100-01-01"  # event time of the row that ends a replay


def deliver(rows: DataFrame, slices: int, late_sec: int = 0, every: int = 17, closing: bool = True) -> str:
    """Writes an event table as files in order of delivery, `slices` of them, and returns their folder.

    Every so many rows come `late_sec` after their time, in a later file if that falls there.  A closing row far ahead in a
    file of its own moves the watermark past all others.  A slice is one file, so take as many as fit in tasks.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, "events")
    late = F.when(F.col("event_id") % every == 0, F.col("t") + late_sec * 1_000_000).otherwise(F.col("t"))
    rows = rows.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("delivered", late)
    first, last = rows.agg(F.min("delivered"), F.max("delivered")).first()
    width = ((last or 0) - (first or 0)) // slices + 1
    for i in range(slices if last else 0):
        part = rows.where(F.col("delivered").between(first + i * width, first + (i + 1) * width - 1)).drop("t", "delivered")
        part.coalesce(1).write.mode("append").parquet(path)
    if closing:
        kinds = dict(rows.drop("t", "delivered").dtypes)
        row = spark.range(1).select(*(F.lit(CLOSING if x == "ts" else None).cast(t).alias(x) for x, t in kinds.items()))
        row.coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark: SparkSession, path: str, schema, each: int = 1) -> DataFrame:
    """Delivered files as a stream, `each` of them a micro-batch, with an event time that watermarks accept."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(path)
    return stream.withColumn("event_time", F.col("ts").cast("timestamp"))


def replay(spark: SparkSession, sf_dir: str, slices: int = 5, late_sec: int = 3000, closing: bool = True) -> DataFrame:
    """The event table as a stream of several micro-batches, some rows late."""
    rows = events(spark, sf_dir)
    return stream_of(spark, deliver(rows, slices, late_sec, closing=closing), rows.schema)
