"""Recorded answers of exchanges as JSON payloads: pages of bars, books, trades, funding and open interest.

A collector's fetches are files here: each row has the pair and the answer as text, so any store that Spark reads can
replay them, in a batch or as a stream.  Fields that an answer lacks are null; an answer that does not parse gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "kind string, ticker string, exchange string, key long, page long, fetched long, payload string"


def read_answers(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of JSON (ANSWER) as a table or, file by file, as a stream."""
    return (spark.readStream if stream else spark.read).schema(ANSWER).json(path)


def ohlcv(answers: DataFrame) -> DataFrame:
    """(pair, page, place, ts_ms, open, high, low, close, volume) of pages [[ms, open, high, low, close, volume], ...]."""
    rows = answers.select("ticker", "exchange", "page", F.posexplode(F.from_json("payload", "array<array<double>>")).alias("place", "r"))
    return rows.select("ticker", "exchange", "page", "place", F.col("r")[0].cast("long").alias("ts_ms"), *(F.get("r", F.lit(i)).alias(x) for i, x in enumerate(("open", "high", "low", "close", "volume"), 1)))


def levels(answers: DataFrame) -> DataFrame:
    """(key, side, price, amount) of books {"bids": [[price, amount], ...], "asks": ...}."""
    book = F.from_json("payload", "bids array<array<double>>, asks array<array<double>>")
    side = lambda name, field: F.transform(F.coalesce(book[field], F.array()), lambda x: F.struct(F.lit(name).alias("side"), x[0].alias("price"), x[1].alias("amount")))
    return answers.select("key", F.inline(F.concat(side("bid", "bids"), side("ask", "asks"))))


def trades(answers: DataFrame) -> DataFrame:
    """(pair, t in microseconds, price, amount, side) of tapes [{"timestamp": ms, "price", "amount", "side"}, ...]."""
    rows = answers.select("ticker", "exchange", F.inline(F.from_json("payload", "array<struct<timestamp:bigint,price:double,amount:double,side:string>>")))
    return rows.select("ticker", "exchange", (F.col("timestamp") * 1000).alias("t"), "price", "amount", F.coalesce("side", F.lit("none")).alias("side"))


def funding(answers: DataFrame) -> DataFrame:
    """(pair, ts in seconds, ts_ms, rate) of {"timestamp": ms, "fundingRate"}."""
    rows = answers.select("ticker", "exchange", F.from_json("payload", "timestamp bigint, fundingRate double").alias("f")).where("f.timestamp IS NOT NULL")
    return rows.select("ticker", "exchange", F.floor(F.col("f.timestamp") / 1000).cast("long").alias("ts"), F.col("f.timestamp").alias("ts_ms"), F.col("f.fundingRate").alias("rate"))


def open_interest(answers: DataFrame) -> DataFrame:
    """(pair, open_interest, oi_ts in seconds) of {"openInterestAmount", "timestamp": ms}."""
    rows = answers.select("ticker", "exchange", F.from_json("payload", "openInterestAmount double, timestamp bigint").alias("f"))
    return rows.select("ticker", "exchange", F.col("f.openInterestAmount").alias("open_interest"), F.floor(F.col("f.timestamp") / 1000).cast("long").alias("oi_ts"))
