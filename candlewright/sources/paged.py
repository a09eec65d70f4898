"""Paged answers of exchanges as a Spark data source: candles by pair and range, in a batch or as a stream.

An exchange answers a request for bars with a page of at most `limit` bars from a time on.  The source asks for page after
page, each from the last bar of the one before, so that pages overlap by a bar; a bar that comes again counts once, as it
first came.  A partition is a pair and a range of time.  A page that fails ends its partition's range with a row that
says so (`error`), and bars that came before it stay.

Options: pairs (JSON, [[ticker, exchange], ...]), since, until (seconds; until is exclusive, and a stream without it
reads up to the last closed bar), step (seconds of a bar), limit
(bars of a page), span (bars of a partition), and either pages (a folder of recorded pages,
see `record`) or fetch ("module:function", called with ticker, exchange, since, limit; returns rows [ms, open, high, low,
close, volume]).  A stream's offset is the time up to which pairs have been read.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "ticker string, exchange string, ts long, open double, high double, low double, close double, volume double, page int, error string"


def record(bars: DataFrame, path: str) -> None:
    """Bars as a folder of recorded pages: files by pair, sorted by time, which a page's request reads in part."""
    rows = bars.select("ticker", "exchange", "ts", "open", "high", "low", "close", "volume")
    pair = F.concat_ws("|", "ticker", "exchange")
    rows.withColumn("pair", F.md5(pair)).repartition("pair").sortWithinPartitions("pair", "ts").write.partitionBy("pair").parquet(path)


class Span(InputPartition):
    def __init__(self, ticker: str, exchange: str, since: int, until: int) -> None:
        self.ticker, self.exchange, self.since, self.until = ticker, exchange, since, until


def recorded(path: str) -> Callable:
    """Pages from a folder of recorded ones, by any file system that Arrow opens."""

    def fetch(ticker: str, exchange: str, since: int, limit: int) -> list:
        import hashlib

        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        pair = hashlib.md5(f"{ticker}|{exchange}".encode(), usedforsecurity=False).hexdigest()
        system, root = fs.FileSystem.from_uri(path)
        folder = f"{root}/pair={pair}"
        if system.get_file_info(folder).type == fs.FileType.NotFound:
            raise LookupError("unknown pair")
        rows = ds.dataset(folder, filesystem=system, format="parquet").scanner(filter=ds.field("ts") >= since, columns=["ts", "open", "high", "low", "close", "volume"]).head(limit)
        return [[ts * 1000, *rest] for ts, *rest in zip(*(x.to_pylist() for x in rows.columns))]

    return fetch


def pages(part: Span, fetch: Callable, step: int, limit: int) -> Iterator[tuple]:
    """Rows of SCHEMA of a partition, page after page."""
    at, last, number = part.since, None, 0
    while at < part.until:
        try:
            rows = fetch(part.ticker, part.exchange, at, limit)
        except Exception as e:  # a page's failure is an answer as well
            yield part.ticker, part.exchange, at, None, None, None, None, None, number, f"{type(e).__name__}: {e}"
            return
        for ms, *rest in rows:
            ts = int(ms) // 1000
            if ts < part.until and ts >= part.since and (last is None or ts > last):
                last = ts
                yield part.ticker, part.exchange, ts, *(None if x is None else float(x) for x in rest[:5]), number, None
        newest = max((int(r[0]) // 1000 for r in rows), default=at)
        if len(rows) < limit or newest <= at:
            if newest <= at and len(rows) >= limit:
                at += step  # a page of one bar: the next bar on
                number += 1
                continue
            return
        at, number = newest, number + 1


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.pairs = json.loads(options["pairs"])
        self.since, self.until = int(options["since"]), int(options["until"]) if "until" in options else None
        self.step, self.limit = int(options.get("step", "900")), int(options.get("limit", "500"))
        self.span = int(options.get("span", "40000")) * self.step
        self.where, self.how = options.get("pages"), options.get("fetch")
        if bool(self.where) == bool(self.how):
            raise ValueError("either pages or fetch must be given")

    def spans(self, since: int, until: int) -> list[Span]:
        return [Span(t, e, at, min(at + self.span, until)) for t, e in self.pairs for at in range(since, until, self.span)]

    def partitions(self) -> list[Span]:
        if self.until is None:
            raise ValueError("a batch needs until")
        return self.spans(self.since, self.until)

    def read(self, partition: Span) -> Iterator[tuple]:
        if self.where:
            fetch = recorded(self.where)
        else:
            module, _, name = self.how.partition(":")
            fetch = getattr(importlib.import_module(module), name)
        return pages(partition, fetch, self.step, self.limit)


class StreamReader(Reader, DataSourceStreamReader):
    """A micro-batch is what has come since the last offset; a restarted query goes on from its checkpoint's offset."""

    def initialOffset(self) -> dict:
        return {"ts": self.since}

    def latestOffset(self) -> dict:
        return {"ts": max(self.since, int(time.time()) // self.step * self.step if self.until is None else self.until)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.spans(start["ts"], end["ts"])

    def commit(self, end: dict) -> None:
        pass


class PagedCandles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def reader(spark, stream: bool = False, **options):
    """spark.read (or readStream) of the source with its options."""
    spark.dataSource.register(PagedCandles)
    out = (spark.readStream if stream else spark.read).format("paged_candles")
    return out.options(**{k: str(v) for k, v in options.items()})
