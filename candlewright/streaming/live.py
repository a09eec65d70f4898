"""Streams: watermarked bars, live bars, keyed ticks, trailing tape windows, watch lists, cooldowns, and their sinks.

Windows run in append mode: a window is emitted once the watermark has passed it, and its state goes then.  What windows
cannot say has state by key (transformWithState) with timers on the watermark, so time is the stream's own: nothing
here reads a clock.  Rows are combined in the tasks that read them before they are dealt by key, so that a pair with most
of the trades sends a few rows a batch.  State of a key is bounded by the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.series import PAIR, by_pair, upsert
from ..sources.tables import CLOSING, trades
from ..storage import children, conf, delete, fresh_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(stream: DataFrame, mode: str, put: Callable[[DataFrame, int], None], checkpoint: str, keyed: bool = False) -> StreamingQuery:
    """Starts a stream over what is there; keyed: with the state store that keyed state needs."""
    with conf(stream.sparkSession, **{"spark_sql_streaming_stateStore_providerClass": ROCKS} if keyed else {}):
        return stream.writeStream.outputMode(mode).foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def log_sink(stream: DataFrame, mode: str, path: str, keyed: bool = False) -> StreamingQuery:
    """A folder of rows for each micro-batch under path/rows; one that runs again replaces its own."""
    return start(stream, mode, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}"), f"{path}/state", keyed)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a log with the number of their micro-batch."""
    whole = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long")).schema
    there = any(x.startswith("batch=") for x in children(spark, f"{path}/rows"))
    return spark.read.schema(whole).parquet(f"{path}/rows") if there else spark.createDataFrame([], whole)


def run_to_end(stream: DataFrame, mode: str = "append", key: list[str] | None = None, keyed: bool = False) -> DataFrame:
    """Runs a stream over what is there and returns its rows from the shared folder, not through the driver.

    Update mode: of each key the row of the newest micro-batch.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    log_sink(stream, mode, path, keyed).awaitTermination()
    delete(spark, f"{path}/state")
    rows = read_log(spark, path, stream.schema)
    return newest(rows, key) if key else rows.drop("batch")


def newest(log: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the last row of a log."""
    rest = [x for x in log.columns if x not in (*key, "batch")]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


def tape_of(stream: DataFrame, late: str) -> DataFrame:
    """Trades of an event stream with a watermark; the row that closes a replay moves it and goes."""
    tape = trades(stream.withColumn("ts", F.col("event_time"))).withColumn("event_time", F.timestamp_micros("t")).withWatermark("event_time", late)
    return tape.where(F.col("event_time") < F.lit(CLOSING).cast("timestamp"))


def combined(stream: DataFrame, late: str, columns: list, combine, kind: str) -> DataFrame:
    """Trades of an event stream combined by task before they are dealt, with a watermark.

    combine takes a pandas frame of `columns` to one with fewer rows, of schema `kind`, whose column t (microseconds) is
    the row's event time.  The row that closes a replay passes by it, moves the watermark and goes.  Trades without a time
    are left out, as are those without a price where prices are asked for.
    """
    names = [x.split()[0] for x in kind.split(", ")]
    ahead = F.unix_micros(F.lit(CLOSING).cast("timestamp"))
    rows = trades(stream.withColumn("ts", F.col("event_time"))).withColumn("event_id", F.coalesce("event_id", F.lit(-1)))
    rows = rows.select(*columns, (F.col("t") >= ahead).alias("_ahead")).where("t IS NOT NULL")
    if "price" in rows.columns:
        rows = rows.where("price IS NOT NULL OR _ahead")

    def task(frames):
        for frame in frames:
            far = frame["_ahead"].astype(bool)
            if far.any():
                yield frame[far].reindex(columns=names)
            if not far.all():
                yield combine(frame[~far].drop(columns="_ahead"))[names]

    out = rows.mapInPandas(task, kind).withColumn("event_time", F.timestamp_micros("t")).withWatermark("event_time", late)
    return out.where(F.col("event_time") < F.lit(CLOSING).cast("timestamp"))


def bars(stream: DataFrame, step: int, late: str = "1 hour") -> DataFrame:
    """Tumbling bars of an event stream with an event_time, each emitted once the watermark has passed it."""
    at = F.struct("t", "event_id")
    out = tape_of(stream, late).groupBy(*PAIR, F.window("event_time", f"{step} seconds").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("volume"),
    )
    return out.select(*PAIR, F.unix_seconds("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def opened_at_close(bars: DataFrame) -> DataFrame:
    """Stored bars as live ones: each opens at the close of the one before, and its range includes that; the first keeps
    its own open."""
    before = F.coalesce(F.lag("close").over(by_pair()), F.col("open"))
    out = bars.withColumn("open", before)
    return out.withColumn("high", F.greatest("high", "open")).withColumn("low", F.least("low", "open"))


def _stateful(rows: DataFrame, key: list[str], processor, kind: str, mode: str) -> DataFrame:
    return rows.groupBy(*key).transformWithStateInPandas(processor, kind, mode, "EventTime")


def live_bars(stream: DataFrame, step: int, late: str = "1 hour") -> DataFrame:
    """(pair, ts, open, high, low, close, volume) in update mode: bars as they form, each opening at the close before.

    A bar is emitted again when a trade changes it, or when a late trade changes the close before it.  The state of a pair
    is the bars that the watermark has not passed and the last close before them; trades of bars behind it are dropped.
    Tasks send one row for each bar and batch of trades.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    kind = "ticker string, exchange string, bar long, t0 long, id0 long, open double, t long, id1 long, close double, high double, low double, cents long"
    own = kind.split("exchange string, ")[1]
    fields = [x.split()[0] for x in own.split(", ")]
    out_names = [*PAIR, "ts", "open", "high", "low", "close", "volume"]
    state = "based boolean, base double, " + ", ".join(f"{a} array<{'bigint' if b == 'long' else b}>" for a, b in (x.split() for x in own.split(", ")))

    def combine(frame):
        frame = frame.sort_values(["t", "event_id"])
        groups = frame.groupby([*PAIR, "bar"], sort=False, dropna=False)
        found = groups.agg(
            t0=("t", "first"), id0=("event_id", "first"), open=("price", "first"), t=("t", "last"), id1=("event_id", "last"), close=("price", "last"),
            high=("price", "max"), low=("price", "min"), cents=("cents", "sum"),
        )
        return found.reset_index()

    def merge(a: dict, b: dict) -> dict:
        first, last = (a if (a["t0"], a["id0"]) <= (b["t0"], b["id0"]) else b), (a if (a["t"], a["id1"]) >= (b["t"], b["id1"]) else b)
        return {
            "bar": a["bar"], "t0": first["t0"], "id0": first["id0"], "open": first["open"], "t": last["t"], "id1": last["id1"], "close": last["close"],
            "high": max(a["high"], b["high"]), "low": min(a["low"], b["low"]), "cents": a["cents"] + b["cents"],
        }

    class Bars(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("bars", state)

        def handleInputRows(self, key, rows, timerValues):
            passed = timerValues.getCurrentWatermarkInMs()
            based, base, *columns = self.state.get() if self.state.exists() else (False, None, *([] for _ in fields))
            known = {x[0]: dict(zip(fields, x)) for x in zip(*columns)}
            touched = set()
            for frame in rows:
                for row in frame[fields].to_dict("records"):
                    if (row["bar"] + step) * 1000 > passed:
                        known[row["bar"]] = merge(known[row["bar"]], row) if row["bar"] in known else row
                        touched.add(row["bar"])
            before, again, out = (base if based else None), False, []
            for ts in sorted(known):
                x = known[ts]
                if ts in touched or again:
                    start = x["open"] if before is None else before
                    out.append((*key, ts, start, max(x["high"], start), min(x["low"], start), x["close"], x["cents"] / 100))
                again, before = ts in touched, x["close"]
            for ts in sorted(known):
                if (ts + step) * 1000 <= passed:
                    based, base = True, known.pop(ts)["close"]
            kept = [known[ts] for ts in sorted(known)]
            self.state.update((based, base, *([x[f] for x in kept] for f in fields)))
            yield pd.DataFrame(out, columns=out_names)

        def close(self) -> None:
            pass

    bar = (F.floor(F.col("t") / F.lit(1_000_000 * step)) * step).cast("long").alias("bar")
    cents = F.coalesce((F.col("amount").cast("decimal(18,2)") * 100).cast("long"), F.lit(0)).alias("cents")
    rows = combined(stream, late, [*PAIR, bar, "t", "event_id", "price", cents], combine, kind)
    return _stateful(rows, PAIR, Bars(), "ticker string, exchange string, ts long, open double, high double, low double, close double, volume double", "update")


def ticks(stream: DataFrame, ttl_sec: int, late: str = "1 hour") -> DataFrame:
    """(pair, live, price, t) in update mode: the newest trade of a pair when it changes, and live = false once the stream's
    time is four times the TTL beyond it.  State is one trade a pair, and goes with it."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    wait = 4 * ttl_sec * 1000

    def combine(frame):
        return frame.sort_values(["t", "event_id"]).groupby(PAIR, sort=False, dropna=False).tail(1)

    class Ticks(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("tick", "t bigint, event_id bigint, price double")

        def handleInputRows(self, key, rows, timerValues):
            old = self.state.get() if self.state.exists() else None
            found = [(int(t), int(i), float(p)) for frame in rows for t, i, p in zip(frame["t"], frame["event_id"], frame["price"])]
            new = max(found)
            if (old is None or new[:2] > tuple(old)[:2]) and new[0] // 1000 + wait >= timerValues.getCurrentWatermarkInMs():
                if old is not None:
                    self.handle.deleteTimer(old[0] // 1000 + wait)
                self.handle.registerTimer(new[0] // 1000 + wait)
                self.state.update(new)
                yield pd.DataFrame([(*key, True, new[2], new[0])], columns=[*PAIR, "live", "price", "t"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                t, _, price = self.state.get()
                self.state.clear()
                yield pd.DataFrame([(*key, False, price, t)], columns=[*PAIR, "live", "price", "t"])

        def close(self) -> None:
            pass

    rows = combined(stream, late, [*PAIR, "t", "event_id", "price"], combine, "ticker string, exchange string, t long, event_id long, price double")
    return _stateful(rows, PAIR, Ticks(), "ticker string, exchange string, live boolean, price double, t long", "update")


def tick_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The live rows of a log of ticks: a batch writes the pairs that it changed, and readers take each pair's last."""
    parts = newest(read_log(spark, path, schema), PAIR)
    return parts.where("live").drop("live")


def compact(spark: SparkSession, path: str, schema, through: int) -> None:
    """Rewrites the log's batches up to a number as one; a reader finds the old folders or the new one.

    The new folder is written aside and takes the last batch's place; the others hold nothing newer, so they go after.
    """
    from ..storage import move

    numbers = sorted(int(x.split("=")[1]) for x in children(spark, f"{path}/rows") if x.startswith("batch="))
    old = [n for n in numbers if n <= through]
    if len(old) < 2:
        return
    log = read_log(spark, path, schema).where(F.col("batch") <= through)
    rest = [x for x in log.columns if x not in (*PAIR, "batch")]
    last = log.groupBy(*PAIR).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*PAIR, "r.*").where("live")
    aside = f"{path}/aside-{through}"
    last.write.mode("overwrite").parquet(aside)
    delete(spark, f"{path}/rows/batch={old[-1]}")
    move(spark, aside, f"{path}/rows/batch={old[-1]}")
    for n in old[:-1]:
        delete(spark, f"{path}/rows/batch={n}")


def live_rows(ticks: DataFrame, now_us: int, stale_us: int = 30_000_000) -> DataFrame:
    """Ticks with their age in seconds and whether they are stale, at the time of a reader."""
    return ticks.withColumn("age", (F.lit(now_us) - F.col("t")) / 1e6).withColumn("stale", F.lit(now_us) - F.col("t") > stale_us)


def trailing(stream: DataFrame, window_sec: int = 300, every_sec: int = 60, late: str = "1 hour") -> DataFrame:
    """(pair, end, trades a minute, signed flow) of the window before each step, from windows that overlap."""
    money = (F.col("price") * F.col("amount")).cast("decimal(18,4)")
    signed = F.when(F.col("side") == "buy", money).when(F.col("side") == "sell", -money).otherwise(F.lit(0).cast("decimal(18,4)"))
    windows = F.window("event_time", f"{window_sec} seconds", f"{every_sec} seconds").alias("w")
    out = tape_of(stream, late).groupBy(*PAIR, windows).agg((F.count(F.lit(1)) / (window_sec / 60.0)).alias("tpm"), F.sum(signed).cast("double").alias("cvd"))
    return out.select(*PAIR, F.unix_seconds("w.end").alias("end"), "tpm", "cvd")


def watch_list(stream: DataFrame, ttl_sec: int, timeframe, late: str = "1 hour") -> DataFrame:
    """(pair, timeframe, kind, at, beats): enter and leave events of a watch list by pair and timeframe, in append mode.

    A publication keeps a pair on the list for the TTL.  An entry is final once the watermark has passed its start, and a
    pair leaves when the watermark passes its last publication by the TTL; timers wake both.  Tasks send runs of
    publications (first, last, count), which combine to longer ones; state is the runs that are not over.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    ttl = ttl_sec * 1_000_000
    key = [*PAIR, "timeframe"]

    def combine(frame):
        frame = frame.sort_values([*key, "t"])
        start = (frame[key] != frame[key].shift()).any(axis=1) | (frame["t"].diff() >= ttl)
        runs = frame.groupby(start.cumsum())
        return runs.agg(ticker=("ticker", "first"), exchange=("exchange", "first"), timeframe=("timeframe", "first"), first=("t", "first"), t=("t", "last"), beats=("t", "size"))

    class Watched(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("runs", "timer bigint, first array<bigint>, last array<bigint>, beats array<bigint>, entered array<boolean>")

        def step(self, key, new, passed, fired=False):
            timer, *old = self.state.get() if self.state.exists() else (-1, [], [], [], [])
            timer = -1 if fired else timer
            runs, out = [], []
            for first, last, beats, entered in sorted([*zip(*old), *new]):
                if runs and first - runs[-1][1] < ttl:
                    a = runs[-1]
                    runs[-1] = [a[0], max(a[1], last), a[2] + beats, a[3] or entered]
                else:
                    runs.append([first, last, beats, entered])
            for run in runs:
                if not run[3] and run[0] // 1000 < passed:
                    run[3] = True
                    out.append((*key, "enter", run[0], None))
                if (run[1] + ttl) // 1000 < passed:
                    out.append((*key, "leave", run[1] + ttl, run[2]))
            runs = [x for x in runs if (x[1] + ttl) // 1000 >= passed]
            due = min(((x[1] + ttl if x[3] else x[0]) // 1000 for x in runs), default=-1)
            if timer >= 0 and timer != due:
                self.handle.deleteTimer(timer)
            if runs:
                if due != timer:
                    self.handle.registerTimer(due)
                self.state.update((due, *([x[i] for x in runs] for i in range(4))))
            elif self.state.exists():
                self.state.clear()
            return pd.DataFrame(out, columns=[*PAIR, "timeframe", "kind", "at", "beats"]).astype({"beats": "Int64"})

        def handleInputRows(self, key, rows, timerValues):
            new = [(int(a), int(b), int(n), False) for x in rows for a, b, n in zip(x["first"], x["t"], x["beats"])]
            yield self.step(key, new, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield self.step(key, [], timerValues.getCurrentWatermarkInMs(), fired=True)

        def close(self) -> None:
            pass

    rows = combined(stream, late, [*PAIR, timeframe.alias("timeframe"), "t"], combine, "ticker string, exchange string, timeframe string, first long, t long, beats long")
    return _stateful(rows, key, Watched(), "ticker string, exchange string, timeframe string, kind string, at long, beats long", "append")


def watched_at(events: DataFrame, now_us: int) -> DataFrame:
    """(pair, timeframe) on the watch list at a time, from its events."""
    past = events.where(F.col("at") <= now_us).groupBy(*PAIR, "timeframe").agg(F.sum(F.when(F.col("kind") == "enter", 1).otherwise(-1)).alias("n"))
    return past.where("n > 0").drop("n")


def latch(stream: DataFrame, wait_sec: int, late: str = "1 hour") -> DataFrame:
    """(pair, t) of trades that pass a cooldown, in append mode: the first of a pair, then the first at least `wait_sec`
    after the last that passed.

    Trades count in order of time: they wait in the state until the watermark has passed them.  From one that passes the
    next is found by bisection, so the work is one step for each that passes.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    wait = wait_sec * 1_000_000

    class Latch(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("latch", "timer bigint, last bigint, pending array<bigint>")

        def step(self, key, new, passed, fired=False):
            timer, last, pending = self.state.get() if self.state.exists() else (-1, None, [])
            timer = -1 if fired else timer
            times = np.unique(np.concatenate([np.asarray(pending, np.int64), *new]))
            ready = int(np.searchsorted(times, passed * 1000, "left"))
            out, at = [], 0 if last is None else int(np.searchsorted(times, last + wait, "left"))
            while at < ready:
                last = int(times[at])
                out.append((*key, last))
                at = int(np.searchsorted(times, last + wait, "left"))
            # what the last one holds back cannot pass any more
            rest = times[max(ready, 0 if last is None else int(np.searchsorted(times, last + wait, "left"))) :]
            # without any, a state that holds nothing back any more goes
            over = not len(rest) and (last is None or last + wait <= passed * 1000)
            due = -1 if over else int(rest[0] if len(rest) else last + wait) // 1000
            if timer >= 0 and timer != due:
                self.handle.deleteTimer(timer)
            if due >= 0 and due != timer:
                self.handle.registerTimer(due)
            if over:
                self.state.clear()
            else:
                self.state.update((due, last, rest.tolist()))
            return pd.DataFrame(out, columns=[*PAIR, "t"])

        def handleInputRows(self, key, rows, timerValues):
            yield self.step(key, [x["t"].to_numpy(np.int64) for x in rows], timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield self.step(key, [], timerValues.getCurrentWatermarkInMs(), fired=True)

        def close(self) -> None:
            pass

    rows = combined(stream, late, [*PAIR, "t"], lambda x: x.drop_duplicates(), "ticker string, exchange string, t long")
    return _stateful(rows, PAIR, Latch(), "ticker string, exchange string, t long", "append")


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, step: int, folder_sec: int = 86_400) -> StreamingQuery:
    """Bars written by micro-batch: buckets that come again are replaced, others survive.

    Bars lie in folders by time; a batch reads and rewrites only the folders that it touches.  They are written aside
    first and then swapped in, so a batch that fails half-way runs again on what was there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("folder", F.floor(F.col("ts") / folder_sec).cast("long")).persist()
        touched = sorted(r.folder for r in batch.select("folder").distinct().collect())  # the batch's days
        there = {x for x in children(spark, path) if x.startswith("folder=")}
        merged = batch
        old = [f"{path}/folder={n}" for n in touched if f"folder={n}" in there]
        if old:
            stored = spark.read.option("basePath", path).schema(batch.schema).parquet(*old)
            merged = upsert(stored, batch, step)
        aside = f"{path}-aside"
        merged.write.mode("overwrite").parquet(aside)
        spark.read.schema(merged.schema).parquet(aside).write.mode("overwrite").partitionBy("folder").option("partitionOverwriteMode", "dynamic").parquet(path)
        delete(spark, aside)
        batch.unpersist()

    return start(stream, "update", write, checkpoint)
