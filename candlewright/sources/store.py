"""A candle store: bars in folders by pair and month, and the jobs that keep it.

    path/live/exchange=E/ticker=T/month=YYYYMM/*.parquet     bars
    path/parked/exchange=E/ticker=T/...                      pairs that were taken out and can come back
    path/ledger, path/audit                                  what was moved, when jobs ran

Jobs touch folders, not the table: retention deletes whole months and rewrites the one that the cut goes through, a sweep
rewrites folders that have changed since the last one, a page reads the newest months that it needs.  Folders that are
rewritten are written aside as a whole and then take the old ones' places one by one; a job that breaks off in between is
finished by the next, as what lies aside complete is newer than what it replaces.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import DAY, PAIR, dedup, newest
from ..storage import children, create, delete, exists, move, read_or_empty, read_text
from .tables import CANDLE

LAYOUT = ["exchange", "ticker", "month"]
LEDGER = "number long, at long, ticker string, exchange string, action string"
ACTIONS = ("park", "restore", "purge", "drop")


def month_at(ts: int) -> int:
    """YYYYMM in UTC of a time in seconds."""
    at = datetime.datetime.fromtimestamp(ts, datetime.UTC)
    return at.year * 100 + at.month


def month_of(ts: Column) -> Column:
    day = F.date_from_unix_date(F.floor(ts / DAY).cast("int"))
    return (F.year(day) * 100 + F.month(day)).cast("int")


def put(bars: DataFrame, path: str) -> None:
    """Adds bars; tasks are dealt by folder, so a folder gets one file."""
    rows = bars.withColumn("month", month_of(F.col("ts")))
    rows.repartition(*LAYOUT).write.mode("append").partitionBy(*LAYOUT).parquet(f"{path}/live")


def _read(spark: SparkSession, root: str, folders: list[str] | None = None) -> DataFrame:
    schema = f"{CANDLE}, month int"
    if folders is None:
        return read_or_empty(spark, root, schema)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", root).schema(schema).parquet(*(f"{root}/{x}" for x in folders))


def read(spark: SparkSession, path: str, where: str = "live") -> DataFrame:
    return _read(spark, f"{path}/{where}")


def months(spark: SparkSession, path: str, where: str = "live") -> DataFrame:
    """(exchange, ticker, month, folder, files, bytes, touched) of the store's folders.

    Spark lists them; no file is opened, as only a file's name, time and length are asked for.
    """
    root = f"{path}/{where}"
    schema = "exchange string, ticker string, month int, folder string, files long, bytes long, touched timestamp"
    if not exists(spark, root):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    folder = F.regexp_extract("path", r"(exchange=[^/]*/ticker=[^/]*/month=\d+)/[^/]*$", 1)
    found = files.select(folder.alias("folder"), "length", "modificationTime").groupBy("folder")
    found = found.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("touched"))
    part = lambda name: F.regexp_extract("folder", name + "=([^/]*)", 1)
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return found.select(plain(part("exchange")).alias("exchange"), plain(part("ticker")).alias("ticker"), part("month").cast("int").alias("month"), "folder", "files", "bytes", "touched")


def _finish(spark: SparkSession, path: str) -> None:
    """Puts what lies aside complete in place of the old folders; what is incomplete goes."""
    for name in children(spark, f"{path}/aside"):
        root = f"{path}/aside/{name}"
        if exists(spark, f"{root}/_SUCCESS"):
            for folder in json.loads(read_text(spark, f"{root}/_folders")) if exists(spark, f"{root}/_folders") else []:
                if exists(spark, f"{root}/{folder}"):
                    delete(spark, f"{path}/live/{folder}")
                    move(spark, f"{root}/{folder}", f"{path}/live/{folder}")
                elif exists(spark, f"{root}/_empty/{folder}"):
                    delete(spark, f"{path}/live/{folder}")
        delete(spark, root)


def rewrite(spark: SparkSession, path: str, folders: list[str], change) -> None:
    """Replaces folders by what `change` makes of their rows; a folder without rows left goes."""
    if not folders:
        return
    root = f"{path}/aside/rewrite"
    delete(spark, root)
    rows = change(_read(spark, f"{path}/live", folders))
    rows.repartition(*LAYOUT).write.partitionBy(*LAYOUT).parquet(root)
    left = {f"{a}/{b}/{c}" for a in children(spark, root) if "=" in a for b in children(spark, f"{root}/{a}") for c in children(spark, f"{root}/{a}/{b}")}
    for gone in (x for x in folders if x not in left):
        create(spark, f"{root}/_empty/{gone}/gone", "")
    create(spark, f"{root}/_folders", json.dumps(folders))
    _finish(spark, path)


def last_run(spark: SparkSession, path: str, job: str) -> dict | None:
    """What a job noted when it last ran."""
    runs = [int(x.split("-")[-1]) for x in children(spark, f"{path}/audit") if x.startswith(f"{job}-")]
    return json.loads(read_text(spark, f"{path}/audit/{job}-{max(runs)}")) if runs else None


def note(spark: SparkSession, path: str, job: str, **facts) -> None:
    """Notes a run; of a job's notes the last two are kept."""
    runs = sorted(int(x.split("-")[-1]) for x in children(spark, f"{path}/audit") if x.startswith(f"{job}-"))
    create(spark, f"{path}/audit/{job}-{(runs[-1] if runs else 0) + 1}", json.dumps(facts))
    for n in runs[:-1]:
        delete(spark, f"{path}/audit/{job}-{n}")


def due(spark: SparkSession, path: str, job: str, now: int, every_sec: int) -> bool:
    last = last_run(spark, path, job)
    return last is None or now - last["at"] >= every_sec


def retain(spark: SparkSession, path: str, now: int, days: int = 180, every_sec: int = DAY) -> bool:
    """Deletes bars older than so many days, once in `every_sec`; whether it ran.

    Months before the cut go as folders; of the month of the cut only folders with older bars are rewritten.
    """
    if not due(spark, path, "retention", now, every_sec):
        return False
    _finish(spark, path)
    cut = now - days * DAY
    border = month_at(cut)
    for row in months(spark, path).where(F.col("month") < border).select("folder").toLocalIterator():
        delete(spark, f"{path}/live/{row.folder}")
    at = months(spark, path).where(F.col("month") == border)
    names = [r.folder for r in at.select("folder").collect()]  # a name for each pair
    older = _read(spark, f"{path}/live", names).where(F.col("ts") < cut).select(*PAIR).distinct()
    touched = [r.folder for r in at.join(older, PAIR, "left_semi").select("folder").collect()]
    rewrite(spark, path, touched, lambda rows: rows.where(F.col("ts") >= cut))
    note(spark, path, "retention", at=now, cut=cut, rewritten=len(touched))
    return True


def sweep(spark: SparkSession, path: str, now: int, step: int, days: int = 180, every_sec: int = 3600, files: int = 1) -> dict:
    """Maintenance: retention, then one row a bucket and one file a folder in folders that changed since the last sweep.

    The audit holds the newest time of a file that the last sweep left, so a sweep over an unchanged store reads no bars.
    """
    last = last_run(spark, path, "sweep")
    if last and now - last["at"] < every_sec:
        return {"ran": False, "folders": 0}
    _finish(spark, path)
    retain(spark, path, now, days)
    mark = last["mark"] if last else -1
    stamp = F.unix_micros("touched")
    changed = [r.folder for r in months(spark, path).where((stamp > mark) & (F.col("files") > 0)).select("folder").collect()]
    rewrite(spark, path, changed, lambda rows: dedup(rows, step))
    newest_file = months(spark, path).agg(F.max(stamp)).first()[0]
    note(spark, path, "sweep", at=now, mark=newest_file or -1, folders=len(changed))
    return {"ran": True, "folders": len(changed)}


def _escaped(value: str) -> str:
    """A partition's value as Spark writes it in a folder's name."""
    return "".join(f"%{ord(x):02X}" if x in _ESCAPED or ord(x) < 32 or ord(x) == 127 else x for x in value)


_ESCAPED = set("\"#%'*/:=?\\{[]^")  # fixed values: the characters that Spark escapes


def folder_of(ticker: str, exchange: str) -> str:
    return f"exchange={_escaped(exchange)}/ticker={_escaped(ticker)}"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Moves that were begun, by number; `done` tells those that are known to be whole."""
    rows = read_or_empty(spark, f"{path}/ledger", LEDGER)
    done = [int(x) for x in children(spark, f"{path}/done")]
    return rows.withColumn("done", F.col("number").isin(done) if done else F.lit(False))


def apply(spark: SparkSession, path: str, plan: DataFrame, now: int) -> int:
    """Carries out a plan (pair, action: park, restore, purge or drop); the number under which the ledger has it.

    The ledger has the moves before the first one is made, and a mark once all are.  A pair's folder moves in one step.
    """
    number = max([int(x) for x in children(spark, f"{path}/done")] + [r.number for r in ledger(spark, path).select(F.max("number").alias("number")).collect() if r.number is not None], default=0) + 1
    rows = plan.select(F.lit(number).cast("long").alias("number"), F.lit(now).cast("long").alias("at"), *PAIR, "action").where(F.col("action").isin(*ACTIONS))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    repair(spark, path)
    return number


def repair(spark: SparkSession, path: str) -> int:
    """Makes the ledger's moves that are not known to be whole; those made already change nothing.  How many it looked at."""
    open_moves = ledger(spark, path).where("NOT done").orderBy("number").collect()  # names of a plan's pairs
    for r in open_moves:
        pair = folder_of(r.ticker, r.exchange)
        if r.action == "park" and not exists(spark, f"{path}/parked/{pair}"):
            move(spark, f"{path}/live/{pair}", f"{path}/parked/{pair}")
        elif r.action == "restore" and not exists(spark, f"{path}/live/{pair}"):
            move(spark, f"{path}/parked/{pair}", f"{path}/live/{pair}")
        elif r.action == "purge":
            delete(spark, f"{path}/parked/{pair}")
        elif r.action == "drop":
            delete(spark, f"{path}/live/{pair}")
    for number in sorted({r.number for r in open_moves}):
        create(spark, f"{path}/done/{number}", "")
    return len(open_moves)


def page(spark: SparkSession, path: str, before: int, limit: int) -> DataFrame:
    """Of each pair the newest `limit` bars before a time, from the newest months that hold so many.

    The horizon grows by pair: one month, then two more, then four, for pairs that have too few bars yet, so a page deep in
    history opens the folders it needs and no others.
    """
    behind: dict[tuple, list[str]] = {}
    for r in months(spark, path).where(F.col("month") <= month_at(before)).orderBy(F.desc("month")).select(*PAIR, "folder").toLocalIterator():
        behind.setdefault((r.ticker, r.exchange), []).append(r.folder)
    chosen, have, width = [], dict.fromkeys(behind, 0), 1
    while open_pairs := [p for p, folders in behind.items() if folders and have[p] < limit]:
        step = [x for p in open_pairs for x in behind[p][:width]]
        for p in open_pairs:
            behind[p] = behind[p][width:]
        chosen += step
        for r in _read(spark, f"{path}/live", step).where(F.col("ts") < before).groupBy(*PAIR).count().collect():  # a row a pair
            have[(r.ticker, r.exchange)] += r["count"]
        width *= 2
    return newest(_read(spark, f"{path}/live", chosen).where(F.col("ts") < before), limit)
