"""Lists and lookups over summary rows: catalogs, drop plans, tickers and tables of a base, filters and orders of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .series import PAIR
from .summary import perp_first


def pair_tables(names: DataFrame, name: str = "table_name") -> DataFrame:
    """Names of pair tables: the underscores of the mark are meant literally, as a bare one would match any character."""
    return names.where(F.col(name).like(r"%\_on\_%"))


def drop_plan(tables: DataFrame, allowed: str | None = None, denied: str | None = None, delisted: DataFrame | None = None) -> DataFrame:
    """(pair, why) of tables to drop: an exchange that is not served, a tokenised stock, a delisted pair.

    With neither list set no exchange is dropped.  delisted: pairs; one that is not stored is ignored.
    """
    ticker, exchange = F.col("ticker"), F.col("exchange")
    base = S.base_of(ticker)
    stock = (F.lower(exchange) == "bitget") & base.startswith("R") & ~base.isin(S.BITGET_CRYPTO)
    marks = tables.select(*PAIR)
    gone = F.lit(False)
    if delisted is not None:
        marks = marks.join(delisted.select(*PAIR).distinct().withColumn("_gone", F.lit(True)), PAIR, "left")
        gone = F.col("_gone").isNotNull()
    why = F.when(~S.exchange_allowed(exchange, allowed, denied), "exchange").when(stock, "stock").when(gone, "delisted")
    return marks.select(*PAIR, why.alias("why")).where("why IS NOT NULL")


def parked(tables: DataFrame, plan: DataFrame, mode: str = "trash", parked_before: DataFrame | None = None, purge: bool = False) -> DataFrame:
    """(pair, status) after a prune plan (spot, exchange, verdict): live, parked (can come back) or dropped.

    parked_before: pairs parked earlier; purge drops those, and only those.
    """
    if mode not in ("trash", "drop"):
        raise ValueError(f"unknown mode {mode!r}")
    pruned = plan.where("verdict = 'prune'").select(F.col("spot").alias("ticker"), "exchange").distinct().withColumn("status", F.lit("parked" if mode == "trash" else "dropped"))
    out = tables.select(*PAIR).join(pruned, PAIR, "left").withColumn("status", F.coalesce("status", F.lit("live")))
    if parked_before is not None:
        out = out.unionByName(parked_before.select(*PAIR, F.lit("dropped" if purge else "parked").alias("status")))
    return out


def find_perp(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (base, exchange) with perp: a perpetual against USDT of that base there, the first frame's (rank), else null."""
    perps = rows.where(F.col("ticker").endswith(":USDT")).groupBy(S.base_of(F.col("ticker")).alias("base"), "exchange").agg(F.min_by("ticker", F.struct("rank", "ticker")).alias("perp"))
    return asked.join(perps, ["base", "exchange"], "left")


def find_row(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ticker, wanted) with the best row of rows (ticker, exchange, volume_tier): the wanted exchange's, else the
    first by tier (HIGH before LOW), then by exchange; null without any."""
    exact = F.coalesce(F.col("exchange") == F.col("wanted"), F.lit(False))
    order = F.struct((~exact).alias("a"), F.when(~exact, F.col("volume_tier")).alias("b"), F.col("exchange").alias("c"))
    best = asked.distinct().join(rows, "ticker").groupBy("ticker", "wanted").agg(F.min_by(F.struct("exchange", "volume_tier"), order).alias("r")).selectExpr("ticker _ticker", "wanted _wanted", "r")
    found = asked.join(best, (F.col("ticker") == F.col("_ticker")) & F.col("wanted").eqNullSafe(F.col("_wanted")), "left")
    return found.select("ticker", "wanted", F.col("r.exchange").alias("exchange"), F.col("r.volume_tier").alias("volume_tier"))


def best_sources(stored: DataFrame, feed: DataFrame, live: DataFrame, fields: list[str]) -> DataFrame:
    """Stored rows with each field from the best source that has it, finite: the live row, else the feed, else the stored one."""
    out = stored
    for name, df in (("feed", feed), ("live", live)):
        out = out.join(df.select(*PAIR, *(S.finite(F.col(x)).alias(f"_{name}_{x}") for x in fields)), PAIR, "left")
    return out.select(*(F.coalesce(f"_live_{x}", f"_feed_{x}", S.finite(F.col(x))).alias(x) if x in fields else F.col(x) for x in stored.columns))


def diagnose(bars: DataFrame, base: str, exchange: str, now: int, red_hours: float = 24.0) -> DataFrame:
    """(place, ticker, bars, first, last, behind, red, selected) of a base's tables on an exchange (bars: with place).

    Hours behind are null without a time; selected: whether the perp-first rule takes the ticker.
    """
    own = bars.where((S.base_of(F.col("ticker")) == base.upper()) & (F.col("exchange") == exchange))
    rows = own.groupBy("place", *PAIR).agg(F.count("ts").alias("bars"), S.epoch_sec(F.min("ts")).alias("first"), S.epoch_sec(F.max("ts")).alias("last"))
    chosen = perp_first(own.select(*PAIR).distinct()).select(F.col("ticker").alias("_ticker"))
    behind = S.behind_hours(F.col("last"), now)
    out = rows.join(chosen, F.col("ticker") == F.col("_ticker"), "left")
    return out.select("place", "ticker", "bars", "first", "last", behind.alias("behind"), F.coalesce(behind > red_hours, F.lit(True)).alias("red"), F.col("_ticker").isNotNull().alias("selected"))


def tiles(daily: DataFrame, quarter: DataFrame) -> DataFrame:
    """(pairs_1d, pairs_15m, high, exchanges, lively) over summary rows; lively: grade A or B."""
    one = daily.agg(F.count(F.lit(1)).alias("pairs_1d"), F.count_if(F.col("volume_tier") == "HIGH").alias("high"), F.count_distinct("exchange").alias("exchanges"), F.count_if(F.col("grade").isin("A", "B")).alias("lively"))
    return one.withColumn("pairs_15m", quarter.agg(F.count(F.lit(1))).scalar())


def scan_roll_up(scans: DataFrame, *by: str) -> DataFrame:
    """Scans of several databases (partial, seconds, rows, tables, carried, answered, chunks, start) as one line."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    most = lambda x: F.coalesce(F.max(x), F.lit(0)).alias(x)
    return scans.groupBy(*by).agg(F.coalesce(F.bool_or("partial"), F.lit(False)).alias("partial"), most("seconds"), total("rows"), total("tables"), total("carried"), total("answered"), total("chunks"), most("start"))


def table_view(rows: DataFrame, exchanges: list[str], tiers: list[str], grades: list[str], most: int | None = None) -> DataFrame:
    """Rows of chosen exchanges, tiers and grades, best score first, unknown scores last."""
    out = rows.where(F.col("exchange").isin(exchanges) & F.col("volume_tier").isin(tiers) & F.col("grade").isin(grades)).orderBy(F.desc_nulls_last("score"), *PAIR)
    return out if most is None else out.limit(most)


def grown(rows: DataFrame, least_pct: float, growth: str = "growth_pct") -> DataFrame:
    """Rows whose growth is known and large enough."""
    return rows.where(F.col(growth) >= least_pct)


def most_of(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows of an order; a limit of zero means all."""
    out = rows.orderBy(*order)
    return out.limit(most) if most else out


def options(rows: DataFrame, column: str = "ticker") -> DataFrame:
    """(option, previous, next) of the sorted different values of a column, with wrap-around.

    A list for a menu: one task walks the distinct values, as a total order needs.
    """
    names = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("option")).distinct()
    w = W.orderBy("option")
    ends = names.agg(F.min("option"), F.max("option")).select(F.struct(F.col("min(option)").alias("a"), F.col("max(option)").alias("z"))).scalar()
    return names.select("option", F.coalesce(F.lag("option").over(w), ends["z"]).alias("previous"), F.coalesce(F.lead("option").over(w), ends["a"]).alias("next"))


def listed(daily: DataFrame, quarter: DataFrame, only_quarter: bool) -> DataFrame:
    """(ticker) of both bar lengths, or only those with quarter-hour bars, unless that leaves none."""
    q = quarter.select("ticker").dropna().distinct()
    every = daily.select("ticker").dropna().unionByName(q).distinct()
    if not only_quarter:
        return every
    none = q.agg((F.count(F.lit(1)) == 0)).scalar()
    return every.join(q.withColumn("_q", F.lit(True)), "ticker", "left").where(F.col("_q") | none).select("ticker")


def bases(spot: DataFrame, swap: DataFrame) -> DataFrame:
    """(base) of either list of pairs."""
    one = lambda df: df.select(S.base_of(F.col("ticker")).alias("base"))
    return one(spot).unionByName(one(swap)).distinct()


def stored_bounds(bars: DataFrame) -> DataFrame:
    """(pair, place, oldest, newest) of the first place that has a pair's table: a time of 1 and 0 for an empty table.

    bars: (pair, place: 0 first, ts: null in the one row of an empty table), in seconds or milliseconds.
    """
    out = bars.groupBy(*PAIR, "place").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    out = out.groupBy(*PAIR).agg(F.min_by(F.struct("place", "a", "z"), "place").alias("r"))
    return out.select(*PAIR, "r.place", F.coalesce(S.epoch_sec(F.col("r.a")), F.lit(0)).alias("oldest"), F.coalesce(S.epoch_sec(F.col("r.z")), F.lit(1)).alias("newest"))
