"""Pump detection: rolling minimum, ratio, islands, qualification, selection over exchanges, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .series import PAIR, by_pair


@dataclass(frozen=True)
class Scan:
    """Parameters of a scan, in bars."""

    window: int = 5
    merge_gap: int = 5
    ratio: float = 8.0
    pre: int = 5
    below: float = 1.0
    source: str = "close"
    short: int = 2

    @classmethod
    def of(cls, pump_pct: float, window_days: float, bars_per_day: int, pre_days: float, merge_days: float, source: str = "close", short_days: float = 0.0) -> Scan:
        n = lambda days, least: max(least, round(days * bars_per_day))
        return cls(n(window_days, 2), n(merge_days, 1), 1 + pump_pct / 100, n(pre_days, 1), 1.0, source, n(short_days, 2))

    @property
    def history(self) -> int:
        """Bars of a full history: a window and its past; `short` are enough for new coins."""
        return self.window + self.pre


def ratios_by_source(bars: DataFrame, scan: Scan, sources: tuple[str, ...]) -> DataFrame:
    """A row for each bar and price source (close, or high_low: from lows to highs): idx, start (first least bar of the
    window), low_price, peak_price and ratio; unknown prices give 0.

    All sources share one shuffle and one sort by pair.  The least bar brings its own past along (the highest price over the
    `pre` bars before it), so nothing is collected.
    """
    df = bars.withColumn("idx", F.row_number().over(by_pair()) - 1)
    frame = by_pair().rowsBetween(-(scan.window - 1), 0)
    names = {x: ("close", "close", "close") if x == "close" else ("low", "high", "high") for x in sources}
    df = df.withColumns({f"before_{x}": F.max(price).over(by_pair().rowsBetween(-scan.pre, -1)) for x, (_, _, price) in names.items()})
    df = df.withColumns({f"bad_{x}": F.max(F.when(F.isnan(low) | F.col(low).isNull(), 1).otherwise(0)).over(frame) for x, (low, _, _) in names.items()})
    least = lambda x, low: F.struct(F.col(low).alias("p"), F.col("idx").alias("i"), F.col("ts").alias("t"), F.col(f"before_{x}").alias("b"))
    df = df.withColumns({f"m_{x}": F.min(least(x, low)).over(frame) for x, (low, _, _) in names.items()})

    def found(x: str, peak: str) -> Column:
        m = F.col(f"m_{x}")
        good = (F.col(f"bad_{x}") == 0) & (m.p > 0) & F.col(peak).isNotNull() & ~F.isnan(peak)
        ratio = F.when(good, F.col(peak) / m.p).otherwise(0.0)
        return F.struct(F.lit(x).alias("source"), m.i.alias("start"), m.t.alias("start_ts"), m.p.alias("low_price"), F.col(peak).alias("peak_price"), m.b.alias("pre_max"), ratio.alias("ratio"))

    return df.select(*PAIR, "ts", "idx", F.inline(F.array(*(found(x, peak) for x, (_, peak, _) in names.items()))))


def ratios(bars: DataFrame, scan: Scan) -> DataFrame:
    """ratios_by_source of the scan's own source."""
    return ratios_by_source(bars, scan, (scan.source,)).drop("source")


def _islands(hits: DataFrame, by: list[str], scan: Scan) -> DataFrame:
    """One row for each run of hits of a pair (and `by`): the first greatest ratio."""
    w = W.partitionBy(*by, *PAIR).orderBy("idx")
    hits = hits.withColumn("new", F.when(F.col("idx") - F.lag("idx").over(w) <= scan.merge_gap, 0).otherwise(1))
    hits = hits.withColumn("island", F.sum("new").over(w))
    best = F.max_by(F.struct("ts", "start_ts", "low_price", "peak_price", "pre_max", "ratio"), F.struct("ratio", -F.col("idx")))
    out = hits.groupBy(*by, *PAIR, "island").agg(best.alias("e")).select(*by, *PAIR, "e.*")
    return out.select(
        *by, *PAIR, S.base_of(F.col("ticker")).alias("base"), F.col("ts").alias("peak_ts"), "start_ts", F.col("low_price").alias("min_price"), "peak_price", "pre_max",
        F.round((F.col("ratio") - 1) * 100, 6).alias("pump_pct"), ((F.col("ts") - F.col("start_ts")) / 86400.0).alias("span_days"),
    )


def detect_at(bars: DataFrame, scan: Scan, thresholds: list[float]) -> DataFrame:
    """Pumps at each of several thresholds (column threshold: the ratio), from one pass over the bars.

    A bar over several thresholds is repeated for those only, so the lowest one bounds what goes on.
    """
    over = F.explode(F.filter(F.array(*map(F.lit, sorted(float(t) for t in thresholds))), lambda t: F.col("ratio") > t)).alias("threshold")
    return _islands(ratios(bars, scan).select("*", over), ["threshold"], scan)


def detect_sources(bars: DataFrame, scan: Scan, sources: tuple[str, ...] = ("close", "high_low")) -> DataFrame:
    """Pumps of each price source (column source), from one pass over the bars."""
    return _islands(ratios_by_source(bars, scan, sources).where(F.col("ratio") > scan.ratio), ["source"], scan)


def detect(bars: DataFrame, scan: Scan) -> DataFrame:
    """One row for each pump: islands of bars over the threshold, represented by the first greatest ratio."""
    return detect_at(bars, scan, [scan.ratio]).drop("threshold")


def aged(events: DataFrame, now: int) -> DataFrame:
    """Adds the days since an event's peak."""
    return events.withColumn("age_days", (F.lit(now) - F.col("peak_ts")) / 86400.0)


def with_history(events: DataFrame, histories: DataFrame, scan: Scan) -> DataFrame:
    """Adds whether a pair's history (pair, bars) is shorter than a window and its past."""
    return events.join(histories.select(*PAIR, (F.col("bars") < scan.history).alias("short_history")), PAIR, "left")


def long_enough(bars: Column, scan: Scan, short: bool = False) -> Column:
    """Whether so many bars suffice: a window and its past, or the minimum for new coins where that is allowed."""
    return (bars >= scan.history) | (bars >= scan.short) if short else bars >= scan.history


def finished(bars: DataFrame, now: int, step: int) -> DataFrame:
    """Bars without a pair's last one while that is still open."""
    last = F.max("ts").over(W.partitionBy(*PAIR))
    return bars.withColumn("_last", last).where((F.col("ts") < F.col("_last")) | (F.col("ts") + step <= now)).drop("_last")


def prepump(events: DataFrame, below: float) -> DataFrame:
    """Events whose prices before the start stayed under the peak; none before it passes."""
    return events.where(F.col("pre_max").isNull() | (F.col("pre_max") < F.col("peak_price") * below))


def strongest(events: DataFrame) -> DataFrame:
    """The strongest event of each (base, exchange); ties by the earlier peak, then by ticker."""
    w = W.partitionBy("base", "exchange").orderBy(F.desc("pump_pct"), "peak_ts", "ticker")
    return events.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def summary(events: DataFrame) -> DataFrame:
    """One row a coin over its events on exchanges."""
    return events.groupBy("base").agg(
        F.min("pump_pct").alias("min_pump_pct"), F.max("pump_pct").alias("max_pump_pct"), F.min("peak_ts").alias("peak_ts_min"), F.max("peak_ts").alias("peak_ts_max"),
        F.min("min_price").alias("min_price"), F.max("peak_price").alias("peak_price"), F.max("pre_max").alias("pre_max"),
        F.array_join(F.array_sort(F.collect_set("exchange")), ",").alias("exchanges"), F.count_distinct("exchange").alias("n_exchanges"),
    )


def report(events: DataFrame, now: int) -> DataFrame:
    """One row a coin as reports show it: its summary, spread of peaks, age, whether a history is short, and its events.

    events: one for each (base, exchange), with short_history; a coin's list has an entry for each exchange.
    """
    nested = F.array_sort(F.collect_list(F.struct("exchange", "ticker", "peak_ts", "pump_pct"))).alias("events")
    more = events.groupBy("base").agg(F.bool_or(F.coalesce("short_history", F.lit(False))).alias("short_history"), nested)
    out = summary(events).join(more, "base")
    return out.withColumn("align_span_days", (F.col("peak_ts_max") - F.col("peak_ts_min")) / 86400.0).withColumn("age_days", (F.lit(now) - F.col("peak_ts_max")) / 86400.0)


def coins_any(events: DataFrame, least: int) -> DataFrame:
    """Coins with an event on `least` exchanges or more: the strongest event of each."""
    return summary(strongest(events)).where(F.col("n_exchanges") >= least)


def _aligned(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coins of the catalog (base, need) that have an event on every exchange, with the upper median of the newest peaks."""
    newest = events.groupBy("base", "exchange").agg(F.max("peak_ts").alias("newest"))
    median = newest.groupBy("base").agg(F.expr("element_at(sort_array(collect_list(newest)), cast(count(1) div 2 as int) + 1)").alias("median"), F.count(F.lit(1)).alias("have"))
    return catalog.groupBy("base").agg(F.count_distinct("exchange").alias("need")).join(median, "base", "left")


def _nearest(events: DataFrame, median: DataFrame) -> DataFrame:
    w = W.partitionBy("base", "exchange").orderBy(F.abs(F.col("peak_ts") - F.col("median")), "peak_ts", "ticker")
    return events.join(median, "base").withColumn("rn", F.row_number().over(w)).where("rn = 1")


def coins_all(events: DataFrame, catalog: DataFrame, align_days: float) -> DataFrame:
    """Coins with an event on every catalog exchange: the event nearest the upper median of the newest peaks."""
    near = _nearest(events, _aligned(events, catalog).where("have = need"))
    return summary(near).where((F.col("peak_ts_max") - F.col("peak_ts_min")) / 86400.0 <= align_days)


def selection_counts(events: DataFrame, catalog: DataFrame, least: int, align_days: float | None = None) -> DataFrame:
    """(outcome, n): why coins of the catalog (base, exchange) were left out, or kept.

    Without align_days one event on `least` exchanges suffices; with it every exchange needs one, close together.
    """
    if align_days is None:
        have = strongest(events).groupBy("base").agg(F.count(F.lit(1)).alias("have"))
        coins = catalog.groupBy("base").agg(F.count_distinct("exchange").alias("need")).join(have, "base", "left")
        outcome = F.when((F.col("need") < least) | (F.coalesce("have", F.lit(0)) < least), "min_exch").otherwise("kept")
    else:
        coins = _aligned(events, catalog)
        span = _nearest(events, coins.where("have = need")).groupBy("base").agg(((F.max("peak_ts") - F.min("peak_ts")) / 86400.0).alias("span"))
        coins = coins.join(span, "base", "left")
        outcome = F.when(F.col("need") < least, "min_exch").when(F.coalesce("have", F.lit(0)) < F.col("need"), "not_all").when(F.col("span") > align_days, "align").otherwise("kept")
    return coins.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def gated(events: DataFrame, books: DataFrame, least: str | None) -> DataFrame:
    """Events whose newest book passes the vitality limit, with its grade; a pair without a book stays, as unverified.

    books: (pair, ts, grade, score); a newest row without a score counts as no book.
    """
    newest = books.groupBy(*PAIR).agg(F.max_by(F.struct("grade", "score"), "ts").alias("b")).where("b.score IS NOT NULL")
    out = events.join(newest, PAIR, "left").withColumn("ob_unverified", F.col("b").isNull())
    return out.where(F.col("ob_unverified") | S.vitality_ok(F.col("b.grade"), least)).select(*events.columns, F.col("b.grade").alias("ob_grade"), "ob_unverified")


def fresh_coins(coins: DataFrame, events: DataFrame, now: int, start_days: float = 10.0) -> DataFrame:
    """Coins with an event that started in the last days."""
    recent = events.where((F.lit(now) - F.col("start_ts")) / 86400.0 <= start_days).select("base").distinct()
    return coins.join(recent, "base", "left_semi")


def recent_coins(coins: DataFrame, now: int, days: float = 30.0, most: int | None = None) -> DataFrame:
    """Coins whose newest peak lies in the last days, newest first."""
    out = coins.where((F.lit(now) - F.col("peak_ts_max")) / 86400.0 <= days).orderBy(F.desc("peak_ts_max"), "base")
    return out if most is None else out.limit(most)


def top_coins(coins: DataFrame, most: int = 100) -> DataFrame:
    """Coins by what their weakest exchange shows, greatest first."""
    return coins.orderBy(F.desc("min_pump_pct"), "base").limit(most)


def by_day(events: DataFrame) -> DataFrame:
    """Pumps collapsed to (base, day), strongest kept, with the exchanges that share them and the newest peak."""
    return events.groupBy("base", F.floor(F.col("peak_ts") / 86400).alias("day")).agg(F.max("pump_pct").alias("pump_pct"), F.count_distinct("exchange").alias("width"))
