"""Scalar column functions: epochs, tickers, exchanges, scores and grades. All stay inside generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, QUARTER = 86400, 900

# fixed values: rules and lists of the pair filters
LEVERAGED = "(?i)(3L|3S|5L|5S|2L|2S|4L|4S|UP|DOWN|BULL|BEAR)/USDT$"
BITGET_CRYPTO = ["RARE", "RAY", "RAMP", "RAU", "RAVE", "RNDR", "RSR", "RUNE", "RVN", "ROSE", "REQ"]
QUOTES = ["usdt", "usdc", "usd", "btc", "eth", "eur", "busd", "fdusd", "tusd"]
ALIASES = {"huobipro": "htx", "huobi": "htx", "okex": "okx", "gate": "gateio", "bg": "bitget"}
TEST_BASE = r"^TEST\d{6}$"
STOCK_BASES = {"bitget": ["RAPP", "RASST", "RBE", "RCELH", "RCOIN", "RGME", "RMETA", "RNVD", "RQBTS", "RQUBT", "RRGTI", "RRIOT", "RSBET", "RSNOW", "RXYZ"]}
LOOKBACK_BARS = {"gateio": 9900, "gate": 9900}  # quarter-hour bars that an exchange still serves
LOOKBACK_DAYS = {"bingx": 379}  # daily bars
TRUE_TOKENS = ["true", "t", "yes", "y", "1", "1.0"]
BLANK_TOKENS = ["", "none", "null", "nan", "nat", "-"]
EARLIEST_BAR = 1356998400  # 2013-01-01 UTC


def epoch_sec(ts: Column) -> Column:
    """Seconds from seconds or milliseconds; null stays null."""
    return F.when(ts > 100_000_000_000, F.floor(ts / 1000)).otherwise(ts).cast("long")


def bucket(ts: Column, step: int) -> Column:
    return F.floor(ts / F.lit(step)).cast("long")


def idle_sec(ts: Column, now: float, is_time: bool = False) -> Column:
    """Seconds since an epoch (seconds or milliseconds) or a timestamp; null for zero, negative and times over a year ahead."""
    v = F.unix_micros(ts) / 1e6 if is_time else F.when(ts > 1e11, ts / 1000.0).otherwise(ts.cast("double"))
    return F.when((v > 0) & (v <= now + 31_536_000), F.lit(float(now)) - v)


def sane_bar(ts: Column, now: int) -> Column:
    """Times from 2013 to two days ahead."""
    return F.coalesce(ts.between(EARLIEST_BAR, now + 2 * DAY), F.lit(False))


def base_of(ticker: Column) -> Column:
    return F.upper(F.split_part(F.split_part(ticker, F.lit(":"), F.lit(1)), F.lit("/"), F.lit(1)))


def quote_of(ticker: Column) -> Column:
    quote = F.split_part(F.split_part(ticker, F.lit(":"), F.lit(1)), F.lit("/"), F.lit(2))
    return F.when(quote == "", "USDT").otherwise(F.upper(quote))


def is_perp(ticker: Column) -> Column:
    return F.contains(ticker, F.lit(":"))


def canonical_exchange(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))[low], low)


def skip_pair(symbol: Column, exchange: Column) -> Column:
    """Leveraged, tokenised, delisted or dollar-based pairs; empty and null symbols too."""
    spot = F.split_part(symbol, F.lit(":"), F.lit(1))
    base = F.upper(F.split_part(spot, F.lit("/"), F.lit(1)))
    stock = F.lower(exchange).isin("bitget", "bg") & base.startswith("R") & ~base.isin(BITGET_CRYPTO)
    bad = (F.contains(base, F.lit("USD")) & (base != "USDT")) | spot.rlike(LEVERAGED) | base.endswith("STOCK") | base.startswith("$") | base.endswith("_OLD") | F.coalesce(stock, F.lit(False))
    return F.coalesce(symbol == "", F.lit(True)) | F.coalesce(bad, F.lit(False))


def table_name(ticker: Column, exchange: Column) -> Column:
    return F.lower(F.concat(F.translate(ticker, "/-", "__"), F.lit("_on_"), exchange))


def perp_to_spot(name: Column) -> Column:
    """Spot table of a perp table (`:` form or doubled quote), null for others."""
    symbol, exchange = F.substring_index(name, "_on_", 1), F.substring_index(name, "_on_", -1)
    doubled = F.regexp_extract(symbol, f"^(.+_({'|'.join(QUOTES)}))[_:]\\2$", 1)
    return F.when(doubled != "", F.concat(doubled, F.lit("_on_"), exchange))


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def parse_table(name: Column) -> Column:
    """struct(ticker, exchange, kind) of a table name; without `_on_` the name itself, no exchange and kind unknown."""
    low = F.lower(F.trim(name))
    pair, exchange = F.regexp_extract(low, "^(.*)_on_(.*)$", 1), F.regexp_extract(low, "^(.*)_on_(.*)$", 2)
    known = F.contains(low, F.lit("_on_"))
    return F.struct(
        F.when(known, F.upper(F.translate(pair, "_", "/"))).otherwise(F.upper(low)).alias("ticker"),
        F.when(known, exchange).otherwise("").alias("exchange"),
        F.when(~known, "unknown").when(is_perp(pair), "swap").otherwise("spot").alias("kind"),
    )


def excluded_base(base: Column, exchange: Column) -> Column:
    """Bases of test markets, and of tokenised stocks where an exchange lists them."""
    stocks = [(exchange == e) & base.isin(names) for e, names in STOCK_BASES.items()]
    return F.coalesce(base.rlike(TEST_BASE), F.lit(False)) | F.coalesce(any_of(*stocks), F.lit(False))


def exchange_list(raw: str | None) -> list[str]:
    """Exchange names of a setting, separated by commas or as a JSON array; nothing usable gives an empty list."""
    import json

    raw = (raw or "").strip()
    try:
        names = json.loads(raw) if raw.startswith("[") else raw.split(",")
    except ValueError:
        names = []
    return [x for x in (str(n).strip().lower() for n in names) if x]


def exchange_allowed(exchange: Column, allowed: str | None, denied: str | None) -> Column:
    """In the allow list (an empty one allows all) and not in the deny list, which wins."""
    only, never = exchange_list(allowed), exchange_list(denied)
    low = F.lower(exchange)
    return (low.isin(only) if only else F.lit(True)) & (~low.isin(never) if never else F.lit(True))


def short_badge(ticker: Column, perp: Column) -> Column:
    """Whether a pair can be sold short: it is a perpetual, its base has one (perp, by name), or neither."""
    return F.when(is_perp(ticker), "perp").when(perp.isNotNull(), F.concat(F.lit("perp "), perp)).otherwise("none")


def clamp01(x: Column) -> Column:
    """x between 0 and 1; null stays null, which greatest and least would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def score_tpm(x: Column) -> Column:
    return F.coalesce(clamp01(x / 120.0), F.lit(0.0))


def score_log(x: Column, low: float, high: float) -> Column:
    """0 at low or less, 1 at high or more, by logarithm; null and values of zero or less give 0."""
    return F.when(x > 0, clamp01((F.log10(x) - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low))))).otherwise(0.0)


def score_spread(x: Column) -> Column:
    return F.when(x <= 5, 1.0).when(x >= 15, 0.0).when(x.isNotNull(), (15 - x) / 10).otherwise(0.0)


def score_lerp(x: Column, bad: float, good: float) -> Column:
    """0 at bad or beyond, 1 at good or beyond, in proportion between; equal limits give 1."""
    return F.lit(1.0) if bad == good else clamp01((x - bad) / (good - bad))


def goodness(vitality: Column, barcode: Column, depth: Column, spread_atr: Column, imbalance: Column, tpm: Column, buy_pct: Column, cvd: Column, last_trade: Column) -> Column:
    """struct of the scores, 0 to 1, of a book and its tape; unknown numbers count as 0."""
    v, s, i, t, b, f, a = (F.coalesce(x.cast("double"), F.lit(0.0)) for x in (vitality, spread_atr, imbalance, tpm, buy_pct, cvd, last_trade))
    return F.struct(
        F.when(barcode, 0.0).otherwise(clamp01(v / 10)).alias("vitality"),
        score_log(depth, 500.0, 50_000.0).alias("depth"),
        (1 - clamp01(s / 5)).alias("spread"),
        F.when(i > 0, score_lerp(i, 0.25, 1.0) * score_lerp(-i, -4.0, -1.0)).otherwise(0.0).alias("imbalance"),
        score_lerp(t, 0.0, 5.0).alias("tpm"),
        clamp01(b / 100).alias("buy"),
        score_lerp(f, -10_000.0, 10_000.0).alias("cvd"),
        (1 - clamp01(a / 600)).alias("last_trade"),
    )


def mid_price(bid: Column, ask: Column, close: Column) -> Column:
    """Between bid and ask; the close where both are zero or unknown."""
    mid = (F.coalesce(bid, F.lit(0.0)) + F.coalesce(ask, F.lit(0.0))) / 2
    return F.when(mid != 0, mid).otherwise(close)


def spread_of(bid: Column, ask: Column, of: Column) -> Column:
    """The spread in percent of a bid, a mid price or a volatility; 0 where that is not positive or unknown."""
    return F.when(of > 0, (ask - bid) / of * 100).otherwise(0.0)


def behind_hours(ts: Column, now: int) -> Column:
    """Hours since a newest bar, in seconds or milliseconds; null without one."""
    return F.when(ts > 0, (F.lit(now) - epoch_sec(ts)) / 3600.0)


def is_stale(ts: Column, now: int, step: int) -> Column:
    """More than an hour behind for intraday bars, than 49 hours for daily ones; false without a bar."""
    return F.coalesce(behind_hours(ts, now) > (49.0 if step >= DAY else 1.0), F.lit(False))


def vitality_ok(grade: Column, least: str | None) -> Column:
    """Grades up to the least one (A is best); no grade fails, no limit passes all."""
    if not least:
        return F.lit(True)
    g = F.upper(F.trim(grade))
    return F.coalesce((g != "") & (g <= least.upper()), F.lit(False))


def flag(text: Column) -> Column:
    """A text as a boolean: one of the true tokens, else false, null too."""
    return F.coalesce(F.lower(F.trim(text)).isin(TRUE_TOKENS), F.lit(False))


def blank(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(BLANK_TOKENS)


def lookback_floor(exchange: Column, now: int, step: int) -> Column:
    """The oldest time in seconds that an exchange still serves; null without a limit."""
    limits, unit = (LOOKBACK_DAYS, DAY) if step >= DAY else (LOOKBACK_BARS, QUARTER)
    out = F.lit(None).cast("long")
    for name, n in limits.items():
        out = F.when(exchange == name, F.lit(now - n * unit).cast("long")).otherwise(out)
    return out


def clamp_since(since: Column, exchange: Column, now: int, step: int) -> Column:
    """A fetch's start, not before what the exchange serves."""
    return F.greatest(since, lookback_floor(exchange, now, step))


def vitality_score(tpm: Column, depth: Column, spread: Column, barcode: Column) -> Column:
    """0 to 10 from the tape, the book's depth and its spread; a barcode market has 0."""
    tape = F.when(tpm >= 120, 4.0).when(tpm >= 45, 3.0).when(tpm >= 15, 2.0).when(tpm >= 3, 1.0).otherwise(0.0)
    book = F.when(depth >= 50_000, 3.0).when(depth >= 10_000, 2.0).when(depth >= 1_000, 1.0).otherwise(0.0)
    tight = F.when(spread < 0.1, 3.0).when(spread < 0.3, 2.0).when(spread < 1.0, 1.0).otherwise(0.0)
    return F.when(barcode, 0.0).otherwise(tape + book + tight)


def vitality_grade(score: Column) -> Column:
    return F.when(score >= 8, "A").when(score >= 6, "B").when(score >= 4, "C").when(score >= 2, "D").otherwise("F")


def growth_pct(close: Column, low: Column) -> Column:
    return F.when((close > 0) & (low > 0), (close - low) / low * 100)


def zombie_verdict(spot: Column, perp: Column, idle: Column, stale: float = 86400.0) -> Column:
    """prune, keep or unknown for a spot table beside its perp table."""
    unknown = spot.isNull() | perp.isNull() | (spot < 0) | (perp < 0) | F.coalesce(F.isnan(idle), F.lit(False))
    out = F.when(unknown, "unknown").when(spot >= perp, "keep")
    if stale > 0:
        out = out.when(idle.isNull(), F.when(spot == 0, "prune").otherwise("unknown")).when(idle < stale, "keep")
    return out.otherwise("prune")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
