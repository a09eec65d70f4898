"""True range and the outlier-filtered average of it, as column expressions over one window by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import by_pair

SMALL, LARGE, ROUNDS = 0.5, 1.8, 10


def true_range(bars: DataFrame) -> DataFrame:
    """Adds tr: the greatest of the bar's range and its distances from the close before; 0 if not finite."""
    before = F.coalesce(F.lag("close").over(by_pair()), F.col("close"))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    whole = F.col("high").isNotNull() & F.col("low").isNotNull() & before.isNotNull()
    return bars.withColumn("tr", F.when(whole & ~F.isnan(tr) & (tr != float("inf")), tr).otherwise(0.0))


def robust_atr(bars: DataFrame, period: int = 14, seed: str = "median") -> DataFrame:
    """Adds atr: the mean of the last `period` true ranges within [0.5, 1.8] of itself, ten rounds at most.

    The start is the median (or mean); a round that moves less than 1 % ends it.  The first two bars have 0.
    """
    frame = by_pair().rowsBetween(-(period - 1), 0)
    df = true_range(bars).withColumn("rn", F.row_number().over(by_pair())).withColumn("win", F.collect_list("tr").over(frame))
    mean = "aggregate({0}, 0.0D, (a, x) -> a + x) / size({0})"
    df = df.withColumn("sorted", F.array_sort("win"))
    middle = "(sorted[cast((size(sorted) - 1) div 2 as int)] + sorted[cast(size(sorted) div 2 as int)]) / 2"
    start = mean.format("win") if seed == "mean" else f"CASE WHEN {middle} > 0 THEN {middle} ELSE {mean.format('win')} END"
    df = df.withColumn("seed", F.expr(start))
    kept = f"filter(win, x -> x >= {SMALL} * s.a AND x <= {LARGE} * s.a)"
    step = f"transform(array({kept}), v -> CASE WHEN size(v) = 0 THEN named_struct('a', s.a, 'done', true) ELSE transform(array({mean.format('v')}), m -> CASE WHEN m <= 0 THEN named_struct('a', s.a, 'done', true) ELSE named_struct('a', m, 'done', abs(m - s.a) / greatest(abs(s.a), 1e-12D) < 0.01D) END)[0] END)[0]"
    fold = f"aggregate(sequence(1, {ROUNDS}), named_struct('a', seed, 'done', seed <= 0), (s, i) -> CASE WHEN s.done THEN s ELSE {step} END, s -> greatest(s.a, 0.0D))"
    return df.withColumn("atr", F.when(F.col("rn") <= 2, 0.0).otherwise(F.expr(fold))).drop("win", "sorted", "seed", "rn")
