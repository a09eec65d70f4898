"""Order statistics without one task that sorts a group: ranges are counted first, and only the range that holds a place is
looked into.

A group (an exchange, say) may have most of the rows.  Its values are cut at approximate quantiles into ranges, counted in
one aggregation that combines in the tasks; the counts tell in which range a place lies.  The rows of that range alone are
counted by value.  A range that still has more than `most` values is cut again, so no window has more rows than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise

RANGES = 64
SMALL_BYTES = 64 << 20  # of cuts or places that are broadcast


def cuts(rows: DataFrame, group: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """(group, cuts): ascending values that cut a group into ranges of about equal size; few numbers a group."""
    shares = [i / ranges for i in range(1, ranges)]
    return rows.groupBy(*group).agg(F.array_distinct(F.percentile_approx(value, F.array(*map(F.lit, shares)), 20 * ranges)).alias("_cuts"))


def range_of(value: Column, cuts: Column) -> Column:
    """How many cuts are at most the value."""
    return F.size(F.filter(cuts, lambda c: c <= value))


def _with_cuts(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    return _join(rows, _if_small(materialise(cuts(rows, group, value), "cuts")), group)


def _if_small(stored: DataFrame) -> DataFrame:
    """A stored table with a row or so for each group, broadcast if it is small: rows of a hot group then stay where they are."""
    return F.broadcast(stored) if stored.count() * RANGES * 16 <= SMALL_BYTES else stored


def at_places(rows: DataFrame, group: list[str], value: str, places, most: int = 1_000_000) -> DataFrame:
    """(group, n, at): of each group the number of values, and `at`, those at places (from 0) of their ascending order.

    places: from the column of a group's count to an array of places; null values do not count, NaN is the largest.
    Groups come in any number; a group's places are few.
    """
    rows = materialise(rows.where(F.col(value).isNotNull()).select(F.lit(0).alias("_all"), *group, F.col(value).alias("_v")), "values")
    group = ["_all", *group]
    asked = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.explode(places(F.col("n")))).where("place BETWEEN 0 AND n - 1")
    asked = asked.withColumn("_left", F.col("place"))
    keys, pool = list(group), rows.withColumn("_k", F.lit(1).cast("long"))
    while True:
        parts = _with_cuts(pool, keys, "_v").withColumn("_r", range_of(F.col("_v"), F.col("_cuts"))).drop("_cuts")
        counts = parts.groupBy(*keys, "_r").agg(F.sum("_k").alias("_k"))
        before = F.coalesce(F.sum("_k").over(W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = _join(asked, counts.withColumn("_before", before), keys).where("_left >= _before AND _left < _before + _k")
        hit = materialise(hit.select(*keys, "n", "place", (F.col("_left") - F.col("_before")).alias("_left"), "_r"), "places")
        wanted = materialise(hit.select(*keys, "_r").distinct(), "wanted")
        inside = _join(parts, _if_small(wanted), [*keys, "_r"], "left_semi")
        by_value = materialise(inside.groupBy(*keys, "_r", "_v").agg(F.sum("_k").alias("_k")), "range-values")
        if (by_value.groupBy(*keys, "_r").count().agg(F.max("count")).first()[0] or 0) <= most:
            break
        # cut again: a range becomes a group of its own, and its values count once each, so it does fall apart
        name = f"_g{len(keys)}"
        pool, asked = by_value.withColumnRenamed("_r", name), hit.withColumnRenamed("_r", name)
        keys = [*keys, name]
    w = W.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    by_value = by_value.withColumn("_to", F.sum("_k").over(w)).withColumn("_from", F.col("_to") - F.col("_k"))
    values = _join(hit, by_value, [*keys, "_r"]).where("_left >= _from AND _left < _to")
    return values.groupBy(*group[1:], "n").agg(F.map_from_entries(F.collect_set(F.struct("place", "_v"))).alias("at"))


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null, whose columns come from a."""
    named = b.select(*(F.col(k).alias(f"_b_{k}") for k in keys), *(x for x in b.columns if x not in keys))
    out = a.join(named, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys], how)
    return out.drop(*(f"_b_{k}" for k in keys))


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, a column for each share): interpolated quantiles, exact."""
    where = lambda n, q: (n - 1) * F.lit(q)
    both = lambda n: F.array_distinct(F.flatten(F.array(*(F.array(F.floor(where(n, q)), F.ceil(where(n, q))) for q in shares.values()))))
    found = at_places(rows, group, value, both)
    n = F.col("n")

    def one(q: float) -> Column:
        low, high = F.col("at")[F.floor(where(n, q))], F.col("at")[F.ceil(where(n, q))]
        return low + (high - low) * (where(n, q) - F.floor(where(n, q)))

    return found.select(*group, "n", *(one(q).alias(name) for name, q in shares.items()))


def ranked(rows: DataFrame, by: str, *ties: str, place: str = "place") -> DataFrame:
    """Adds the place of each row by a value, greatest first, null last; ties by other columns.

    Rows are dealt by ranges of the whole order, so equal values are split too where the ties differ; a row's place is its
    number in its range behind the rows of the ranges above.
    """
    keys = [F.desc_nulls_last(by), *(F.asc(t) for t in ties)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ranked").withColumn("_range", F.shiftright("_id", 33))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_k"))  # a row a partition
    above = counts.select(F.col("_range").alias("_q"), F.coalesce(F.sum("_k").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    out = dealt.join(F.broadcast(above), F.col("_range") == F.col("_q"))
    return out.withColumn(place, (F.col("_id") - F.shiftleft("_range", 33) + F.col("_above") + 1).cast("int")).drop("_id", "_range", "_q", "_above")
