"""Pair lists, spot and perp reconciliation, unions of tables, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .order import ranked


def perp_first(pairs: DataFrame) -> DataFrame:
    """One symbol a base and exchange: its perpetual if there is one, else its spot pair."""
    pairs = pairs.where(~S.skip_pair(F.col("ticker"), F.col("exchange")))
    perp = S.is_perp(F.col("ticker"))
    out = pairs.groupBy("exchange", S.base_of(F.col("ticker")).alias("base")).agg(F.max(F.when(perp, F.col("ticker"))).alias("swap"), F.max(F.when(~perp, F.col("ticker"))).alias("spot"))
    return out.select("exchange", "base", F.coalesce("swap", "spot").alias("ticker"))


def drop_stale_spot(rows: DataFrame, lag_sec: int) -> DataFrame:
    """Rows without spot rows that are more than lag_sec older than the perp of their base and exchange; no join.

    Times are compared in seconds, whatever unit a row has; an unknown time counts as 0, and a perp without one drops nothing.
    """
    perp = S.is_perp(F.col("ticker"))
    w = W.partitionBy("exchange", S.base_of(F.col("ticker")))
    seconds = F.coalesce(S.epoch_sec(F.col("ts")), F.lit(0))
    out = rows.withColumn("perp_ts", F.max(F.when(perp, seconds)).over(w))
    return out.where(perp | (F.coalesce("perp_ts", F.lit(0)) == 0) | (seconds >= F.col("perp_ts") - lag_sec)).drop("perp_ts")


def zombie_plan(tables: DataFrame, now: int) -> DataFrame:
    """Spot tables beside their perp tables with a verdict (tables: ticker, exchange, bars, last_ts)."""
    key = [S.base_of(F.col("ticker")).alias("base"), "exchange"]
    perp = tables.where(S.is_perp(F.col("ticker"))).select(*key, F.col("bars").alias("perp_bars"))
    spot = tables.where(~S.is_perp(F.col("ticker"))).select(*key, F.col("ticker").alias("spot"), F.col("bars").alias("spot_bars"), (F.lit(now) - F.col("last_ts")).cast("double").alias("idle"))
    out = perp.join(spot, ["base", "exchange"])
    return out.withColumn("verdict", S.zombie_verdict(F.col("spot_bars"), F.col("perp_bars"), F.col("idle")))


def prune_order(plan: DataFrame) -> DataFrame:
    """The prune list, most bars gained first; places are counted by ranges of gains."""
    gain = F.greatest(F.lit(0), F.coalesce(F.col("perp_bars") - F.col("spot_bars"), F.lit(0)))
    out = plan.where("verdict = 'prune'").withColumn("gain", gain)
    return ranked(out, "gain", "spot", "exchange")


def over_prune(pruned, tables, fraction: float):
    """Whether a prune list is implausibly large and needs a second consent; counts as columns."""
    return F.lit(fraction > 0) & (tables > 0) & (pruned > fraction * tables)


def carry(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and old rows whose key was not read again."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def union_stable(frames: list[DataFrame]) -> DataFrame:
    """Union of tables by name; a column whose types differ in kind becomes text, a missing one is null."""
    kind = lambda t: "number" if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal") else t
    kinds: dict[str, set] = {}
    for df in frames:
        for name, t in df.dtypes:
            kinds.setdefault(name, set()).add(kind(t))
    text = {name for name, k in kinds.items() if len(k) > 1}
    cast = [df.select(*(F.col(x).cast("string").alias(x) if x in text else F.col(x) for x in df.columns)) for df in frames]
    out = cast[0]
    for df in cast[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, columns): the schema of each Parquet file below a folder as DDL, read from the files by tasks."""

    def task(frames):
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        plain = {"int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "double": "double", "float": "float", "string": "string", "large_string": "string", "bool": "boolean", "date32[day]": "date", "binary": "binary"}

        def ddl(kind: pa.DataType) -> str:
            if pa.types.is_timestamp(kind):
                return "timestamp" if kind.tz else "timestamp_ntz"
            if pa.types.is_list(kind):
                return f"array<{ddl(kind.value_type)}>"
            if pa.types.is_decimal(kind):
                return f"decimal({kind.precision},{kind.scale})"
            return plain[str(kind)]

        for frame in frames:
            schemas = [pq.read_schema(io.BytesIO(x)) for x in frame["content"]]
            yield frame[["file"]].assign(columns=[", ".join(f"`{f.name}` {ddl(f.type)}" for f in s) for s in schemas])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file"), "content").mapInPandas(task, "file string, columns string")


def union_files(spark: SparkSession, path: str) -> DataFrame:
    """Union of all tables below a folder, as union_stable has it, with the `file` that a row is from.

    Files are grouped by their schema: a scan reads all files of one, so the plan grows with schemas and not with tables.
    """
    groups = manifest(spark, path).groupBy("columns").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("columns").collect()  # names of tables
    frames = [spark.read.schema(g.columns).parquet(*g.files).withColumn("file", F.col("_metadata.file_path")) for g in groups]
    if not frames:
        raise ValueError(f"no tables in {path}")
    return union_stable(frames)


def retype(df: DataFrame, columns: list[str], flags: list[str] = (), never: list[str] = ()) -> DataFrame:
    """Text columns as doubles where every value that is not blank parses, else left as text; flags become booleans.

    One aggregation decides on all columns; `never` lists columns that are text by meaning.
    """
    tried = [x for x in columns if x not in never and x not in flags]
    if tried:
        lost = df.agg(*(F.count_if(~S.blank(F.col(x)) & F.trim(x).try_cast("double").isNull()).alias(x) for x in tried)).first()
        whole = [x for x in tried if not lost[x]]
        df = df.withColumns({x: F.when(~S.blank(F.col(x)), F.trim(x).try_cast("double")) for x in whole})
    return df.withColumns({x: S.flag(F.col(x).cast("string")) for x in flags}) if flags else df


def with_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Adds the columns of a schema that a table lacks, as nulls of their type; what it has keeps its type."""
    return df.withColumns({x: F.lit(None).cast(t) for x, t in schema.items() if x not in df.columns})


def growth(bars: DataFrame, now: int, days: int) -> DataFrame:
    """Growth from the least low of the last days to the last close; times in milliseconds are normalised first."""
    bars = bars.withColumn("ts", S.epoch_sec(F.col("ts")))
    out = bars.groupBy("ticker", "exchange").agg(F.max_by("close", "ts").alias("close"), F.min(F.when(F.col("ts") >= now - days * 86400, F.col("low"))).alias("low"))
    return out.withColumn("growth_pct", F.round(S.growth_pct(F.col("close"), F.col("low")), 6))
