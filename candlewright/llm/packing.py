"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the longest length are cut into pieces of it and a rest.  The plan is made on the histogram of piece
sizes, which has one count for each size up to the longest length, so it is the same at every input size and needs no
sequential pass over documents: sizes are taken in descending order; for each permitted length a bin is filled best
fit (the largest piece that fits), the length with the least cost per token is opened, the pattern is used as often as
its scarcest size allows, and each bin is finally downsized to the least permitted length that holds its contents.

Pieces get their place by rank within their size.  Ranks are counted in two levels (by bucket, then over buckets), so
a size that very many pieces share is never in one task.

Rows with no tokens or null texts get one row without a bin; repeated rows are packed on their own; ties go by
identifier, then by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

LENGTHS = (512, 1024, 2048, 4096)


def cost(length: int) -> float:
    """Cost of a sequence: its tokens, more by the share that attention adds."""
    return length * (1 + length / 65536)


def plan(count: np.ndarray, lengths=LENGTHS):
    """Patterns (times, capacity, sizes) for counts by size; count is used up."""
    largest = max(lengths)
    top = largest
    while True:
        while top and not count[top]:
            top -= 1
        if not top:
            return
        best = None
        for length in lengths:
            if length < top:
                continue
            left, need = length - top, {top: 1}
            while left:
                fits = np.flatnonzero(count[1 : left + 1])[::-1] + 1
                size = next((int(s) for s in fits if count[s] > need.get(int(s), 0)), 0)
                if not size:
                    break
                more = min(left // size, int(count[size]) - need.get(size, 0))
                need[size] = need.get(size, 0) + more
                left -= more * size
            used = length - left
            price = cost(min(x for x in lengths if x >= used)) / used
            if best is None or price < best[0]:
                best = price, used, need
        _, used, need = best
        times = min(int(count[s]) // k for s, k in need.items())
        for s, k in need.items():
            count[s] -= times * k
        yield times, min(x for x in lengths if x >= used), need


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths=LENGTHS) -> DataFrame:
    """(id, chunk, n_tokens, bin_id, capacity, bin_offset long): where each piece of each text lies; tokens are words."""
    spark = docs.sparkSession
    c.prepare(spark)
    largest = max(lengths)
    n = c.layout(docs, 64 << 20).parts
    spaces = F.translate(F.coalesce(docs[f"`{text_col}`"], F.lit("")), " \t\n\x0b\f\r", " " * 6)
    sized = docs.select(docs[f"`{id_col}`"].alias("id"), F.monotonically_increasing_id().alias("rid"), F.size(F.array_remove(F.split(spaces, " "), "")).cast("long").alias("n"))
    pieces = sized.select("id", "rid", F.explode(F.expr(f"CASE WHEN n = 0 THEN array(named_struct('chunk', 0L, 'size', 0L)) ELSE transform(sequence(0L, (n - 1) div {largest}), i -> named_struct('chunk', i, 'size', least(n - i * {largest}, {largest}L))) END")).alias("p"))
    pieces = pieces.select("id", "rid", F.col("p.chunk").alias("chunk"), F.col("p.size").alias("size"), F.expr(f"cast(pmod(xxhash64(id, rid, p.chunk), {n}) as int)").alias("bucket"))
    pieces = c.materialise(pieces, "pieces")

    by_bucket = pieces.where("size > 0").groupBy("size", "bucket").count()
    before = by_bucket.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    count = np.zeros(largest + 1, np.int64)
    for size, k in by_bucket.groupBy("size").agg(F.sum("count")).collect():  # a row for each size
        count[size] = k
    patterns = list(plan(count, lengths))
    segments: dict[int, list] = {}
    bins = 0
    for times, capacity, need in patterns:
        at = 0
        for size, k in sorted(need.items(), reverse=True):
            segments.setdefault(size, []).append((times * k, bins, k, at, capacity))
            at += size * k
        bins += times
    table = spark.sparkContext.broadcast({s: np.array(x, np.int64) for s, x in segments.items()})  # bounded by the sizes

    ranked = (
        pieces.join(before.select("size", "bucket", "before"), ["size", "bucket"], "left")
        .withColumn("rank", F.row_number().over(W.partitionBy("bucket", "size").orderBy("id", "rid", "chunk")) - 1 + F.coalesce("before", F.lit(0)))
        .select("id", "chunk", F.col("size").alias("n_tokens"), F.col("rank").cast("long").alias("rank"))
    )

    def place(batches):
        ends = {s: np.cumsum(x[:, 0]) for s, x in table.value.items()}
        for batch in batches:
            size, rank = batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy()
            out = np.full((3, len(size)), -1, np.int64)
            for s, at in c.split_by(size, np.arange(len(size))):
                if s:
                    rows = np.searchsorted(ends[s], rank[at], "right")
                    times, first, k, offset, capacity = table.value[s][rows].T
                    inside = rank[at] - (ends[s][rows] - times)
                    out[:, at] = first + inside // k, capacity, offset + inside % k * s
            none = size == 0
            yield pa.record_batch([batch.column("id"), batch.column("chunk"), batch.column("n_tokens"), *(pa.array(x, pa.int64(), mask=none) for x in out)], ["id", "chunk", "n_tokens", "bin_id", "capacity", "bin_offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, chunk long, n_tokens long, bin_id long, capacity long, bin_offset long")
