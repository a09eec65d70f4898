"""Delta Lloyd: k-means over integer vectors whose rounds touch what changed.

Vectors are stored once, in blocks; a table beside them holds the assignments, a row a block, and is written anew each
round.  Both are bucketed by block, so a round joins them in place and no vector moves.  Global sums and counts of clusters
persist from round to round.  In a round, a vector whose owner's centroid changed is compared with all centroids; any
other is compared with the changed centroids only, as its own distance and those to the rest are what they were.  A block
leaves a signed transfer for each cluster that lost or gained vectors (count and sums); transfers meet in a grouped
shuffle and k rows reach the driver, which adds them to the global sums.  Integers all along: results do not depend on
the order of tasks.

Rows without a vector, of another length, or with a null or non-finite component are left out; rows with a null identifier
are clustered but start no centroid; repeated rows count each; ties go to the smaller number, ties of starting rows by
vector; with fewer rows than k there is a centroid for each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from . import vectors as V

BLOCK = 4096  # vectors
STATE = "block long, state binary, moves array<struct<cluster: int, n: bigint, s: array<bigint>>>, inertia array<struct<cluster: int, n: bigint, d: bigint>>"
_MOVES = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))
_INERTIA = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("d", pa.int64())]))


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """(block, vectors): blocks of identifiers and integer vectors, numbered by partition and place."""

    def task(batches):
        held, ids, n, number = [], [], 0, TaskContext.get().partitionId() << 32

        def out():
            data = c.pack(np.concatenate(ids), c._narrow(np.concatenate(held)))
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["block", "vectors"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held.append(V.integers(part.column("vector"), dims))
                ids.append(c.ids_of(part.column("id")))
                n += part.num_rows
                if n >= BLOCK:
                    yield out()
                    held, ids, n, number = [], [], 0, number + 1
        if n:
            yield out()

    return vectors.mapInArrow(task, "block long, vectors binary")


def reassign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) after some centroids changed; owner -1: none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        found = V.squared(v[lost], centroids)
        owner[lost] = found.argmin(axis=1)
        distance[lost] = found.min(axis=1)
    rest, moved = np.flatnonzero(~lost), np.flatnonzero(changed)
    if len(rest) and len(moved):
        found = V.squared(v[rest], centroids[moved])
        best = found.argmin(axis=1)
        least, number = found[np.arange(len(rest)), best], moved[best]
        better = (least < distance[rest]) | ((least == distance[rest]) & (number < owner[rest]))
        owner[rest[better]] = number[better]
        distance[rest[better]] = least[better]
    return owner, distance


def transfers(v: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """Signed counts and sums by cluster of the vectors whose owner is another now."""
    moved = np.flatnonzero(before != after)
    cluster = np.concatenate([before[moved], after[moved]])
    sign = np.repeat([-1, 1], len(moved))
    values = np.concatenate([-v[moved], v[moved]])
    return [{"cluster": k, "n": int(s.sum()), "s": x.sum(axis=0).tolist()} for k, s, x in c.split_by(cluster, sign, values) if k >= 0]


def bucketed(rows: DataFrame, name: str, n: int) -> DataFrame:
    """Rows as a table in the shared folder, bucketed by block; the catalog's entry goes once the frame knows its files."""
    spark = rows.sparkSession
    path, table = c.fresh(spark, name), f"candlewright_{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(n, "block").option("path", path).option("compression", "zstd").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def assignment_round(stored: DataFrame, state: DataFrame | None, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The state of every block after centroids changed: the join is by bucket, without an exchange."""
    spread = stored.sparkSession.sparkContext.broadcast((centroids, changed))
    if state is None:
        rows = stored.withColumn("state", F.lit(None).cast("binary"))
    else:
        rows = stored.hint("merge").join(state.select("block", "state"), "block")

    def task(batches):
        centres, new = spread.value
        for batch in batches:
            for i in range(batch.num_rows):
                _, v = c.unpack(batch.column("vectors")[i].as_py())
                v = v.astype(np.int64)
                known = batch.column("state")[i].as_py()
                owner, distance = c.unpack(known) if known else (np.full(len(v), -1, np.int64), np.zeros(len(v), np.int64))
                to, d = reassign(v, owner, distance, centres, new)
                sums = [{"cluster": k, "n": len(x), "d": int(x.sum())} for k, x in c.split_by(to, d)]
                yield pa.record_batch([batch.column("block").slice(i, 1), pa.array([c.pack(to, d)], pa.binary()), pa.array([transfers(v, owner, to)], _MOVES), pa.array([sums], _INERTIA)], ["block", "state", "moves", "inertia"])

    return rows.select("block", "vectors", "state").mapInArrow(task, STATE)


def first_centroids(vectors: DataFrame, k: int, dims: int, salt: str) -> np.ndarray:
    """The vectors with the smallest hashes of their identifiers: k rows are read to the driver."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    found = vectors.where("id IS NOT NULL").withColumn("key", key).orderBy("key", "vector").limit(k).select("vector").toArrow()
    return V.integers(found.column("vector").combine_chunks(), dims) if found.num_rows else np.empty((0, dims), np.int64)


def moved_sums(state: DataFrame, dims: int) -> list:
    """Transfers of a round by cluster: a row for each cluster that lost or gained, with decimal sums."""
    rows = state.select(F.inline("moves"))
    exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    spark = rows.sparkSession
    c.prepare(spark)
    vectors = V.finite(c.columns(rows, id=id_col, vector=vector_col).withColumn("id", F.col("id").cast("long")), dims)
    centroids = first_centroids(vectors, k, dims, salt)
    out = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    n = c.layout(vectors, 64 << 20).parts
    stored = bucketed(blocks(vectors, dims).repartition(n, "block"), "vectors", n)
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    changed, state = np.ones(len(centroids), bool), None
    for _ in range(rounds):
        state = bucketed(assignment_round(stored, state, centroids, changed), "owners", n)
        for row in moved_sums(state, dims):
            counts[row.cluster] += row.n
            sums[row.cluster] = [a + int(b) for a, b in zip(sums[row.cluster], row[2:])]
        after = np.array([V.floor_mean(s, m) if m else old for s, m, old in zip(sums, counts, centroids.tolist())], np.int64)
        changed, centroids = (after != centroids).any(axis=1), after
    state = bucketed(assignment_round(stored, state, centroids, changed), "owners", n)
    inertia = dict.fromkeys(range(len(centroids)), 0)
    for row in state.select(F.inline("inertia")).groupBy("cluster").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d")).collect():
        inertia[row.cluster] = int(row.d)
    total = sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids.tolist()]
    inertias = np.array([inertia[i] for i in range(len(centroids))], np.int64)

    def rows_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _ = c.unpack(batch.column("vectors")[i].as_py())
                owner, distance = c.unpack(batch.column("state")[i].as_py())
                sha = pa.DictionaryArray.from_arrays(pa.array(owner, pa.int32()), pa.array(names)).cast(pa.string())
                yield pa.record_batch([c.ids_array(ids), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(inertias[owner], pa.int64()), pa.array(np.full(len(ids), total), pa.int64()), sha], ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return stored.hint("merge").join(state.select("block", "state"), "block").select("vectors", "state").mapInArrow(rows_of, out)
