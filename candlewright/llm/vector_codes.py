"""Vector code compression: a product quantiser with integer codebooks.

Vectors are cut into equal consecutive parts and every part position has a codebook of its own, whose entries start as the
parts of the vectors with the smallest identifiers.  The codebooks are broadcast (parts x entries x components of a part
integers, whatever the input); a task takes an Arrow batch at a time, gets all distances of a part by norm expansion and an
exact int64 matrix product, and takes the first least.  A batch leaves one row for each entry that it used, with a
count and sums; rows meet in a grouped shuffle, so a round sends the driver parts x entries rows at most.  Every round
reads the source again instead of storing a copy of it.

Rows without a vector, of another length, or with a null or non-finite component have no code; rows with a null identifier
get one but start no codebook; repeated rows count each; ties go to the lower entry, ties of starting rows by their vectors;
with fewer rows than entries a codebook has one entry a row; an empty table gives an empty result; null labels are one
label; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from . import vectors as V

BATCH = 2048  # vectors whose distances are held at once


def assign(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry: v (rows, parts * width), books (parts, entries, width)."""
    parts, _, width = books.shape
    index, error = np.empty((len(v), parts), np.int64), np.empty((len(v), parts), np.int64)
    for p in range(parts):
        found = V.squared(v[:, p * width : (p + 1) * width], books[p])
        index[:, p] = found.argmin(axis=1)
        error[:, p] = np.take_along_axis(found, index[:, p, None], 1)[:, 0]
    return index, error


def pieces(batches, dims: int):
    """(batch, its vectors as integers) in pieces of at most BATCH rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, V.integers(part.column("vector"), dims)


def entry_sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums) of the rows nearest to each entry, merged by a grouped shuffle; unused entries have no row."""
    parts, entries, width = books.shape
    spread = vectors.sparkSession.sparkContext.broadcast(books)

    def task(batches):
        for _, v in pieces(batches, parts * width):
            index, _ = assign(v, spread.value)
            cell = (index + np.arange(parts) * entries).ravel()
            sums = np.zeros((parts * entries, width), np.int64)
            np.add.at(sums, cell, v.reshape(-1, width))
            n = np.bincount(cell, minlength=parts * entries)
            used = np.flatnonzero(n)
            yield pa.record_batch([pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(n[used], pa.int64()), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    found = vectors.mapInArrow(task, "part int, entry int, n long, s array<long>")
    exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact)


def first_books(vectors: DataFrame, parts: int, entries: int, dims: int) -> np.ndarray:
    """Codebooks of the parts of the vectors with the smallest identifiers: `entries` rows are read to the driver."""
    found = vectors.where("id IS NOT NULL").orderBy("id", "vector").limit(entries).select("vector").toArrow()
    v = V.integers(found.column("vector").combine_chunks(), dims) if found.num_rows else np.empty((0, dims), np.int64)
    return np.ascontiguousarray(v.reshape(-1, parts, dims // parts).transpose(1, 0, 2))


def fit(vectors: DataFrame, parts: int, entries: int, rounds: int, dims: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after the rounds."""
    books = first_books(vectors, parts, entries, dims)
    for _ in range(rounds if books.size else 0):
        for row in entry_sums(vectors, books).collect():  # a row for each entry
            books[row.part, row.entry] = V.floor_mean(row[3:], row.n)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, keep: dict[str, str] | None = None) -> DataFrame:
    """(id, kept columns, code, error): two hex digits for each part's entry, squared distances summed over parts."""
    dims = books.shape[0] * books.shape[2]
    spread = vectors.sparkSession.sparkContext.broadcast(books)
    names = ["id", *(keep or {})]

    def task(batches):
        for part, v in pieces(batches, dims):
            index, error = assign(v, spread.value)
            text = index.astype(np.uint8).tobytes().hex()
            step = 2 * books_parts
            codes = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.record_batch([*(part.column(x) for x in names), pa.array(codes, pa.string()), pa.array(error.sum(axis=1), pa.int64())], [*names, "code", "error"])

    books_parts = books.shape[0]
    kinds = ", ".join(f"{x} {vectors.schema[x].dataType.simpleString()}" for x in names)
    return vectors.mapInArrow(task, f"{kinds}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """The rows with `decoded`, the vector that a code stands for (integers / 256)."""
    parts, _, width = books.shape
    table = codes.sparkSession.createDataFrame([(p, [[float(x) / V.SCALE for x in e] for e in books[p].tolist()]) for p in range(parts)], "p int, entries array<array<double>>")
    whole = F.broadcast(table.agg(F.sort_array(F.collect_list(F.struct("p", "entries"))).alias("_books")))  # the codebooks
    entry = f"conv(substring({code_col}, 2 * i + 1, 2), 16, 10)"
    found = F.expr(f"CASE WHEN {code_col} IS NOT NULL THEN flatten(transform(sequence(0, {parts - 1}), i -> _books[i].entries[cast({entry} as int)])) END")
    return codes.crossJoin(whole).withColumn("decoded", found).drop("_books")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, dims: int = 64) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): codes of every vector that counts."""
    if dims % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide dims, and an entry's index has two hex digits")
    c.prepare(rows.sparkSession)
    vectors = V.finite(c.columns(rows, id=id_col, vector=vector_col, label=label_col), dims)
    books = fit(vectors, parts, entries, rounds, dims)
    found = c.materialise(encode(vectors, books, {"label": label_col}), "codes")
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    # a label may have most rows: sums are small, and a skewed side of the join is split at run time
    whole = found.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return whole.select("id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
