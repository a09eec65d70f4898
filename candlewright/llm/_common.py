"""What the training-data operators share: shared-folder tables, packed rows, text blocks.

Large intermediate relations (one row per shingle, anchor or token) travel as *packed rows*: a bucket
number and a zstd-compressed bundle of numpy arrays.  A task packs what it has found for a partition, so that
a shuffle moves a few hundred bytes per hundred items, and a reducer handles one bucket at a time in
bounded memory.  Buckets follow the input size; partitions do so up to MOST.  Beyond it a partition has several
buckets: what it received is split by bucket and sorted (Spark spills a sort), then taken bucket by bucket.
"""

from __future__ import annotations

import contextlib
import math
import pickle
import re
import tempfile
import uuid
import zipfile
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, shared_dir

NULL_ID = np.iinfo(np.int64).min  # stands for a null identifier inside packed rows
FLUSH_BYTES = 16 << 20  # text gathered before a task combines what it found
BLOCK_BYTES = 1 << 20  # text handled by one run of vectorised steps
PACKED = "bucket int, kind int, data binary"

MOST = 16_384  # partitions of a shuffle of packed rows, however large the input

_tables: dict[str, dict[str, list[str]]] = {}
_owner = [""]
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, remembered for purge()."""
    path = f"{shared_dir(spark)}/candlewright/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, {}).setdefault(_owner[-1], []).append(path)
    return path


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.  options: the writer's."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def owned(name: str):
    """Tables that are written inside belong to an owner, whose purge() leaves all others alone."""
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def purge(spark: SparkSession, owner: str = "") -> None:
    """Delete an owner's tables; call it once results are stored.  An operator's result is lazy and reads its tables
    when it is written, so only the caller knows when they can go; without an owner: those of operators called directly."""
    for path in _tables.get(spark.sparkContext.applicationId, {}).pop(owner, []):
        delete(spark, path)


@contextlib.contextmanager
def tables(spark: SparkSession):
    """Deletes what operators that were called inside have written, once the caller has stored their results."""
    name = uuid.uuid4().hex
    with owned(name):
        try:
            yield
        finally:
            purge(spark, name)


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application; bounds Arrow batches by bytes, as packed rows are large."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="candlewright-"), "candlewright.zip")  # read by the driver only, which serves it
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) > 16 << 20:
        spark.conf.set(key, 16 << 20)


@dataclass(frozen=True)
class Layout:
    """How items are dealt by a 64-bit key: to `parts` partitions, `subs` buckets in each."""

    parts: int
    subs: int = 1

    def part(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) % np.uint64(self.parts)).astype(np.int32)

    def sub(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) // np.uint64(self.parts)) % np.uint64(self.subs)).astype(np.int32)

    def part_of(self, ids: np.ndarray) -> np.ndarray:
        return self.part(spread(ids))


def spread(ids: np.ndarray) -> np.ndarray:
    """A key that deals identifiers evenly."""
    return mix(np.asarray(ids).astype(np.int64, copy=False).view(np.uint64))


def stored_bytes(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size > 1 << 58 else size  # no statistics


def layout(df: DataFrame, each: int, least: int = 1, by_session: bool = True) -> Layout:
    """Buckets for `each` bytes of stored input; by_session: at least the session's shuffle partitions."""
    n = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if by_session else 1, math.ceil(stored_bytes(df) / each))
    return Layout(min(n, MOST), -(-n // MOST))


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under internal names, so that extra columns cannot clash."""
    return df.select(*(df[f"`{column}`"].alias(name) for name, column in names.items()))


def deal(df: DataFrame, where: Layout, keys: dict | None = None) -> DataFrame:
    """Packed rows by bucket: partition p gets the rows with bucket p, so that none gets several by chance.

    With several buckets to a partition, the items of each row are split among them: keys has, by kind, a function of a
    row's arrays (or of an Arrow batch) to the items' keys; a kind without one goes to the first bucket whole.
    """
    dealt = df.repartitionById(where.parts, F.col("bucket"))
    if where.subs == 1:
        return dealt
    keys = keys or {}

    def split(batches):
        held, size = {}, 0

        def flush():
            out = Rows()
            for (sub, kind), parts in held.items():
                if isinstance(parts[0], pa.RecordBatch):
                    data = pack_batch(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                else:
                    data = pack(*(np.concatenate(x) for x in zip(*parts)))
                out.add(sub, kind, data)
                yield from out.batches(4 << 20)
            yield from out.batches()
            held.clear()

        for _, kind, data in packed_rows(batches):
            if kind not in keys:
                yield from Rows.one(0, kind, data)
                continue
            of, whole = keys[kind]
            items = unpack_batch(data) if whole else unpack(data)
            sub = where.sub(of(items))
            for b, at in split_by(sub, np.arange(len(sub))):
                held.setdefault((b, kind), []).append(items.take(pa.array(at)) if whole else tuple(x[at] for x in items))
            size += len(data)
            if size >= FLUSH_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return dealt.mapInArrow(split, PACKED).sortWithinPartitions("bucket")


def by_bucket(batches):
    """(bucket, [(kind, data)]) of packed rows that come sorted by bucket, one bucket at a time."""
    held, last = [], None
    for bucket, kind, data in packed_rows(batches):
        if held and bucket != last:
            yield last, held
            held = []
        last = bucket
        held.append((kind, data))
    if held:
        yield last, held


def _narrow(a: np.ndarray) -> np.ndarray:
    lo, hi = int(a.min()), int(a.max())
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= lo and hi <= np.iinfo(kind).max:
            return a.astype(kind)
    return a


def pack(*arrays) -> bytes:
    """Arrays as compressed bytes; 64-bit integers go as they are or as differences, whichever is narrower."""
    out = []
    for a in arrays:
        if isinstance(a, np.ndarray) and a.ndim == 1 and len(a) and a.dtype in (np.int64, np.uint64):
            v = a.view(np.int64)
            with np.errstate(over="ignore"):
                plain, steps = _narrow(v), _narrow(np.diff(v, prepend=v[:1]))
            out.append((a.dtype.str, 1, v[0], steps) if steps.itemsize < plain.itemsize else (a.dtype.str, 0, 0, plain))
        else:
            out.append((None, 0, 0, a))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, 5))


def unpack(data: bytes) -> tuple:
    out = []
    for kind, steps, first, a in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        if kind:
            a = a.astype(np.int64)
            if steps:
                a = np.cumsum(a) + first
            a = a.view(kind)
        out.append(a)
    return tuple(out)


class Rows:
    """Gathers packed rows for output, a bounded batch at a time."""

    def __init__(self) -> None:
        self.bucket, self.kind, self.data, self.size = [], [], [], 0

    def add(self, bucket: int, kind: int, data: bytes) -> None:
        self.bucket.append(bucket)
        self.kind.append(kind)
        self.data.append(data)
        self.size += len(data)

    @classmethod
    def one(cls, bucket: int, kind: int, data: bytes):
        out = cls()
        out.add(bucket, kind, data)
        yield from out.batches()

    def batches(self, least: int = 0):
        if self.bucket and self.size >= least:
            out = pa.record_batch([pa.array(self.bucket, pa.int32()), pa.array(self.kind, pa.int32()), pa.array(self.data, pa.binary())], ["bucket", "kind", "data"])
            self.__init__()
            yield out


def packed_rows(batches):
    """(bucket, kind, data) of packed rows."""
    for batch in batches:
        b, k, d = batch.column("bucket"), batch.column("kind"), batch.column("data")
        for i in range(batch.num_rows):
            yield b[i].as_py(), k[i].as_py(), d[i].as_py()


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ids_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty."""
    column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if big else np.int32, len(column) + 1, column.offset * (8 if big else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, most: int = BLOCK_BYTES):
    """(ids, bytes, offsets) of whole documents, about `most` bytes at a time; a longer text is a block of its own."""
    ids, parts, lengths, size = [], [], [], 0

    def out():
        text = np.concatenate(parts) if parts else np.empty(0, np.uint8)
        return np.concatenate(ids), text, np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)

    for batch in batches:
        own = ids_of(batch.column("id"))
        data, offsets = texts_of(batch.column("text"))
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most - size, "right")) - 1)
            if size and offsets[to] - offsets[at] + size > most:
                yield out()
                ids, parts, lengths, size = [], [], [], 0
                continue
            ids.append(own[at:to])
            parts.append(data[offsets[at] : offsets[to]])
            lengths.append(np.diff(offsets[at : to + 1]))
            size += int(offsets[to] - offsets[at])
            at = to
    if ids:
        yield out()


def split_by(bucket: np.ndarray, *arrays):
    """(bucket, arrays of its rows) for each bucket, rows in their order."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edges = np.flatnonzero(np.diff(sorted_)) + 1
    for rows in np.split(order, edges) if len(order) else ():
        yield int(bucket[rows[0]]), *(a[rows] for a in arrays)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on uint64."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_rng = np.random.default_rng(20240131)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(text: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Words `[^\\x20\\x09-\\x0D]+` of a block: (uint64 hash, start, end, document) of each, in order.

    Words never cross documents.  The hash is a polynomial over random byte codes, finalised.
    """
    if not len(text):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    word = ~SPACE[text]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = offsets[:-1][offsets[:-1] < len(text)]
    first[begin] = word[begin]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    end = offsets[1:][offsets[1:] > 0] - 1
    last[end] = word[end]
    ends = np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends, doc
    code = BYTE_CODE[LOWER[text]] if lower else BYTE_CODE[text]
    inside = np.flatnonzero(word)
    place = inside - np.repeat(starts, ends - starts)
    value = code[inside] * POWER[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    edges = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    return mix(np.add.reduceat(value, edges) + (ends - starts).astype(np.uint64)), starts, ends, doc


def carried_row(df: DataFrame, id_col: str, carry: list[str] | None):
    """struct<id, carried: struct of the carried columns>: names cannot clash with the operator's own."""
    own = [F.struct(*(df[f"`{x}`"] for x in carry)).alias("carried")] if carry else []
    return F.struct(df[f"`{id_col}`"].alias("id"), *own)


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def unpack_batch(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()


def key_of_ids(batch: pa.RecordBatch) -> np.ndarray:
    return spread(ids_of(batch.column("id")))


def row_packs(rows: DataFrame, where: Layout, kind: int) -> DataFrame:
    """Rows with an `id` column as compressed Arrow batches dealt by id: texts move once, packed."""

    def task(batches):
        held, size = [], 0

        def flush():
            out = Rows()
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            for batch in whole:
                for b, index in split_by(where.part(key_of_ids(batch)), np.arange(batch.num_rows)):
                    out.add(b, kind, pack_batch(batch.take(pa.array(index))))
                    yield from out.batches(4 << 20)
            yield from out.batches()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(part := batch.slice(at, 256))
                size += part.nbytes
                if size >= FLUSH_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(task, PACKED)


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans [start, end) of documents as disjoint, not touching spans in order of document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]).astype(np.int64) << 42
    reach = np.maximum.accumulate(base + end)
    first = np.ones(len(doc), bool)
    first[1:] = base[1:] + start[1:] > reach[:-1]
    at = np.flatnonzero(first)
    return doc[at], start[at], (reach - base)[np.append(at[1:] - 1, len(doc) - 1)]
