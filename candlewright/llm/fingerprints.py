"""Document fingerprints: invertible Bloom lookup sketch of paragraph digests.

A text's paragraphs are its lines; a long one is cut after words that their hash picks (one in CUT), so that an edit
changes few pieces.  A piece's digest has 32 bits of its hash and 16 check bits of those; a repeated piece counts with
its number.  Each digest is put into three cells (count, sum of digests, seven bytes).  The sketch has as many cells as it takes to
peel all digests out of it again; it is tried larger until that succeeds.  The published fingerprint is this sketch, so
whoever has two of them can list their digests and subtract them at any size.

Likeness of two fingerprints: both are brought to a small size, their cells subtracted, and cells with one digest peeled,
which frees others, until the differing digests are recovered; if cells remain, it is done with twice as many.  It is the Jaccard
similarity that the recovered difference implies (1.0 for two empty texts).  `likeness_of` does the same for two strings.

Successors: documents are dealt by ranges of identifiers (MOST at most); the first document of a range is also given to
the range before, so that each task walks its own range, in order, as a stream.  Equal identifiers are ordered by text.
Null texts are empty; a null identifier sorts first; a table of one document is its own successor; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as c

CUT = 8  # about so many words to a piece of a long line
ROUNDS = 200  # of peeling at most; a sketch that can be peeled takes far fewer
LOW48 = np.uint64((1 << 48) - 1)


def sealed(h: np.ndarray) -> np.ndarray:
    """48-bit digests of hashes: 32 bits and 16 check bits."""
    top = h >> np.uint64(32)
    return (top << np.uint64(16)) | (c.mix(top ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(48))


def digests(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 digest, document) of the paragraph pieces of a block, all different within a document."""
    word, start, _, doc = c.words(text, offsets, lower=False)
    if not len(word):
        return word, doc
    line = np.cumsum(text == 10)[start]
    last = np.ones(len(word), bool)
    last[:-1] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]) | ((word[:-1] >> np.uint64(8)) % np.uint64(CUT) == 0)
    first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    size = np.diff(np.append(first, len(word)))
    place = np.arange(len(word)) - np.repeat(first, size)
    piece = c.mix(np.add.reduceat(word * c.POWER[place & 4095], first) + size.astype(np.uint64))
    owner = doc[first]
    order = np.lexsort((piece, owner))
    piece, owner = piece[order], owner[order]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
    number = np.arange(len(piece)) - np.maximum.accumulate(np.where(new, np.arange(len(piece)), 0))
    key = sealed(np.where(number == 0, piece, c.mix(piece + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    while True:  # different pieces can share the bits that are kept; a digest must be in a sketch once
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        again = np.flatnonzero((key[1:] == key[:-1]) & (owner[1:] == owner[:-1])) + 1
        if not len(again):
            return key, owner
        key[again] = sealed(c.mix(key[again] + np.uint64(1)))


def _places(key: np.ndarray, third: np.ndarray) -> list[np.ndarray]:
    """Three cells for each key, one in each third."""
    h = c.mix(key ^ np.uint64(0xA0761D6478BD642F))
    return [((h >> np.uint64(s)) & np.uint64(0x1FFFFF)).astype(np.int64) % third + third * i for i, s in enumerate((0, 21, 42))]


def sketch(key: np.ndarray, owner: np.ndarray, third: np.ndarray):
    """Cells (count, sum) of the sketches of all owners in a row; an owner has three times `third` of them."""
    base = np.concatenate([[0], np.cumsum(3 * third)])
    count, total = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.uint64)
    for place in _places(key, third[owner]):
        at = base[owner] + place
        count += np.bincount(at, minlength=base[-1])
        np.add.at(total, at, key)
    return count, total & LOW48


def peel(count: np.ndarray, total: np.ndarray, third: np.ndarray):
    """(owner, sign, digest, whole by owner) that peeling takes out of the sketches; the cells are used up.

    sign: 1 for a digest of the first, -1 for one of the second of two sketches that were subtracted.
    """
    base = np.concatenate([[0], np.cumsum(3 * third)])
    sketch_of = np.repeat(np.arange(len(third)), 3 * third)
    found = []
    look = np.flatnonzero(count)
    for _ in range(ROUNDS):  # a sum that passes for a digest by chance could go out and in for ever; a larger sketch has others
        if not len(look):
            break
        look = look[np.abs(count[look]) == 1]
        sign = count[look]
        key = np.where(sign > 0, total[look], np.uint64(0) - total[look]) & LOW48
        owner = sketch_of[look]
        inside = look - base[owner]
        pure = (sealed(key << np.uint64(16)) == key) & np.logical_or.reduce([place == inside for place in _places(key, third[owner])])
        sign, key, owner = sign[pure], key[pure], owner[pure]
        order = np.lexsort((key, owner))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        at = order[new]
        owner, sign, key = owner[at], sign[at], key[at]
        found.append((owner, sign, key))
        touched = []
        for place in _places(key, third[owner]):
            cell = base[owner] + place
            np.subtract.at(count, cell, sign)
            np.subtract.at(total, cell, np.where(sign > 0, key, np.uint64(0) - key))
            touched.append(cell)
        look = np.unique(np.concatenate(touched)) if len(at) else at
        total[look] &= LOW48
    left = np.bincount(sketch_of[(count != 0) | ((total & LOW48) != 0)], minlength=len(third))
    if not sum(len(owner) for owner, _, _ in found):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), left == 0
    owner, sign, key = (np.concatenate(x) for x in zip(*found))
    # a sum that passed for a digest by chance is taken out and put back later: its signs cancel
    order = np.lexsort((key, owner))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(owner[order]) != 0) | (key[order][1:] != key[order][:-1])]))
    net = np.add.reduceat(sign[order], first)
    return owner[order][first][net != 0], net[net != 0], key[order][first][net != 0], left == 0


def _of(key, size, versions):
    """Digests of chosen versions (sizes by version, digests in order of version) and which each belongs to."""
    begin, n = (np.cumsum(size) - size)[versions], size[versions]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    return key[at], np.repeat(np.arange(len(versions)), n)


def written(key: np.ndarray, size: np.ndarray) -> list[str]:
    """Fingerprints: sketches large enough to be peeled whole, as text."""
    third, open_, out = size * 15 // 32 + 2, np.arange(len(size)), [""] * len(size)
    while len(open_):
        own = third[open_]
        count, total = sketch(*_of(key, size, open_), own)
        base = np.concatenate([[0], np.cumsum(3 * own)])
        *_, whole = peel(count.copy(), total.copy(), own)
        whole &= np.maximum.reduceat(count, base[:-1]) < 128
        for i, v in enumerate(open_.tolist()):
            if whole[i]:
                at = slice(base[i], base[i + 1])
                sums = total[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                out[v] = base64.b64encode(count[at].astype(np.int8).tobytes() + sums.tobytes()).decode()
        open_ = open_[~whole]
        third[open_] = third[open_] * 5 // 4 + 1
    return out


def listed(fingerprint: str) -> np.ndarray:
    """The digests in a fingerprint, peeled out of its cells."""
    raw = base64.b64decode(fingerprint)
    cells = len(raw) // 7
    count = np.frombuffer(raw, np.int8, cells).astype(np.int64)
    total = np.zeros((cells, 8), np.uint8)
    total[:, :6] = np.frombuffer(raw, np.uint8, offset=cells).reshape(cells, 6)
    return peel(count, total.view("<u8").ravel().astype(np.uint64), np.array([cells // 3]))[2]


def likeness(key: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints one[i] and two[i], given how many digests are in each and all of them in order.

    Sketches are subtracted and peeled, twice as large where cells remain; at eight times the digests of both, these
    themselves are compared, which no known pair has needed.
    """
    out = np.full(len(one), -1.0)
    open_ = np.arange(len(one))
    third = np.minimum(size[one], size[two]) // 4 + 2
    while len(open_):
        own = third[open_]
        a, b = (sketch(*_of(key, size, v[open_]), own) for v in (one, two))
        owner, sign, _, whole = peel(a[0] - b[0], (a[1] - b[1]) & LOW48, own)
        first, second = (np.bincount(owner[sign == s], minlength=len(open_)) for s in (1, -1))
        same = size[one[open_]] - first
        union = same + first + second
        out[open_[whole]] = np.where(union > 0, same / np.maximum(union, 1), 1.0)[whole]
        open_ = open_[~whole]
        third[open_] *= 2
        last = open_[third[open_] > 8 * (size[one] + size[two] + 1)[open_]]
        for i in last.tolist():
            x, y = (_of(key, size, np.array([v[i]]))[0] for v in (one, two))
            shared = len(np.intersect1d(x, y))
            out[i] = shared / (len(x) + len(y) - shared)
        open_ = np.setdiff1d(open_, last)
    return out


def likeness_of(one: str, two: str) -> float:
    """Likeness of two published fingerprints."""
    lists = [listed(one), listed(two)]
    return float(likeness(np.concatenate(lists), np.array([len(x) for x in lists]), np.array([0]), np.array([1]))[0])


def fingerprint_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per input row.

    The edited text has its last quarter of code points replaced by the beginning of the successor's text.
    """
    spark = docs.sparkSession
    c.prepare(spark)
    n = c.layout(docs, 4 << 20).parts  # MOST at most, and so are the bounds and heads below
    slim = c.columns(docs, id=id_col, text=text_col)
    bounds = np.array(sorted({int(x) for x in slim.na.drop(subset=["id"]).approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)}), np.int64)

    def firsts(batches):
        least: dict[int, int] = {}
        for batch in batches:
            for b, ids in c.split_by(np.searchsorted(bounds, own := c.ids_of(batch.column("id")), "right"), own):
                least[b] = min(least.get(b, ids.min()), ids.min())
        yield pa.record_batch([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], ["bucket", "id"])

    heads = slim.select("id").mapInArrow(firsts, "bucket int, id long").groupBy("bucket").min("id").collect()  # n rows at most
    heads = sorted((r[0], r[1]) for r in heads)
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}  # a range's first document also goes to the range before

    def ranged(batches):
        """Rows as packed batches by range; kind 1: the first document of the range after."""
        held, size = [], 0

        def flush():
            out = c.Rows()
            for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
                ids = c.ids_of(batch.column("id"))
                ghost = np.array([before.get(i, -1) for i in ids.tolist()], np.int32)
                for kind, to in enumerate((np.searchsorted(bounds, ids, "right").astype(np.int32), ghost)):
                    for b, at in c.split_by(to, np.arange(len(ids))):
                        if b >= 0:
                            out.add(b, kind, c.pack_batch(batch.take(pa.array(at))))
                            yield from out.batches(4 << 20)
            yield from out.batches()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(part := batch.slice(at, 256))
                size += part.nbytes
                if size >= c.FLUSH_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def opened(batches):
        for _, kind, data in c.packed_rows(batches):
            batch = c.unpack_batch(data)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([pa.array(np.full(part.num_rows, kind, np.int32)), pa.array(c.ids_of(part.column("id"))), part.column("text").fill_null("").cast(pa.string())], ["kind", "id", "text"])

    def described(rows):
        """Results of a run of documents (id, text) but the last, which only succeeds."""
        texts = [t for _, t in rows]
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:])]
        k = len(edited)
        raw = [t.encode() for t in texts + edited]
        key, owner = digests(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        size = np.bincount(owner, minlength=len(raw))
        marks = written(key, size)
        here = np.arange(k)
        near = likeness(key, size, np.concatenate([here, here]), np.concatenate([here + k + 1, here + 1]))
        return pa.record_batch(
            [c.ids_array(np.array([i for i, _ in rows[:k]], np.int64)), pa.array([len(t) for t in texts[:k]], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw[k + 1 :]]), pa.array(marks[:k]), pa.array(marks[k + 1 :]), pa.array(near[:k]), pa.array(near[k:])],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def compare(batches):
        run, size, ended = [], 0, False
        for batch in batches:
            for kind, i, text in zip(*(batch.column(x).to_pylist() for x in ("kind", "id", "text"))):
                if ended:
                    break
                run.append((i, text))
                size += len(text)
                ended = kind == 1  # the first of the next range
                if len(run) > 1 and (ended or len(run) > 256 or size >= c.BLOCK_BYTES):
                    yield described(run)
                    run, size = run[-1:], len(text)

    order = c.deal(slim.mapInArrow(ranged, c.PACKED), c.Layout(n)).mapInArrow(opened, "kind int, id long, text string").sortWithinPartitions("kind", "id", "text")
    return order.mapInArrow(compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
