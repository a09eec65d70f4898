"""Suffix-array dedup: repeated byte strings found by backward extension on a Burrows-Wheeler transform.

Every byte covered by a string of `length` bytes that also starts earlier (smaller identifier, or the same
document and an earlier start) is removed; strings are judged on the input.

1. *Dealing.*  Each `length`-byte window is dealt by its minimizer (the least hashed `GRAM`-byte gram in it),
   which its content alone decides, so equal windows meet in one bucket.  Runs of windows with the same
   minimizer form a piece.  Grams that a bounded sample shows in many documents rank last as minimizers,
   so that the edges of common passages are dealt by their rare neighbours; this only steers the dealing.
   Pieces whose minimizer does not recur hold no repeat and go no further.
2. *Combining.*  Pieces with equal bytes (compared as bytes, not by digest) become one wherever they meet: in the
   task that reads them, in the task that fetches bytes, and in the bucket.  The first of them stands for all, the
   later ones are covered whole by strings that start earlier.  So a passage of very many documents reaches a
   bucket once for each 16 MB of text.
3. *Hot minimizers.*  The pieces of a minimizer with more than HOT of them are cut once more, into runs with the same
   second minimizer, and dealt by both.
4. *Intervals.*  Where a bucket has different pieces of a minimizer, a Burrows-Wheeler transform of them is built.
   Breadth-first backward extension derives common-prefix values by increasing value and stops at `length`: entries
   without a value bound the classes of suffixes that share `length` bytes.  All but the first of a class are removed.
5. Spans and texts meet by document.

Null texts are empty, and texts under `length` bytes are left whole.  Rows of one identifier stand for one
document: equal rows give equal results, and the spans found in either of two different texts apply to both
(clipped).  A null identifier sorts first.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

GRAM = 24
CHUNK = 1_000_000  # window starts handled at once; positions in a chunk take 20 bits
RUN_BYTES = 2 << 20  # text of one transform, cut between minimizers
SAMPLE_DOCS = 1024  # documents looked at for common grams
COMMON_IN = 12  # a gram in so many of them ranks last
HOT = 4096  # pieces of a minimizer that are cut by a second one

SPANS, PIECES, WANTED, TEXTS, BYTES = range(5)


def _keys():
    """How each kind of packed row is dealt: (key of its items, whether it is an Arrow batch)."""
    by_doc = lambda a: c.spread(a[0])
    return {SPANS: (by_doc, False), WANTED: (by_doc, False), PIECES: (lambda a: a[0], False), BYTES: (lambda a: a[0], False), TEXTS: (c.key_of_ids, True)}


def gram_hashes(code: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte gram, joined from halves."""

    def joined(a, b, gap):
        return (a[: len(b) - gap] ^ (a[: len(b) - gap] >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + b[gap:]

    out, size, level, span = None, 0, code, 1
    while True:
        if k & span:
            out = level if out is None else joined(level, out, span)[: len(code) - size - span + 1]
            size += span
        if span * 2 > k:
            return c.mix(out[: max(0, len(code) - k + 1)])
        level, span = joined(level, level, span), span * 2


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    count, span = len(key) - w + 1, 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    return np.minimum(key[:count], key[w - span : w - span + count])


class Common:
    """Set of common grams: a bit table first, then a search."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = np.sort(grams)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        found = np.zeros(len(grams), bool)
        if len(self.grams):
            at = np.flatnonzero(self.bits[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
            near = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
            found[at] = self.grams[near] == grams[at]
        return found


def pieces(text: np.ndarray, offsets: np.ndarray, length: int, gram: int, common: Common | None, other_than: np.ndarray | None = None):
    """Runs of windows that share a minimizer: (start, windows - 1, minimizer) by position in the block.

    other_than: a gram for each document that ranks last there, so that the second minimizer is found.
    """
    long = np.flatnonzero(np.diff(offsets) >= length)
    step = np.zeros(len(text) + 1, np.int8)
    step[offsets[:-1][long]] += 1
    step[offsets[1:][long] - length + 1] -= 1
    valid = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    for at in range(0, max(0, len(text) - length + 1), CHUNK):
        h = gram_hashes(c.BYTE_CODE[text[at : at + CHUNK + length - 1]], gram)
        key = (h >> np.uint64(1)) & np.uint64(0x7FFFFFFFFFF00000)
        if common is not None:
            key[common(h)] |= np.uint64(1 << 63)
        if other_than is not None:
            key[h == other_than[np.searchsorted(offsets, np.arange(at, at + len(h)), "right") - 1]] |= np.uint64(1 << 63)
        least = sliding_min(key | np.arange(len(key), dtype=np.uint64), length - gram + 1)
        who = (least & np.uint64(0xFFFFF)).astype(np.int64)
        ok = valid[at : at + len(who)]
        change = np.ones(len(who), bool)
        change[1:] = (who[1:] != who[:-1]) | (ok[1:] != ok[:-1])
        start = np.flatnonzero(change)
        end = np.append(start[1:], len(who)) - 1
        keep = ok[start]
        start, end = start[keep], end[keep]
        yield start + at, end - start, h[who[start]]


def common_grams(docs: DataFrame, gram: int, length: int) -> np.ndarray:
    """Grams found in COMMON_IN or more of about SAMPLE_DOCS documents: at most sample bytes / COMMON_IN of them."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    need = max(3, round(COMMON_IN * min(1.0, total / SAMPLE_DOCS)))
    limit = np.uint64(int(share * float(1 << 63)))

    def sample(batches):
        for ids, text, offsets in c.blocks(batches):
            for i in np.flatnonzero((c.mix(ids.view(np.uint64) ^ np.uint64(77)) >> np.uint64(1)) <= limit):
                own = text[offsets[i] : offsets[i + 1]]
                if len(own) >= length:
                    found = np.unique(gram_hashes(c.BYTE_CODE[own], gram))
                    yield pa.record_batch([pa.array(found.view(np.int64))], ["g"])

    found = docs.mapInArrow(sample, "g long").groupBy("g").count().where(F.col("count") >= need).select("g")
    return np.array([r.g for r in found.collect()], np.int64).view(np.uint64)


def transform_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of text (uint16, ordered by at least `length` symbols) and a class number for each entry;
    entries of one class share their first `length` symbols.

    Suffixes are sorted by doubling.  Intervals of the transform are then extended backwards, breadth first:
    the intervals of all strings of v symbols set the common-prefix value v - 1 at their right ends, each entry
    once, and are followed no further if it was set before.  After `length` rounds the entries without a value
    have common prefixes of `length` or more.
    """
    text = np.append(text + np.uint16(1), np.uint16(0))  # one terminator, so that rotations and suffixes have one order
    n = len(text)
    symbols = text.astype(np.uint64) + np.uint64(1)
    packed = np.zeros(n + 7, np.uint64)
    packed[:n] = symbols
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | packed[i : i + n]
    have = 7
    while True:
        order = np.argsort(key, kind="stable") if n < 1 << 16 else np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if have >= length + 8 or rank.max(initial=0) == n - 1:
            break
        ahead = np.zeros(n, np.uint64)
        if have < n:
            ahead[: n - have] = (rank[have:] + 1).astype(np.uint64)
        key = (rank.astype(np.uint64) << np.uint64(32)) | ahead
        have *= 2
    suffixes = order
    last = text[suffixes - 1].astype(np.int64)  # the transform; entry 0 wraps round
    by_symbol = np.argsort(last, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    first = last[by_symbol]  # first symbol of each sorted suffix
    value_set = np.zeros(n + 1, bool)
    value_set[[0, n]] = True
    left, right = np.array([0]), np.array([n])
    owner = np.empty(n, np.int64)
    for _ in range(length):
        sizes = right - left
        total = int(sizes.sum())
        if not total:
            break
        number = np.repeat(np.arange(len(left)), sizes)
        to = lf[np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left[number]]
        owner[to] = number
        if total > n // 8:
            seen = np.zeros(n, bool)
            seen[to] = True
            to = np.flatnonzero(seen)
        else:
            to = np.sort(to)
        own = owner[to]
        change = np.ones(len(to), bool)
        change[1:] = (own[1:] != own[:-1]) | (first[to[1:]] != first[to[:-1]])
        at = np.flatnonzero(change)
        left = to[at]
        right = to[np.append(at[1:], len(to)) - 1] + 1
        new = ~value_set[right]
        value_set[right[new]] = True
        left, right = left[new], right[new]
    return suffixes[1:], (np.cumsum(value_set[:n]) - 1)[1:]


def earlier_windows(anchor, doc, start, span, data, length):
    """Of pieces (sorted by minimizer; data: their bytes joined): spans of windows that also start earlier."""
    if not len(anchor):
        return
    sizes = span + length
    ends = np.cumsum(sizes)
    cuts, at = [0], 0
    borders = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
    for a, b in zip(borders, np.append(borders[1:], borders[-1])):
        if ends[b - 1] - (ends[at - 1] if at else 0) > RUN_BYTES or a == len(anchor):
            cuts.append(int(a))
            at = int(a)
    for lo, hi in zip(cuts, cuts[1:]):
        if hi <= lo:
            continue
        own = sizes[lo:hi] + 1
        text = np.zeros(int(own.sum()), np.uint16)
        inside = np.ones(len(text), bool)
        stops = np.cumsum(own) - 1
        inside[stops] = False
        text[inside] = data[ends[lo] - sizes[lo] : ends[hi - 1]].astype(np.uint16) + 1
        suffixes, group = transform_classes(text, length)
        piece = np.repeat(np.arange(hi - lo), own)[suffixes]
        offset = suffixes - (stops - own + 1)[piece]
        full = offset + length < own[piece]
        piece, offset, group = piece[full] + lo, offset[full], group[full]
        where = start[piece] + offset
        order = np.lexsort((where, doc[piece], group))
        piece, where, group = piece[order], where[order], group[order]
        head = np.ones(len(group), bool)
        head[1:] = group[1:] != group[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
        later = (doc[piece] != doc[piece[first]]) | (where != where[first]) if len(group) else head
        yield c.merge_spans(doc[piece[later]], where[later], where[later] + length)


def combine(contents: list[bytes], doc: np.ndarray, start: np.ndarray):
    """Which pieces are the first of their bytes, by document and start, and spans of the later ones: (first, spans).

    A piece that is the same place as the first one (a repeated row) is neither.
    """
    order = np.lexsort((start, doc))
    seen: dict[bytes, int] = {}
    head = np.fromiter((seen.setdefault(contents[i], i) for i in order.tolist()), np.int64, len(order))
    first = order[head == order]
    apart = (doc[order] != doc[head]) | (start[order] != start[head])
    later = order[apart]
    ends = start[later] + np.fromiter((len(contents[i]) for i in later.tolist()), np.int64, len(later))
    return first, c.merge_spans(doc[later], start[later], ends)


def _add_spans(out: c.Rows, spans, where: c.Layout) -> None:
    for b, d, s, e in c.split_by(where.part_of(spans[0]), *spans):
        out.add(b, SPANS, c.pack(d, s, e))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, carry: list[str] | None = None) -> DataFrame:
    """Rows (row: struct<id, carried: struct of the `carry` columns>, n_bytes, n_removed, n_spans long,
    spans: array of struct<start, end> in bytes, kept: binary), one per input row."""
    spark = docs.sparkSession
    c.prepare(spark)
    gram = min(GRAM, max(1, length // 4))
    where = c.layout(docs, 8 << 20)
    slim = c.columns(docs, id=id_col, text=text_col)
    common = spark.sparkContext.broadcast(common_grams(slim, gram, length))  # at most sample bytes / COMMON_IN

    def find(batches):
        rare = Common(common.value)
        found, texts, size = [], [], 0

        def flush():
            raw = b"".join(texts)
            anchor, at, doc, start, span = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(anchor, kind="stable")
            same = anchor[order][1:] == anchor[order][:-1]
            again = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order  # of recurring minimizers
            contents = [raw[a:b] for a, b in zip(at[again].tolist(), (at + span + length)[again].tolist())]
            first, spans = combine(contents, doc[again], start[again])
            keep = np.ones(len(anchor), bool)
            keep[again] = False
            keep[again[first]] = True
            out = c.Rows()
            _add_spans(out, spans, where)
            yield from out.batches(1)
            near = np.flatnonzero(keep)
            near = near[np.lexsort((start[near], doc[near]))]
            for b, *x in c.split_by(where.part(anchor[near]), anchor[near], doc[near], start[near], span[near]):
                out.add(b, PIECES, c.pack(*x))
                yield from out.batches(1 << 20)
            yield from out.batches()

        for ids, text, offsets in c.blocks(batches):
            for start, span, anchor in pieces(text, offsets, length, gram, rare):
                doc = np.searchsorted(offsets, start, "right") - 1
                found.append((anchor, start + size, ids[doc], start - offsets[doc], span))
            texts.append(text.tobytes())
            size += len(text)
            if size >= c.FLUSH_BYTES:
                if found:
                    yield from flush()
                found, texts, size = [], [], 0
        if found:
            yield from flush()

    def passed(bucket, data):
        """Spans that met a bucket of something else on their way to their documents."""
        out = c.Rows()
        if where.subs == 1:
            out.add(bucket, SPANS, data)
        else:
            _add_spans(out, c.unpack(data), where)
        yield from out.batches()

    def settle(batches):
        """Spans pass; of the pieces of a bucket, those of recurring minimizers are wanted, those of hot ones marked."""
        for bucket, rows in c.by_bucket(batches):
            held = []
            for kind, data in rows:
                if kind == SPANS:
                    yield from passed(bucket, data)
                else:
                    held.append(c.unpack(data))
            if not held:
                continue
            anchor, doc, start, span = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(anchor, kind="stable")
            anchor, doc, start, span = (x[order] for x in (anchor, doc, start, span))
            edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            count = np.repeat(np.diff(np.append(edges, len(anchor))), np.diff(np.append(edges, len(anchor))))
            several = np.flatnonzero(count > 1)
            several = several[np.lexsort((start[several], doc[several]))]
            out = c.Rows()
            for b, *x in c.split_by(where.part_of(doc[several]), doc[several], start[several], span[several], anchor[several], (count[several] > HOT).astype(np.int8)):
                out.add(b, WANTED, c.pack(*x))
                yield from out.batches(4 << 20)
            yield from out.batches()

    def cut_again(contents, anchor, doc, start):
        """Pieces of hot minimizers as runs with the same second one: (key, anchor, doc, start, bytes)."""
        edges = np.cumsum([0, *map(len, contents)])
        joined = np.frombuffer(b"".join(contents), np.uint8)
        for at, span, second in pieces(joined, edges, length, gram, None, anchor):
            of = np.searchsorted(edges, at, "right") - 1
            raw = [joined[x : x + n].tobytes() for x, n in zip(at.tolist(), (span + length).tolist())]
            yield c.mix(anchor[of] + second * np.uint64(0x9E3779B97F4A7C15)), doc[of], start[of] + at - edges[of], raw

    def fetch(batches):
        """Bytes of the wanted pieces, equal ones of a task combined."""
        held, size = [], 0  # (key, doc, start, bytes)

        def flush():
            key, doc, start = (np.concatenate([h[i] for h in held]) for i in range(3))
            contents = [x for h in held for x in h[3]]
            held.clear()
            first, spans = combine(contents, doc, start)
            out = c.Rows()
            _add_spans(out, spans, where)
            data = np.empty(len(contents), object)
            data[:] = contents
            for b, *x in c.split_by(where.part(c.mix(key[first])), c.mix(key[first]), key[first], doc[first], start[first], data[first]):
                out.add(b, BYTES, c.pack(*x))
                yield from out.batches(1 << 20)
            yield from out.batches()

        for _, rows in c.by_bucket(batches):
            wanted = [c.unpack(data) for kind, data in rows if kind == WANTED]
            if not wanted:
                continue
            doc, start, span, anchor, hot = (np.concatenate(x) for x in zip(*wanted))
            order = np.lexsort((start, doc))
            doc, start, span, anchor, hot = (x[order] for x in (doc, start, span, anchor, hot))
            end, seen = start + span + length, set()
            for kind, data in rows:
                if kind != TEXTS:
                    continue
                batch = c.unpack_batch(data)
                ids, (text, offsets) = c.ids_of(batch.column("id")), c.texts_of(batch.column("text"))
                lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
                got, parts = [], []
                for i in np.flatnonzero(hi > lo):
                    if ids[i] in seen:
                        continue  # a repeated row: the first text of an identifier that holds all pieces serves
                    view = text[offsets[i] : offsets[i + 1]].tobytes()
                    here = [j for j in range(lo[i], hi[i]) if end[j] <= len(view)]
                    got += here
                    parts += [view[start[j] : end[j]] for j in here]
                    if len(here) == hi[i] - lo[i]:
                        seen.add(ids[i])
                if not got:
                    continue
                at, is_hot = np.array(got), hot[got] > 0
                plain = np.flatnonzero(~is_hot)
                held.append((anchor[at[plain]], doc[at[plain]], start[at[plain]], [parts[i] for i in plain]))
                if is_hot.any():
                    more = np.flatnonzero(is_hot)
                    held.extend(cut_again([parts[i] for i in more], anchor[at[more]], doc[at[more]], start[at[more]]))
                size += sum(map(len, parts))
                if size >= 2 * c.FLUSH_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def extend(batches):
        """Pieces of a bucket: equal ones combined, different ones of a minimizer through the transform.  Spans pass."""
        for bucket, rows in c.by_bucket(batches):
            held = []
            for kind, data in rows:
                if kind == BYTES:
                    held.append(c.unpack(data))
                else:
                    yield from passed(bucket, data)
            rows.clear()
            if not held:
                continue
            _, key, doc, start, data = (np.concatenate(x) for x in zip(*held))
            held.clear()
            out = c.Rows()
            first, spans = combine(data.tolist(), doc, start)
            _add_spans(out, spans, where)
            yield from out.batches()
            first = first[np.argsort(key[first], kind="stable")]
            same = key[first][1:] == key[first][:-1]
            first = first[np.append(same, False) | np.insert(same, 0, False)] if len(first) else first
            contents = data[first].tolist()
            flat = np.frombuffer(b"".join(contents), np.uint8)
            span = np.fromiter(map(len, contents), np.int64, len(contents)) - length
            for spans in earlier_windows(key[first], doc[first], start[first], span, flat, length):
                _add_spans(out, spans, where)
                yield from out.batches(1 << 20)
            yield from out.batches()

    def cut(batches):
        for _, rows in c.by_bucket(batches):
            spans = [c.unpack(data) for kind, data in rows if kind == SPANS]
            doc, start, end = c.merge_spans(*(np.concatenate(x) for x in zip(*spans))) if spans else (np.empty(0, np.int64),) * 3
            for kind, data in rows:
                if kind == SPANS:
                    continue
                batch = c.unpack_batch(data)
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    ids, (text, offsets) = c.ids_of(part.column("id")), c.texts_of(part.column("text"))
                    lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
                    size, removed, runs, listed, kept = np.diff(offsets), [], [], [], []
                    for i in range(len(ids)):
                        view = text[offsets[i] : offsets[i + 1]].tobytes()
                        s, e = start[lo[i] : hi[i]].tolist(), np.minimum(end[lo[i] : hi[i]], len(view)).tolist()
                        own = [(x, y) for x, y in zip(s, e) if x < y]
                        listed.append([{"start": x, "end": y} for x, y in own])
                        removed.append(sum(y - x for x, y in own))
                        runs.append(len(own))
                        kept.append(b"".join(view[x:y] for x, y in zip([0, *(y for _, y in own)], [*(x for x, _ in own), len(view)])) if own else view)
                    yield pa.record_batch([part.column("row"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(listed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    keys = _keys()
    settled = c.materialise(c.deal(slim.mapInArrow(find, c.PACKED), where, keys).mapInArrow(settle, c.PACKED), "suffix-pieces")
    fetched = c.deal(settled.where(F.col("kind") == WANTED).unionByName(c.row_packs(slim, where, TEXTS)), where, keys).mapInArrow(fetch, c.PACKED)
    extended = c.deal(fetched, where, keys).mapInArrow(extend, c.PACKED)
    row = c.carried_row(docs, id_col, carry)
    packs = c.row_packs(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), row.alias("row")), where, TEXTS)
    found = settled.where(F.col("kind") == SPANS).unionByName(extended).unionByName(packs)
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    return c.deal(found, where, keys).mapInArrow(cut, f"row {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary")
