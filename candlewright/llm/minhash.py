"""MinHash near-dedup: b-bit signatures, bands for candidates, links confirmed on full shingle sets.

Documents are linked where the Jaccard similarity of their sets of distinct `shingle`-word shingles reaches
`threshold` (A-Z lower-cased; a text with fewer words is one shingle; a text without words is linked with
nothing).  Components of links are found for every document.

1. Each document gets minima of `perms` hash functions.  Bands of `rows` minima give candidates; the low two
   bits of each minimum are kept, packed into 64-bit words.  Band count follows the threshold: a link at the
   threshold is missed with probability `miss`.
2. Documents with equal sets become one: at once where a task holds both sets, else as a pair to be confirmed.
3. *Stars.*  The documents of a band bucket are paired with the one of them that shares most buckets with others (the
   middle of a group of near copies): inside a task, whose middles alone meet in the bucket, and then with the bucket's.
4. Pairs are screened by the collision-corrected similarity that bit counts of the packed signatures give, then the
   NEAREST of each document are confirmed on full sets.
5. *Rest.*  Documents of one bucket can be linked though neither is linked with its star's middle.  Where several
   components are left that share buckets, all their documents outside the largest one meet all others there, bin by
   bin; what the estimate lets through and is not connected yet is confirmed, the most similar first.  A task gives a
   spanning forest of its links, never all pairs.
6. Components of all links are the result.

Null texts are empty.  Rows of one identifier stand for one document (their links unite); a null identifier gets
no links and is its own component (null).  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c
from ._graph import components

BITS = 2
MARGIN = 5.0  # standard deviations below the threshold at which the estimate rules a pair out
BIN = 128  # documents on either side of a comparison of the rest
BINS = 512  # of a cluster at most; beyond it they grow
NEAREST = 3  # of a document's pairs that are confirmed first
SIZES, LINKS, SAME, SETS, SIGNS, PAIRS, SHARED, STARS, TEXTS, MEMBERS = range(10)


class Plan:
    """Bands, hash functions and the estimate's cut for a threshold."""

    def __init__(self, threshold: float, rows: int = 7, miss: float = 1e-6) -> None:
        self.threshold, self.rows = threshold, rows
        self.bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        self.perms = self.bands * rows
        rng = np.random.default_rng(7)
        self.a = rng.integers(0, 1 << 32, self.perms, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.perms, dtype=np.uint64).astype(np.uint32)
        self.words = -(-self.perms * BITS // 64)
        self.chance = 1 / (1 << BITS)  # that low bits of different minima are equal
        equal = threshold + (1 - threshold) * self.chance
        self.least = threshold - MARGIN * math.sqrt(equal * (1 - equal) / self.perms) / (1 - self.chance)

    def similarity(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Collision-corrected estimates from the bit counts of packed signatures."""
        return (equal_parts(one, many, self.perms) / self.perms - self.chance) / (1 - self.chance)


def shingles(text: np.ndarray, offsets: np.ndarray, k: int):
    """(uint64 hash, document) of the k-word shingles of a block, with repeats; one for a shorter text with words."""
    word, _, _, doc = c.words(text, offsets)
    if not len(word):
        return word, doc
    count = np.bincount(doc, minlength=len(offsets) - 1)
    last = np.cumsum(count)
    reach = np.minimum(np.arange(len(word)) + k, last[doc])
    begins = np.flatnonzero((reach - np.arange(len(word)) == k) | (np.arange(len(word)) == (last - count)[doc]))
    out = np.zeros(len(begins), np.uint64)
    for i in range(k):
        there = begins + i < reach[begins]
        out = c.mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(there, word[np.minimum(begins + i, len(word) - 1)], np.uint64(0)) + np.uint64(1))
    return out, doc[begins]


def _distinct(shingle, doc):
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    return shingle[new], doc[new]


def signatures(shingle: np.ndarray, edges: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(band keys uint64 [docs, bands], packed low bits uint64 [docs, words]) of runs of shingles that begin at edges."""
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((plan.perms, len(edges)), np.uint32)
    step = 1 << 14  # documents' shingles in cache for all hash functions
    cuts = np.unique(np.append(np.searchsorted(edges, np.arange(0, len(x), step)), len(edges)))
    for lo, hi in zip(cuts, cuts[1:]):
        part = x[edges[lo] : edges[hi] if hi < len(edges) else len(x)]
        at = edges[lo:hi] - edges[lo]
        for p in range(plan.perms):
            np.minimum.reduceat(part * plan.a[p] + plan.b[p], at, out=minima[p, lo:hi])
    bands = np.zeros((len(edges), plan.bands), np.uint64)
    low = np.zeros((len(edges), plan.words), np.uint64)
    for p in range(plan.perms):
        band = p // plan.rows
        bands[:, band] = c.mix(bands[:, band] * np.uint64(0x9E3779B97F4A7C15) + minima[p] + np.uint64(band + 1))
        bits = c.mix(minima[p].astype(np.uint64) + np.uint64(p)) & np.uint64((1 << BITS) - 1)
        low[:, p * BITS // 64] |= bits << np.uint64(p * BITS % 64)
    return bands, low


def equal_parts(one: np.ndarray, many: np.ndarray, perms: int) -> np.ndarray:
    """Number of equal two-bit parts of packed signatures, by bit counts."""
    differ = one ^ many
    differ = (differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return perms - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)


def _heads(key: np.ndarray, ids: np.ndarray, weight: np.ndarray | None = None):
    """Rows sorted by key, then greatest weight, then identifier: (order, whether first of its key, index of the first)."""
    order = np.lexsort((ids, *(() if weight is None else (-weight,)), *(key.T if key.ndim == 2 else (key,))))
    k = key[order]
    head = np.ones(len(order), bool)
    head[1:] = (k[1:] != k[:-1]).any(axis=1) if key.ndim == 2 else k[1:] != k[:-1]
    return order, head, np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))


def equal_sets(ids, digest, x, begin, count):
    """Documents with equal sets, compared element by element: (rows of the first of each set, copies, their firsts)."""
    order, head, first = _heads(digest, ids)
    keep, copy, of = [], [], []
    for at, is_head, f in zip(order.tolist(), head.tolist(), order[first].tolist()):
        if is_head:
            keep.append(at)
        elif count[at] == count[f] and np.array_equal(x[begin[at] : begin[at] + count[at]], x[begin[f] : begin[f] + count[f]]):
            copy.append(ids[at])
            of.append(ids[f])
        else:
            keep.append(at)  # a digest of two sets
    return np.array(keep, np.int64), np.array(copy, np.int64), np.array(of, np.int64)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles long, component long, kept boolean), one row per input row; links at similarity num / den."""
    spark = docs.sparkSession
    c.prepare(spark)
    plan = Plan(num / den)
    where = c.layout(docs, 8 << 20)
    slim = c.columns(docs, id=id_col, text=text_col)

    def sketch(batches):
        held, size = [], 0

        def flush():
            ids, count, digest, bands, low, x = (np.concatenate(part) for part in zip(*held))
            out = c.Rows()
            own = int(where.part_of(ids[:1])[0])  # any bucket will do for what only passes through
            out.add(own, SIZES, c.pack(ids, count))
            begin = np.cumsum(count) - count
            use = np.flatnonzero((count > 0) & (ids != c.NULL_ID))
            keep, copy, of = equal_sets(ids[use], digest[use], x, begin[use], count[use])
            out.add(own, LINKS, c.pack(of, copy))
            at = use[keep]
            for b, d, e, i, k, w in c.split_by(where.part(digest[at, 0]), digest[at, 0], digest[at, 1], ids[at], bands[at], low[at]):
                out.add(b, SETS, c.pack(d, e, i, k, w))
                yield from out.batches(1 << 20)
            yield from out.batches()

        for ids, text, offsets in c.blocks(batches):
            x, doc = _distinct(*shingles(text, offsets, shingle))
            count = np.bincount(doc, minlength=len(ids))
            with_any = np.flatnonzero(count)
            edges = (np.cumsum(count) - count)[with_any]
            digest = np.zeros((len(ids), 2), np.uint64)
            bands, low = np.zeros((len(ids), plan.bands), np.uint64), np.zeros((len(ids), plan.words), np.uint64)
            if len(edges):
                digest[with_any, 0] = c.mix(np.add.reduceat(x, edges))
                digest[with_any, 1] = np.add.reduceat(c.mix(x + np.uint64(99)), edges)
                bands[with_any], low[with_any] = signatures(x, edges, plan)
            held.append((ids, count, digest, bands, low, x))
            size += len(text) + 400 * len(ids)
            if size >= c.FLUSH_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def settle(batches):
        """Of equal digests one goes on; local stars of equal band keys, of which the middles go to band buckets."""
        for bucket, rows in c.by_bucket(batches):
            held = []
            for kind, data in rows:
                if kind == SETS:
                    held.append(c.unpack(data))
                else:
                    yield from c.Rows.one(bucket, kind, data)
            if not held:
                continue
            d0, d1, ids, bands, low = (np.concatenate(x) for x in zip(*held))
            order, head, first = _heads(np.stack([d0, d1], axis=1), ids)
            out = c.Rows()
            out.add(bucket, SAME, c.pack(ids[order][first][~head], ids[order][~head]))
            at = order[head]
            ids, bands, low = ids[at], bands[at], low[at]
            out.add(bucket, SIGNS, c.pack(ids, low))
            key, who = bands.ravel(), np.repeat(np.arange(len(ids)), plan.bands)
            _, group, size = np.unique(key, return_inverse=True, return_counts=True)
            shared = np.bincount(who, size[group] - 1, minlength=len(ids)).astype(np.int64)
            order, head, first = _heads(key, ids[who], shared[who])
            k, w, f = key[order], who[order], who[order][first]
            pair = np.unique(np.stack([ids[f[~head]], ids[w[~head]]], axis=1), axis=0)
            out.add(bucket, PAIRS, c.pack(pair[:, 0], pair[:, 1]))
            several = size[group[order]] > 1
            out.add(bucket, SHARED, c.pack(k[several].view(np.int64), ids[w[several]]))
            for b, *x in c.split_by(where.part(k[head]), k[head], ids[w[head]], size[group[order]][head]):
                out.add(b, STARS, c.pack(*x))
                yield from out.batches(1 << 20)
            yield from out.batches()

    def stars(batches):
        """Band keys that came from several buckets: (key, document, documents of the key)."""
        for _, rows in c.by_bucket(batches):
            key, ids, size = (np.concatenate(x) for x in zip(*(c.unpack(data) for _, data in rows)))
            _, at, n = np.unique(key, return_inverse=True, return_counts=True)
            total = np.bincount(at, size).astype(np.int64)[at]
            some = n[at] > 1
            yield pa.record_batch([pa.array(key[some].view(np.int64)), pa.array(ids[some]), pa.array(total[some])], ["key", "id", "total"])

    def listed(batches):
        for _, _, data in c.packed_rows(batches):
            a, b = c.unpack(data)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b.astype(np.int64), pa.int64())], ["a", "b"])

    def signed(batches):
        for _, _, data in c.packed_rows(batches):
            ids, low = c.unpack(data)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in low], pa.binary())], ["id", "low"])

    def of_kind(kind, f=listed, schema="a long, b long"):
        return settled.where(F.col("kind") == kind).mapInArrow(f, schema)

    keys = {STARS: (lambda a: a[0], False), SETS: (lambda a: a[0], False), MEMBERS: (lambda a: c.spread(a[0]), False), TEXTS: (c.key_of_ids, True)}
    settled = c.materialise(c.deal(slim.mapInArrow(sketch, c.PACKED), where, keys).mapInArrow(settle, c.PACKED), "minhash-sets")
    sizes = of_kind(SIZES)
    copies = of_kind(LINKS).selectExpr("a src", "b dst")
    same = of_kind(SAME).selectExpr("least(a, b) src", "greatest(a, b) dst")
    signs = c.materialise(of_kind(SIGNS, signed, "id long, low binary"), "minhash-signs")

    met = c.materialise(c.deal(settled.where(F.col("kind") == STARS), where, keys).mapInArrow(stars, "key long, id long, total long"), "minhash-stars")
    degree = met.groupBy("id").agg(F.sum("total").alias("degree"))
    middle = met.hint("merge").join(degree.hint("merge"), "id").groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("middle"))
    every = met.select("key", "id").unionByName(of_kind(SHARED).selectExpr("a key", "b id"))
    across = every.hint("merge").join(middle.hint("merge"), "key").where("id <> middle").selectExpr("least(id, middle) src", "greatest(id, middle) dst")
    pairs = c.materialise(of_kind(PAIRS).selectExpr("least(a, b) src", "greatest(a, b) dst").unionByName(across).distinct(), "minhash-pairs")

    def lows(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), plan.words)

    def estimate(batches):
        for batch in batches:
            near = plan.similarity(lows(batch.column("low")), lows(batch.column("other")))
            yield pa.record_batch([batch.column("src"), batch.column("dst"), pa.array(near)], ["src", "dst", "near"]).filter(pa.array(near >= plan.least))

    both = pairs.hint("merge").join(signs.withColumnRenamed("id", "src"), "src").hint("merge").join(signs.selectExpr("id dst", "low other"), "dst")
    passing = c.materialise(both.select("src", "dst", "low", "other").mapInArrow(estimate, "src long, dst long, near double"), "minhash-passing")

    # texts of documents that any pair names, fetched once
    named = pairs.unionByName(same).selectExpr("inline(array(struct(src id), struct(dst id)))").distinct()

    def address(batches):
        for batch in batches:
            out = c.Rows()
            ids = c.ids_of(batch.column("id"))
            for b, own in c.split_by(where.part_of(ids), ids):
                out.add(b, MEMBERS, c.pack(own))
            yield from out.batches()

    def gather(batches):
        for _, rows in c.by_bucket(batches):
            wanted = [c.unpack(data)[0] for kind, data in rows if kind == MEMBERS]
            if not wanted:
                continue
            wanted = np.concatenate(wanted)
            for kind, data in rows:
                if kind == TEXTS:
                    batch = c.unpack_batch(data)
                    found = batch.filter(pa.array(np.isin(c.ids_of(batch.column("id")), wanted)))
                    if found.num_rows:
                        yield found.select(["id", "text"])

    dealt = c.deal(named.mapInArrow(address, c.PACKED).unionByName(c.row_packs(slim, where, TEXTS)), where, keys)
    texts = c.materialise(dealt.mapInArrow(gather, "id long, text string"), "minhash-texts")

    def sets_of(texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        x, doc = _distinct(*shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), shingle))
        return np.split(x, np.cumsum(np.bincount(doc, minlength=len(raw)))[:-1])

    def linked(one: np.ndarray, two: np.ndarray) -> bool:
        shared = len(np.intersect1d(one, two, assume_unique=True))
        return bool(shared > 0 and den * shared >= num * (len(one) + len(two) - shared))

    def compare(batches):
        """Whether the full sets of pairs reach the threshold; a text that comes again in a part is taken apart once."""
        for batch in batches:
            sizes_ = [len(a or "") + len(b or "") for a, b in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist())]
            part_of = np.cumsum(sizes_) // (2 * c.BLOCK_BYTES)
            for lo, hi in zip(np.searchsorted(part_of, np.unique(part_of)), np.searchsorted(part_of, np.unique(part_of), "right")):
                part = batch.slice(lo, hi - lo)
                place: dict = {}
                own = [[place.setdefault(t or "", len(place)) for t in part.column(x).to_pylist()] for x in ("text", "other")]
                sets = sets_of(list(place))
                yield pa.record_batch([part.column("src"), part.column("dst"), pa.array([linked(sets[i], sets[j]) for i, j in zip(*own)], pa.bool_())], ["src", "dst", "linked"])

    def confirmed(asked: DataFrame) -> DataFrame:
        """(src, dst, linked) of pairs, on the full sets of their texts."""
        full = asked.select("src", "dst").distinct().hint("merge").join(texts.withColumnRenamed("id", "src"), "src").hint("merge").join(texts.selectExpr("id dst", "text other"), "dst")
        found = full.select("src", "dst", "text", "other").mapInArrow(compare, "src long, dst long, linked boolean")
        return c.materialise(found.groupBy("src", "dst").agg(F.max("linked").alias("linked")), "minhash-confirmed")

    def labelled(asked: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs with the components of their ends (a, b); a document without links is its own."""
        out = asked
        for end, name in (("src", "a"), ("dst", "b")):
            out = out.hint("merge").join(label.selectExpr(f"node {end}", f"component {name}"), end, "left")
        return out.withColumns({"a": F.coalesce("a", "src"), "b": F.coalesce("b", "dst")})

    ends = passing.select("src", "dst", "near", F.explode(F.array("src", "dst")).alias("id"))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("near"), "src", "dst"))  # its rank limit is applied before the shuffle
    nearest = ends.withColumn("place", place).where(f"place <= {NEAREST}").select("src", "dst")
    checked = confirmed(nearest.unionByName(same))
    label = components(checked.where("linked").select("src", "dst"))

    # components that share buckets, without the pairs of documents that have been compared
    open_ = c.materialise(labelled(pairs, label).where("a <> b"), "minhash-open")
    clusters = components(open_.selectExpr("a src", "b dst"))
    nodes = pairs.selectExpr("inline(array(struct(src id), struct(dst id)))").distinct()
    links = checked.where("linked").select("src", "dst")
    if not clusters.isEmpty():
        members = labelled(nodes.selectExpr("id src", "id dst"), label).selectExpr("src id", "a label")
        members = c.materialise(members.hint("merge").join(clusters.selectExpr("node label", "component cluster").hint("merge"), "label"), "minhash-members")
        counts = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("largest"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("outside"))
        counts = c.materialise(counts.where("size > 2 AND outside > 0"), "minhash-clusters")  # a table, so that a join with a very large cluster can be split
        rows = members.hint("merge").join(counts.hint("merge"), "cluster").hint("merge").join(signs.hint("merge"), "id").hint("merge").join(texts.hint("merge"), "id")
        links = c.materialise(links.unionByName(_rest(rows, plan, lows, sets_of, linked)), "minhash-links")

    found = components(links.unionByName(copies))
    return (
        sizes.selectExpr(f"nullif(a, {c.NULL_ID}) id", "b n_shingles")
        .join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
    )


def _rest(rows: DataFrame, plan: Plan, lows, sets_of, linked) -> DataFrame:
    """Links (src, dst) among documents of clusters (rows: cluster, size, outside, label, largest, id, low, text).

    Each document outside its cluster's largest component meets every other document of the cluster: all are dealt to
    bins, those outside to chunks of askers too, and each bin and chunk is compared in one place, a *spot*.  A text is
    copied once for each chunk of askers, so a few documents outside a large component cost a copy of it.
    """
    parts = lambda n: F.least(F.ceil(F.col(n) / BIN), F.lit(BINS)).cast("int")
    rows = rows.withColumn("bins", parts("size")).withColumn("chunks", parts("outside"))
    deal = lambda seed, n: F.expr(f"cast(pmod(xxhash64(id, {seed}), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    own = rows.select("cluster", deal(0, "bins").alias("bin"), every("chunks").alias("chunk"), F.lit(False).alias("asks"), "id", "label", "low", "text")
    asks = rows.where("label <> largest").select("cluster", every("bins").alias("bin"), deal(1, "chunks").alias("chunk"), F.lit(True).alias("asks"), "id", "label", "low", "text")
    spot = own.unionByName(asks).repartition("cluster", "bin", "chunk").sortWithinPartitions("cluster", "bin", "chunk")

    def examined(held):
        asks, ids, labels, low, text = (np.concatenate(x) for x in zip(*held))
        other = np.flatnonzero(~asks)
        sets: dict[int, np.ndarray] = {}
        root = np.unique(labels, return_inverse=True)[1]  # components, as far as links here have joined them
        out = []

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = sets_of([text[i]])[0]
            return sets[i]

        for i in np.flatnonzero(asks).tolist():
            apart = other[root[other] != root[i]]
            near = plan.similarity(low[i], low[apart])
            for j in apart[np.argsort(-near, kind="stable")[: int((near >= plan.least).sum())]].tolist():
                if root[j] != root[i] and linked(set_of(i), set_of(j)):
                    out.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        src, dst = zip(*out) if out else ((), ())
        return pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def compare(batches):
        last, held = None, []
        for batch in batches:
            at = np.stack([batch.column(x).to_numpy() for x in ("cluster", "bin", "chunk")], axis=1).astype(np.int64)
            text = np.empty(len(at), object)
            text[:] = [t or "" for t in batch.column("text").to_pylist()]
            columns = [batch.column("asks").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(), batch.column("label").to_numpy(), lows(batch.column("low")), text]
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(at)]])
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and last != tuple(at[lo]):
                    if held:
                        yield examined(held)
                    last, held = tuple(at[lo]), []
                if hi > lo:
                    held.append(tuple(x[lo:hi] for x in columns))
        if held:
            yield examined(held)

    return spot.mapInArrow(compare, "src long, dst long")
