"""LM scoring by a hierarchical Pitman-Yor model of words.

Context restaurants (the word before) share one parent restaurant, whose parent is the uniform distribution over the
vocabulary and one unknown word.  Every training word and the beginning of a text has a restaurant of its own; a word
without training tokens has an empty one, which predicts as the parent does.

1. Words are counted by bucket; N, V and the frequent words (at least N / 2**18 training tokens) follow.  Sums of
   frequent words are broadcast, those of rarer words are exchanged by bucket; this decides where sums are kept, not
   what they are.  Dishes (word and context) with at least N / 2**14 tokens are *hot*; there are 2**14 at most.
2. Tokens go once to buckets: a frequent word's by word and context, a rarer word's by word, so a bucket knows its
   rarer words' counts whole.  Tokens of hot dishes are counted by text where they are read and stay with the text; the
   driver seats them, so no bucket gets a pair of words that a large share of all tokens has.
3. Gibbs sweeps by blocks: all customers of a dish are removed and seated again given all other dishes.  The number of
   a dish's tables is drawn from its distribution, generalised Stirling numbers times the weight of opening so many
   tables: exact ones up to EXACT customers, beyond it exact ones at EXACT carried on by their saddle-point approximation,
   and a normal distribution round the mode where that is beyond NORMAL tables.  Sums over dishes in other buckets, and in the same one, are those of the state before, as usual where Gibbs
   sampling is distributed.  Then the customers of the parent (a table of a context is one) are seated likewise.
   The first state has one table for each dish; discounts come from counts of ones and twos.  BURN sweeps are not used.
4. Predictions are averaged over the sampled states, then log10 is summed by text.

A bucket is held in memory; there are MOST at most, so beyond about 130 GB of stored text buckets grow with the input.

Null texts are empty (one end token).  Every row is scored on its own, repeated rows and null identifiers too (a
null identifier trains).  Without training texts predictions are uniform.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

FREQUENT_SHARE = 1 << 18
HOT_SHARE = 1 << 14
EXACT = 1024
NORMAL = 64
STRENGTH = 1.0
BURN = 1
END = np.uint64(0xE4D0F7E87000A5C3)
START = np.uint64(0)  # the context of a text's first token
STEP = np.uint64(0x9E3779B97F4A7C15)
PAIRS, TOKENS, HOT, HOT_COUNTS, ROWS = range(5)
TOTALS, STATE = 10, 100  # kinds of rows of state s: TOTALS + s, STATE + s
FLUSH_BYTES = c.FLUSH_BYTES // 2  # a token takes more memory than its text
BLOCK_BYTES = 1 << 18  # tokenised at once
PIECE = 1 << 18  # tokens in a stored cell
WEIGHTS = 1 << 17  # weighed at once when dishes are seated
#: A row group ends with the cell that fills it, so a scan holds one cell of a bucket and passes over other kinds of cells.
CELLS = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % 5 == 1 if i != c.NULL_ID else False for i in ids.tolist()], bool)


def tokens_of(text: np.ndarray, offsets: np.ndarray):
    """(word, word before, document) of the tokens of a block, an end after each document's words."""
    w, _, _, doc = c.words(text, offsets)
    n = len(offsets) - 1
    size = np.bincount(doc, minlength=n)
    place, end = np.arange(len(w)) + doc, np.cumsum(size) + np.arange(n)
    word, before = np.full(len(w) + n, END, np.uint64), np.zeros(len(w) + n, np.uint64)
    word[place], before[place + 1] = w, w
    before[end - size] = START
    return word, before, np.repeat(np.arange(n), size + 1)


def dish_key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return c.mix(word + before * STEP)


@functools.lru_cache(4)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [n, t] sums over the seatings of n customers at t tables the product of
    what each customer who joined a table weighed."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for n in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= n, out[n, 1:] + np.log(np.maximum(n - discount * t, 1e-300)), -np.inf)
        out[n + 1, 1:] = np.logaddexp(stay, out[n, :-1])
    return out


def seat(count: np.ndarray, base: np.ndarray, prediction: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of dishes with so many customers, drawn given everything else.

    base: strength and discount times the tables of other dishes in the restaurant; prediction: of the dish by the parent.
    A seating at t tables has weight S(n, t) * product over i < t of (base + discount * i) * prediction.
    """
    tables = (count > 0).astype(np.float64)
    first = np.minimum(count, EXACT).astype(np.int64)
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], 2) :]
    cuts = np.flatnonzero(np.diff(first[order])) + 1
    stirling = log_stirling(round(discount, 6))
    for same in np.split(order, cuts) if len(order) else ():
        n = int(first[same[0]])
        for lo in range(0, len(same), max(1, WEIGHTS // n)):
            at = same[lo : lo + max(1, WEIGHTS // n)]
            opening = np.log(base[at, None] + discount * np.arange(n)) + np.log(np.maximum(prediction[at, None], 1e-300))
            weight = stirling[n, 1 : n + 1] + np.cumsum(opening, axis=1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + np.minimum((weight < rng.random(len(at))[:, None] * weight[:, -1:]).sum(axis=1), n - 1)
    large = np.flatnonzero(count > EXACT)
    for lo in range(0, len(large), 4096):
        at = large[lo : lo + 4096]
        tables[at] = _seat_many(count[at], base[at], prediction[at], discount, rng)
    return tables


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after eight steps up."""
    steps = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - steps


def _digamma(x: np.ndarray) -> np.ndarray:
    steps = sum(1 / (x + i) for i in range(8))
    y = x + 8
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - steps


def _halved(low: np.ndarray, high: np.ndarray, falls, rounds: int = 60) -> np.ndarray:
    """Where a falling function changes its sign, between bounds."""
    for _ in range(rounds):
        middle = (low + high) / 2
        above = falls(middle) > 0
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def _saddle(n: np.ndarray, t: np.ndarray, a: float) -> np.ndarray:
    """Logarithm of the generalised Stirling number by the saddle point of its generating function ((1 - (1 - x)^a) / a)^t / t!."""

    def ratio(v):  # of x g'(x) / g(x) at x = 1 - u, u = exp(v)
        return a * -np.expm1(v) * np.exp((a - 1) * v) / -np.expm1(a * v)

    v = _halved(np.full(n.shape, -200.0), np.full(n.shape, -1e-9), lambda v: t * ratio(v) - n)
    r, g = -np.expm1(v), -np.expm1(a * v) / a
    first = ratio(v)
    second = first + r * r * (1 - a) * np.exp((a - 2) * v) / g - first * first
    return _log_gamma(n + 1) - _log_gamma(t + 1) + t * np.log(g) - n * np.log(r) - 0.5 * np.log(np.maximum(t * second, 1e-300))


def _seat_many(count, base, prediction, a: float, rng) -> np.ndarray:
    """Tables of dishes with more than EXACT customers."""
    start, opening = base / a, np.log(a * np.maximum(prediction, 1e-300))

    def slope(t):  # of the logarithm of the weight; the saddle point moves with t
        def ratio(v):
            return a * -np.expm1(v) * np.exp((a - 1) * v) / -np.expm1(a * v)

        v = _halved(np.full(t.shape, -200.0), np.full(t.shape, -1e-9), lambda v: t * ratio(v) - count, 50)
        return np.log(-np.expm1(a * v) / a) - _digamma(t + 1) + _digamma(start + t) + opening

    mode = np.exp(_halved(np.zeros(len(count)), np.log(count - 1), lambda x: slope(np.exp(x)), 40))
    step = np.maximum(mode * 1e-3, 1e-3)
    under = np.maximum(mode - step, 0.5)
    spread = np.sqrt((mode + step - under) / np.maximum(slope(under) - slope(mode + step), 1e-12))
    wide = np.minimum(spread, mode / 2)  # a step as wide as the curve, for its skewness: the mean lies beside the mode
    skew = (slope(mode + wide) + slope(mode - wide)) / wide**2
    out = np.clip(np.rint(mode + skew * wide**4 / 2 + np.minimum(spread, mode) * rng.standard_normal(len(count))), 1, count)
    few = np.flatnonzero(mode < NORMAL)
    if len(few):
        t = np.arange(1.0, 5 * NORMAL + 1)
        known = log_stirling(round(a, 6))[EXACT, 1 : len(t) + 1] - _saddle(np.full(len(t), float(EXACT)), t, a)
        for lo in range(0, len(few), 256):
            at = few[lo : lo + 256]
            n, many = np.broadcast_arrays(count[at, None], t)
            weight = known + _saddle(n.copy(), many.copy(), a) + _log_gamma(start[at, None] + t) + t * opening[at, None]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (weight < rng.random(len(at))[:, None] * weight[:, -1:]).sum(axis=1)
    return np.minimum(out, count)


class Model:
    """What all tasks need: frequent words, hot dishes, and for each state sums over buckets.  Bounded by 2**18 words."""

    def __init__(self, n: int, v: int, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.n, self.v, self.words, self.counts = n, v, words[order], counts[order]
        self.contexts = len(words) + 1  # frequent words and the beginning; a bucket's rarer contexts follow
        self.customers = np.zeros(self.contexts)
        self.states: list[dict] = []
        self.discount = self.parent_discount = 0.5
        self.hot = np.empty(0, np.uint64)  # keys of hot dishes, their words and contexts, and training counts
        self.hot_word = self.hot_context = np.empty(0, np.int64)
        self.hot_count = np.empty(0)

    def frequent(self, w: np.ndarray) -> np.ndarray:
        """Index of each word among the frequent ones, or -1."""
        if not len(self.words):
            return np.full(len(w), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, at, -1)

    def context(self, before: np.ndarray) -> np.ndarray:
        """Index of each context, -1 for a rarer word."""
        return np.where(before == START, len(self.words), self.frequent(before))

    def take_hot(self, key: np.ndarray, word: np.ndarray, before: np.ndarray) -> None:
        word, context = self.frequent(word), self.context(before)
        known = np.flatnonzero((word >= 0) & (context >= 0))
        known = known[np.argsort(key[known])]
        self.hot, self.hot_word, self.hot_context, self.hot_count = key[known], word[known], context[known], np.zeros(len(known))

    def hot_index(self, key: np.ndarray) -> np.ndarray:
        """Index of each dish among the hot ones, or -1."""
        if not len(self.hot):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
        return np.where(self.hot[at] == key, at, -1)

    def parent(self, state: dict, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent restaurant's prediction of words with so many customers and tables."""
        d = self.parent_discount
        return (np.maximum(customers - d * tables, 0) + (STRENGTH + d * state["parent_tables"]) / (self.v + 1)) / (STRENGTH + state["parent_customers"])

    def reseated(self, s: int, count, tables, context_tables, predicted, rng) -> np.ndarray:
        """Tables of dishes in state s, given their tables, their contexts' and the parent's predictions in the state before."""
        return seat(count, STRENGTH + self.discount * np.maximum(context_tables - tables, 0), predicted, self.discount, rng)

    def parent_seats(self, s: int, customers: np.ndarray, seats: np.ndarray | None, rng) -> np.ndarray:
        """Tables of words in the parent in state s; seats: in the state before."""
        if not s:
            return (customers > 0).astype(np.float64)
        others = np.maximum(self.states[s - 1]["parent_tables"] - seats, 0)
        return seat(customers, STRENGTH + self.parent_discount * others, np.full(len(customers), 1 / (self.v + 1)), self.parent_discount, rng)

    def predicted_by(self, s: int, count, tables, context_tables, context_customers, predicted) -> np.ndarray:
        """Predictions of dishes in a state."""
        d = self.discount
        return (np.maximum(count - d * tables, 0) + (STRENGTH + d * context_tables) * predicted) / (STRENGTH + context_customers)


class Pairs:
    """A bucket's dishes: word and context (frequent index, or number of frequent ones + local index), training count.

    keys: the rarer contexts; totals: (owner, state, tables, customers) of them, as the owners sent them; state: tables of
    dishes and seats of rare words in the parent, by state.
    """

    def __init__(self, bucket: int, model: Model, word, context, count, rare: int, keys: np.ndarray, n: int, totals=(), state=None) -> None:
        self.bucket, self.model, self.word, self.context, self.count, self.rare, self.keys = bucket, model, word, context, count, rare, keys
        self.state = state or {}
        self.owner = (keys % np.uint64(n)).astype(np.int64)
        order = np.argsort(self.owner, kind="stable")
        self.tables, self.customers = {}, None
        for s in sorted({t[1] for t in totals}):
            own = sorted((t for t in totals if t[1] == s), key=lambda t: t[0])
            self.tables[s] = np.zeros(len(keys))
            self.tables[s][order] = np.concatenate([t[2] for t in own])
            if s == 0:
                self.customers = np.zeros(len(keys))
                self.customers[order] = np.concatenate([t[3] for t in own])
        self.is_rare = word >= len(model.words)
        self.local = word - len(model.words)

    def rare_customers(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.local[self.is_rare], tables[self.is_rare], minlength=self.rare)

    def context_tables(self, s: int) -> np.ndarray:
        """Tables of each dish's context in a state."""
        return np.concatenate([self.model.states[s]["tables"], self.tables.get(s, np.empty(0))])[self.context]

    def context_customers(self) -> np.ndarray:
        return np.concatenate([self.model.customers, np.empty(0) if self.customers is None else self.customers])[self.context]

    def parents(self, s: int) -> np.ndarray:
        """The parent's predictions of each dish in a state."""
        tables, seats = self.state[s]
        now = self.model.states[s]
        every = np.concatenate([now["frequent"], self.model.parent(now, self.rare_customers(tables), seats)])
        return every[self.word] if len(self.word) else np.empty(0)

    def advance(self, s: int) -> np.ndarray:
        """Draws state s from the one before; returns the rare words' customers in the parent."""
        rng = np.random.default_rng([self.bucket, s])
        tables, seats = (self.count > 0).astype(np.float64), None
        if s:
            before, seats = self.state[s - 1]
            tables = self.model.reseated(s, self.count, before, self.context_tables(s - 1), self.parents(s - 1), rng)
        customers = self.rare_customers(tables)
        self.state[s] = tables, self.model.parent_seats(s, customers, seats, rng)
        return customers


def _sums(pairs: Pairs, s: int):
    """What state s sums over buckets: (kind, index, value); kinds 4 and 5: tables and customers of all its rarer contexts."""
    customers = pairs.advance(s)
    tables, seats = pairs.state[s]
    shared, most = pairs.model.contexts, pairs.model.contexts + len(pairs.keys)
    by_context = np.bincount(pairs.context, tables, minlength=most)
    yield 4, np.arange(len(pairs.keys)), by_context[shared:]
    by_context = by_context[:shared]
    frequent = np.bincount(pairs.word[~pairs.is_rare], tables[~pairs.is_rare], minlength=0)
    yield 0, np.flatnonzero(by_context), by_context[by_context > 0]
    yield 1, np.flatnonzero(frequent), frequent[frequent > 0]
    yield 2, np.arange(2), np.array([tables.sum(), seats.sum()])
    if s == 0:
        own = np.bincount(pairs.context, pairs.count, minlength=most)
        yield 5, np.arange(len(pairs.keys)), own[shared:]
        own = own[:shared]
        yield 3, np.flatnonzero(own), own[own > 0]
        yield 2, np.arange(2, 6), np.array([(pairs.count == 1).sum(), (pairs.count == 2).sum(), (customers == 1).sum(), (customers == 2).sum()], np.float64)


def _added(at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of whole numbers by index, exact beyond what doubles hold."""
    out = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    np.add.at(out, at, value)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per input row."""
    spark = docs.sparkSession
    c.prepare(spark)
    where = c.Layout(c.layout(docs, 8 << 20, least=12, by_session=False).parts)
    n = where.parts
    slim = c.columns(docs, id=id_col, text=text_col)

    def count(batches):
        held, size = [], 0

        def flush():
            word, before = (np.concatenate(x) for x in zip(*held))
            held.clear()
            known, at, total = np.unique(word, return_inverse=True, return_counts=True)
            out = c.Rows()
            for b, w, m in c.split_by(where.part(known), known, total):
                out.add(b, 0, c.pack(w, m))
                yield from out.batches(1 << 20)
            # pairs that may be hot: in a task, where both words are as frequent as that
            least = max(2, len(word) // HOT_SHARE)
            both = np.flatnonzero(total[at] >= least)
            both = both[np.isin(before[both], np.append(known[total >= least], START))]
            key, first, times = np.unique(dish_key(word[both], before[both]), return_index=True, return_counts=True)
            first, key, times = both[first][times >= least], key[times >= least], times[times >= least]
            for b, *x in c.split_by(where.part(key), key, word[first], before[first], times):
                out.add(b, 1, c.pack(*x))
            yield from out.batches()

        for ids, text, offsets in c.blocks(batches, BLOCK_BYTES):
            word, before, doc = tokens_of(text, offsets)
            train = ~held_out(ids)[doc]
            held.append((word[train], before[train]))
            size += len(text) + len(ids)
            if size >= FLUSH_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def united(batches):
        """(kind, key, n, word, before) of the words and the pairs of a bucket."""
        rows = {0: [], 1: []}
        for _, kind, data in c.packed_rows(batches):
            rows[kind].append(c.unpack(data))
        for kind, held in rows.items():
            if not held:
                continue
            parts = [np.concatenate(x) for x in zip(*held)]
            known, first, at = np.unique(parts[0], return_index=True, return_inverse=True)
            total = np.zeros(len(known), np.int64)
            np.add.at(total, at, parts[-1])
            word, before = (parts[i][first] if kind else np.zeros(len(known), np.uint64) for i in (1, 2))
            for lo in range(0, len(known), 100_000):
                cut = slice(lo, lo + 100_000)
                yield pa.record_batch([pa.array(np.full(len(known[cut]), kind, np.int32)), *(pa.array(x[cut].view(np.int64)) for x in (known, total, word, before))], ["kind", "key", "n", "word", "before"])

    counts = c.materialise(c.deal(slim.mapInArrow(count, c.PACKED), where).mapInArrow(united, "kind int, key long, n long, word long, before long"), "words")
    total, distinct = counts.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("key")).first()
    some = lambda kind, least: counts.where((F.col("kind") == kind) & (F.col("n") >= least)).toArrow()
    bits = lambda t, x: t.column(x).to_numpy().view(np.uint64)
    frequent = some(0, max(2, -(-total // FREQUENT_SHARE)))  # FREQUENT_SHARE rows at most
    model = Model(total, distinct, bits(frequent, "key"), frequent.column("n").to_numpy())
    pairs_ = some(1, max(64, -(-total // HOT_SHARE)))  # HOT_SHARE rows at most
    model.take_hot(bits(pairs_, "key"), bits(pairs_, "word"), bits(pairs_, "before"))
    shared = spark.sparkContext.broadcast(model)

    def tokens(batches):
        held, rows, size = ([], [], []), [], 0  # words, words before, texts; (row, identifier) of each text
        m = shared.value

        def flush():
            columns = []
            for parts in held:  # one after the other, so that only one is there twice
                columns.append(np.concatenate(parts))
                parts.clear()
            word, before, doc = columns
            rid, ids = (np.concatenate(x) for x in zip(*rows))
            key = dish_key(word, before)
            hot = m.hot_index(key).astype(np.int32)
            out = c.Rows()
            warm = np.flatnonzero(hot >= 0)
            if len(warm):  # counted by text
                pair, times = np.unique(doc[warm] * np.int64(len(m.hot)) + hot[warm], return_counts=True)
                del warm
                text = pair // len(m.hot)
                for b, *x in c.split_by(where.part_of(rid[text]), rid[text], ids[text], pair % len(m.hot), times):
                    out.add(b, HOT, c.pack(*x))
                    yield from out.batches(4 << 20)
            code = m.frequent(word).astype(np.int32)
            bucket = np.where(hot < 0, where.part(np.where(code >= 0, key, word)), np.int32(-1))
            del key, hot
            for b, w, k, u, d in c.split_by(bucket, word, code, before, doc):
                if b < 0:  # hot
                    continue
                x = m.context(u)
                used, own = np.unique(d, return_inverse=True)
                out.add(b, TOKENS, c.pack(w[k < 0], k.astype(np.int64), x, u[x < 0], own, rid[used], ids[used]))
                yield from out.batches(4 << 20)
            yield from out.batches()

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rids, done = part.column("rid").to_numpy(), 0
                for ids, text, offsets in c.blocks([part], BLOCK_BYTES):
                    word, before, doc = tokens_of(text, offsets)
                    for parts, x in zip(held, (word, before, (doc + sum(len(r) for r, _ in rows)).astype(np.int32))):
                        parts.append(x)
                    rows.append((rids[done : done + len(ids)], ids))
                    done += len(ids)
                    size += len(text) + 8 * len(ids)
                    if size >= FLUSH_BYTES:
                        yield from flush()
                        rows, size = [], 0
        if rows:
            yield from flush()

    def dishes(batches):
        """A bucket's dishes, its tokens by dish, and what texts have of hot dishes."""
        held, warm, bucket = [], [], 0
        for bucket, kind, data in c.packed_rows(batches):
            (held if kind == TOKENS else warm).append(data)
        m, out = shared.value, c.Rows()
        if warm:
            rid, ids, hot, times = (np.concatenate(x) for x in zip(*map(c.unpack, warm)))
            warm.clear()
            own = np.bincount(hot, times * ~held_out(ids), minlength=len(m.hot)).astype(np.int64)
            out.add(bucket, HOT_COUNTS, c.pack(np.flatnonzero(own), own[own > 0]))
            for lo in range(0, len(rid), PIECE):
                out.add(bucket, HOT, c.pack(*(x[lo : lo + PIECE] for x in (rid, ids, hot, times))))
                yield from out.batches(1 << 20)
            yield from out.batches()
            del rid, ids, hot, times
        if not held:
            return
        # twice over the packed rows: unpacked, they are several times as large
        found, n_tokens = [], 0
        for data in held:
            w, k, _, u, _, r, i = c.unpack(data)
            found.append((np.unique(w), np.unique(u), r, i))
            n_tokens += len(k)
        rare, keys = (np.unique(np.concatenate([f[j] for f in found])) for j in (0, 1))
        contexts = m.contexts + len(keys)
        rows, at = np.unique(np.concatenate([f[2] for f in found]), return_index=True)
        ids = np.concatenate([f[3] for f in found])[at]
        del found
        key, doc, at = np.empty(n_tokens, np.int64), np.empty(n_tokens, np.int32), 0
        for data in held:
            w, k, x, u, d, r, _ = c.unpack(data)
            word, context = k.copy(), x.copy()
            word[k < 0] = len(m.words) + np.searchsorted(rare, w)
            context[x < 0] = m.contexts + np.searchsorted(keys, u)
            key[at : at + len(k)] = word * contexts + context
            doc[at : at + len(k)] = np.searchsorted(rows, r)[d]
            at += len(k)
        held.clear()
        train = ~held_out(ids)
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        trained = np.add.reduceat(train[doc], first, dtype=np.int64)
        pair = key[first]
        out.add(bucket, PAIRS, c.pack(pair // contexts, pair % contexts, trained, np.array([len(rare)]), keys))
        out.add(bucket, ROWS, c.pack(rows, ids))
        yield from out.batches()
        piece = np.append(np.flatnonzero(np.diff(first // PIECE, prepend=-1)), len(first))
        edge = np.append(first, len(key))
        for lo, hi in zip(piece[:-1], piece[1:]):
            out.add(bucket, TOKENS, c.pack(np.array([lo]), size[lo:hi], doc[edge[lo] : edge[hi]]))
            yield from out.batches(1 << 20)
        yield from out.batches()

    with_row = slim.withColumn("rid", F.monotonically_increasing_id())
    table = c.materialise(c.deal(with_row.mapInArrow(tokens, c.PACKED), where).mapInArrow(dishes, c.PACKED), "tokens", **CELLS)

    def summed(batches):
        for _, _, data in c.packed_rows(batches):
            index, value = c.unpack(data)
            yield pa.record_batch([pa.array(index, pa.int64()), pa.array(value, pa.int64())], ["i", "n"])

    def of_kind(kind: int) -> DataFrame:
        return table.where(F.col("kind") == kind)

    for i, times in of_kind(HOT_COUNTS).mapInArrow(summed, "i long, n long").groupBy("i").agg(F.sum("n")).collect():  # hot dishes
        model.hot_count[i] = times

    def pairs_of(bucket: int, data: bytes, m: Model, more=()) -> Pairs:
        """A bucket's dishes with the totals and states that came with it: (kind, data) rows."""
        word, context, trained, rare, keys = c.unpack(data)
        totals, state = [], {}
        for kind, row in more:
            if kind >= STATE:
                state[kind - STATE] = tuple(x.astype(np.float64) for x in c.unpack(row))
            else:
                owner, *x = c.unpack(row)
                totals.append((int(owner[0]), kind - TOTALS, *x))
        return Pairs(bucket, m, word, context, trained.astype(np.float64), int(rare[0]), keys, n, totals, state)

    results: list[DataFrame] = []  # of each state: its totals of rarer contexts and its tables, by bucket

    def joined(*frames) -> DataFrame:
        """Rows of frames, a bucket to a partition."""
        out = frames[0]
        for t in frames[1:]:
            out = out.union(t)
        return c.deal(out, where)

    hot_tables: list[np.ndarray] = []
    frequent_seats: list[np.ndarray] = []
    last = BURN + samples
    for s in range(last + 1):
        known = spark.sparkContext.broadcast(model)

        def sweep(batches, s=s, known=known):
            def send(pairs):
                own, parts, out = {}, [], c.Rows()
                for kind, index, value in _sums(pairs, s):
                    if kind >= 4:
                        own[kind] = value.astype(np.int64)
                    else:
                        parts.append((np.full(len(index), kind, np.int64), index, value.astype(np.int64)))
                kind, index, value = (np.concatenate(x) for x in zip(*parts))
                for b, k, i, v in c.split_by((index % n).astype(np.int32), kind, index, value):
                    out.add(b, 0, c.pack(k, i, v))
                    yield from out.batches(4 << 20)
                for b, key, *x in c.split_by(pairs.owner.astype(np.int32), pairs.keys, *own.values()):
                    out.add(b, 1, c.pack(np.array([pairs.bucket]), key, *x))
                    yield from out.batches(4 << 20)
                out.add(pairs.bucket, STATE, c.pack(*(x.astype(np.int64) for x in pairs.state[s])))
                yield from out.batches()

            data, sent = {}, []
            for bucket, kind, row in c.packed_rows(batches):
                if not s:  # needs no totals
                    yield from send(pairs_of(bucket, row, known.value))
                elif kind == PAIRS:
                    data[bucket] = row
                else:
                    sent.append((kind, row))
            for bucket, row in data.items():
                yield from send(pairs_of(bucket, row, known.value, sent))

        def owned(batches, s=s):
            sums, asked, bucket, out = [], [], None, c.Rows()
            for bucket, kind, row in c.packed_rows(batches):
                if kind == STATE:
                    out.add(bucket, STATE + s, row)
                else:
                    (asked if kind else sums).append(c.unpack(row))
            if sums:
                kind, index, value = (np.concatenate(x) for x in zip(*sums))
                pair, at = np.unique(index * 4 + kind, return_inverse=True)
                out.add(-1, 0, c.pack(pair % 4, pair // 4, _added(at, value)))
            if asked:
                _, at = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
                found = [_added(at, np.concatenate([a[j] for a in asked]))[at] for j in range(2, len(asked[0]))]
                to = 0
                for source, key, *_ in asked:
                    to, lo = to + len(key), to
                    out.add(int(source[0]), TOTALS + s, c.pack(np.array([bucket]), *(x[lo:to] for x in found)))
                    yield from out.batches(4 << 20)
            yield from out.batches()

        swept = (joined(of_kind(PAIRS), results[-1]) if s else of_kind(PAIRS)).mapInArrow(sweep, c.PACKED)
        result = c.materialise(c.deal(swept, where).mapInArrow(owned, c.PACKED), "totals", **CELLS)
        sums = [c.unpack(r.data) for r in result.where("bucket < 0").collect()]  # by frequent context and word
        results.append(result.where("bucket >= 0"))
        kind, index, value = (np.concatenate(x) for x in zip(*sums)) if sums else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        of = lambda k, size: np.bincount(index[kind == k], value[kind == k].astype(np.float64), minlength=size)
        # the driver's part: hot dishes, and frequent words in the parent
        rng = np.random.default_rng([s, 7])
        if s:
            before = model.states[s - 1]
            hot_tables.append(model.reseated(s, model.hot_count, hot_tables[-1], before["tables"][model.hot_context], before["frequent"][model.hot_word], rng))
        else:
            hot_tables.append((model.hot_count > 0).astype(np.float64))
        hot = hot_tables[-1]
        scalar = of(2, 6)
        customers = of(1, len(model.words)) + np.bincount(model.hot_word, hot, minlength=len(model.words))
        if s == 0:
            model.customers = of(3, model.contexts) + np.bincount(model.hot_context, model.hot_count, minlength=model.contexts)
            ones, twos = scalar[4] + (customers == 1).sum(), scalar[5] + (customers == 2).sum()
            model.discount = float(np.clip(scalar[2] / max(scalar[2] + 2 * scalar[3], 1), 0.1, 0.95))
            model.parent_discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))
        frequent_seats.append(model.parent_seats(s, customers, frequent_seats[-1] if s else None, rng))
        state = {"tables": of(0, model.contexts) + np.bincount(model.hot_context, hot, minlength=model.contexts), "parent_customers": scalar[0] + hot.sum(), "parent_tables": scalar[1] + frequent_seats[-1].sum()}
        state["frequent"] = model.parent(state, customers, frequent_seats[-1])
        model.states.append(state)
    model.hot_mean = sum(model.predicted_by(s, model.hot_count, hot_tables[s], st["tables"][model.hot_context], model.customers[model.hot_context], st["frequent"][model.hot_word]) for s, st in enumerate(model.states) if s > BURN) / samples
    final = spark.sparkContext.broadcast(model)

    def predict(batches):
        m = final.value
        base_of = lambda k: np.log10((k + 0.5) / (m.n + 0.5 * (m.v + 1)))
        data, texts, pieces, sent, out = {}, {}, {}, [], c.Rows()
        for bucket, kind, row in c.packed_rows(batches):
            if kind == HOT:
                rid, ids, hot, times = c.unpack(row)
                rows, at, own = np.unique(rid, return_index=True, return_inverse=True)
                add = lambda x, own=own, times=times: np.bincount(own, x * times)
                known = m.counts[m.hot_word[hot]].astype(np.float64)
                out.add(bucket, 0, c.pack(rows, ids[at], add(1).astype(np.int64), add(known > 0).astype(np.int64), add(base_of(known)), add(np.log10(m.hot_mean[hot]))))
                yield from out.batches(4 << 20)
            elif kind == TOKENS:
                pieces.setdefault(bucket, []).append(row)
            elif kind in (PAIRS, ROWS):
                (data if kind == PAIRS else texts)[bucket] = row
            else:
                sent.append((kind, row))
        for bucket, row in data.items():
            pairs = pairs_of(bucket, row, m, sent)
            mean = np.zeros(len(pairs.word))
            for s in range(BURN + 1, last + 1):
                mean += m.predicted_by(s, pairs.count, pairs.state[s][0], pairs.context_tables(s), pairs.context_customers(), pairs.parents(s))
            # a rarer word's tokens are all in this bucket, so its dishes sum to its count
            word_count = np.concatenate([m.counts.astype(np.float64), pairs.rare_customers(pairs.count)])[pairs.word] if len(pairs.word) else mean
            rows, ids = c.unpack(texts[bucket])
            of_dish = ((word_count > 0).astype(np.float64), base_of(word_count), np.log10(mean / samples))
            n_tokens, sums = np.zeros(len(rows), np.int64), np.zeros((3, len(rows)))
            for piece in pieces[bucket]:
                first, size, doc = c.unpack(piece)
                n_tokens += np.bincount(doc, minlength=len(rows))
                for to, x in zip(sums, of_dish):
                    to += np.bincount(doc, np.repeat(x[first[0] : first[0] + len(size)], size), minlength=len(rows))
            for b, *x in c.split_by(where.part_of(rows), rows, ids, n_tokens, sums[0].astype(np.int64), sums[1], sums[2]):
                out.add(b, 0, c.pack(*x))
                yield from out.batches(4 << 20)
        yield from out.batches()

    def collect(batches):
        held = [c.unpack(data) for _, _, data in c.packed_rows(batches)]
        if not held:
            return
        r, i, t, k, x, y = (np.concatenate(part) for part in zip(*held))
        rows, first, at = np.unique(r, return_index=True, return_inverse=True)
        ids = i[first]
        yield pa.record_batch(
            [c.ids_array(ids), pa.array(held_out(ids)), pa.array(_added(at, t)), pa.array(_added(at, k)), pa.array(np.full(len(ids), total), pa.int64()), pa.array(np.bincount(at, x)), pa.array(np.bincount(at, y))],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    first = results[0].where(F.col("kind") == TOTALS)  # has the contexts' customers
    whole = joined(table.where(F.col("kind") != HOT_COUNTS), first, *results[BURN + 1 :])
    return c.deal(whole.mapInArrow(predict, c.PACKED), where).mapInArrow(collect, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
