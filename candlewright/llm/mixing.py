"""Mixing sources to target weights with soft membership.

A classifier fitted on labelled texts predicts every document's posteriors over domains; projected gradient steps then
fit nonnegative document rates, so that the expected token totals of the domains (rate x tokens x posterior) match the
targets while rates stay near one.

The classifier (softmax regression on a few shape measures and on hashed distinct words, each scaled by how many standard
errors its shares of documents differ between domains, so that words without a clear difference can say little) is
fitted on at most `sample` labelled documents and `sample_bytes` of their texts, taken by hash; posteriors, totals and
rates cover all documents.  A step is the
residual of each domain, scaled by the inverse Gram matrix, so a document's rate follows from the list of past steps: each step is one pass
over (tokens, posteriors) that sums K numbers, and the driver holds K numbers a step.

Domains of `labels`: toxic (toxic = 1), poor (quality = 0), good (quality = 1).  Labels without a text, and null
labels, are not used; without any usable label the posteriors are uniform.  Null texts have no tokens and rate one.
Repeated rows and null identifiers get rates of their own (the classifier sees one text of an identifier, the least);
an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

BITS = 20
FEATURES = 1 << BITS
CERTAIN = 10.0  # standard errors at which a word has its full scale; below, it falls with their third power
LEAST_DOCUMENTS = 2  # with a feature in the sample
SHAPE = 5
DOMAINS = ("good", "poor", "toxic")
#: Target shares of the expected token total.
TARGETS = {"good": 0.80, "poor": 0.18, "toxic": 0.02}
STAY = 1e-3  # weight of staying near rate one
STEPS = 30


def features(text: np.ndarray, offsets: np.ndarray):
    """(feature, document) of distinct hashed words, words and shape measures of each document of a block."""
    w, first, last, doc = c.words(text, offsets)
    n = len(offsets) - 1
    words = np.bincount(doc, minlength=n)
    pair = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | (w & np.uint64(FEATURES - 1)))
    feature, owner = (pair & np.uint64(FEATURES - 1)).astype(np.int32), (pair >> np.uint64(BITS)).astype(np.int32)
    symbol = np.concatenate([[0], np.cumsum(np.isin(text, np.frombuffer(b"#*$%&|<>", np.uint8)))])
    symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]
    distinct = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    shape = np.stack([np.ones(n), np.minimum(symbols / some, 1), distinct / some, np.minimum(np.bincount(doc, last - first, minlength=n) / some / 10, 2), np.log1p(words) / 10], axis=1)
    return feature, owner, words, shape


def logits(weights, bias, feature, owner, shape):
    out = shape @ bias
    for k in range(weights.shape[1]):
        out[:, k] += np.bincount(owner, weights[feature, k], minlength=len(shape))
    return out


def scales(parts, labels: np.ndarray, k: int) -> np.ndarray:
    """Scale of each hashed word, 0 to 1, by how significantly its shares of documents differ between domains."""
    seen, at = np.zeros((FEATURES, k)), 0
    for feature, owner, shape in parts:
        np.add.at(seen, (feature, labels[at + owner]), 1)
        at += len(shape)
    n, of = len(labels), np.bincount(labels, minlength=k)
    total = seen.sum(axis=1)
    share = total / n
    most = np.zeros(FEATURES)
    for j in np.flatnonzero((of > 0) & (of < n)):
        error = np.sqrt(share * (1 - share) * (1 / of[j] + 1 / (n - of[j])))
        most = np.maximum(most, np.abs(seen[:, j] / of[j] - (total - seen[:, j]) / (n - of[j])) / np.maximum(error, 1e-12))
    return np.where((most > 1) & (total >= LEAST_DOCUMENTS), np.minimum(most / CERTAIN, 1) ** 3, 0)


def only(place: np.ndarray, feature: np.ndarray, owner: np.ndarray):
    found = place[feature]
    return found[found >= 0], owner[found >= 0]


def softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(parts, labels: np.ndarray, k: int, rounds: int = 30, steps: int = 1000):
    """(place, weights, bias): softmax regression by Adagrad over blocks of documents (feature, owner, shape), in so many
    rounds and steps at least."""
    scale = scales(parts, labels, k)
    place = np.full(FEATURES, -1, np.int32)
    chosen = np.flatnonzero(scale)
    place[chosen] = np.arange(len(chosen))
    scale = scale[chosen][:, None]
    parts = [(*only(place, feature, owner), shape) for feature, owner, shape in parts]
    weights, bias = np.zeros((len(chosen), k)), np.zeros((SHAPE, k))
    seen_w, seen_b = np.full(weights.shape, 1e-6), np.full((SHAPE, k), 1e-6)
    for _ in range(max(rounds, -(-steps // len(parts)))):
        at = 0
        for feature, owner, shape in parts:
            y = labels[at : at + len(shape)]
            at += len(shape)
            used, nth = np.unique(feature, return_inverse=True)
            error = softmax(logits(weights[used] * scale[used], bias, nth, owner, shape))
            error[np.arange(len(y)), y] -= 1
            g = np.stack([np.bincount(nth, error[owner, j], minlength=len(used)) for j in range(k)], axis=1) * scale[used] / len(y) + 1e-5 * weights[used]
            seen_w[used] += g * g
            weights[used] -= 0.3 * g / np.sqrt(seen_w[used])
            g = shape.T @ error / len(y)
            seen_b += g * g
            bias -= 0.1 * g / np.sqrt(seen_b)
    return place, weights * scale, bias


def train(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int, id_col: str, text_col: str):
    """(place, weights, bias) fitted on at most `sample` labelled texts of `sample_bytes` together."""
    known = labels.selectExpr("doc_id id", "CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 0 END y").where("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = c.columns(docs, id=id_col, text=text_col).join(F.broadcast(known), "id")  # `sample` small rows
    rows = c.materialise(rows.groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")
    within = rows.select("id", F.octet_length("text").alias("text_bytes"))
    within = within.withColumn("run", F.sum(F.coalesce("text_bytes", F.lit(0))).over(W.orderBy(F.xxhash64("id"), "id"))).where(F.col("run") <= sample_bytes)  # over `sample` numbers
    rows = rows.join(F.broadcast(within.select("id")), "id").toArrow().sort_by("id")
    parts, ys = [], []
    for at in range(0, rows.num_rows, 128):
        part = rows.slice(at, 128).combine_chunks()
        text, offsets = c.texts_of(part.column("text").combine_chunks())
        feature, owner, _, shape = features(text, offsets)
        parts.append((feature, owner, shape))
        ys.append(part.column("y").to_numpy())
    if not parts:
        return np.full(FEATURES, -1, np.int32), np.zeros((0, len(DOMAINS))), np.zeros((SHAPE, len(DOMAINS)))
    return fit(parts, np.concatenate(ys), len(DOMAINS))


def rates_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after projected gradient steps, replayed from rate one; a step is the scaled residual of each domain."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(rate - p @ step - STAY * (rate - 1), 0)
    return rate


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = 20_000, sample_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_totals: dict[str, float] | None = None) -> DataFrame:
    """(row: struct<id, carried: struct of the carried columns>, n_tokens long, p_<domain>, rate, residual double), one per
    input row; residual: the largest share of tokens by which the rates miss a target, so that a missed one shows.

    targets: shares of the token total by domain; keep_totals: instead, factors by a document's likeliest domain, and
    the targets are the domains' expected totals of documents so weighted (rates that meet them exist therefore: the
    factors themselves; targets of zero for a soft domain have none, for every document has a little of each).
    """
    spark = docs.sparkSession
    c.prepare(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, sample, sample_bytes, id_col, text_col))  # FEATURES places and as many weights at most
    row = c.carried_row(docs, id_col, carry)
    df = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), row.alias("row"))

    def predict(batches):
        place, weights, bias = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                feature, owner, words, shape = features(*c.texts_of(part.column("text")))
                p = softmax(logits(weights, bias, *only(place, feature, owner), shape))
                yield pa.record_batch([part.column("row"), pa.array(words, pa.int64()), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1]))], ["row", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    kind = df.schema["row"].dataType.simpleString()
    known = c.materialise(df.mapInArrow(predict, f"row {kind}, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)), "posteriors")
    factor = F.lit(1.0)
    for d in DOMAINS if keep_totals else ():
        factor = F.when(F.col(f"p_{d}") == F.greatest(*(f"p_{x}" for x in DOMAINS)), float(keep_totals[d])).otherwise(factor)
    wanted = known.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col(f"p_{d}") * factor) for d in DOMAINS)).first()
    total = max(float(wanted[0] or 0), 1.0)
    goal = np.array([float(x or 0) for x in wanted[1:]]) / total if keep_totals else np.array([(targets or TARGETS)[d] for d in DOMAINS])
    slim = known.select("n_tokens", *(f"p_{d}" for d in DOMAINS))

    def arrays(batch):
        return batch.column("n_tokens").to_numpy(), np.stack([batch.column(f"p_{d}").to_numpy() for d in DOMAINS], axis=1)

    def sums(batches, steps):
        out = np.zeros((len(DOMAINS) + 1, len(DOMAINS)))
        for batch in batches:
            n, p = arrays(batch)
            weight = n * rates_of(p, steps)
            out[0] += weight @ p
            out[1:] += (p * (weight > 0)[:, None] * n[:, None]).T @ p
        yield pa.record_batch([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["i", "value"])

    # gradient scaled by the inverse Gram matrix of the documents that are not held at zero
    steps: list[np.ndarray] = []
    best, chosen = np.inf, 0
    for _ in range(STEPS):
        got = np.zeros((len(DOMAINS) + 1) * len(DOMAINS))
        for i, value in slim.mapInArrow(functools.partial(sums, steps=list(steps)), "i long, value double").groupBy("i").agg(F.sum("value")).collect():  # K (K + 1) numbers
            got[i] = value / total
        got = got.reshape(-1, len(DOMAINS))
        off = got[0] - goal
        if np.abs(off).max() < best:
            best, chosen = np.abs(off).max(), len(steps)
        if np.abs(off).max() < 1e-4 or len(steps) > chosen + 5:
            break
        steps.append(np.linalg.solve(got[1:] + STAY * np.eye(len(DOMAINS)), off))
    steps = steps[:chosen]

    def rated(batches):
        for batch in batches:
            n, p = arrays(batch)
            rate = rates_of(p, steps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(n > 0, rate, 1.0))], [*batch.schema.names, "rate"])

    return known.mapInArrow(rated, f"row {kind}, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double").withColumn("residual", F.lit(float(best)))
