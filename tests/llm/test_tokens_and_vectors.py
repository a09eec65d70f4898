"""Token counts against the library, clusters and codes against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.llm import delta_lloyd, token_counts, vector_codes
from candlewright.llm import queries as registered

from oracle import compare

SF = "/root/testdata/sf0.01"
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tok = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return token_counts.vocabulary_of(f.read())


ODD = [
    "'ll", "'l", "'s", "'re", "''s", "é", "é", "İ", "Σ", "ΑΣ", "ß", "ÅÅ", "Å", "한", "한", "が",
    "x̣̂", "the", "ing", " ", "  ", "\n", " ", " ", "1", "23", "½", "²", "!", "!!", "'", "Don'T", "WE'VE", "<|endoftext|>", "<|startoftext|>", "<|endo", "\U0001f600",
    "中文字", "the" * 30, "aaaa" * 40, "'sabc", "\x00", "\x85", "_", "ǅ", "ﬁ", "́", "internationalization", "\U0001d400", "क़",
]


def test_every_prefix_counts_as_the_library_counts_it(vocabulary, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 10))) for _ in range(400)]
    for text, counts in zip(texts, token_counts.Counter(vocabulary).prefixes(texts)):
        assert len(counts) == len(text)
        assert [library(text[:i]) for i in range(1, len(text) + 1)] == counts.tolist(), text
        assert (token_counts.unpacked(token_counts.packed(counts)) == counts).all()


def test_long_words_and_chunks(vocabulary, library, monkeypatch):
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghé中") for _ in range(3000))
    text = " ".join("".join(rng.choice("etaoin'1!") for _ in range(rng.randint(1, 9))) for _ in range(2000))
    monkeypatch.setattr(token_counts, "CHUNK", 500)
    monkeypatch.setattr(token_counts, "KNOWN", 50)
    counter = token_counts.Counter(vocabulary)
    for x in (word, "".join("éx" for _ in range(200)), text, word + " " + text):
        counts = counter.prefixes([x])[0]
        for i in [*rng.sample(range(1, len(x)), 30), len(x)]:
            assert counts[i - 1] == library(x[:i])


def test_words_that_share_a_hash_are_told_apart(vocabulary, library, monkeypatch):
    monkeypatch.setattr(token_counts, "_CODE", np.ones(256, np.uint64))  # words of one length share a hash
    counter = token_counts.Counter(vocabulary)
    calls = []
    monkeypatch.setattr(counter, "learn", lambda *a, f=counter.learn: (calls.append(1), f(*a)))
    counter.prefixes(["one two six one"])
    assert len(calls) == 3 and counter.data.tobytes() == b"onetwosix"


def test_token_query_is_whole(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    found = registered.op11_token_counts(spark, SF).toPandas().set_index("doc_id")
    assert len(found) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text.fillna("")):
        row = found.loc[doc_id]
        assert row.n_tokens == library(text) and row.n_bytes == len(text.encode()) and row.over_limit == (row.n_tokens > 2048)
        if row.over_limit:
            assert library(text[: row.fits_2048]) <= 2048 and row.fits_2048 < len(text)
        else:
            assert row.fits_2048 == len(text) == row.n_chars


def test_token_rows(spark, library):
    rows = [(1, None, 9), (None, "a b", 9), (2, "", 9), (3, "The cat's <|endoftext|>", 9), (3, "The cat's <|endoftext|>", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    stored = token_counts.prefix_counts(docs, PATH)
    found = token_counts.totals(stored, limits=(1, 3))
    assert sorted(map(tuple, found.select("id", "n_bytes", "n_tokens", "fits_1", "fits_3").collect()), key=repr) == sorted([(1, 0, 0, 0, 0), (None, 3, 2, 2, 3), (2, 0, 0, 0, 0), (3, 23, 4, 4, 10), (3, 23, 4, 4, 10)], key=repr)
    assert {r.tokens_5 for r in token_counts.tokens_at(stored, 0, 5).where("id = 3").collect()} == {2}
    whole = token_counts.truncated(docs, PATH, 3)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted([(1, None, 9), (None, "a b", 9), (2, "", 9), (3, "The cat's ", 9), (3, "The cat's ", 9)], key=repr)
    assert token_counts.totals(token_counts.prefix_counts(docs.limit(0), PATH), (5,)).count() == 0
    with pytest.raises(ValueError):
        token_counts.Vocabulary('{"model": {}, "pre_tokenizer": {}}')


def vectors_of(spark):
    """Given vectors, and rows that do not count."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = [float(x) for x in range(64)]
    nan, null, inf = v[:-1] + [float("nan")], v[:-1] + [None], v[:-1] + [float("-inf")]
    odd = [(-1, None, 1), (-2, nan, 1), (-3, null, 1), (-4, inf, 1), (-5, v[:63], 1), (-6, [], 1), (None, v, None), (7, v, None)]
    return df.unionByName(spark.createDataFrame(odd, df.schema)).withColumn("id", F.lit(1)).withColumn("cluster", F.lit("x"))


def plain(df):
    pdf = df.toPandas()
    keep = [v is not None and len(v) == 64 and all(x is not None for x in v) and bool(np.isfinite(np.asarray(v, float)).all()) for v in pdf.embedding]
    pdf = pdf[keep].reset_index(drop=True)
    return pdf, np.floor(np.stack([np.asarray(v, float) for v in pdf.embedding]) * 256).astype(np.int64)


def near(v, centres):
    d = ((v[:, None, :] - centres[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def means(v, owner, old):
    return np.array([v[owner == k].sum(0) // (owner == k).sum() if (owner == k).any() else old[k] for k in range(len(old))])


def key(i):
    return None if i is None or i != i else int(i)


def test_delta_lloyd_equals_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(delta_lloyd, "BLOCK", 37)
    df = vectors_of(spark)
    pdf, v = plain(df)
    ids = [key(i) for i in pdf.vec_id]
    hashes = [hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "z" for i in ids]
    centres = v[sorted(range(len(ids)), key=lambda i: (hashes[i], list(pdf.embedding[i])))[:40]]
    for _ in range(5):
        centres = means(v, near(v, centres)[0], centres)
    owner, d = near(v, centres)
    want = [(ids[i], int(k), int(d[i]), int(d[owner == k].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k in enumerate(owner)]
    found = delta_lloyd.cluster(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_reassignment_compares_what_changed():
    rng = np.random.default_rng(1)
    v, centres = rng.integers(-50, 50, (500, 8)), rng.integers(-50, 50, (12, 8))
    owner, d = delta_lloyd.reassign(v, np.full(500, -1), np.zeros(500, np.int64), centres, np.ones(12, bool))
    after = centres.copy()
    after[[2, 5]] = centres[[5, 2]] + 1
    after[7] = after[3]  # ties
    changed = (after != centres).any(axis=1)
    got = delta_lloyd.reassign(v, owner, d, after, changed)
    assert [x.tolist() for x in got] == [x.tolist() for x in near(v, after)]
    moves = delta_lloyd.transfers(v, owner, got[0])
    for k in range(12):
        n = sum(x["n"] for x in moves if x["cluster"] == k)
        assert n == (got[0] == k).sum() - (owner == k).sum()
        s = np.sum([x["s"] for x in moves if x["cluster"] == k] or [np.zeros(8, int)], axis=0)
        assert (s == v[got[0] == k].sum(0) - v[owner == k].sum(0)).all()


def test_codes_equal_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BATCH", 50)
    df = vectors_of(spark)
    pdf, v = plain(df)
    ids = [key(i) for i in pdf.vec_id]
    first = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (ids[i], list(pdf.embedding[i])))[:64]
    books, code, error = [], [""] * len(v), np.zeros(len(v), np.int64)
    for p in range(16):
        part = v[:, 4 * p : 4 * p + 4]
        book = part[first]
        for _ in range(2):
            book = means(part, near(part, book)[0], book)
        index, d = near(part, book)
        books.append(book)
        error += d
        code = [x + f"{i:02x}" for x, i in zip(code, index)]
    label = [key(x) for x in pdf.label]
    by_label = {k: int(error[[x == k for x in label]].sum()) for k in set(label)}
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = [(ids[i], code[i], int(error[i]), by_label[label[i]], sha) for i in range(len(v))]
    found = vector_codes.compress(df)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    books = np.array(books)
    one = vector_codes.decode(found.where("id = 9"), books).first()
    whole = np.concatenate([books[p][int(one.code[2 * p : 2 * p + 2], 16)] for p in range(16)])
    assert one.decoded == (whole / 256).tolist()


def test_empty_and_few_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    for f in (delta_lloyd.cluster, vector_codes.compress):
        assert f(df.limit(0)).count() == 0
        assert f(df.where("vec_id < 3")).count() == 3
    huge = spark.createDataFrame([(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0), (3, [0.0] * 64, 0)], df.schema)
    assert {r.distance for r in delta_lloyd.cluster(huge).collect()} == {0}
    assert {r.error for r in vector_codes.compress(huge).collect()} == {0}


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_minhash_dedup", "op5_warc", "op12_delta_lloyd", "op13_vector_codes"])
def test_query_matches_its_sql(spark, name):
    compare(spark, SF, registered.queries()[name], registered.oracle_sql()[name])
