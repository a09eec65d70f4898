"""Each stage against a plain version on its own input, and the defined results of odd rows."""

import numpy as np
import pytest

import corpus_pipeline
from candlewright.llm import _common as c
from candlewright.llm import mixing, quality
from test_operators import brute_components, brute_spans, check_bins, word_sets

SF = "/root/testdata/sf0.001"


def stored(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows of documents, and of what each stage made of them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(spark, stage(spark, docs, SF), tmp_path_factory.mktemp("stages") / name)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[1:-1])


def test_quality_rules(kept):
    expected = {r[0] for r in quality.passing(quality.ledger(kept[0]), "web-1").select("row.doc_id").collect()}
    assert set(texts(kept[1])) == expected and 0 < len(expected) < kept[0].count()


def test_near_duplicates(kept):
    least = brute_components(word_sets(texts(kept[1]).items()), 80, 100)
    assert set(texts(kept[2])) == {i for i, j in least.items() if i == j} and kept[2].count() < kept[1].count()


def test_repeated_passages(kept):
    before, after = texts(kept[2]), texts(kept[3])
    marks = brute_spans(sorted(before.items()), 100)
    assert after == {i: bytes(x for x, m in zip(t.encode(), marks[i]) if not m).decode(errors="ignore") for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in kept[3].collect()) and after != before


def test_mixing(kept, spark):
    rows = mixing.mix(kept[3], spark.read.parquet(f"{SF}/labels.parquet"), keep_totals=corpus_pipeline.WEIGHTS).toPandas()
    p, n = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), rows.n_tokens.to_numpy()
    factor = np.array([corpus_pipeline.WEIGHTS[d] for d in mixing.DOMAINS])[p.argmax(axis=1)]
    assert (n * rows.rate) @ p == pytest.approx((n * factor) @ p, abs=2e-4 * n.sum())  # expected totals match the targets
    copies = {r["id"]: int(np.floor(x + 0.5)) for r, x in zip(rows.row, rows.rate)}
    got = {}
    for r in kept[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: k for i, k in copies.items() if k}


def test_packing(kept):
    rows = kept[5].collect()
    check_bins(rows)
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: len(t.split()) for i, t in texts(kept[4]).items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rate double, id string, row string, component long"


def test_stages_with_odd_rows(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, " \n "), (4, good), (5, good), (5, good), (None, good), (None, None), (7, "é\x00" * 400), (8, good + " " + "longer text " * 30)]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None, "x", "y", None) for i, t in rows], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stored(spark, stage(spark, docs, SF), tmp_path / f"odd{k}")  # each on the odd rows themselves
        if k < 4:
            assert got.schema == docs.schema
        if k == 2:
            assert got.count() == len(rows) and got.where("text IS NULL").count() == 2
        if k == 4:
            assert {r.doc_id for r in got.collect()} == {i for i, _ in rows}
        assert stored(spark, stage(spark, docs.limit(0), SF), tmp_path / f"none{k}").count() == 0


def test_near_duplicates_of_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None), (2, ""), (4, good), (5, good), (5, good), (None, good), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [(False, 1, True), (False, 2, False), (False, 4, False), (True, 0, False), (True, 0, True)]


def test_a_stage_leaves_the_tables_of_other_operators(spark):
    from candlewright.llm import minhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = minhash.near_components(docs)
    corpus_pipeline.quality_rules(spark, docs, SF)
    assert found.count() == docs.count()
    with c.tables(spark):
        inner = minhash.near_components(docs.limit(20))
        assert inner.count() == 20
    assert found.count() == docs.count()
