"""Operators against brute force on a small table, and the defined results of odd rows."""

import collections
import hashlib
import html
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from candlewright.llm import _common as c
from candlewright.llm import chat, fingerprints, html_extract, minhash, mixing, packing, pitman_yor, queries, quality, suffix_dedup, warc

from oracle import compare

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 40
SCHEMA = "doc_id long, text string, kept boolean, bucket int, component string"
ODD = [(1, None, True, 0, "x"), (2, "", None, 1, None), (3, " \n\t ", None, None, "y"), (4, "one two", None, None, None), (5, LONG, None, None, None), (6, LONG, None, None, None), (6, LONG, None, None, None), (None, LONG + "end", None, None, None), (8, "a\x00b é\n" * 300, None, None, None)]


def table(name, *columns):
    rows = pq.read_table(f"{SF}/{name}.parquet")
    return sorted(zip(*(rows.column(x).to_pylist() for x in columns)))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_spans(docs, length):
    seen, out = {}, {}
    for i, text in docs:
        b = (text or "").encode()
        mark = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if seen.setdefault(w, (i, j)) != (i, j):
                mark[j : j + length] = b"\1" * length
        out[i] = mark
    return out


def test_suffix_dedup(spark):
    got = {r.doc_id: r for r in queries.op1_suffix_dedup(spark, SF).collect()}
    docs = table("documents", "doc_id", "text")
    marks = brute_spans(docs, 100)
    for i, text in docs:
        b = text.encode()
        kept = bytes(x for x, m in zip(b, marks[i]) if not m)
        runs = len(re.findall(b"\1+", bytes(marks[i])))
        assert tuple(got[i])[1:] == (len(b), sum(marks[i]), runs, hashlib.sha256(kept).hexdigest())


def test_transform_classes():
    import numpy as np

    rng = np.random.default_rng(3)
    text = rng.integers(1, 3, 400).astype(np.uint16)
    order, group = suffix_dedup.transform_classes(text, 5)
    keys = [tuple(text[s : s + 5]) for s in order if s + 5 <= len(text)]
    full = [g for s, g in zip(order, group) if s + 5 <= len(text)]
    assert all((a == b) == (g == h) for a, b, g, h in zip(keys, keys[1:], full, full[1:]))


def test_suffix_dedup_with_hot_minimizers_and_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(c, "MOST", 2)
    monkeypatch.setattr(c, "FLUSH_BYTES", 1 << 14)
    rng = np.random.default_rng(5)
    shared = "The same beginning of very many different lines, "
    docs = [(i, "".join(shared + "".join(rng.choice(list("ab"), 60)) + "\n" for _ in range(8)) + (LONG if i % 3 else "")) for i in range(40)]
    got = {r.row.id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), length=40).collect()}
    marks = brute_spans(docs, 40)
    for i, text in docs:
        assert got[i] == (sum(marks[i]), len(re.findall(b"\1+", bytes(marks[i]))), bytes(x for x, m in zip(text.encode(), marks[i]) if not m))


def test_suffix_dedup_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)  # windows at once
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 3000)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    docs = [(1, " ".join(rng.choice(words, 1500))), (2, ""), (3, " ".join(rng.choice(words, 4000)) * 2), (4, "x" * 9000)]
    docs.append((5, docs[0][1][2000:6000] + docs[2][1][-7000:]))
    got = {r.row.id: (r.n_removed, r.n_spans) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), length=100).collect()}
    marks = brute_spans(docs, 100)
    assert got == {i: (sum(m), len(re.findall(b"\1+", bytes(m)))) for i, m in marks.items()} and got[3][0] > 0 and got[4][0] == 8999


def test_suffix_dedup_odd(odd, none):
    rows = suffix_dedup.dedup_substrings(odd, length=100).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.row.id].append((r.n_bytes, r.n_removed))
    n = len(LONG)
    assert by[1] == by[2] == [(0, 0)] and by[4] == [(7, 0)]
    assert by[None][0][1] > 0 and by[5] == [(n, n)] and by[6] == [(n, n)] * 2
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_minhash(spark):
    docs = table("documents", "doc_id", "text")
    sets = {}
    for i, text in docs:
        w = text.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    assert {tuple(r) for r in queries.op2_minhash_dedup(spark, SF).collect()} == {(i, len(s), low[i], low[i] == i) for i, s in sets.items()}


def test_minhash_odd(odd, none):
    rows = sorted((tuple(r) for r in minhash.near_components(odd).collect()), key=str)
    assert len(rows) == len(ODD)
    assert (1, 0, 1, True) in rows and (3, 0, 3, True) in rows and (4, 1, 4, True) in rows
    assert rows.count((6, 5, 5, False)) == 2 and (5, 5, 5, True) in rows
    assert minhash.near_components(none).count() == 0


def brute_components(sets, num, den):
    """Least reachable document of each, links by comparing all pairs that share a shingle."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, own in sets.items():
        shared = collections.Counter(j for x in own for j in where[x])
        for j, n in shared.items():
            if den * n >= num * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in own:
            where[x].append(i)
    return {i: find(i) for i in sets}


def word_sets(rows, k=5):
    out = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def near_rows():
    """A chain whose ends have little in common, near copies of one text and of no other, and loners."""
    stream = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(stream[6 * i : 6 * i + 100])) for i in range(30)]
    base = [f"w{i}" for i in range(120)]
    rows += [(100 + i, " ".join([*base[: 3 * i], f"x{i}", *base[3 * i + 1 :]])) for i in range(30)]
    rows += [(200 + i, " ".join(f"u{i}_{j}" for j in range(60))) for i in range(5)] + [(300 + i, " ".join(base)) for i in range(3)]
    return rows


@pytest.mark.parametrize("small", (False, True))
def test_minhash_chains_and_large_groups(spark, monkeypatch, small):
    if small:  # bins of a few documents, one pair of a document first, several buckets to a partition
        for name, value in (("BIN", 3), ("BINS", 4), ("NEAREST", 1)):
            monkeypatch.setattr(minhash, name, value)
        monkeypatch.setattr(c, "MOST", 2)
    rows = near_rows()
    got = {r.id: r.component for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_components(word_sets(rows), 80, 100)
    assert len(set(got.values())) == 7


def test_minhash_estimate():
    plan = minhash.Plan(0.85)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        kept = int(2000 * 2 * share / (1 + share))
        two = np.concatenate([x[:kept], rng.integers(0, 1 << 63, 2000 - kept).astype(np.uint64)])
        _, low = minhash.signatures(np.concatenate([np.sort(x), np.sort(two)]), np.array([0, 2000]), plan)
        assert plan.similarity(low[0], low[1:])[0] == pytest.approx(share, abs=0.1)


def test_equal_digests_of_different_sets_stay_apart():
    x = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.uint64)
    keep, copy, of = minhash.equal_sets(np.array([7, 8, 9]), np.zeros((3, 2), np.uint64), x, np.array([0, 3, 6]), np.array([3, 3, 3]))
    assert keep.tolist() == [0, 1] and copy.tolist() == [9] and of.tolist() == [7]


def piece_set(text):
    raw = text.encode()
    return set(fingerprints.digests(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    docs = table("documents", "doc_id", "text")
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, SF).collect()}
    for (i, a), (_, b) in zip(docs, docs[1:] + docs[:1]):
        edited = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        r, own = got[i], piece_set(a)
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(own, piece_set(edited))) and r.near_next == pytest.approx(jaccard(own, piece_set(b)))
        assert set(fingerprints.listed(r.fingerprint).tolist()) == own  # a fingerprint can be taken apart
        assert fingerprints.likeness_of(r.fingerprint, r.edited_fingerprint) == pytest.approx(r.near_edited)
    assert sum(r.near_edited for r in got.values()) > 0.5 * len(docs) and sum(r.near_next for r in got.values()) < 0.1 * len(docs)


def test_pieces_are_paragraphs():
    text = "one two three\nfour five\n\n one two three \nfour five"
    assert len(piece_set(text)) >= 4 and piece_set("four five\none two three") <= piece_set(text)  # a repeated line has its number
    assert not piece_set("\n \n") and len(piece_set(" ".join(f"w{i}" for i in range(800)))) > 50


def test_digests_that_share_their_bits_stay_apart(monkeypatch):
    real_seal = fingerprints.sealed
    monkeypatch.setattr(fingerprints, "sealed", lambda h: real_seal((h >> np.uint64(56)) << np.uint64(56)))  # of eight bits
    raw = "\n".join(f"line {i}" for i in range(60)).encode()
    key, owner = fingerprints.digests(np.frombuffer(raw * 2, np.uint8), np.array([0, len(raw), 2 * len(raw)]))
    assert len(np.unique(key[owner == 0])) == (owner == 0).sum() == 60 and key[owner == 0].tolist() == key[owner == 1].tolist()


def test_fingerprint_likeness_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 1, 30, 3000)]
    sets += [np.concatenate([s[: len(s) // 2], s[len(s) // 2 :] + np.uint64(1 << 62)]) for s in sets]
    sets = [np.unique(fingerprints.sealed(s)) for s in sets]
    marks = fingerprints.written(np.concatenate(sets), np.array([len(s) for s in sets]))
    for i, j in [*((i, i + 4) for i in range(4)), (0, 3), (1, 3), (2, 3), (3, 3)]:
        assert fingerprints.likeness_of(marks[i], marks[j]) == pytest.approx(jaccard(set(sets[i].tolist()), set(sets[j].tolist())))


def test_fingerprint_likeness_does_not_jump_with_length():
    rng = np.random.default_rng(2)
    for n in range(28, 37):
        near = []
        for _ in range(200):
            text = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            sets = [piece_set(" ".join(t)) for t in (text, text + ["more"], text[:-1])]
            near.append([jaccard(sets[0], sets[1]), jaccard(sets[0], sets[2])])
        assert (np.mean(near, axis=0) > 0.55).all(), n  # of four or five pieces one differs


def test_fingerprints_odd(odd, none, spark):
    rows = fingerprints.fingerprint_successors(odd).collect()
    assert len(rows) == len(ODD) and len({r.fingerprint for r in rows if r.id in (5, 6)}) == 1
    assert fingerprints.fingerprint_successors(none).count() == 0
    alone = fingerprints.fingerprint_successors(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def test_quality(spark):
    compare(spark, SF, queries.op4_quality_ledger, queries.OP4_SQL)


def test_quality_odd(odd, none):
    rows = quality.ledger(odd)
    assert rows.count() == len(ODD) and quality.ledger(none).count() == 0
    got = {r.row.doc_id: r for r in rows.collect()}
    assert got[1].n_words == got[3].n_words == 0 and got[5].n_repeat_words == 200
    found = {r.rule: (r.failing, r.only_rule) for r in quality.ablations(rows, "base-1").collect()}
    assert found["repeated_words"][0] == 5 and found["repeated_words"][1] == 5


def test_warc(spark):
    got = {r.page_id: tuple(r)[1:5] for r in queries.op5_warc(spark, SF).collect()}
    first = {}
    for i, text in table("pages", "page_id", "html"):
        b = text.encode()
        digest = hashlib.sha256(b).hexdigest()
        known = len(b) >= 100 and digest in first
        assert got[i] == (len(b), digest, "revisit" if known else "response", first[digest] if known else None)
        first.setdefault(digest, i)


@pytest.mark.parametrize("version", (1, 2))
def test_arc_round_trip(version):
    records = [("http://a/ b", "1.2.3.4", "20010203040506", "text/html", b"x\n\nfiledesc://"), ("http://b", "1.2.3.4", "20010203040507", "text/plain", b"")]
    got = list(warc.read_arc(warc.write_arc(records, version)))
    assert [r[1:] for r in got] == [r[1:] for r in records] and got[0][0] == "http://a/%20b"
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.write_arc(records[:1], version)[:-5]))


def test_warc_odd(spark, tmp_path):
    page = "<p>é WARC/1.1\r\n\r\n" + "x" * 200
    rows = [(3, "u", page, 1), (1, "u", page, 1), (2, None, None, 1), (None, "u", "short", 1), (4, "u", "short", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write_archives(warc.convert(warc.to_arc(df)), str(tmp_path / "w"), 2)
    got = {r.key: (r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got[1][:2] == ("response", None) and bytes(got[1][3]) == page.encode() and got[3][:3] == ("revisit", 1, len(page.encode()))
    assert got[2][:3] == ("response", None, 0) and got[None][0] == got[4][0] == "response"
    empty = spark.createDataFrame([], df.schema)
    warc.write_archives(warc.convert(warc.to_arc(empty)), str(tmp_path / "e"), 1)
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_messy_arc_headers():
    body = b"1 0 Somebody\nURL IP-address Archive-date Content-type Archive-length\n"
    intro = b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain %d\n%s\n" % (len(body), body)
    lines = [b"http://a/ b\xff 1.2.3.4 199701010000 text/html; charset=utf-8 3\nabc\n", b"http://c - 1997 no-type 0\n\n", b"dns:x ::1 19970101000000 text/dns 2\r\nxy\n\n\n"]
    got = list(warc.read_arc(intro + b"".join(lines)))
    assert [r[:4] for r in got] == [("http://a/%20b%FF", "1.2.3.4", "199701010000", "text/html; charset=utf-8"), ("http://c", "-", "1997", "no-type"), ("dns:x", "::1", "19970101000000", "text/dns")]
    assert [r[4] for r in got] == [b"abc", b"", b"xy"]
    assert [warc.iso_date(x) for x in ("199701010000", "1997", "19979901000000")] == ["1997-01-01T00:00:00Z"] * 3
    with pytest.raises(ValueError):
        list(warc.read_arc(intro + b"http://a 1.2.3.4 no date 3\nabc\n"))


def test_archives_are_members_with_standard_headers(spark, tmp_path):
    import gzip
    import zlib
    from pathlib import Path

    page = "<p>" + "x" * 200
    rows = [(3, "http://c", page), (1, "http://a", page), (1, "http://a", page), (None, "http://n", "y" * 300), (None, "http://n", "y" * 300), (2, "http://b", "z" * (17 << 20))]
    path = str(tmp_path / "w")
    warc.write_archives(warc.convert(warc.to_arc(spark.createDataFrame(rows, "page_id long, url string, html string"))), path)
    records = []
    for file in Path(path).glob("part-*"):
        data = file.read_bytes()
        records += list(warc.read_warc([gzip.decompress(data)]))  # any gzip reader takes it
        one = zlib.decompressobj(31)
        assert next(iter(warc.read_warc([one.decompress(data)])))[0]["WARC-Type"] == "warcinfo" and one.eof  # a member a record
    by_name = {h["WARC-Record-ID"]: h for h, _ in records if h["WARC-Type"] == "response"}
    again = [h for h, _ in records if h["WARC-Type"] == "revisit"]
    assert len(by_name) == 3 and sorted(h["X-Key"] for h in again) == ["", "1", "3"]
    for h in again:
        first = by_name[h["WARC-Refers-To"]]
        assert (first["WARC-Target-URI"], first["WARC-Date"], first["WARC-Payload-Digest"]) == (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"], h["WARC-Payload-Digest"])
    got = {(r.key, r.record_type): r.payload_bytes for r in warc.read_archives(spark, path).collect()}
    assert got[2, "response"] == 17 << 20 and got[None, "response"] == 300


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    import os

    rng = np.random.default_rng(1)
    rows = [(i, f"http://h/{i}", bytes(rng.integers(97, 123, 2000 if i != 20 else 30_000, dtype=np.uint8)).decode()) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.convert(warc.to_arc(df)), path, most_bytes=10_000)
    sizes = sorted(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "w") for f in names if f.startswith("part-"))
    assert len(sizes) > 6 and sizes[-2] <= 10_500 and sizes[-1] > 15_000
    assert {r.key: r.payload_bytes for r in warc.read_archives(spark, path).collect()} == {i: len(x) for i, _, x in rows}


def test_html(spark):
    got = {r.page_id: r.text for r in queries.op6_html_extract(spark, SF).collect()}
    for i, page in table("pages", "page_id", "html"):
        body = re.sub(r"<br>", " ", re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[i] == "\n\n".join(b for b in blocks if b)


def test_html_layouts(spark):
    page = '<html><body><header><h1>Site</h1></header><ul class="menu"><li>Home</ul><div id="wrap"><div class="text"><h2>T{0}</h2><p>One &amp; two{0} <b>b</b><p>Three{0}</div><div class="comments"><p>nice</div></div><form><p>mail</form><script>x</script></body>'
    rows = [(i, "http://h/x", page.format(i)) for i in range(6)] + [(9, None, None), (None, "http://h/y", "")]
    got = {r.key: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3\n\nOne & two3 b\n\nThree3" and got[9] == got[None] == ""


def test_html_copies_are_not_boilerplate(spark):
    page = '<html><head><title>S</title></head><body><p>Site notice</p><div><h2>T{0}</h2><p>One{0} and more words</p>{1}</div></body></html>'
    copy = page.format("c", "<blockquote>Only here</blockquote>")
    rows = [(i, "http://a/x", copy) for i in range(7)] + [(10 + i, "http://a/y", page.format(i, "")) for i in range(7)]
    rows += [(20 + i, "http://b/x", "<html><head><title>S</title></head><body><h2>Head</h2><p>One paragraph</p></body></html>") for i in range(7)]
    got = {r.key: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[6] == "Tc\n\nOnec and more words\n\nOnly here"
    assert got[12] == "T2\n\nOne2 and more words" and got[20] == got[26] == "Head\n\nOne paragraph"


def extracted(spark, pages, host="h"):
    rows = [(i, f"http://{host}/x", p) for i, p in enumerate(pages)]
    return [r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("key").collect()]


def test_html_words_of_classes(spark):
    kept = ['<p class="social-science">a</p>', '<div class="share-price">b</div>', '<p class="ad-hoc">c</p>', '<h2 id="related-work">d</h2>', '<section id="discussion"><p>e</p></section>', '<div class="no-sidebar"><p>f</p></div>']
    gone = ['<div class="share">x</div>', '<div class="comments-area"><p>x</p></div>', '<ul class="related-posts"><li>x</ul>', '<section id="comments">x</section>', '<p hidden>x</p>', '<div class="ad">x</div>', '<div id="sidebar">x</div>', '<div role="navigation">x</div>']
    body = "".join(x for pair in zip(kept, gone) for x in pair) + "".join(gone[len(kept) :])
    assert extracted(spark, [f"<article><p>first</p>{body}</article>"]) == ["first\n\na\n\nb\n\nc\n\nd\n\ne\n\nf"]


def test_html_marks_inside_an_article_need_the_wrapper(spark):
    words = ("notice", "alert", "discussion", "related", "search", "tags", "menu", "promo", "social", "share", "widget", "reply", "banner")
    pages = ["<article><p>first</p>" + "".join(f'<p class="{w}">{w} {i}</p>' for w in words) + f'<div class="share">Share this</div><div class="related"><a href="#">See {i}</a></div><div class="alert"><p>Alert {i}</p></div><p class="ad">Buy {i}</p></article>' for i in range(6)]
    for i, text in enumerate(extracted(spark, pages)):
        assert text.split("\n\n") == ["first", *(f"{w} {i}" for w in words), f"Alert {i}"]


def test_html_a_class_must_hold_most_of_the_text(spark):
    pages = [f'<div class="content"><p>teaser {i}</p></div><div class="text"><p>the long article number {i} goes on</p><p>and on {i}</p></div>' for i in range(6)]
    assert extracted(spark, pages) == [f"the long article number {i} goes on\n\nand on {i}" for i in range(6)]
    pages = [f'<div class="x"><p>teaser {i}</p></div><div class="content"><p>the long article number {i} goes on</p></div>' for i in range(6)]
    assert extracted(spark, pages) == [f"the long article number {i} goes on" for i in range(6)]


def test_html_tags_that_never_close():
    import time

    began = time.time()
    for start in ('<a "', '<a "x"', '<a ">" ', "<a '>", '<a <b "', "<!x", "<a", "<?"):
        assert sum(1 for _ in html_extract.tokens(start * (1_000_000 // len(start)))) >= 1
    assert time.time() - began < 10
    assert [t for t, _ in html_extract.tokens("a<p class='>'>b</p><!-- <i> -->c<script>x<y</script>d<a 'e>f")] == ["a", "<p class='>'>", "b", "</p>", "c", "d", "<a 'e>", "f"]


def test_html_wrapper_decides_without_marks(spark):
    """Constant slots, optional notices and repeated groups of links go, whatever their classes say."""
    menu = lambda i: "".join(f'<li><a href="/{i}{j}">Topic {i * j}</a>' for j in range(4))
    pages = [f"<body><div class='top'><h3>My site</h3></div><ul class='x'>{menu(i)}</ul>" + ("<div class='y'><p>We moved on Monday</p></div>" if i % 2 else "") + f"<div class='z'><h2>Title {i}</h2><p>Long text number {i} about many things</p><p>{'more ' * i}end {i}</p></div><div class='w'><p>All rights reserved</p></div></body>" for i in range(8)]
    assert extracted(spark, pages) == [f"Title {i}\n\nLong text number {i} about many things\n\n{'more ' * i}end {i}" for i in range(8)]


def test_html_does_not_depend_on_the_order_of_pages(spark):
    rng = np.random.default_rng(3)
    blocks = ["<h2>T{0}</h2>", "<p>One {0} and text</p>", "<ul><li>a{0}<li>b{0}</ul>", "<div class='q'><p>Quote {0}</p></div>", "<div class='n'>Notice</div>"]
    pages = [(i, f"http://host{i % 2}/", "<body><h1>Site</h1><div>" + "".join(b.format(i) for b in rng.permutation(blocks)[: 2 + i % 4]) + "</div></body>") for i in range(60)]
    results = [{r.key: r.text for r in html_extract.extract(spark.createDataFrame([pages[i] for i in rng.permutation(60)], "page_id long, url string, html string").repartition(1 + k)).collect()} for k in range(3)]
    assert results[0] == results[1] == results[2]


def test_html_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "<article><p>deep</p></article>"
    inline = "<article><p>" + "<span>" * 50_000 + "in" + "</span>" * 50_000
    wide = "<main>" + "".join(f"<p>w{i}</p>" for i in range(20_000))
    bare = "<b>" * 3000 + "text" + "<p>" * 3000 + "more"
    got = extracted(spark, [deep, inline, wide, bare, "<", "", "<p", "&lt;b&gt;"])
    assert got[:4] == ["deep", "in", "\n\n".join(f"w{i}" for i in range(20_000)), "text\n\nmore"] and got[5] == "" and got[7] == "<b>"


def test_html_odd(spark):
    rows = [(1, None, "<article>a</article>", "u"), (1, None, "<article>a</article>", "v"), (None, "http://[", None, None), (2, "http://h/", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    assert sorted((r.key is None, r.text) for r in html_extract.extract(df.withColumn("rules", df.host).withColumn("key", df.host)).collect()) == [(False, ""), (False, "a"), (False, "a"), (True, "")]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_rules_beyond_the_broadcast(spark, monkeypatch):
    pages = [(i, f"http://h{i % 7 if i % 3 else 0}/", f"<body><div><h2>T{i}</h2><p>text {i}</p></div><p>Foot</p></body>") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    one = {tuple(r) for r in html_extract.extract(df).collect()}
    monkeypatch.setattr(html_extract, "RULE_BYTES", 0)
    monkeypatch.setattr(html_extract, "HOT", 4)
    assert {tuple(r) for r in html_extract.extract(df).collect()} == one


def test_chat_odd(spark):
    schema = "conv_id long, turn long, role string, text string, message long, seq string, kind string"
    rows = [(1, 0, "user", "a", 9, "x", "y"), (1, 0, "user", "a", 9, "x", "y"), (1, None, None, None, None, None, None), (None, 1, "assistant", "\\e<l[b]c\n", None, None, None), (None, 0, "us\ner", "<s>" * 2000, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.conversation: r for r in chat.read_back(chat.render(chat.fold(chat.log_of(df)))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("user", "a"), ("user", "a")] and got[1].loss == []
    assert [tuple(t) for t in got[None].turns] == [("us\ner", "<s>" * 2000), ("assistant", "\\e<l[b]c\n")] and got[None].loss == ["\\e<l[b]c\n"]
    assert chat.read_back(chat.render(chat.fold(chat.log_of(df.limit(0))))).count() == 0


def test_chat(spark):
    compare(spark, SF, queries.op7_chat_format, queries.OP7_SQL)


def test_chat_events(spark):
    rows = [(1, 1, 0, 0, "start", "user", None), (1, 1, 0, 1, "delta", None, "he"), (1, 1, 0, 2, "delta", None, "y"), (1, 2, 1, 3, "start", "assistant", None), (1, 2, 1, 4, "delta", None, "bad"), (1, 2, 1, 5, "regenerate", None, None), (1, 2, 1, 6, "delta", None, "a<b\\l"), (1, 3, 2, 7, "start", "user", None), (1, 3, 2, 8, "drop", None, None), (1, 4, 3, 9, "start", "assistant", None), (1, 4, 3, 10, "delta", None, "x"), (1, 4, 3, 11, "edit", None, "[y]\n"), (2, 5, 0, 0, "start", None, None)]
    log = spark.createDataFrame(rows, "conversation long, message long, turn long, seq long, kind string, role string, text string")
    got = {r.conversation: r for r in chat.read_back(chat.render(chat.fold(log))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "hey"), ("assistant", "a<b\\l"), ("assistant", "[y]\n")] and got[1].loss == ["a<b\\l", "[y]\n"]
    assert [tuple(t) for t in got[2].turns] == [("", "")]


def test_pitman_yor(spark):
    import math
    import zlib

    docs = table("documents", "doc_id", "text")
    got = {r.doc_id: r for r in queries.op8_pitman_yor(spark, SF).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in docs}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    count = collections.Counter(w for i in tokens if i not in out for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, own in tokens.items():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (i in out, len(own), sum(count[w] > 0 for w in own), n)
        assert got[i].base_score == pytest.approx(base)
    assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out)


def test_pitman_yor_is_a_distribution(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "a b a", "b a", "c a b", "a"] * 3)]
    texts = ["a", "b", "c", "zz", ""]  # after the beginning: each word or the end, then the end
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pitman_yor.score(df)
    assert got.count() == len(rows) + len(texts) and all(r.score < 0 for r in got.collect())


def test_pitman_yor_rare_contexts_are_not_pooled(spark):
    rows = [(2 * i, f"w{i}xyz {'p' if i % 2 else 'q'}") for i in range(60)]  # contexts that occur once, with equal endings
    texts = [f"w{i}xyz {'p' if (i % 2 == 0) == other else 'q'}" for i in range(60) for other in (False, True)]
    ids = [i for i in range(1001, 3000) if pitman_yor.held_out(np.array([i]))[0]][: len(texts)]
    rows = [r for r in rows if not pitman_yor.held_out(np.array(r[:1]))[0]]
    known = {t for _, t in rows}
    rows += [(5000 + i, f"u{i // 2} v{i // 2}") for i in range(600) if not pitman_yor.held_out(np.array([5000 + i]))[0]]  # pairs that occur twice keep the discount small
    got = {r.id: r.score for r in pitman_yor.score(spark.createDataFrame(rows + list(zip(ids, texts)), "doc_id long, text string")).collect()}
    pairs = [(got[a], got[b], t in known) for a, b, t in zip(ids[::2], ids[1::2], texts[::2])]
    assert all(right > other + 0.3 for right, other, trained in pairs if trained) and sum(t for *_, t in pairs) > 30


def test_pitman_yor_does_not_depend_on_what_is_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shared = {r.id: r.score for r in pitman_yor.score(docs).collect()}
    monkeypatch.setattr(pitman_yor, "FREQUENT_SHARE", 1)
    apart = {r.id: r.score for r in pitman_yor.score(docs).collect()}
    assert sum(apart.values()) == pytest.approx(sum(shared.values()), rel=0.005)
    assert all(apart[i] == pytest.approx(s, rel=0.05) for i, s in shared.items())


def seatings(n, base, prediction, discount):
    """Probabilities of numbers of tables, by every way to seat n customers one after the other."""
    weight = collections.Counter()

    def add(tables, w, left):
        if not left:
            weight[len(tables)] += w
            return
        for i, k in enumerate(tables):
            add((*tables[:i], k + 1, *tables[i + 1 :]), w * (k - discount), left - 1)
        add((*tables, 1), w * (base + discount * len(tables)) * prediction, left - 1)

    add((), 1.0, n)
    total = sum(weight.values())
    return {t: w / total for t, w in weight.items()}


@pytest.mark.parametrize("n, base, prediction, discount", ((2, 1.0, 0.5, 0.5), (5, 3.0, 0.1, 0.3), (7, 1.0, 0.9, 0.8)))
def test_pitman_yor_seats_are_drawn_from_their_distribution(n, base, prediction, discount):
    many = 60_000
    tables = pitman_yor.seat(np.full(many, float(n)), np.full(many, base), np.full(many, prediction), discount, np.random.default_rng(1))
    for t, p in seatings(n, base, prediction, discount).items():
        assert (tables == t).mean() == pytest.approx(p, abs=4 * (p * (1 - p) / many) ** 0.5 + 1e-9)


@pytest.mark.parametrize("base, prediction, discount", ((2.0, 0.3, 0.5), (40.0, 0.5, 0.5), (3000.0, 0.05, 0.7), (1000.0, 0.6, 0.6), (1.0, 1e-5, 0.8)))
def test_pitman_yor_seats_of_large_dishes(monkeypatch, base, prediction, discount):
    """Dishes of 1,500 customers: exact numbers against those carried on from 500 customers."""
    n, many = 1500, 4000
    exact = pitman_yor.log_stirling(discount, n)[n, 1:]
    weight = exact + np.cumsum(np.log((base + discount * np.arange(n)) * prediction))
    p = np.exp(weight - weight.max())
    mean = (p * np.arange(1, n + 1)).sum() / p.sum()
    std = np.sqrt((p * (np.arange(1, n + 1) - mean) ** 2).sum() / p.sum())
    monkeypatch.setattr(pitman_yor, "EXACT", 512)
    monkeypatch.setattr(pitman_yor, "log_stirling", lambda d, most=512: np.pad(real(d, 512), 0))
    tables = pitman_yor.seat(np.full(many, float(n)), np.full(many, base), np.full(many, prediction), discount, np.random.default_rng(3))
    assert tables.mean() == pytest.approx(mean, abs=0.02 * mean + 4 * std / many**0.5) and tables.std() == pytest.approx(std, rel=0.15, abs=0.05)


real = pitman_yor.log_stirling


def test_pitman_yor_probabilities_sum_to_one(spark):
    """From scores of all texts of one and two words the predictions of words are found, and sum to one."""
    train = [(i, t) for i, t in enumerate(["a b", "a b a", "b a", "b b a b", "a", ""] * 40) if not pitman_yor.held_out(np.array([i]))[0]]
    words = ["a", "b", "zz"]  # the last is unknown
    texts = ["", *words, *(f"{x} {y}" for x in words for y in words)]
    ids = [i for i in range(1001, 9000) if pitman_yor.held_out(np.array([i]))[0]][: len(texts)]
    for hot in (False, True):
        rows = train * (12 if hot else 1)
        got = {r.id: 10**r.score for r in pitman_yor.score(spark.createDataFrame(rows + list(zip(ids, texts)), "doc_id long, text string")).collect()}
        p = {t: got[i] for i, t in zip(ids, texts)}
        # with x the predictions at the beginning: sum over v of p(w v) x_v / p(v), and p(w), give x_w
        m = np.eye(3) - np.array([[p[f"{w} {v}"] / p[v] for v in words] for w in words])
        x = np.linalg.solve(m, np.array([p[w] for w in words]))
        assert p[""] + x.sum() == pytest.approx(1, abs=1e-6) and (x > 0).all() and x[0] > x[2]


def plain_pitman_yor(train, sweeps=80, burn=30, seed=5):
    """Customers seated one by one at tables of context restaurants and of their parent: {(context, word): prediction}."""
    rng = np.random.default_rng(seed)
    tokens = [(u, w) for text in train for u, w in zip([None, *text], [*text, "</s>"])]
    count = collections.Counter(tokens)
    words = sorted({w for _, w in tokens})
    share = lambda values: float(np.clip(sum(v == 1 for v in values) / max(sum(v == 1 for v in values) + 2 * sum(v == 2 for v in values), 1), 0.1, 0.95))
    d, e = share(count.values()), share(collections.Counter(w for _, w in count).values())
    low, high = {}, {}  # tables' customers of dishes: {(context, word): [n, ...]}, {word: [n, ...]}
    customers, tables, up, up_tables, v = collections.Counter(), collections.Counter(), 0, 0, len(words)

    def parent(w):
        own = high.get(w, [])
        return (sum(own) - e * len(own) + (1 + e * up_tables) / (v + 1)) / (1 + up)

    def take(own, at):
        own[at] -= 1
        if not own[at]:
            del own[at]
            return True
        return False

    def add_parent(w):
        nonlocal up, up_tables
        own = high.setdefault(w, [])
        weight = [n - e for n in own] + [(1 + e * up_tables) / (v + 1)]
        at = rng.choice(len(weight), p=np.array(weight) / sum(weight))
        if at == len(own):
            own.append(0)
            up_tables += 1
        own[at] += 1
        up += 1

    def drop_parent(w):
        nonlocal up, up_tables
        own = high[w]
        up -= 1
        up_tables -= take(own, rng.choice(len(own), p=np.array(own) / sum(own)))

    def add(u, w):
        own = low.setdefault((u, w), [])
        weight = [n - d for n in own] + [(1 + d * tables[u]) * parent(w)]
        at = rng.choice(len(weight), p=np.array(weight) / sum(weight))
        if at == len(own):
            own.append(0)
            tables[u] += 1
            add_parent(w)
        own[at] += 1
        customers[u] += 1

    def drop(u, w):
        own = low[u, w]
        customers[u] -= 1
        if take(own, rng.choice(len(own), p=np.array(own) / sum(own))):
            tables[u] -= 1
            drop_parent(w)

    for u, w in tokens:
        add(u, w)
    found = collections.defaultdict(float)
    for k in range(sweeps):
        for u, w in tokens:
            drop(u, w)
            add(u, w)
        if k >= burn:
            for u in [None, *words, "?"]:
                for w in [*words, "?"]:
                    own = low.get((u, w), [])
                    found[u, w] += (sum(own) - d * len(own) + (1 + d * tables[u]) * parent(w)) / (1 + customers[u]) / (sweeps - burn)
    return found, set(words)


def test_pitman_yor_equals_a_plain_sampler(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(25)]
    share = 1 / np.arange(1, 26)
    follow = {u: rng.permutation(share) * rng.random(25) + share / 8 for u in (None, *vocabulary)}

    def text():
        out, u = [], None
        for _ in range(rng.integers(3, 15)):
            u = vocabulary[rng.choice(25, p=follow[u] / follow[u].sum())]
            out.append(u)
        return out

    ids = np.arange(400)
    texts = {int(i): text() + (["new"] if i % 50 == 0 else []) for i in ids}
    test = [int(i) for i in ids[pitman_yor.held_out(ids)]]
    found, words = plain_pitman_yor([texts[int(i)] for i in ids[~pitman_yor.held_out(ids)]])
    got = {r.id: r for r in pitman_yor.score(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()}
    name = lambda w: w if w in words else "?"
    want = {i: sum(np.log10(found[u if u is None else name(u), name(w)]) for u, w in zip([None, *texts[i]], [*texts[i], "</s>"])) for i in test}
    n = sum(got[i].n_tokens for i in test)
    assert abs(sum(got[i].score - want[i] for i in test)) / n < 0.01
    assert sum(abs(got[i].score - want[i]) for i in test) / n < 0.02


def test_pitman_yor_hot_dishes_are_only_kept_elsewhere(spark, monkeypatch):
    rows = [(i, "of the " * (i % 5 + 1) + f"w{i % 30} end") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = {r.id: r for r in pitman_yor.score(df).collect()}
    monkeypatch.setattr(pitman_yor.Model, "take_hot", lambda self, *a: None)
    cold = {r.id: r for r in pitman_yor.score(df).collect()}
    for i, r in hot.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (cold[i].n_tokens, cold[i].n_known, cold[i].train_tokens) and r.base_score == pytest.approx(cold[i].base_score)
        assert r.score == pytest.approx(cold[i].score, rel=0.1)


def test_pitman_yor_stores_a_bucket_in_bounded_cells(spark, monkeypatch):
    """Else each reader of the stored tokens holds buckets whole, several times over (check tool: over 3,000 MB of an executor)."""
    monkeypatch.setattr(c, "layout", lambda *a, **b: c.Layout(1))
    paths, fresh = [], c.fresh
    monkeypatch.setattr(c, "fresh", lambda spark, name: paths.append((name, fresh(spark, name))) or paths[-1][1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with c.tables(spark):
        got = pitman_yor.score(docs).agg(F.count("id"), F.sum("n_tokens")).first()
        path = next(p for name, p in paths if name == "tokens").removeprefix("file://").removeprefix("file:")
        stored = [pq.ParquetFile(p) for p in Path(path).glob("*.parquet")]
        cells = [c.unpack(data) for f in stored for kind, data in zip(*f.read(["kind", "data"]).to_pydict().values()) if kind == pitman_yor.TOKENS]
        groups = [f.metadata.row_group(i).total_byte_size for f in stored for i in range(f.metadata.num_row_groups)]
    assert tuple(got) == (docs.count(), sum(len(WORD.findall(r.text or "")) + 1 for r in docs.collect()))
    assert max(len(x) for cell in cells for x in cell) < 300_000 < sum(len(cell[-1]) for cell in cells)
    assert len(groups) > 1 and max(groups) < 3 << 20


def test_pitman_yor_odd(odd, none):
    rows = pitman_yor.score(odd).collect()
    assert len(rows) == len(ODD) and sorted(r.n_tokens for r in rows)[:3] == [1, 1, 1]
    assert pitman_yor.score(none).count() == 0


def test_mixing(spark):
    rows = queries.op9_mixing(spark, SF).toPandas()
    total = rows.n_tokens.sum()
    for domain, share in mixing.TARGETS.items():
        assert (rows.n_tokens * rows[f"p_{domain}"] * rows.rate).sum() / total == pytest.approx(share, abs=0.02)
    assert (rows.rate >= 0).all() and len(rows) == 200


def test_mixing_removes_toxic_texts_and_leaves_clean_ones(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    good = docs.join(labels.where("quality = 0"), "doc_id", "left_anti")  # the pipeline's rules have removed poor texts
    held_out = labels.where("pmod(xxhash64(doc_id), 4) = 0")
    rates = mixing.mix(good, labels.join(held_out, "doc_id", "left_anti"), keep_totals={"good": 1.0, "poor": 1.0, "toxic": 0.0}).selectExpr("row.id doc_id", "rate")
    rows = rates.join(held_out, "doc_id").toPandas()
    clean, toxic = rows[rows.toxic == 0], rows[rows.toxic == 1]
    assert len(clean) and len(toxic)
    assert ((clean.rate >= 0.5) & (clean.rate < 1.5)).mean() >= 0.99
    assert (toxic.rate < 0.5).mean() >= 0.75


def test_mixing_rates_against_a_plain_solution(spark):
    """The least change of rates that meets the targets, by small projected gradient steps on all documents."""
    rows = queries.op9_mixing(spark, "/root/testdata/sf0.01").toPandas().query("n_tokens > 0")
    p, n = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), rows.n_tokens.to_numpy()
    goal = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    rate = np.ones(len(n))
    for _ in range(20_000):
        off = (n * rate) @ p / n.sum() - goal
        rate = np.maximum(rate - 0.3 * p @ off, 0)
    assert np.abs((n * rate) @ p / n.sum() - goal).max() < 1e-3
    assert np.abs((n * rows.rate.to_numpy()) @ p / n.sum() - goal).max() < 1e-3
    assert np.corrcoef(rate, rows.rate)[0, 1] > 0.98 and np.average(np.abs(rate - rows.rate), weights=n) < 0.1


def test_mixing_odd(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, None), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.rate == 1.0 for r in rows if not r.n_tokens)
    assert mixing.mix(none, labels.limit(0)).count() == 0


def check_bins(rows):
    bins = collections.defaultdict(list)
    for r in rows:
        if r.n_tokens:
            bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.capacity))
        else:
            assert r.bin_id is None
    for own in bins.values():
        own.sort()
        assert [o for o, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]
        used, capacity = sum(n for _, n, _ in own), own[0][2]
        assert capacity == min(x for x in packing.LENGTHS if x >= used)
    return bins


def test_packing(spark):
    rows = queries.op10_packing(spark, SF).collect()
    check_bins(rows)
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert got == {i: len(WORD.findall(t)) for i, t in table("documents", "doc_id", "text")}


def best_fit(sizes, lengths):
    """Plain variable-capacity best fit: pieces in descending order, each into the fullest open bin it fits, else into a new
    one of the length that the remaining pieces fill at the least cost; bins end downsized."""
    bins = []
    for k, size in enumerate(sizes):
        fits = [b for b in bins if b[0] - b[1] >= size]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += size
        else:
            def price(length):
                used = size
                for s in sizes[k + 1 :]:
                    used += s if used + s <= length else 0
                return packing.cost(min(x for x in lengths if x >= used)) / used

            bins.append([min((x for x in lengths if x >= size), key=price), size])
    return sum(packing.cost(min(x for x in lengths if x >= used)) for _, used in bins)


@pytest.mark.parametrize("seed", range(4))
def test_packing_costs_no_more_than_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(5.5, 1.2, 400).astype(int) + 1, 4096)
    count = np.bincount(sizes, minlength=4097)
    price = used = 0
    for times, capacity, need in packing.plan(count, packing.LENGTHS):
        filled = sum(s * k for s, k in need.items())
        assert filled <= capacity
        price, used = price + times * packing.cost(capacity), used + times * filled
    assert not count.any() and used == sizes.sum()
    assert price <= 1.02 * best_fit(sorted(sizes.tolist(), reverse=True), packing.LENGTHS)


def test_packing_odd(spark, odd, none):
    check_bins(packing.pack(odd).collect())
    assert packing.pack(none).count() == 0
    same = spark.range(1000).selectExpr("id doc_id", "repeat('w ', 300) text", "id bucket")
    bins = check_bins(packing.pack(same).collect())
    assert sum(len(b) for b in bins.values()) == 1000
