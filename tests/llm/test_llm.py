"""Training-data operators: against brute force, round trips, held-out accuracy and odd inputs."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import components, decontamination, html_extraction, jaccard_join, language_id, license_scan, order_minhash, sentence_pieces, token_counts, token_files, warc
from touchline.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "Hello wörld, 12 km!"), (6, "Hello wörld, 12 km!"), (7, "x" * 5000), (8, "🙂 日本語 \u0000 é"), (9, "<|endoftext|> it's ▁ here"), (9, "the same id again"), (None, "no id")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in ODD], "doc_id long, text string, lang string, n int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_language_held_out(docs):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_cross_parsing_against_brute_force():
    texts = {"a": "abracadabra the cat", "b": "los gatos del barrio"}
    p = language_id.CrossParser(texts)

    def phrases(codes, sample):
        n = at = 0
        while at < len(codes):
            size = 1
            while at + size < len(codes) and any((sample[k : k + size + 1] == codes[at : at + size + 1]) for k in range(len(sample))):
                size += 1
            n, at = n + 1, at + size
        return n

    for t in ["the cadabra", "gatos", "zz", "a", "cat cat cat los"]:
        c = p.codes(t)
        assert p.phrases([c])[0].tolist() == [phrases(c.tolist(), p.codes(x).tolist()) for x in texts.values()]
    r = np.random.default_rng(1)
    wide = {"han": "".join(chr(0x4E00 + k) for k in r.integers(0, 6000, 900)), "latin": "some words of a language " * 3}
    p = language_id.CrossParser(wide)
    codes = [p.codes(x) for x in [wide["han"][40:90], wide["han"][::7], "some of a 一丁", *[wide["han"][k : k + 9] + "words" for k in range(20)]]]
    assert p.width > 700 and p.phrases(codes).tolist() == [[phrases(c.tolist(), p.codes(x).tolist()) for x in wide.values()] for c in codes]


def test_language_of_odd_texts(odd):
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en"
    assert language_id.identify(odd.limit(0)).collect() == []
    assert language_id.keep(odd, {"en": "hello"}).columns == odd.columns


def test_token_counts_against_brute_force(docs, odd):
    words = set(token_counts.vocabulary(tokenizer_path("byte_bpe_50k.json"))) | {bytes([b]) for b in range(256)}

    def greedy(w):
        n = at = 0
        while at < len(w):
            size = min(len(w) - at, 130)
            while w[at : at + size] not in words:
                size -= 1
            n, at = n + 1, at + size
        return n

    split = token_counts._splitter().findall
    for d in (docs.limit(30), odd):
        texts = d.select("doc_id", "text").collect()
        want = sorted((r.doc_id or 0, sum(greedy(w.encode()) for w in split(r.text or ""))) for r in texts)
        assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(d).collect()) == want


def test_token_files_round_trip(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for d in (docs, odd, odd.limit(0)):
        texts = sorted(((r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        got = token_files.round_trip(d, files=3).collect()
        assert len(got) == len(texts) and sum(r.n_tokens for r in got) == max([r.start + r.n_tokens for r in got], default=0)
        want = sorted((i or 0, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4").tobytes())) for i, x in texts)
        assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == want
        starts = [r.doc_id or 0 for r in sorted(got, key=lambda r: r.start)]
        assert starts == sorted(starts)


def test_license_scan(spark):
    d = spark.createDataFrame([(1, "foo bar. Released under the MIT License. baz"), (2, "This work is licensed under the GNU General Public License, version 3.0 and more"), (3, "nothing here at all, only words"), (4, None), (5, "a b")], "doc_id int, text string")
    assert {(r.doc_id, r.license) for r in license_scan.scan(d).collect()} == {(1, "MIT"), (2, "GPL-3.0")}
    every = spark.createDataFrame([(k, f"w w w {t} z z z") for k, (_, t) in enumerate(license_scan.TEMPLATES)], "doc_id int, text string")
    found = {(r.doc_id, r.template) for r in license_scan.scan(every).collect()}
    assert all((k, k) in found for k in range(len(license_scan.TEMPLATES)))


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) or rows[a][0] is not None and rows[a][0] == rows[b][0]:
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i) if i is not None else least.get(root(k))
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows) if i is not None)


@pytest.mark.parametrize(("limit", "counted"), [(1_000_000, 4096), (300, 2), (300, 3)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, limit, counted):
    monkeypatch.setattr(jaccard_join, "BLOCK", limit)
    monkeypatch.setattr(jaccard_join, "COUNTED", counted)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1 if counted == 2 else 32)
    monkeypatch.setattr(jaccard_join, "SHORT", 64 if limit > 300 else 2)
    r = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = list(r.choice(vocabulary, 120))
    rows = [(1000 + k, t) for k, t in enumerate([None, "", "one two", "One TWO", "one two three"])]
    for k in range(40):  # near copies with a few edits each: chains of links
        w = list(base)
        for at in r.integers(0, 120, k // 8):
            w[at] = "edit%d" % r.integers(0, 30)
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(r.choice(vocabulary, 60)) + " " + " ".join(base[:20])) for k in range(20)]
    rows.append((200, rows[-1][1].upper().replace("W", "w")))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(d).collect())) == brute_components(rows)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (1, 1)], "a long, b long")
    assert sorted(map(tuple, components.components(e).collect())) == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 3)]


def test_fingerprints(docs, odd):
    import hashlib

    rows = sorted(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in order_minhash.fingerprints(docs).collect()}
    prints = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt.text[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        a, b = got[i].fingerprint, got[nxt.doc_id].fingerprint
        assert got[i].near_next == sum(a[k : k + 8] == b[k : k + 8] for k in range(0, 256, 8)) / 32
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.3 and np.mean([r.near_next for r in long]) < 0.1
    assert len(order_minhash.fingerprints(odd).collect()) == len(ODD) and order_minhash.fingerprints(odd.limit(0)).collect() == []


def python_fingerprint(spark, text):
    """The sketches in plain Python; only Spark's hash is its own."""
    from pyspark.sql import types as T

    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    t = [c for w in words for c in (w if len(w) > order_minhash.LONG else [w])]
    if not t:
        return [0] * order_minhash.SKETCHES

    def hashed(rows, *kinds):
        schema = T.StructType([T.StructField(f"c{k}", x) for k, x in enumerate(kinds)])
        return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(F.xxhash64(*(f"c{k}" for k in range(len(kinds))))).collect()]

    bits = order_minhash.PLACE
    padded = ["", "", *t, None, None]
    mers = [h >> bits for h in hashed([tuple(padded[k : k + 3]) for k in range(len(t) + 2)], *[T.StringType()] * 3)]
    number = [sum(x == m for x in mers[:k]) for k, m in enumerate(mers)]
    elements = sorted((h >> bits, k) for k, h in enumerate(hashed(list(zip(mers, number)), T.LongType(), T.IntegerType())))
    width, out = 2 ** (64 - bits) // order_minhash.SKETCHES, []
    for b in range(order_minhash.SKETCHES):
        at = next((k for k, (h, _) in enumerate(elements) if h + 2 ** (63 - bits) >= b * width), 0)
        pair = sorted((elements[at], elements[(at + 1) % len(elements)]), key=lambda x: x[1])
        out.append([h for h, _ in pair])
    if len(elements) == 1:
        return [h & 0xFFFFFFFF for h in hashed([(x[0],) for x in out], T.LongType())]
    return [h & 0xFFFFFFFF for h in hashed([tuple(x) for x in out], T.LongType(), T.LongType())]


def test_fingerprints_against_brute_force(spark):
    texts = ["one two three four five", "a", "la la la la la la la", "word " * 30 + "end", "x" * 60, "日本語の文章 " * 8, "", " \t", "the quick brown fox jumps over the lazy dog " * 3]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in d.select("k", "text", order_minhash.fingerprint(F.col("text")).alias("f")).collect():
        assert list(r.f) == python_fingerprint(spark, r.text), r.text


def test_fingerprints_of_hot_ids(spark):
    import hashlib

    rows = [(5, f"text {k} of one id " * (k % 4)) for k in range(80)] + [(None, f"none {k} and so on") for k in range(30)] + [(k, f"other {k} here") for k in range(10, 20)] + [(-(2**63), None)]
    d = spark.createDataFrame([(i, t, "clash", 1, True) for i, t in rows], "doc_id long, text string, bucket string, h int, head boolean")
    got = order_minhash.fingerprints(d, 16).collect()
    h = {r.text: r.h for r in d.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        cut = len(t) // 4
        want.append((str(i), hashlib.sha256((t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(want)
    assert order_minhash.in_order(d, 16).select("bucket").distinct().count() > 8


def test_order_tells(spark):
    a = "one two three four five six seven eight nine ten " * 10
    d = spark.createDataFrame([(a, a), (a, " ".join(reversed(a.split())))], "x string, y string")
    got = [r.v for r in d.select(order_minhash.likeness(order_minhash.fingerprint(F.col("x")), order_minhash.fingerprint(F.col("y"))).alias("v")).collect()]
    assert got[0] == 1 and got[1] < 0.5


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/b", "<p>Hi &amp; bye</p>"), (2, None, None), (3, "http://c", "<b>ü")], "page_id long, url string, html string")
    responses = warc.responses(pages)
    derived = {(r.page_id, r.record_type): r for r in warc.derive(responses).collect()}
    source = {r.page_id: r for r in responses.collect()}
    assert len(derived) == 6
    for (page, _), r in derived.items():
        (headers, block), = warc.parse(bytes(r.record))
        assert headers["WARC-Refers-To"] == source[page].record_id and headers["WARC-Block-Digest"] == warc.digest(block)
        assert headers["WARC-Source-Payload-Digest"] == source[page].payload_digest
    (_, text), = warc.parse(bytes(derived[1, "conversion"].record))
    assert text.decode() == "Hi & bye"
    warc.write_files(responses, str(tmp_path / "w"), 2)
    assert sorted(bytes(r.record) for r in warc.read_files(spark, str(tmp_path / "w")).collect()) == sorted(bytes(r.record) for r in source.values())


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy now.</div><article><h1>Head &amp; more</h1><p><b>First  para\ngraph of text.<br><p>Second one.</p><aside><p>Related things.</p></aside></article><section id=comments><p>I like it.</p></section><footer>&copy; me</footer></body></html>"
    d = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extraction.extract(d).collect()}
    assert got[1].text == "Head & more\nFirst para graph of text.\nSecond one." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == ""
    right = pages = 0
    w = html_extraction.train()
    for p in html_extraction.labelled_pages(100, seed=99):
        t = html_extraction.Tree(p)
        m = html_extraction.marginals([t], w)
        right += [x for x, y in zip(t.text, t.marks) if x and y == "1"] == [x for x, q in zip(t.text, m) if x and q >= 0.5]
        pages += 1
    assert right / pages > 0.85  # whole pages, of many layouts, some of which tell too little


def test_sum_product_against_enumeration():
    from itertools import product

    t = html_extraction.Tree("<div><p>a</p><p>b.</p></div>")
    w = html_extraction.train()
    x, parent, _ = html_extraction.design([t])
    own, j = x.times(w), [[0, w[-3]], [w[-2], w[-1]]]
    total, one = 0.0, np.zeros(len(parent))
    for y in product((0, 1), repeat=len(parent)):
        p = np.exp(sum(own[k] * y[k] for k in range(len(y))) + sum(j[y[parent[k]]][y[k]] for k in range(1, len(y))))
        total, one = total + p, one + p * np.array(y)
    assert np.allclose(one / total, html_extraction.marginals([t], w))


def test_pieces_equal_the_library(docs, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for d in (docs.limit(60), odd):
        for r in sentencepiece_rows(d):
            assert list(r.piece_ids) == model.encode(r.text or "") and r.decodes
    back = sentence_pieces.decode(sentence_pieces.encode(odd)).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)


def sentencepiece_rows(d):
    return sentence_pieces.encode(d, verify=True).collect()


def test_decontamination(spark):
    item = "A train leaves Boston at 9 oclock and travels 120 km towards the city of Albany before it stops for lunch"
    other = item.replace("Boston", "Paris").replace("120", "350").replace("9", "7")
    twice = "We know that 5 apples and 5 pears make a fine basket of fruit for the winter market"
    d = spark.createDataFrame([(1, f"noise before. {item} noise after"), (2, f"some text {other} and so on"), (3, "an unrelated text about trains that leave the city at noon"), (4, None), (5, twice.replace("5 pears", "9 pears"))], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(d, b).collect()}
    assert got == {(1, 7), (2, 7)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.count() <= before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert 0 < docs.count() < spark.read.parquet(f"{SF}/documents.parquet").count() and all(r.decodes for r in docs.select("decodes").collect())


def test_token_ids_equal_the_library():
    import random

    r = random.Random(5)
    symbols = [*"aAbJz09 .,!?;:'\"-_<|>\n\t\r", "İ", "ı", "É", "́", "̌", "日", "🙂", " ", " ", "Σ", "ﬁ", "½", "한", "ᄒ", "ᅡ", "'s", "'LL", "<|endoftext|>", "ǰ", "ǅ", "²"]
    texts = ["".join(r.choice(symbols) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    e = token_files.encoder(tokenizer_path("word_bpe_49k.json"))
    assert [g.tolist() for g in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files_of_hot_and_extreme_ids(spark, tmp_path):
    rows = [(7, f"text number {k}") for k in range(60)] + [(-(2**63), "least"), (2**63 - 1, "most"), (None, "none"), (None, None), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_files.round_trip(d, str(tmp_path / "t"), files=8).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    import json

    assert sum(f["n_docs"] > 0 for f in json.load(open(tmp_path / "t" / "manifest.json"))) > 3  # the hot doc_id has several files


def test_html_of_odd_markup():
    import time

    w = html_extraction.train()
    cases = {
        "<article><p class=it's>A</p><p>It's B</p><p>C</p></article>": "A\nIt's B\nC",
        "<main><div><div><p>Some words of prose that go on for a while, as they do.</p></div></div></main>": "Some words of prose that go on for a while, as they do.",
        "<p>Hello there, a page\n of  few words.": "Hello there, a page of few words.",
        "plain text &amp; no more": "plain text & no more",
        "<title>T</title><h1>H</h1><p>a < b and c &lt; d": "H\na < b and c < d",
        "<article class='post sponsored-links more'><h1>Head</h1><p>Text of the article.</p></article>": "Head\nText of the article.",
        "<article><p>A.</p><script>var x = '</p>';</script><style>p{}</style><!-- <p>no</p> --><textarea>no</textarea><p>B.</p></article>": "A.\nB.",
        "<article><p>One.</p><svg><path d='x'/><text>no</text></svg><p>Two.</p></article>": "One.\nTwo.",
        "<article><p>a</p></article></div></p></x><a href='": "a",
        "<article><p title=\"it never ends>A</p><p>B</p></article>": "A\nB",
        "": "",
        "<br><!-- nothing -->": "",
    }
    for page, text in cases.items():
        assert html_extraction.extract_all([page], w) == [text], page
    long = "<article>" + "".join(f"<p>Paragraph {k} of a long page.</p>" for k in range(30_000)) + "</article>"
    assert html_extraction.extract_all([long], w)[0].count("\n") == 29_999
    for hard in ('<a "' * 1_250_000, '<script "' * 500_000, "<div>" * 100_000 + "x" + "</x>" * 100_000, "<li><ul>" + "<x>" * 50_000 + "<li></li>" * 50_000, '<a x="' * 500_000 + "'", "<p a='x>" * 100_001):
        began = time.process_time()
        html_extraction.extract_all([hard], w)
        assert time.process_time() - began < 6


def test_html_against_regular_expressions():
    """The given pages have one layout, whose article regular expressions find too."""
    import html

    import pyarrow.parquet as pq

    for page in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist():
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("<[^/ph!][^>]*>|</[^ph][^>]*>|<!--.*?-->", " ", inner, flags=re.S))
        want = "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)
        assert html_extraction.extract_all([page], html_extraction.train()) == [want]


def test_warc_headers_and_streams(spark, tmp_path):
    import gzip

    odd = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <urn:x>\r\ncontent-length:  %d\r\nWARC-Target-URI:http://a:80/b\r\nX-Long: one\r\n two\r\nX-Twice: 1\r\nX-Twice:2\r\nWARC-Page-Id: seven\r\n\r\n%s\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\ncontent-type:text/html\r\nBad line\r\n\r\n<p>A</p><p>B</p>"
    raw = odd % (len(block), block)
    (headers, got), (_, empty) = warc.parse(raw + b"\r\n" + odd % (0, b""))
    assert got == block and empty == b"" and headers["X-Long"] == "one two" and headers["X-Twice"] == "1, 2" and headers["WARC-Target-URI"] == "http://a:80/b"
    assert warc.row(raw)[:3] == (None, "response", "<urn:x>")
    d = spark.createDataFrame([("response", raw), ("response", raw), ("request", raw)], "record_type string, record binary")
    kinds = sorted(r.record_type for r in warc.derive(d).collect())
    assert kinds == ["conversion"] * 2 + ["metadata"] * 2
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.warc.gz").write_bytes(gzip.compress(raw * 3))  # one member, three records
    (tmp_path / "w" / "two.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    (tmp_path / "w" / "plain.warc").write_bytes(raw)
    assert warc.read_files(spark, str(tmp_path / "w")).count() == 6
    with pytest.raises(ValueError):
        list(warc.parse(raw[:-20]))


def test_warc_of_odd_tables(spark, tmp_path):
    schema = "page_id long, url string, html string, record_id string, record binary"
    rows = [(1, "u", "<p>a</p>", "clash", None)] * 3 + [(None, None, "x" * 300_000, None, None)]
    d = spark.createDataFrame(rows, schema)
    made = warc.responses(d)
    assert made.count() == 4 and made.select("record_id").distinct().count() == 2 and warc.derive(made).count() == 8
    warc.write_files(made, str(tmp_path / "w"), 2)
    assert warc.read_files(spark, str(tmp_path / "w")).count() == 2  # equal captures once
    assert warc.responses(d.limit(0)).collect() == warc.derive(made.limit(0)).collect() == []


def test_pieces_of_odd_texts():
    import random
    import time

    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, t, r = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Transducer(path), random.Random(3)
    symbols = [*"aaeeiinnrstlothedbm AB.,'\n\t 01", "  ", "   ", "▁", "\x1f", "é", "日", "🙂", "\x00", "İ", "the", "ing", "</s>", "<0x0A>", " "]
    texts = ["".join(r.choice(symbols) for _ in range(r.randint(0, 30))) for _ in range(6000)]
    texts += ["x" * 20_000, "日本語の" * 5000, "the " * 20_000, "ab" * 300, " " * 500]
    began = time.process_time()
    for x, ids in zip(texts, t.encode_all(texts)):
        assert ids.tolist() == model.encode(x), x[:50]
        assert t.decode(ids.tolist()) == x.replace("▁", " ")
    assert time.process_time() - began < 30


def test_normaliser_arcs():
    t = sentence_pieces.transducer(tokenizer_path("piece_bpe_32k.model"))
    plain, t.normaliser.plain = t.normaliser.plain, False
    try:
        for x in ("a b", " a  b ", "", "a", "  "):
            assert t.normaliser.read(x) == (sentence_pieces.MARK + x.replace(" ", sentence_pieces.MARK) if x else "")
    finally:
        t.normaliser.plain = plain


def test_long_map():
    from touchline.llm.common import LongMap

    m, r = LongMap(), np.random.default_rng(2)
    keys = np.unique(r.integers(0, 2**62, 20_000))
    r.shuffle(keys)
    for at in range(0, len(keys), 777):
        m.put(keys[at : at + 777], np.arange(at, min(at + 777, len(keys))))
    assert m.get(keys).tolist() == list(range(len(keys))) and set(m.get(keys + 1)[~np.isin(keys + 1, keys)]) == {-1}


PAST = "the quick brown fox jumps over the lazy dog while seven other animals look on from behind a wooden fence near the old mill"


def odd_documents(spark, item):
    """Documents with null and repeated ids, copies, a leak and columns whose names operators may use themselves."""
    near = PAST.replace("wooden", "painted")
    rows = [
        (1, PAST, "keep"), (2, PAST, "copy of 1"), (None, PAST, "copy of 1"), (3, None, "no text"), (4, "", "empty"), (5, "12 34 !!", "no letters"),
        (6, "one text of its own that nobody else has written so far", "keep"), (6, "another text under the same id which comes first by its words", "keep"),
        (None, "a text without an id that is like no other text in this table", "keep"), (None, "a second text without an id that talks about something else", "keep"),
        (None, f"noise before it {item} and noise after it", "leak"), (7, f"some other noise {item} and more", "leak"), (8, "x" * 9000 + " long words and more", "keep"), (9, near + " " + near, "keep"),
    ]
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, "s", 5, why, k, True, {"a": k}) for k, (i, t, why) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, id string, row_id int, n boolean, m map<string,int>")


def test_pipeline_stages_of_odd_documents(spark, tmp_path):
    item = "which of the following rivers flows through the largest number of countries before it reaches the sea"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_documents(spark, item)
    stages = dict(corpus_pipeline.STAGES)
    english = stages["language_id"](spark, docs.withColumn("lang", F.lit("en")), str(tmp_path))
    assert english.columns == docs.columns and sorted(r.id for r in english.collect() if "no " in r.id or r.id == "empty") == []
    got = stages["jaccard_join"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    ids = sorted(r.id for r in got.collect())
    assert ids.count("keep") == 7 and "copy of 1" not in ids and ids.count("leak") == 2, ids
    got = stages["decontamination"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.count() == docs.count() - 2 and got.where("id = 'leak'").count() == 0
    got = stages["sentence_pieces"](spark, docs, str(tmp_path))
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == docs.count() and all(r.decodes for r in got.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name


def test_jaccard_join_of_odd_documents(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(odd_documents(spark, "an item")).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2)] == [(1, 21, 1), (2, 21, 1)] and (None, 21, 1) in got and [x for x in got if x[0] == 4] == [(4, 0, 4)]
    assert {x[2] for x in got if x[0] == 6} == {6} and len(got) == 14
    # linked with each other, under no id; a repeated id of which one text is empty
    other = "five words stand here and more"
    d = spark.createDataFrame([(None, PAST), (None, PAST.replace("quick", "slow") + " x"), (5, ""), (5, other), (4, other), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.join(d, percent=60).collect()} == {(None, None), (5, 4), (4, 4)}
    assert jaccard_join.join(d.limit(0)).collect() == []


def license_words(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def test_license_scan_against_brute_force(spark):
    """Recall at containment 0.8 and more, over templates of all lengths with edited words."""
    r = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    templates = [(f"L{k}", " ".join(r.choice(vocabulary, n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40, 80, 160] * 2)]
    rows, want = [], set()
    for doc in range(320):
        k = doc % len(templates)
        words = templates[k][1].split()
        for at in r.integers(0, len(words), int(r.integers(0, 1 + max(1, len(words) // 12)))) if len(words) > 2 else ():
            words[at] = "edited"
        text = [*r.choice(vocabulary, int(r.integers(0, 60))), *words, *r.choice(vocabulary, int(r.integers(0, 60)))]
        rows.append((doc, " ".join(text)))
        own = templates[k][1].split()
        grams = lambda ws: {tuple(ws[j : j + 3]) for j in range(len(ws) - 2)}
        if len(own) < 3 or len(grams(own) & grams(words)) >= 0.8 * len(grams(own)):
            want.add((doc, f"L{k}"))
    rows += [(1000, None), (1001, ""), (1002, "w1"), (0, "a second row of one id")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id int, text string, license string, at int")
    got = {(x.doc_id, x.license) for x in license_scan.scan(d, templates).collect()}
    assert len(got & want) >= 0.99 * len(want)
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(license_words(t))
    for i, name in got:  # nothing is found that isn't there
        own = dict(templates)[name].split()
        if len(own) < 3:
            assert any(own == ws[j : j + len(own)] for ws in text[i] for j in range(len(ws)))
        else:
            grams = lambda ws: {tuple(ws[j : j + 3]) for j in range(len(ws) - 2)}
            assert any(len(grams(own) & grams(ws)) >= 0.8 * len(grams(own)) for ws in text[i])
    assert license_scan.scan(d.limit(0)).collect() == [] and license_scan.scan(d, []).collect() == [] and license_scan.scan(d, [("x", "--")]).collect() == []


def python_tokens(text):
    import regex

    t = regex.sub("[\x01\x02]", " ", text or "")
    t = regex.sub(rf"(?<=\d ?)((?i:{decontamination.UNITS}))(?![\p{{L}}\p{{N}}])", "  \x01u\\1 ", t)
    t = regex.sub(r"(?<=[\p{Ll},;] )\p{Lu}\p{L}*", lambda m: "\x01p" + m[0], t)
    t = regex.sub(r"(?<=\d)[.,](?=\d)", "\x02", t)
    t = regex.sub("(?<![\\p{L}\\p{N}])\\d[\\d\x02]*", lambda m: f" \x01n{m[0]} ", t)
    return [w for w in regex.split("[^\\p{L}\\p{N}\x01\x02]+", t.lower()) if w]


def brute_leaks(docs, items, width=6, coverage=0.5, least=3, literals=3):
    slot = lambda w: w[0] == "\x01"
    shape = lambda ws: tuple(w[:2] if slot(w) else w for w in ws)
    plain = lambda ws: tuple(w[2:] if slot(w) else w for w in ws)
    out = set()
    for item, itext in items:
        t = python_tokens(itext)
        n = min(width, len(t))
        ws = [(k, t[k : k + n]) for k in range(len(t) - n + 1)] if n else []
        weak = [sum(not slot(x) for x in w) < literals for _, w in ws]
        by_shape = [x for x, bad in zip(ws, weak) if not bad]
        raws = ws if len(ws) < least or any(weak) else []
        for doc, text in docs:
            d = python_tokens(text)
            for some, key, exact in ((by_shape, shape, False), (raws, plain, True)):
                by_offset = {}
                for at in range(len(d) - n + 1):
                    for k, w in some:
                        if key(d[at : at + n]) == key(w):
                            hits, slots = by_offset.setdefault(at - k, (set(), set()))
                            hits.add(key(w))
                            slots.update((b, a) for a, b in zip(d[at : at + n], w) if slot(b))
                good = set().union(*(h for h, s in by_offset.values() if exact or len({b for b, _ in s}) == len(s)), set())
                windows = len({key(w) for _, w in some})
                if windows and len(good) >= min(least, windows) and len(good) >= windows * coverage:
                    out.add((doc, item))
    return out


@pytest.mark.parametrize("most", [300_000, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST", most)
    r = np.random.default_rng(6)
    words = [*"the of a train city river takes from to and with before".split(), "Boston", "Paris", "12", "7", "3.5", "km", "hours", "apples"]
    say = lambda n: " ".join(r.choice(words, n)).strip()
    items = [(k, say(int(r.integers(1, 25)))) for k in range(25)] + [(50, "What is 12 plus 7?"), (51, "What is 12 + 34 + 56 + 78 + 90?"), (52, None), (53, ""), (54, "?!")]
    docs = []
    for k in range(120):
        _, t = items[int(r.integers(0, 27))]
        w = t.split()
        for at in r.integers(0, len(w), int(r.integers(0, 3))):
            w[at] = str(r.choice(words))
        docs.append((k, f"{say(int(r.integers(0, 9)))} {' '.join(w)} {say(int(r.integers(0, 9)))}"))
    docs += [(200, "As for what is 12 plus 7? It is 19."), (201, "What is 13 plus 8?"), (202, None), (203, "")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, hash int, t string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(d, b).collect()}
    assert (200, 50) in got and got == brute_leaks(docs, items)
    assert decontamination.leaks(d.limit(0), b).collect() == decontamination.leaks(d, b.limit(0)).collect() == []
