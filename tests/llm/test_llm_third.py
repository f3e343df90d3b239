"""Token alignment, exact top-k search and conversation repair against brute force, and their odd inputs."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from touchline.llm import conversation_repair as repair
from touchline.llm import html_extraction, jaccard_join, language_id, queries, token_counts, token_files
from touchline.llm import token_alignment as alignment
from touchline.llm import topk_search as search
from touchline.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- token alignment


def tokens(text):
    """Ids and byte strings of both tokenizers over the whole text; none where they don't read as space+text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters = alignment.byte_letters()

    def both(text):
        if not text:
            return [], []
        ea = a.encode(" " + text, add_special_tokens=False)
        xa = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ea.ids]
        xb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (xa, xb) if b"".join(x for _, x in xa) == whole == b"".join(x for _, x in xb) else ([], [])

    return both(text) if not isinstance(text, list) else [both(t) for t in text]


def brute_alignment(docs):
    each, count = [], Counter()
    for (_, text), (xa, xb) in zip(docs, tokens([t for _, t in docs])):
        ends = [list(itertools.accumulate(len(x) for _, x in xs)) for xs in (xa, xb)]
        meet = sorted(set(ends[0]) & set(ends[1]))
        groups, pairs, before = [], [], 0
        for m in meet:
            ga = [i for (i, _), e in zip(xa, ends[0]) if before < e <= m]
            gb = [i for (i, _), e in zip(xb, ends[1]) if before < e <= m]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            pairs.append((ga[-1], gb[-1]))
            before = m
        count.update(pairs)
        each.append((len(xa), len(xb), groups, pairs))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted((d is not None, d or 0, na, nb, len(g), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (d, _), (na, nb, g, p) in zip(docs, each))


def rows_of(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ODD = ["", None, " ", "  ", "a", "a ", " a", "a  b", "a\n b", "a \nb", "\n", "\r\n x\r\n", "x  y", "x  y", "!\x1c x", "﷐ stand in ﷐", "mark ▁ here", "<|endoftext|> and <s> </s> <unk> <0x41>", "a\x00b \x00", "don't we'll I'M", "日本語 テキスト です", "é ́ é", "🙂🙃 🙂", "x" * 12_000, "ab " * 9_000, "  lead and trail  ", "​ zero ‍ width", "1234 5678,90 €"]


def test_alignment_equals_brute_force(spark):
    r = random.Random(3)
    docs = list(enumerate(ODD)) + [(7, "a"), (None, "null id"), (None, "null id")]
    docs += [(100 + k, "".join(r.choice(["a", "the", " ", "  ", "\n", "\t", "ß", "é", "'s", ".", "12", "　", "▁" if r.random() < 0.02 else "z", "🙂"]) for _ in range(r.randint(1, 60)))) for k in range(150)]
    given = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, segment string, n long").repartition(3)
    want = brute_alignment(docs)
    assert rows_of(alignment.align(given)) == want
    assert rows_of(alignment.align(given, chunk_bytes=300)) == want


def test_alignment_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op11_token_alignment(spark, SF)) == brute_alignment(docs)


def test_alignment_of_an_empty_table_and_int_ids(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert rows_of(alignment.align(spark.createDataFrame([(5, "one two")], "doc_id int, text string")))[0][:2] == (True, 5)


def test_every_character_reads_back(spark):
    """The rule by which texts have no tokens: only the mark reads as another text."""
    t = alignment.tokenizers(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert t.apart
    some = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xA100), 0xFEFF, 0xFFFD, 0xFFFE, 0xFDD0, 0x1F600, 0x10FFFF]]
    for c in some:
        a, b = t.encode(["q" + c + "r"])
        text = f" q{c}r".encode()
        assert b"".join(t.bytes_a[i] for i in a) == text
        assert (b"".join(t.bytes_b[i] for i in b) == text) == (c != "▁")


# ---------------------------------------------------------------- exact top-k search


def brute_search(rows, every=100, k=10):
    fine = [(i, [int(np.floor(np.float64(c) * 1024)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for n, (i, q) in enumerate(fine):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for m, (j, v) in enumerate(fine) if m != n)
            out += [(i, rank, j, min(max(-s, -(2**63)), 2**63 - 1)) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_search_of_embeddings_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op12_topk_search(spark, SF).collect())) == brute_search(rows)


def test_search_of_odd_vectors(spark, monkeypatch):
    r = random.Random(5)
    inf, nan = float("inf"), float("nan")
    rows = [(k, [r.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(6)]) for k in range(0, 900)]  # many ties
    rows += [(5000 + k, [0.5] * 6) for k in range(700)] + [(200, [0.5] * 6), (200, [0.5] * 6), (300, [0.0] * 6)]
    rows += [(1000, None), (1100, [None, 1.0]), (1200, [nan]), (1300, [inf, 1.0]), (None, [1.0] * 6), (1400, []), (1500, [2.0]), (1600, [1.0] * 9), (-100, [-1.0, 3e5, 1.0])]
    given = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score long").repartition(4)
    want = brute_search(rows)
    assert sorted(map(tuple, search.search(given).collect())) == want
    assert search.search(given.limit(0)).collect() == []


def test_search_beyond_whole_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (100, [-1e30, 2.0]), (1, [5.0, 1.0]), (2, [3e-3, -7.5])]
    got = sorted(map(tuple, search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    cut = [(i, [min(max(int(np.floor(c * 1024)), -(2**63)), 2**63 - 1) for c in v]) for i, v in rows]
    want = []
    for i, q in cut:
        if i % 100 == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(q, v)), -(2**63)), 2**63 - 1), j) for j, v in cut if j != i)
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    assert got == sorted(want)


def test_the_bound_holds_the_best_rows():
    """Whatever the spread of components, the k best rows are among those that the slices leave."""
    r = np.random.default_rng(1)
    for spread in (1, 40, 3000, 10**9):
        v = np.rint(r.standard_normal((3000, 17)) * spread).astype(np.int64)
        v[:, 3] *= 50
        block = search.Block(np.arange(3000), v, *search.slice_up(v))
        left = []
        for q in v[:40]:
            best = set(np.argsort(-(v.astype(object) @ q.astype(object)).astype(float), kind="stable")[:10].tolist())
            near = block.near(q, block.rows, 10)
            left.append(len(near))
            scores = v.astype(object) @ q.astype(object)
            assert min(scores[list(best)]) <= min(sorted(scores[near], reverse=True)[:10])
        assert spread < 40 or np.mean(left) < 1500  # the slices do sort rows out


# ---------------------------------------------------------------- conversation repair


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if mark == 1 else "".join(c for c in text if c not in ".!?") if mark == 2 else text
        out += [(conv, turn, "user" if mark == 4 else role, text)] * (0 if mark == 0 else 2 if mark == 3 else 1)
    return out


def fits(initials):
    s = "".join(initials)
    s = s[1:] if s.startswith("s") and len(s) > 1 else s
    return s == "ua" * (len(s) // 2)


def brute_repair(rows):
    """All edits of one conversation's rows in order, up to a cost that some edit reaches."""
    white, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        body = text.rstrip(white)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    extra = {k: 3 if f == "truncated" else 0 for k, f in enumerate(faults)}
    best = None

    def walk(k, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows):
            if fits(x[0][:1] or "?" for x in out) and (not best or (cost, audit) < best[:2]):
                best = (cost, audit, list(out))
        else:
            _, role, text = rows[k]
            walk(k + 1, cost + 4, audit + "D", out)
            if faults[k] not in ("blank", "duplicate"):
                walk(k + 1, cost + extra[k], audit + "K", [*out, (role, text)])
                for to in ("user", "assistant"):
                    walk(k + 1, cost + 3 + extra[k], audit + "R", [*out, (to, text)])
        if not audit.endswith("II"):
            for to in ("user", "assistant"):
                walk(k, cost + 3, audit + "I", [*out, (to, "")])

    walk(0, 0, "", [])
    turns = sorted({t for t, _, _ in rows if t is not None})
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in best[2]).encode()).hexdigest()
    return (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], digest)


def brute_conversations(rows):
    after, out = defaultdict(list), []
    for conv, *row in damaged(rows):
        after[conv].append(tuple(row))
    for conv in {r[0] for r in rows}:
        own = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out.append((conv, *brute_repair(own)))
    return sorted(out, key=str)


def conversations():
    r = random.Random(11)
    texts = ["Yes.", "No", " ", "", None, "Why?", "\t\n", "ok. ", "Ja!", "long text with no end"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", None, ""]
    rows = [(c, r.choice([None, 1, 2, 3, 4, 5, 9]), r.choice(roles), r.choice(texts)) for c in [*range(150), None] for _ in range(r.randint(1, 5))]
    return rows + [(c, t, ("user", "assistant")[t % 2], f"turn {t}.") for c in range(200, 230) for t in range(6)] + [(500, 1, "user", "same.")] * 5


@pytest.mark.parametrize("bits", [repair.SEGMENT_BITS, 1, 0])
def test_repair_equals_brute_force(spark, bits):
    rows = conversations()
    given = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    got = sorted(map(tuple, repair.repair(repair.damage(given), given, bits).collect()), key=str)
    assert got == brute_conversations(rows)


def test_repair_as_sql(spark):
    rows = conversations()
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for table, df in ((given.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}), given), (spark.read.parquet(f"{SF}/conversations.parquet").toPandas(), spark.read.parquet(f"{SF}/conversations.parquet"))):
        con = duckdb.connect()
        con.register("conversations", table)
        got = sorted(map(tuple, repair.repair(repair.damage(df), df).collect()), key=str)
        assert sorted(con.execute(repair.SQL).fetchall(), key=str) == got


def test_a_long_conversation_and_an_empty_table(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"text {t % 40}" + "." * (t % 2) + "x" * (30_000 if t == 77 else 0)) for t in range(3000)]
    given = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    one, two = (repair.repair(given, given, bits).collect() for bits in (13, 5))
    assert one == two and len(one) == 1 and one[0].duplicate > 2800 and len(one[0].audit) >= 3000
    assert repair.repair(given.limit(0)).collect() == []


def test_conversations_without_rows_stay(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair(repair.damage(given), given).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_ids_survive_as_they_are(spark):
    """A conv_id may be of any type."""
    key = base64.b64encode(b"any").decode()
    given = spark.createDataFrame([(key, 0, "user", "Hello."), (key, 1, "assistant", "Yes.")], "conv_id string, turn long, role string, text string")
    got = repair.repair(given).collect()
    assert (got[0].conv_id, got[0].cost, got[0].audit) == (key, 0, "KK")


# ---------------------------------------------------------------- main text of pages


PROSE = "The council met on Tuesday to discuss the new bridge over the river, which has been closed since the flood of last spring."


def test_what_is_around_a_text_counts_more_than_its_length():
    w = html_extraction.train()
    cases = {
        f"<body><h1>Head</h1><p>{PROSE}</p><aside><p>Side text.</p></aside></body>": f"Head\n{PROSE}",
        f"<body><p>{PROSE}</p><aside><p>Side text.</p></aside></body>": PROSE,
        f"<article><p>{PROSE}</p><div class='ad'><p>Buy our stuff now.</p></div><p>{PROSE}</p></article>": f"{PROSE}\n{PROSE}",
        f"<article><p>{PROSE}</p><aside><p>{PROSE}</p><p>{PROSE} {PROSE}</p></aside></article>": PROSE,
        f"<div><p>{PROSE}</p></div><div><a>Home</a> <a>News</a></div>": PROSE,
        "<article><p>The sign © stands for copyright.</p></article>": "The sign © stands for copyright.",
        "plain text": "plain text",
    }
    for page, text in cases.items():
        assert html_extraction.extract_all([page], w) == [text], page


def written_pages(n, seed):
    """Pages of a newspaper, a blog, a manual, a shop's magazine and a page without containers, with their main texts."""
    r = random.Random(seed)
    subjects, verbs, objects = "The mayor|Our team|A visitor|The old engine|Every reader|My neighbour|The committee|Nobody".split("|"), "opened|described|repaired|forgot|measured|painted|sold|carried".split("|"), "the gate behind the station|two boxes of apples|a report on the harbour|the longest road in the county|his first letter|an unusual kind of clock|their plans for the summer".split("|")
    sentence = lambda: f"{r.choice(subjects)} {r.choice(verbs)} {r.choice(objects)}{r.choice(['', ', as expected', ' in ' + str(r.randint(1900, 2020)), ' &amp; more'])}."
    plain = lambda t: t.replace("&amp;", "&")
    title = lambda: " ".join(r.sample("Bridge Harbour Market Garden Winter Music Letters Engine Trade".split(), r.randint(1, 4)))

    def text(k):
        return " ".join(sentence() for _ in range(k))

    def body():
        parts = [(f"<h1>{(t := title())}</h1>", t)]
        for _ in range(r.randint(2, 7)):
            t = text(r.randint(1, 5))
            kind = r.random()
            parts.append((f"<p>{t}</p>", plain(t)) if kind < 0.7 else (f"<h2>{(h := title())}</h2>", h) if kind < 0.8 else (f"<ul><li>{t}</li><li>{t}</li></ul>", plain(t) + "\n" + plain(t)) if kind < 0.9 else (f"<blockquote><p>{t}</p></blockquote>", plain(t)))
        return parts

    def menu(k=5):
        return "<ul>" + "".join(f'<li><a href="/{i}">{title()}</a></li>' for i in range(k)) + "</ul>"

    noise = [
        lambda: f'<aside class="related"><h3>Read also</h3>{menu(3)}</aside>', lambda: f'<div class="advertisement"><p>{text(1)}</p></div>', lambda: f'<div id="sidebar"><h4>Popular</h4><p>{text(1)}</p>{menu(4)}</div>',
        lambda: f'<div class="newsletter-signup"><p>{text(1)}</p><form><input name=mail><button>Send</button></form></div>', lambda: f'<div class="share-buttons"><a>Mail</a> <a>Print</a></div>', lambda: f"<aside><p>{text(3)}</p></aside>",
    ]

    def page():
        parts = body()
        core = "".join(h + (r.choice(noise)() if r.random() < 0.12 else "") for h, _ in parts)
        main = "\n".join(t for _, t in parts)
        top = f'<header class="masthead"><a href="/">{title()}</a><nav class="main-nav">{menu()}</nav></header>'
        foot = f'<footer><p>&copy; 2021 {title()}. {text(1)}</p>{menu(3)}</footer>'
        talk = f'<section id="comments"><h2>Comments</h2><div class="comment"><p>{text(2)}</p></div><div class="comment"><p>{text(1)}</p></div></section>' if r.random() < 0.5 else ""
        cookie = f'<div class="cookie-banner"><p>{text(1)}</p><button>Accept</button></div>' if r.random() < 0.3 else ""
        side = r.choice(noise)()
        layout = r.choice([
            f"{cookie}{top}<main><article>{core}</article>{side}</main>{talk}{foot}", f'{top}<div class="wrapper"><div class="post-content">{core}</div>{side}</div>{talk}{foot}{cookie}',
            f'{cookie}{top}<article class="story"><div class="story-body">{core}</div>{talk}</article>{foot}', f'{top}<div id="content" role="main">{core}</div>{side}{foot}', f"{top}{core}{side}{foot}",
        ])
        return f"<!DOCTYPE html><html lang=en><head><title>{title()}</title><style>p{{}}</style><script>let a = '<p>x</p>';</script></head><body>{layout}</body></html>", main

    return [page() for _ in range(n)]


def test_pages_that_were_written_apart_from_the_training_ones():
    pages = written_pages(300, 4)
    got = html_extraction.extract_all([p for p, _ in pages], html_extraction.train())
    right = sum(a == b for a, (_, b) in zip(got, pages)) / len(pages)
    assert right > 0.95


def test_extraction_ignores_clashing_columns_and_takes_empty_tables(spark):
    given = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}</p></article>", "x", 7), (1, "u", None, "x", 7)], "page_id long, url string, html string, text string, n_chars long")
    got = html_extraction.extract(given).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "", 0), (1, PROSE, len(PROSE))]
    assert html_extraction.extract(given.limit(0)).collect() == []


# ---------------------------------------------------------------- ids of other types


def test_ids_may_be_stored_as_smaller_numbers(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", 7), (2, text, "en", 7), (3, None, "en", 7), (4, "eins zwei drei vier", "de", 7)]
    small, large = (spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, n_tokens long") for kind in ("int", "long"))
    for run in (language_id.identify, token_counts.count_tokens, jaccard_join.join, token_files.round_trip):
        got = run(small)
        assert dict(got.dtypes)["doc_id"] == "bigint"
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, run(large).collect()), key=str)
    assert token_counts.count_tokens(small.limit(0)).collect() == []
