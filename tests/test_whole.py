"""Queries that once did less than the whole job, against brute force on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from touchline.plans import people
from touchline.plans.registry import queries

SF = "/root/testdata/sf0.001"

NAMES = [(1, "en", "anna maria lopez"), (2, "en", "lopez anna maria"), (3, "en", "john smith"), (4, "en", "paul smith jones miller brown"), (7, "en", "john smith"), (10, "fr", "jean petit"), (11, "fr", "xu"), (12, "de", "allein")]


@pytest.fixture(scope="session")
def names(spark):
    return spark.createDataFrame(NAMES, "doc_id long, club string, name string")


def brute_links(rows):
    out = {}
    for i, club, name in rows:
        a, cand = set(name.split()), []
        for o, c, other in rows:
            if o != i and c == club:
                b = set(other.split())
                cand.append((name == other, 1.0 if name == other else len(a & b) / len(a | b) if a and b else 0.0, o, bool({w for w in a & b if len(w) >= 4})))
        if not cand:
            out[i] = (None, 0.0, "none")
            continue
        ex, score, tm, _ = min(cand, key=lambda c: (not c[0], -c[1], c[2]))
        anchored = [c for c in cand if c[3]]
        if ex or score >= 0.34:
            out[i] = (tm, score, "exact" if ex else "token")
        elif len(anchored) == 1:
            best = min(anchored, key=lambda c: (-c[1], c[2]))
            out[i] = (best[2], score, "surname")
        else:
            out[i] = (None, score, "ambiguous" if anchored else "none")
    return out


def test_every_name_is_linked_to_the_others_of_its_club(names):
    pairs = {(r.id, r.other): r.score for r in people.blocked(names, 1).select("id", "other", people.S.set_jaccard(F.col("ta"), F.col("tb")).alias("score")).collect()}
    assert set(pairs) == {(a, b) for a, c, _ in NAMES for b, d, _ in NAMES if a != b and c == d}
    assert pairs[1, 2] == 1 and pairs[3, 4] == pytest.approx(1 / 6)
    got = {r.id: (r.tm_id, pytest.approx(r.score), r.method) for r in people.linked(names, 1).collect()}
    assert got == brute_links(NAMES)


def test_control_grid_covers_all_snapshots(spark):
    snapshots = spark.read.parquet(f"{SF}/orders.parquet").count()
    got = queries()["g05_control_grid"](spark, SF)
    r = got.agg(F.count("*").alias("n"), F.count_distinct("pass_id").alias("ids"), F.max("ix").alias("ix"), F.max("iy").alias("iy")).first()
    assert tuple(r) == (snapshots * 50 * 34, snapshots, 49, 33)
    key, cust = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey", "o_custkey").orderBy("o_orderkey").first()
    at = {(r.ix, r.iy): r.control for r in got.where(F.col("pass_id") == key).collect()}
    for ix, iy in [(0, 0), (17, 20), (49, 33)]:
        x, y = ix * 105 / 49 - 52.5, iy * 68 / 33 - 34
        time = lambda k: 0.7 + math.hypot((key * 31 + k * 97) % 1050 / 10 - 52.5 - x, (cust * 17 + k * 61) % 680 / 10 - 34 - y) / 5
        own, other = min(map(time, range(3, 21, 2))), min(map(time, range(2, 21, 2)))
        assert at[ix, iy] == pytest.approx(1 / (1 + math.exp(-(other - own) / 0.45)), abs=2e-6)


def test_scans_without_a_filter_of_their_own(spark):
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    got = queries()["s17_all_passes"](spark, SF)
    assert got.count() == lines.count() and got.select("team").distinct().count() == lines.selectExpr("l_suppkey % 18 t").distinct().count()
    labels = {r.tiebreak: r.label for r in queries()["f06_formats"](spark, SF).collect()}
    assert set(labels) == {r.o_orderkey for r in orders.select("o_orderkey").collect()}
    for r in orders.limit(20).collect():
        assert float(labels[r.o_orderkey][:-1]) == pytest.approx(float(r.o_totalprice) / 1000, abs=0.051) and labels[r.o_orderkey][-1] == "k"


def test_date_range_with_an_equality(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_custkey", "o_orderkey", "cast(cast(o_orderdate as date) as string) day", "o_orderpriority").collect()
    want = sorted((r.o_custkey, r.o_orderkey) for r in rows if "1996-01-01" <= r.day <= "1996-06-30" and r.o_orderpriority == "1-URGENT")
    assert want and sorted(map(tuple, queries()["p16_date_range"](spark, SF).collect())) == want


def test_every_name_is_normalised_whole(spark):
    d = spark.createDataFrame([(1, "en", "Łukasz Piszczek"), (2, "de", "Weiß, Öl–Bär"), (3, "ru", "Лев Яшин"), (4, "ja", "中田 英寿!"), (5, "en", None)], "doc_id long, club string, name string")
    got = {r.id: r.norm for r in people.named(d).collect()}
    assert got == {1: "łukasz piszczek", 2: "weiß ol bar", 3: "лев яшин", 4: "中田 英寿", 5: ""}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    norm = {r.id: r.norm for r in queries()["f01_normalize_name"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(norm) == set(texts)
    plain = {i: t for i, t in texts.items() if t.isascii()}
    assert plain and all(norm[i] == " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for i, t in plain.items())
