"""Pairs met in blocks against all pairs."""

import math
import random

import pytest

from touchline.operators import models as M
from touchline.operators import order, pairs
from touchline.operators import roles as R


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(pairs, "OTHERS", 16)


def test_word_pairs_in_blocks(spark, small):
    r = random.Random(3)
    word = lambda: r.choice(["a", "de", "silva", "lopez", "common", f"w{r.randrange(40)}", f"rare{r.randrange(200)}"])
    rows = [(k, r.choice("xy"), " ".join(word() for _ in range(r.choice([0, 1, 3, 8, 30])))) for k in range(120)]
    d = spark.createDataFrame(rows, "id long, _pool string, norm string")
    asked, others = d.where("id % 2 = 0"), d.selectExpr("id other", "_pool", "norm other_norm")
    want = {}
    for i, p, n in rows[::2]:
        for j, q, m in rows:
            if p == q and i != j:
                a, b = set(n.split()), set(m.split())
                want[i, j] = (len(a & b), len(a | b), len(a) > 0 < len(b), any(len(w) >= 4 for w in a & b))
    met = lambda work, schema: pairs.met(asked, others, "_pool", "id", "other", work, schema, 20)
    got = met(pairs.every_pair, "id long, other long, score double").collect()
    assert {(x.id, x.other): x.score for x in got} == {k: s / u if both else 0.0 for k, (s, u, both, _) in want.items()} and len(got) == len(want)
    total = lambda i, f: sum(f(v) for (a, _), v in want.items() if a == i)
    sums = met(pairs.sums_of_sets, "id long, met long, shared long, total long").groupBy("id").sum("met", "shared", "total").collect()
    assert {x[0]: tuple(x[1:]) for x in sums} == {i: (total(i, lambda v: 1), total(i, lambda v: v[0]), total(i, lambda v: v[1])) for i, _, _ in rows[::2]}
    near = met(pairs.long_shared, "id long, met long, anchors long").groupBy("id").sum("anchors").collect()
    assert {x[0]: x[1] for x in near} == {i: total(i, lambda v: v[3]) for i, _, _ in rows[::2]}


def test_a_population_of_more_than_a_league(spark):
    d = spark.range(20_001).selectExpr("cast(id as int) player_id", "id % 7 * 1.5D a", "id % 11 * 0.5D b")
    assert R.pair_distances(d, ["a", "b"]).where("p = 7 and q > 19998").count() == 2


def test_quantiles_of_rows_that_are_made_again(spark):
    r = random.Random(1)
    v = sorted(r.gauss(0, 5) for _ in range(501))
    got = order.quantiles(spark.createDataFrame([(x,) for x in v], "d double"), "d", {"h": 0.5}, keep=False).first()
    assert got.h == v[250]


def test_neighbours_in_blocks(spark, small):
    r = random.Random(5)
    at = {k: (r.randrange(8) / 2, r.randrange(8) / 2) for k in range(150)}
    d = spark.createDataFrame([(k, *v) for k, v in at.items()], "player_id int, a double, b double")
    labels = spark.createDataFrame([(k, k % 3) for k in at], "player_id int, label int")
    got = M.nearest_neighbours_accuracy(R.neighbours(d, ["a", "b"], 3), labels, "player_id", "label").first()
    right = 0
    for p in at:
        near = sorted((math.dist(at[p], at[q]), q) for q in at if q != p)[:3]
        votes = [q % 3 for _, q in near]
        right += min(set(votes), key=lambda x: (-votes.count(x), x)) == p % 3
    assert got.n == 150 and got.accuracy == pytest.approx(right / 150)
