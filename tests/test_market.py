"""Name links by the token index against all pairs."""

import random

import pytest

from touchline.functions import scalar as S
from touchline.operators import market


def brute(players, rows, least=0.34, same=False):
    out, clubs = {}, {c for _, _, c, _ in rows if c is not None}
    for i, norm, club in players:
        pool = [r for r in rows if club not in clubs or r[2] == club]
        a, found = set(norm.split()), []
        for tm, other, _, order in pool:
            if not (same and tm == i):
                b = set(other.split())
                found.append((norm != other, -(len(a & b) / len(a | b) if a and b else 0.0), order, tm, any(len(w) >= 4 for w in a & b)))
        exact = [f for f in found if not f[0]]
        best = min(found, default=None, key=lambda f: f[1:3])
        near = [f for f in found if f[4]]
        if exact:
            out[i] = (min(exact, key=lambda f: f[2])[3], 1.0, "exact")
        elif best and -best[1] >= least:
            out[i] = (best[3], -best[1], "token")
        else:
            out[i] = (near[0][3] if len(near) == 1 else None, -best[1] if best else 0.0, "surname" if len(near) == 1 else "ambiguous" if near else "none")
    return out


def names(r, n, long=False):
    words = ["de", "al", "o", "maria", "jose", "anna", "silva", "lopez", "miller", "smith", "jones", "petit"] + [f"{a}{b}" for a in ("kov", "sen", "berg", "ton") for b in ("acs", "sson", "er", "y", "ic")]
    return [" ".join(r.choices(words, k=r.choice([0, 1, 2, 2, 3, 4] + [25] * long))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(1000 + k, n, r.choice(["a", "b", "c", None]), k) for k, n in enumerate(names(r, 300, True) + ["maria silva"] * 60)]
    players = [(k, n, r.choice(["a", "b", "c", "no squad", None])) for k, n in enumerate(names(r, 120, True) + ["nobody xyzzy"] + [x[1] for x in rows[:10]])]
    got = market.link_players(spark.createDataFrame(players, "id long, norm string, club string"), spark.createDataFrame(rows, "tm_id long, tm_norm string, club string, ord long"))
    assert {x.id: (x.tm_id, pytest.approx(x.score), x.method) for x in got.collect()} == brute(players, rows)
    assert {x.method for x in got.collect()} >= {"exact", "token", "none"}


def test_links_within_one_table_equal_all_pairs(spark):
    r = random.Random(7)
    rows = [(k, n, r.choice(["a", "b"]), k) for k, n in enumerate(names(r, 150) + ["ana de sousa"] * 4 + ["rare wordle", "onlyone here", "twice here", "twice there wordless more than enough words in a name"])]
    players = [x[:3] for x in rows]
    got = market.link_players(spark.createDataFrame(players, "id long, norm string, club string"), spark.createDataFrame(rows, "tm_id long, tm_norm string, club string, ord long"), same=True)
    assert {x.id: (x.tm_id, pytest.approx(x.score), x.method) for x in got.collect()} == brute(players, rows, same=True)


def test_nobody_and_nothing(spark):
    rows = spark.createDataFrame([(1, "anna", "a", 1)], "tm_id long, tm_norm string, club string, ord long")
    players = spark.createDataFrame([(5, "anna", "a"), (6, "", "a")], "id long, norm string, club string")
    assert market.link_players(players.limit(0), rows).collect() == []
    assert {tuple(x) for x in market.link_players(players, rows.limit(0)).collect()} == {(5, None, 0.0, "none"), (6, None, 0.0, "none")}


def test_names_of_every_script(spark):
    some = ["Łukasz Piszczek", "İlkay GÜNDOĞAN", "Weiß, Öl–Bär_x", "Лев Яшин", "中田 英寿!", "ﬁn ½ ²", "a\u0301 e", "", None, "Σίσυφος"]
    import unicodedata

    def one(s):
        folded = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c.isalnum() else " " for c in folded).split())

    got = spark.createDataFrame(list(enumerate(some)), "i int, n string").select("i", S.normalize_name("n").alias("v")).collect()
    assert {r.i: r.v for r in got} == {i: one(s) for i, s in enumerate(some)}
