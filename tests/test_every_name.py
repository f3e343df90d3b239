"""Queries that take every name, not only those whose id is divisible by 50, against their SQL and brute force."""

import duckdb
import pytest

from touchline.plans.registry import oracle_sql, queries

TEXTS = ["anna maria lopez", "lopez anna maria", "john smith", "paul smith jones miller brown", "john smith", "a b", "jean petit", "xu", "", "Ünal smith john b"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("names"))
    rows = [(i, TEXTS[i % 10] + (f" w{i % 7}" if i % 3 else ""), [None, "en", "de", "fr"][(i % 31 > 1) * (1 + i % 3)]) for i in range(1, 121)] + [(121, "alone", "xx"), (122, None, "en"), (123, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{where}/documents.parquet")
    return where


@pytest.mark.parametrize("name", ["c12_link_audit", "f02_token_jaccard", "t04_lowest_confidence", "u03_token_sets"])
def test_every_name_is_asked(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in queries()[name](spark, folder).collect()]
    flat = lambda rows: [tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows]
    ordered = name[0] in "ct"
    assert flat(got) == flat(want) if ordered else sorted(flat(got)) == sorted(flat(want))
    assert any(r[0] % 50 for r in got)
    if not ordered:
        assert {r[0] for r in got} == set(range(1, 124)) - {121}
