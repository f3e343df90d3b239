"""Cases in which the training-data operators once did less than the whole job."""

from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import decontamination, jaccard_join, order_minhash

SF = "/root/testdata/sf0.001"


def test_items_of_numbers_and_short_items_are_found(spark):
    long, short, brief = "What is 12 + 34 + 56 + 78 + 90?", "What is 12 times 7?", "12 km"
    d = [(1, f"so they ask: {long} and more"), (2, "he said What is 12 times 7? to them"), (3, "what is 13 + 34 + 56 + 78 + 90 then"), (4, "What is 15 times 3?"), (5, "it was 12km away"), (6, "it was 13 km away"), (7, None)]
    b = [(1, long), (2, short), (3, brief), (4, None), (5, "")]
    got = decontamination.leaks(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (4, 2), (5, 3)}
    assert len(got) == 4 and all(r.coverage == 1 for r in got)


def test_fingerprints_of_texts_on_both_sides_of_a_length_meet(spark):
    words = [f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "amet", "erat") for b in ("um", "is", "ant", "or", "ius", "em", "us", "at", "it")]
    long = " ".join(words[:36])
    short, blankless = " ".join(words[:30]), "".join(chr(0x4E00 + 7 * k) for k in range(300))
    assert len(short) < 256 < len(long)
    pairs = [(1, long, short), (2, blankless, blankless[:225] + short[:75]), (3, " ".join(words[:9]), " ".join(words[:10]))]
    d = spark.createDataFrame(pairs, "k int, x string, y string")
    got = {r.k: r.v for r in d.select("k", order_minhash.likeness(order_minhash.fingerprint(F.col("x")), order_minhash.fingerprint(F.col("y"))).alias("v")).collect()}
    assert got[1] > 0.4 and got[2] > 0.2 and got[3] > 0
    docs = spark.createDataFrame([(1, long), (2, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.near_edited for r in order_minhash.fingerprints(docs).collect()}[1] > 0.2


def test_repeated_and_missing_ids_lose_no_text(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (6, b), (7, c), (7, c), (None, d), (None, d), (None, "another text without an id"), (9, None), (9, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.join(docs).where("doc_id is not null").collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 7), (9, 7)}
    left = corpus_pipeline.without_copies(spark, docs, SF).collect()
    # each row is a document of its own there
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(1, a), (6, b), (7, c), (9, ""), (0, d), (0, "another text without an id")])
