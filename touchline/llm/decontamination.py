"""Benchmark decontamination by template canonicalisation.

DataFrame operations only. Numbers, units after numbers and names (capitalised words within a sentence) become typed
placeholders; the other words are lower-cased. Windows of `width` tokens of texts and items are hash-joined on their
template, so that a question put with other numbers or names is still found. The values that stand in the slots are
then held together: within one alignment of a text and an item each value of the item must stand for one value of the
text. An item counts as leaked where consistent windows cover at least `coverage` of its windows, and at least
`least` windows (all, if it has fewer).

Windows with fewer than `literals` plain words can't be told from chance by their template: an item that has such a
window, or fewer than `least` windows, is also searched by all its windows of raw tokens, so that its numbers and names
must be equal. An item under `width` tokens is one window; an item of one word is thus found wherever that word stands.

Null and empty texts and items, and empty tables: no row. Texts or items that repeat: rows with equal ids count as one.
Very long texts are searched whole, in all their windows. Every item that is leaked is a row, so that there are no ties.
Extra columns are ignored, whatever their names. The windows of the items are broadcast only up to MOST rows; beyond, both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Rows of item windows that are still broadcast.
MOST = 300_000
#: Units, in the singular and plural spellings of the languages at hand.
UNITS = "mm|cm|dm|m|km|in|ft|yd|mi|mg|g|kg|t|lb|lbs|oz|ml|cl|l|s|ms|h|hr|hrs|min|kw|w|v|a|hz|kb|mb|gb|tb|percent|pct|meters?|metres?|kilometers?|kilometres?|miles?|feet|foot|inches|inch|grams?|kilograms?|kilos?|tons?|tonnes?|pounds?|ounces?|liters?|litres?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|degrees?|jours?|heures?|ans|tage?|stunden?|jahre?|horas?|dias?|años?"
NUMBER, UNIT, NAME, POINT = "\x01n", "\x01u", "\x01p", "\x02"


def tokens(text: Column) -> Column:
    """Tokens of a text; placeholders are marked and keep what they stand for."""
    t = F.regexp_replace(text, "[\\x01\\x02]", " ")
    t = F.regexp_replace(t, f"(?<=\\d ?)(?i:({UNITS}))(?![\\p{{L}}\\p{{N}}])", f" {UNIT}$1 ")
    t = F.regexp_replace(t, "(?<=[\\p{Ll},;] )\\p{Lu}\\p{L}*", f"{NAME}$0")
    t = F.regexp_replace(t, "(?<=\\d)[.,](?=\\d)", POINT)
    t = F.regexp_replace(t, f"(?<![\\p{{L}}\\p{{N}}])\\d[\\d{POINT}]*", f" {NUMBER}$0 ")
    return F.filter(F.split(F.lower(t), f"[^\\p{{L}}\\p{{N}}\\x01{POINT}]+"), lambda w: w != "")


def is_slot(w: Column) -> Column:
    return w.startswith("\x01")


def template(words: Column) -> Column:
    """Hash of each token, of a placeholder's type alone."""
    return F.transform(words, lambda w: F.xxhash64(F.when(is_slot(w), F.substring(w, 1, 2)).otherwise(w)))


def raw(words: Column) -> Column:
    """Hash of each token as it stands, without the mark of a placeholder: that depends on what is before it."""
    return F.transform(words, lambda w: F.xxhash64(F.when(is_slot(w), F.substring(w, 3, 1 << 30)).otherwise(w)))


def windows(df: DataFrame, key: str, kinds: list[tuple[int, bool]]) -> DataFrame:
    """`key`, t, at, hash of every window of the texts, for each kind (tokens of a window, whether raw)."""
    t = df.select(key, tokens(F.col("text")).alias("t"))
    some = F.array().cast("array<bigint>")
    t = t.select(key, "t", *((f("t") if any(e == exact for _, e in kinds) else some).alias(c) for c, f, exact in (("c", template, False), ("r", raw, True))))
    least = min(n for n, _ in kinds)
    t = t.select(key, "t", "c", "r", F.explode(F.when(F.size("t") >= least, F.sequence(F.lit(0), F.size("t") - least))).alias("at"))
    hashed = lambda n, exact: F.when(F.col("at") + n <= F.size("t"), window_hash(F.lit(n), F.lit(exact), [F.get("r" if exact else "c", F.col("at") + k) for k in range(n)]))
    # explode() of few values: they are computed once, and no filter is pushed into it
    return t.select(key, "t", "at", F.explode(F.array(*(hashed(n, e) for n, e in kinds))).alias("hash"))


def window_hash(n: Column, exact: Column, hashes: list[Column]) -> Column:
    """Nulls at the end change nothing."""
    return F.xxhash64(n, exact, *hashes)


def item_windows(items: DataFrame, width: int, least: int, literals: int) -> DataFrame:
    """item_id, item_at, n (tokens), exact, item_words, hash of all windows that the texts are searched for."""
    t = items.select("item_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    n = F.least(F.size("t"), F.lit(width))
    t = t.select("item_id", n.alias("n"), F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.struct(i.alias("at"), F.slice("t", i + 1, n).alias("words"))).alias("ws"))
    enough = lambda w: F.size(F.filter(w["words"], lambda x: ~is_slot(x))) >= literals
    as_kind = lambda ws, exact: F.transform(ws, lambda w: F.struct(w["at"].alias("at"), w["words"].alias("words"), F.lit(exact).alias("exact")))
    by_template = as_kind(F.filter("ws", enough), False)
    t = t.select("item_id", "n", F.explode(F.concat(by_template, F.when((F.size("ws") < least) | F.exists("ws", lambda w: ~enough(w)), as_kind(F.col("ws"), True)).otherwise(F.slice(as_kind(F.col("ws"), True), 1, 0)))).alias("w"))
    t = t.select("item_id", F.col("w.at").alias("item_at"), "n", F.col("w.exact").alias("exact"), F.col("w.words").alias("item_words"))
    h = F.when(F.col("exact"), raw(F.col("item_words"))).otherwise(template(F.col("item_words")))
    return t.withColumn("hash", window_hash(F.col("n"), F.col("exact"), [F.get(h, F.lit(k)) for k in range(width)])).distinct()


def leaks(docs: DataFrame, items: DataFrame, width: int = 6, coverage: float = 0.5, least: int = 3, literals: int = 3) -> DataFrame:
    """doc_id, item_id, windows (of the item), matched (consistent, distinct), coverage, slots (values bound) of every leak."""
    w = item_windows(items, width, least, literals)
    kinds = sorted(map(tuple, w.select("n", "exact").distinct().collect())) or [(width, False)]
    per_item = w.groupBy("item_id", "exact").agg(F.count_distinct("hash").alias("windows"))
    n = w.count()
    rows = windows(docs, "doc_id", kinds)
    if n <= MOST:
        hit = rows.join(F.broadcast(w), "hash")
    else:  # rows that are shuffled carry their window alone; a window that very many texts hold is split by the join
        hit = rows.select("doc_id", "at", "hash", F.slice("t", F.col("at") + 1, F.lit(width)).alias("t"), F.lit(0).alias("from")).join(w, "hash")
    words = F.slice("t", (F.col("at") if n <= MOST else F.col("from")) + 1, F.col("n"))
    bound = let(words, lambda ws: F.filter(F.zip_with(ws, F.col("item_words"), lambda a, b: F.when(is_slot(b), F.struct(b.alias("item"), a.alias("text")))), lambda x: x.isNotNull()))
    hit = hit.select("doc_id", "item_id", "exact", (F.col("at") - F.col("item_at")).alias("offset"), "hash", bound.alias("slots"))
    found = hit.groupBy("doc_id", "item_id", "exact", "offset").agg(F.collect_set("hash").alias("hashes"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    values = F.size(F.array_distinct(F.transform("slots", lambda s: s["item"])))
    found = found.where(F.col("exact") | (values == F.size("slots"))).withColumn("values", values)
    found = found.groupBy("doc_id", "item_id", "exact").agg(F.size(F.array_distinct(F.flatten(F.collect_set("hashes")))).alias("matched"), F.max("values").alias("slots"))
    found = found.join(F.broadcast(per_item) if n <= MOST else per_item, ["item_id", "exact"])
    found = found.where((F.col("matched") >= F.least(F.lit(least), "windows")) & (F.col("matched") >= F.col("windows") * coverage))
    # of both ways the one by templates, as it takes other values too
    best = F.min_by(F.struct("windows", "matched", "slots"), "exact").alias("b")
    found = found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
    return found.select("doc_id", "item_id", "windows", "matched", (F.col("matched") / F.col("windows")).alias("coverage"), "slots")
