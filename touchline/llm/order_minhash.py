"""Document fingerprints by Order MinHash.

DataFrame operations only. A text of any length is a sequence of tokens: its words, and the characters of words of over
LONG characters (scripts without blanks). What a token is depends on its word alone, so texts of all lengths share
sketches. Both ends are padded, so that texts under K tokens have k-mers in common too. Each k-mer of tokens is numbered
among its equals, so that repeats differ, and hashed. The hash circle is cut at SKETCHES points; the sketch of a point is
the LENGTH least numbered k-mers after it, put back into text order and hashed as a tuple. So both the set of k-mers and
their order tell. The likeness of two fingerprints is the share of equal sketches (0 to 1). One circle stands for SKETCHES
permutations: each tuple is a random one, but those of a text of few k-mers are often the same.

Null text: as an empty one; its fingerprint is that of no k-mer, equal only to that of texts without a token. Equal texts
have equal fingerprints. Repeated rows and equal doc_ids: each row on its own, in the order of (doc_id, hash of the text,
text); a null doc_id comes first. The last document is followed by the first, a single one by itself. Extra columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, let, parts

SKETCHES, LENGTH, K, LONG = 32, 2, 3, 24
#: Bits of an element that hold its position; the others hold its hash.
PLACE = 28


def tokens(text: Column) -> Column:
    """Words of a text; long words as their characters."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    pieces = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(F.length(w) > LONG, F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))))
    return let(words, lambda ws: F.when(F.exists(ws, lambda w: F.length(w) > LONG), pieces(ws)).otherwise(ws))


def packed(h: Column, place: Column) -> Column:
    """Hash and position as one number that sorts by the hash."""
    return F.shiftleft(F.shiftright(h, PLACE), PLACE).bitwiseOR(place.cast("long"))


def kmers(t: Column) -> Column:
    """Sorted array of (hash of a k-mer, position) of an array of tokens."""
    # a start is '', an end is null, which changes nothing: no token is ''
    at = lambda i, j: F.get(t, i + j) if j == 0 else F.when(i + j < 0, F.lit("")).otherwise(F.get(t, i + j))
    one = lambda i: F.xxhash64(*(at(i, j) for j in range(1 - K, 1)))
    n = F.size(t) + (K - 1)
    return F.when(F.size(t) > 0, F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: packed(one(i), i)))).otherwise(F.array().cast("array<bigint>"))


def numbered(a: Column) -> Column:
    """Sorted array of (hash of k-mer and number among its equals, position), from a sorted array of k-mers."""
    mask = F.lit((1 << PLACE) - 1)
    hash_at = lambda i: F.shiftright(F.get(a, i), PLACE)
    n = F.size(a)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (hash_at(i) != hash_at(i - 1)))
    runs = let(first, lambda s: F.flatten(F.transform(s, lambda b, j: F.transform(F.sequence(b, F.coalesce(F.get(s, j + 1), n) - 1), lambda i: packed(F.xxhash64(hash_at(i), i - b), F.get(a, i).bitwiseAND(mask))))))
    return F.when(n > 0, F.sort_array(runs)).otherwise(a)


def sketches(e: Column) -> Column:
    """The tuples' hashes, one a point of the circle, from the sorted array of numbered k-mers."""
    n = F.size(e)
    width = 2**64 // SKETCHES
    bin_of = lambda i: F.shiftright(F.get(e, i), 64 - (SKETCHES - 1).bit_length()) + SKETCHES // 2
    mask = F.lit((1 << PLACE) - 1)
    assert width * SKETCHES == 2**64 and LENGTH == 2
    # where each bin begins; a bin without elements takes the next one's
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (bin_of(i) != bin_of(i - 1)))
    pairs = let(begins, lambda s: F.transform(s, lambda i: F.struct(bin_of(i).alias("b"), i.alias("i"))))
    hashed = lambda x: F.shiftright(x, PLACE)
    place = lambda x: x.bitwiseAND(mask)

    def sketch(i):
        a, b = F.get(e, i), F.get(e, (i + 1) % n)
        return F.when(n == 1, F.xxhash64(hashed(a))).when(place(a) < place(b), F.xxhash64(hashed(a), hashed(b))).otherwise(F.xxhash64(hashed(b), hashed(a)))

    made = let(pairs, lambda p: let(F.transform(p, lambda x: sketch(x["i"])), lambda v: F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda b: F.get(v, F.size(F.filter(p, lambda x: x["b"] < b)) % F.size(p)))))
    return F.when(n > 0, F.transform(made, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.array_repeat(F.lit(0).cast("long"), SKETCHES))


def fingerprint(text: Column) -> Column:
    """The sketches of a text as array<bigint> of unsigned 32-bit numbers."""
    return let(tokens(F.coalesce(text, F.lit(""))), lambda x: let(kmers(x), lambda a: let(numbered(a), sketches)))


def as_string(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(SKETCHES))


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, h (a hash of the text) and bucket: ascending ranges of (doc_id, h), bounded by quantiles of doc_id.

    Null doc_ids come first. A doc_id that would fill several buckets has several, by h.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts, rows, nulls = docs.select(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], max(10_000, 20 * buckets)) if buckets > 1 else F.lit(None), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    cuts = sorted(cuts or [])
    first = -(-nulls * buckets // max(1, rows))  # buckets of null doc_ids
    least = sorted({c: cuts.index(c) for c in cuts}.items())  # each cut, and how many are below it

    # the number of cuts below doc_id, by halving
    def rank(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(least[lo][1] if lo < len(least) else len(cuts))
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= F.lit(least[mid][0]), rank(lo, mid)).otherwise(rank(mid + 1, hi))

    part = lambda n: F.shiftright((F.shiftright("h", 32) + F.lit(1 << 31)) * n, 32)
    many = {c: cuts.count(c) for c, _ in least if cuts.count(c) > 1}
    share = F.element_at(F.create_map(*(F.lit(x) for kv in many.items() for x in kv)), F.col("doc_id")) if many else F.lit(1)
    place = rank(0, len(least)) if len(least) <= 256 else F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))), F.lit(0))
    bucket = F.when(F.col("doc_id").isNull(), part(F.lit(max(1, first)))).otherwise(first + place + part(F.coalesce(share, F.lit(1)).cast("long")))
    return docs.withColumn("bucket", bucket.cast("int"))


def with_heads(docs: DataFrame) -> DataFrame:
    """`docs` with head (false), and the first row of each bucket once more at the end of the bucket before (head: true)."""
    least = docs.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("x"))
    order = Window.orderBy("bucket")  # one row a bucket
    least = kept(least.select("bucket", F.col("x.doc_id").alias("first_id"), F.col("x.h").alias("first_h"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("before")), "heads")
    # a few dozen bytes a bucket
    same = docs.join(F.broadcast(least.withColumnRenamed("bucket", "b")), (F.col("bucket") == F.col("b")) & (F.col("h") == F.col("first_h")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = same.groupBy(F.col("before").alias("bucket")).agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("h"), "bucket", F.lit(True).alias("head"))
    return docs.withColumn("head", F.lit(False)).unionByName(heads)


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row: the edited
    text has its last floor(n_chars / 4) characters replaced by the first as many of the next document.

    Rows are dealt out once, by ranges of doc_id; only each range's first text goes on to the range before it.
    """
    buckets = buckets or 4 * parts(docs.sparkSession)
    own = with_heads(in_order(docs.withColumn("doc_id", F.col("doc_id").cast("long")), buckets)).withColumn("sketch", fingerprint(F.col("text")))
    by = Window.partitionBy("bucket").orderBy("head", F.col("doc_id").asc_nulls_first(), "h", "text")
    both = own.withColumn("next", F.lead(F.struct("text", "sketch")).over(by)).where("not head")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("next.text"), F.lit(1), cut))
    both = both.select("doc_id", n.alias("n_chars"), "sketch", edited.alias("edited"), likeness(F.col("sketch"), F.col("next.sketch")).alias("near_next"))
    both = both.select("*", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_sketch")).drop("edited")
    return both.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), "near_next")
