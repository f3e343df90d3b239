"""N-gram Jaccard join by T-occurrence search.

A document's set is its distinct shingles of SHINGLE words. Documents with equal sets are one class; each class goes on
as one set. Two sets link when 100 * intersection >= PERCENT * union.

1. Shingles are hashed to 64 bits; a set is a sorted array of hashes.
2. A first sieve: of each class the least hashes (all that a link could miss, and `spare` more) are counted over all
   classes. A linked pair shares at least `spare` of them, so a set with fewer shared ones has no link.
3. A second sieve: all hashes of the sets that are left are counted. A set with more hashes of its own than a link allows
   goes; of the others the rarest hashes stay, of which each partner has one among its own (a passage that many
   documents share is never among them unless it is nearly all of a document).
4. Each set is held against one other, the first set of most of its posting lists. What that leaves apart in a list is
   searched, in blocks of bounded size, by those sets alone that are outside the list's largest part.
5. A search is DivideSkip: short postings are merged and counted, long ones probed by binary search (or merged, where
   that costs less), and sets that reach the required overlap are kept. Only links that join two parts are returned,
   so a group of n copies makes n - 1 rows.

Null texts and texts without words have the empty set, and link with nothing. Fewer than SHINGLE words: the whole
sequence is one shingle. Rows with one doc_id are one document: it links with all that one of its rows links with. A
null doc_id is a document of its own, which links as any other. Extra columns are ignored. An empty table gives an
empty result. Very long texts are one set of all their shingles. component_id: the least doc_id reachable (no ties: a
doc_id is one document); null where only rows without a doc_id are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, few_rows, frugal, kept, parts, passing, release, texts_of
from .components import components

SHINGLE, PERCENT = 4, 85
#: Hashes in a block of a list (8 bytes each; a task holds two blocks); blocks into which smaller lists are dealt; sets in
#: the lists of which equal ones are one.
BLOCK, SPREAD, SHORT = 1_000_000, 12, 64
#: From so many rows on, hashes count as equally frequent. One class in SAMPLE tells which hashes are hot.
COUNTED, SAMPLE = 4096, 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
BYTES[65:91] = BYTES[97:123]  # A-Z as a-z


@functools.lru_cache(maxsize=1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, ODD), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text: a polynomial over the bytes of each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    blank = SPACE[raw]
    if len(raw) > PIECE:  # cut at blanks, so that the tables of powers stay small
        cuts = np.flatnonzero(blank)
        cuts = np.unique(cuts[np.minimum(np.searchsorted(cuts, np.arange(PIECE, len(raw), PIECE)), len(cuts) - 1)]) if len(cuts) else cuts
        return np.concatenate([_piece(r, b) for r, b in zip(np.split(raw, cuts), np.split(blank, cuts))])
    return _piece(raw, blank)


def _piece(raw: np.ndarray, blank: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    begin, end = edge[::2], edge[1::2]
    up, down = powers(max(16, int(len(raw)).bit_length()))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[raw] * up[: len(raw)])))
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * ODD + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def required(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    return max(1, n // 20)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - required(n, percent) + spare(n))


def sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, whole: bool = False) -> DataFrame:
    """doc_id, n, set_key (null for the empty set), and the least hashes that are counted, or with `whole` all."""
    import hashlib

    import pyarrow as pa

    def batches(it):
        for b in it:
            for at in range(0, b.num_rows, 400):
                c = b.slice(at, 400)
                s = [shingle_set(t, size) for t in c.column(1).to_pylist()]
                keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in s]
                some = s if whole else [x[: prefix_length(len(x), percent)] for x in s]
                flat = np.concatenate(some).view(np.int64) if some else np.zeros(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(list(map(len, s)), pa.int64()), pa.array(keys, pa.binary()), lists], names=["doc_id", "n", "set_key", "hashes"])

    batch_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(frugal(batches), "doc_id long, n long, set_key binary, hashes array<long>")


# --- search within one task -----------------------------------------------------------------------------------------


class Index:
    """Inverted index of some sets."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = np.array(list(map(len, members)), dtype=np.int64)
        ends = np.cumsum(self.sizes)
        flat = np.concatenate(members)
        order = np.argsort(flat, kind="stable")
        fresh = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
        self.first = np.flatnonzero(fresh)
        self.length = np.diff(np.append(self.first, len(flat)))
        token = np.empty(len(flat), dtype=np.int64)
        token[order] = np.cumsum(fresh) - 1
        self.owner = np.repeat(np.arange(len(members)), self.sizes)[order]
        self.tokens = np.split(token, ends[:-1])  # ascending, as the hashes are

    def merged(self, lists: np.ndarray) -> np.ndarray:
        """How many of the lists hold each member."""
        n = self.length[lists]
        where = np.repeat(self.first[lists] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[where], minlength=len(self.sizes))

    def search(self, q: int, percent: int) -> np.ndarray:
        """Members that link with member q, by DivideSkip."""
        size, t = int(self.sizes[q]), required(int(self.sizes[q]), percent)
        at = self.tokens[q]
        at = at[self.length[at] > 1]
        if len(at) < t:
            return np.zeros(0, dtype=np.int64)
        at = at[np.argsort(self.length[at], kind="stable")]
        skip = min(t - 1, int(t / (0.05 * np.log2(int(self.length[at[-1]])) + 1)))
        short, long = at[: len(at) - skip], at[len(at) - skip :]
        count = self.merged(short)
        rest = np.flatnonzero((count >= t - skip) & (100 * np.minimum(self.sizes, size) >= percent * np.maximum(self.sizes, size)))
        rest = rest[rest != q]
        if len(rest) * 8000 > int(self.length[long].sum()):  # many candidates: to merge the long lists costs less than to probe them
            both = (count + self.merged(long))[rest]
        else:
            long = np.sort(long)
            probe = [int((m[np.minimum(np.searchsorted(m, long), len(m) - 1)] == long).sum()) for m in (self.tokens[c] for c in rest.tolist())]
            both = count[rest] + np.array(probe, dtype=np.int64)
        return rest[100 * both >= percent * (self.sizes[rest] + size - both)]


def forest(ids: list[int], members: list[np.ndarray], queries: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between the queries and all members that join parts not joined before; sets of one part are not compared again."""
    up = list(range(len(ids)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    index = Index(members)
    for q in queries:
        for m in index.search(q, percent).tolist():
            a, b = root(q), root(m)
            if a != b:
                up[a] = b
                out.append((ids[q], ids[m]))
    return out


def search_groups(units: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links a, b within each group of units(grp, id, query), found by its queries; full(id, hashes) has the sets."""
    import pyarrow as pa

    def batches(it):
        now, ids, members, queries, out = None, [], [], [], []

        def flush():
            if len(ids) > 1 and queries:
                out.extend(forest(ids, members, queries, percent))

        for b in it:
            groups, keys, asks = (b.column(k).to_pylist() for k in range(3))
            col = b.column(3)
            for k, g in enumerate(groups):
                if g != now:
                    flush()
                    now, ids, members, queries = g, [], [], []
                    if len(out) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])
                        out = []
                if asks[k]:
                    queries.append(len(ids))
                ids.append(keys[k])
                members.append(col[k].values.to_numpy().view(np.uint64))
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    rows = units.join(full, "id").select("grp", "id", "query", "hashes")
    dealt = rows.repartition(parts(rows.sparkSession), "grp").sortWithinPartitions("grp", "id")
    batch_rows(rows.sparkSession)
    return dealt.mapInArrow(frugal(batches), "a long, b long")


# --- candidates -----------------------------------------------------------------------------------------------------


def hot_hashes(rows: DataFrame, key: str = "id") -> list[int]:
    """Hashes that would fill a good part of a shuffle partition, from the sets of one class in SAMPLE. At most 8 a partition
    on average, so they are few at any size. They only steer where rows go: what is found does not depend on them."""
    n = parts(rows.sparkSession)
    some = rows.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(SAMPLE)) == 0)
    total = some.count()
    most = max(16, total // (8 * n))
    return [r.t for r in some.groupBy("t").count().where(F.col("count") > most).select("t").limit(16 * n).collect()]


def shared(rows: DataFrame, hot: list[int]) -> DataFrame:
    """rows(t, id) whose hash t is in more than one row, and m: how many rows have it, or COUNTED if there are as many.

    One shuffle; a task holds COUNTED rows of a hash at most. Hot hashes are dealt out by id.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    known = np.array(sorted(hot), dtype=np.int64)

    def batches(it):
        held, over = [], None  # rows of the last hash so far; that hash once it has COUNTED rows

        def out(cols, m):
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(m, pa.int32())], names=["t", "id", "m"])

        for b in it:
            cols = [b.column(k).to_numpy() for k in range(2)]
            if held:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
                held = []
            t = cols[0]
            if not len(t):
                continue
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            m = np.diff(np.append(first, len(t)))
            m[np.isin(t[first], known)] = COUNTED
            if over is not None and t[0] == over:
                m[0] = COUNTED
            last = int(first[-1])
            if m[-1] >= COUNTED:
                over, last = t[-1], len(t)
            else:
                held = [c[last:] for c in cols]
            m = np.minimum(np.repeat(m, np.diff(np.append(first, len(t)))), COUNTED)[:last]
            many = m > 1
            if many.any():
                yield out([c[:last][many] for c in cols], m[many])
        if held and len(held[0]) > 1:
            yield out(held, np.full(len(held[0]), len(held[0]), dtype=np.int32))

    to = F.when(F.col("t").isin(hot), F.xxhash64("id")).otherwise(F.col("t")) if hot else F.col("t")
    batch_rows(spark, 20_000)
    return rows.select("t", "id").repartition(parts(spark), to).sortWithinPartitions("t").mapInArrow(frugal(batches), "t long, id long, m int")


def least_shared(n: str, percent: int) -> Column:
    """What a set of n shares at least of its least hashes with any partner: the smaller set's spare."""
    return F.greatest(F.lit(1), F.floor(F.ceil(F.col(n) * percent / 100) / 20)).cast("int")


def survivors(counted: DataFrame, classes: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """id of the sets that share enough of their least hashes with others. Smaller sets link with equal ones only."""
    some, rows = (x.where(F.col("n") * (100 - percent) >= percent).select(F.explode("hashes").alias("t"), k) for x, k in ((counted, "set_key"), (classes, "id")))
    counts = shared(rows, hot_hashes(some, "set_key")).groupBy("id").count()
    # sizes come last: rows of a hash and an id alone are shuffled
    return counts.join(sizes.hint("merge"), "id").where(F.col("count") >= least_shared("n", percent)).select("id")


def prefixes(full: DataFrame, percent: int) -> DataFrame:
    """t, id, n of the rarest hashes of each set, of which each partner has one among its own; sets with more hashes of
    their own than a link allows have none, and so no row."""
    rows = full.select(F.explode("hashes").alias("t"), "id")
    both = shared(rows, hot_hashes(rows)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("m", "t"))).alias("x"))
    both = both.join(full.select("id", F.size("hashes").alias("n")).hint("merge"), "id")
    # in order of (m, t) those of a set's own come first, then the shared ones
    left = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("x"))).cast("int")
    return both.where(left > 0).select("id", "n", F.explode(F.slice("x", F.lit(1), left)).alias("x")).select("x.t", "id", "n")


def block_count(hashes: Column) -> Column:
    """Smaller blocks, for more tasks, as long as they are few: what is sent grows with their number."""
    return F.ceil(F.greatest(hashes / BLOCK, F.least(F.lit(SPREAD), hashes * SPREAD / BLOCK))).cast("int")


def in_blocks(members: DataFrame, key: str) -> DataFrame:
    """members(key, id, n) and blocks, block: each key's members in blocks of BLOCK hashes at most, on average."""
    size = members.groupBy(key).agg(block_count(F.sum("n")).alias("blocks"))
    return members.join(size.hint("merge"), key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def star_links(lists: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links of each set with one other: of the least sets of its lists the one that is that of most."""
    centre = lists.groupBy("t").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1").select("t", "a")
    near = lists.join(centre.hint("merge"), "t").where("a <> id").groupBy("id", "n", "a").agg(F.count("*").alias("w"))
    near = kept(in_blocks(near.groupBy("id", "n").agg(F.max_by("a", F.struct("w", "a")).alias("a")), "a"), "stars")
    units = near.select(F.concat_ws(":", "a", "block").alias("grp"), "id", F.lit(False).alias("query"))
    units = units.union(near.select("a", "block").distinct().select(F.concat_ws(":", "a", "block"), "a", F.lit(True)))
    return search_groups(units, full, percent)


def open_links(lists: DataFrame, label: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links of the sets of each list that are not joined so far. Equal short lists are one; long ones are searched block by
    block, each block by the sets that are outside the list's largest part."""
    member = lists.join(label.hint("merge"), "id", "left").select("t", "id", "n", F.coalesce("component", "id").alias("component"))
    parts_ = member.groupBy("t", "component").agg(F.count("*").alias("size"))
    mixed = parts_.groupBy("t").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("k"), F.sum("size").alias("m")).where("k > 1").drop("k")
    member = kept(member.join(mixed.hint("merge"), "t"), "open")
    short = member.where(F.col("m") <= SHORT).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("id", "n", "component", "main"))).alias("ids"))
    short = short.groupBy("ids").agg(F.min("t").alias("t")).select("t", F.explode("ids").alias("x")).select("t", "x.id", "x.n", "x.component", "x.main")
    member = short.unionByName(member.where(F.col("m") > SHORT).drop("m")).withColumn("query", F.col("component") != F.col("main"))
    asked = member.where("query").groupBy("t").agg(block_count(F.sum("n")).alias("asks"))
    member = in_blocks(member, "t").join(asked.hint("merge"), "t").withColumn("ask", F.pmod(F.xxhash64("id", F.lit(1)), F.col("asks")).cast("int"))
    # each block of sets meets each block of those that ask
    of = lambda ask, block, query: F.struct(F.concat_ws(":", "t", ask, block).alias("grp"), query.alias("query"))
    own = F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda k: of(k, F.col("block"), F.col("query") & (k == F.col("ask"))))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.col("query") & (k != F.col("block"))), lambda k: of(F.col("ask"), k, F.lit(True)))
    units = member.select("id", F.explode(F.concat(own, others)).alias("x")).select("x.grp", "id", "x.query")
    return search_groups(units, full, percent)


def links(counted: DataFrame, classes: DataFrame, sizes: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links a, b of the classes: enough of them to reach each from all that it is linked with."""
    spark = classes.sparkSession
    with passing(spark) as stays:
        with passing(spark) as stay:
            found = kept(survivors(counted, classes, sizes, percent), "survivors")
            release(spark)
            full = kept(fetch(found), "sets")
            release(spark)
            lists = stay(kept(prefixes(full, percent), "prefixes"))
            release(spark)
            few = stay(kept(full.join(few_rows(kept(lists.select("id").distinct(), "ids")), "id", "left_semi"), "full"))
        stars = kept(star_links(lists, few, percent), "stars")
        label = kept(components(stars), "labels")
        rest = open_links(lists, label, few, percent)
        out = stays(kept(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(rest), "found"))
    release(spark)
    return out


# --- the join -------------------------------------------------------------------------------------------------------


def numbered(counted: DataFrame) -> tuple[DataFrame, bool]:
    """set_key, n, doc_id (the least) and id of each class, and whether any id differs from doc_id: that of a class
    whose least doc_id is null or that of another class too."""
    spark = counted.sparkSession
    classes = kept(counted.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "classes")
    odd = kept(classes.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "odd")
    if odd.isEmpty():
        return classes.withColumn("id", F.col("doc_id")), False
    lo, hi = classes.agg(F.min("doc_id"), F.max("doc_id")).first()
    # numbers that no doc_id has: above all, or where there is no room below all
    fresh = F.monotonically_increasing_id()
    fresh = F.lit((hi if hi is not None else 0) + 1) + fresh if (hi or 0) < 2**62 else F.lit(lo - 2**62) + fresh
    odd = few_rows(odd)
    same = classes.doc_id.eqNullSafe(odd.doc_id)
    own = classes.join(odd, same, "left_anti").withColumn("id", F.col("doc_id"))
    others = classes.join(odd, same, "left_semi").withColumn("id", fresh)
    return kept(own.unionByName(others), "numbered"), True


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = texts_of(docs)
    counted = kept(sets(docs, size, percent), "shingles")
    classes, odd = numbered(counted)
    one = counted.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    if odd:
        one = one.drop("id").join(classes.select("set_key", "id"), "set_key")

    def fetch(ids: DataFrame) -> DataFrame:
        """id and all hashes of some classes."""
        if not odd:
            some = docs.join(few_rows(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")
            return sets(some, size, percent, whole=True).select(F.col("doc_id").alias("id"), "hashes")
        wanted = kept(classes.join(few_rows(ids), "id", "left_semi"), "wanted")
        texts = few_rows(wanted.select("doc_id").distinct())
        some = sets(docs.join(texts, docs.doc_id.eqNullSafe(texts.doc_id), "left_semi"), size, percent, whole=True)
        return some.join(wanted.select("set_key", "id"), "set_key").groupBy("id").agg(F.first("hashes").alias("hashes"))

    found = links(counted, one, classes.select("id", "n"), fetch, percent)
    if odd:  # one document may have several classes, where its doc_id repeats: it links them
        of = kept(counted.where("doc_id is not null and n > 0").select("doc_id", "set_key").distinct().join(classes.select("set_key", "id"), "set_key"), "rows")
        least = of.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("hi")).where("b <> hi").select("doc_id", "b")
        found = found.union(of.join(least, "doc_id").select(F.col("id").alias("a"), "b"))
    label = components(found)
    linked = classes.join(label, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    rows = counted.select("doc_id", "n", "set_key").join(linked, "set_key", "left")
    if odd:  # a repeated doc_id is one document also where one of its texts is empty; labels may be numbers of our own
        rows = kept(rows, "labelled")
        least = rows.where("component_id is not null").groupBy("component_id").agg(F.min("doc_id").alias("least"))
        rows = rows.join(least, "component_id", "left").select("doc_id", "n", F.when(F.col("component_id").isNotNull(), F.col("least")).alias("component_id"))
        of = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("own"))
        rows = rows.join(of, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "own"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
