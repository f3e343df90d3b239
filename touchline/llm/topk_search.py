"""Exact top-k search by inner product over a bit-sliced index.

Components become whole numbers, floor(1024 * x). Rows are indexed in blocks. For each dimension a block keeps SLICES
bitmaps over its rows: slice j of dimension d has a row's bit where bit j of its component, less the block's least one and
without the last bits, is set. A query's components, as signed digits of few bits, say which slices are added with which
weight; the sum is formed by bitmap arithmetic (carry-save adders over whole bitmaps), so that all rows of a block are
scored together. From the most significant slice of the sums downward the k-th largest is found; what the quantisation may
hide is bounded for each query and block, and the rows within that bound of the k-th are resolved with their exact
components.

Stated queries meet every block: a block is read with groups of queries at a time, so that a task holds one block and one
group, whatever the tables' sizes; work grows with queries x rows, the longest list is k rows a query and block. No task
or driver holds all queries or all rows.

Vectors that are null, or hold null or a component that isn't finite, take no part, nor do rows without vec_id. A shorter
vector has zeros for the rest. Components beyond 64 bits are cut to that range, scores likewise. Ties go to the smaller
vec_id. Rows that share a vec_id are rows of their own: each is a query (with ranks from 1) and a candidate for the
others. Fewer rows than k: all of them. An empty table gives no row. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, frugal, kept, parts

#: Bits kept of a component and of a query's weight; they tell how many rows are resolved exactly, not the result.
SLICES, DIGITS = 7, 7
#: Rows of a block, and its components at most (512 rows have any block's room).
ROWS, CELLS = 16_384, 1 << 21
#: Queries of a group.
GROUP = 512


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor(1024 * x) of each component) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 1024.0)).alias("v"))


def slice_up(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows x dimensions: the bitmaps (dimension x SLICES, words), the least component and the bits cut off, a dimension."""
    n, dims = v.shape
    low = v.min(axis=0, initial=np.iinfo(np.int64).max) if n else np.zeros(dims, dtype=np.int64)
    above = v.astype(np.uint64) - low.astype(np.uint64)
    most = above.max(axis=0, initial=0)
    shift = np.array([max(0, int(m).bit_length() - SLICES) for m in most], dtype=np.uint64)
    cut = (above >> shift).astype(np.uint8)
    bits = ((cut.T[:, None, :] >> np.arange(SLICES, dtype=np.uint8)[None, :, None]) & 1).reshape(dims * SLICES, n)
    padded = np.zeros((dims * SLICES, -(-n // 64) * 64), dtype=np.uint8)
    padded[:, :n] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64), low, shift


def signed_digits(weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in weights, power of two, sign) of the non-adjacent form of each weight."""
    out = []
    for k, w in enumerate(weights.tolist()):
        sign, w, p = (-1, -w, 0) if w < 0 else (1, w, 0)
        while w:
            if w & 1:
                d = 2 - (w & 3)
                out.append((k, p, sign * d))
                w -= d
            w >>= 1
            p += 1
    return out


def add_up(levels: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The slices of the sum, least significant first, of bitmaps that stand in stacks by their power of two."""
    out, k = [], 0
    while any(at >= k for at in levels):
        stack = levels.pop(k, [])
        x = np.concatenate(stack) if stack else np.zeros((0, words), dtype=np.uint64)
        while len(x) > 1:
            m = len(x) // 3
            if m:
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                half = a ^ b
                carry, x = (a & b) | (half & c), np.concatenate((half ^ c, x[3 * m :]))
            else:
                carry, x = x[:1] & x[1:], x[:1] ^ x[1:]
            levels.setdefault(k + 1, []).append(carry)
        out.append(x[0] if len(x) else np.zeros(words, dtype=np.uint64))
        k += 1
    return out


class Block:
    """The rows of a block, ready to be searched."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, slices: np.ndarray, low: np.ndarray, shift: np.ndarray):
        self.ids, self.v, self.low, self.shift = ids, v, low, shift
        self.words = slices.shape[1]
        self.both = np.concatenate((slices, ~slices))  # a slice to be subtracted is its complement, and one for each row
        rows = np.zeros(self.words * 64, dtype=np.uint8)
        rows[: len(ids)] = 1
        self.rows = np.packbits(rows, bitorder="little").view(np.uint64)
        self.most = int(np.abs(v.astype(np.float64)).max(initial=0)) + 1

    def near(self, q: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
        """Places of rows among which the k best are for sure."""
        if int(np.bitwise_count(valid).sum()) <= k:
            return self._places(valid)
        g = q.astype(np.float64) * np.exp2(self.shift.astype(np.float64))  # a kept unit of dimension d adds g[d]
        unit = np.abs(g).max(initial=0) / ((1 << DIGITS) - 1)
        if not unit:
            return self._places(valid)
        weights = np.rint(g / unit).astype(np.int64)
        # what is left: cut-off bits (0 to 2^shift - 1 of a component) and cut-off weights (of 0 to 2^SLICES - 1 units)
        spread = (np.abs(q.astype(np.float64)) * (np.exp2(self.shift.astype(np.float64)) - 1)).sum() + (np.abs(g - unit * weights) * ((1 << SLICES) - 1)).sum()
        levels: dict[int, list] = {}
        for d, p, sign in signed_digits(weights):
            for j in range(SLICES):
                levels.setdefault(p + j, []).append(d * SLICES + j + (len(self.both) // 2 if sign < 0 else 0))
        total = add_up({p: [self.both[rows]] for p, rows in levels.items()}, self.words)
        # the k-th largest sum, from the most significant slice downward
        here, need, kth = valid, k, 0
        for p in range(len(total) - 1, -1, -1):
            ones = here & total[p]
            n = int(np.bitwise_count(ones).sum())
            if n >= need:
                here, kth = ones, kth | 1 << p
            else:
                here, need = here & ~total[p], need - n
        least = max(0, kth - int(spread / unit) - 3)  # and rounding
        above, same = np.zeros_like(valid), valid
        for p in range(max(len(total), least.bit_length()) - 1, -1, -1):
            ones = total[p] if p < len(total) else np.zeros_like(valid)
            if least >> p & 1:
                same = same & ones
            else:
                above, same = above | (same & ones), same & ~ones
        return self._places(above | same)

    def _places(self, rows: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))

    def top(self, q: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, list[int]]:
        """vec_ids and scores of the k best rows but row `own`."""
        q = np.concatenate((q, np.zeros(max(0, self.v.shape[1] - len(q)), dtype=np.int64)))[: self.v.shape[1]]
        valid = self.rows
        if own >= 0:
            valid = valid.copy()
            valid[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        at = self.near(q, valid, k)
        if float(np.abs(q.astype(np.float64)).max(initial=0)) * self.most * max(1, len(q)) < 2**62:
            score = self.v[at].astype(np.int64) @ q
        else:
            exact = self.v[at].astype(object) @ q.astype(object)
            score = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in exact], dtype=np.int64)
        best = np.lexsort((self.ids[at], ~score))[:k]  # ~ turns the order round without overflow
        return self.ids[at][best], score[best]


def _narrow(v: np.ndarray) -> tuple[bytes, str]:
    kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or not len(v) or (v.min(initial=0) >= np.iinfo(k).min and v.max(initial=0) <= np.iinfo(k).max))
    return v.astype(kind).tobytes(), kind


def index(numbers: DataFrame) -> DataFrame:
    """Blocks of the rows of vec_id, v, as a written table: block, n, ids, kind and exact components, slices, low, shift."""
    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("kind", pa.string()), ("exact", pa.binary()), ("slices", pa.binary()), ("low", pa.binary()), ("shift", pa.binary())])

    def build(batches):
        from pyspark import TaskContext

        part, made, ids, vectors, rows, widest = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def block():
            nonlocal made, ids, vectors, rows, widest
            flat, sizes = np.concatenate([f for f, _ in vectors]), np.concatenate([s for _, s in vectors])
            v = np.zeros((rows, widest), dtype=np.int64)
            v[np.arange(widest)[None, :] < sizes[:, None]] = flat
            slices, low, shift = slice_up(v)
            exact, kind = _narrow(v)
            out = [(part << 33) + made, rows, np.concatenate(ids).astype("<i8").tobytes(), kind, exact, slices.tobytes(), low.astype("<i8").tobytes(), shift.astype("<u8").tobytes()]
            made, ids, vectors, rows, widest = made + 1, [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema)], schema=schema)

        for b in batches:
            at = 0
            sizes = b.column(1).value_lengths().to_numpy()
            while at < b.num_rows:
                wide = max(widest, int(sizes[at]), 1)
                room = min(ROWS, max(512, CELLS // wide)) - rows
                if room <= 0:
                    yield block()
                    continue
                to = min(b.num_rows, at + room)
                longer = np.flatnonzero(sizes[at:to] > wide)  # a wider row asks anew
                to = at + int(longer[0]) if len(longer) and longer[0] else to if not len(longer) else at + 1
                some = b.slice(at, to - at)
                ids.append(some.column(0).to_numpy())
                vectors.append((some.column(1).flatten().to_numpy(), sizes[at:to]))
                rows, widest, at = rows + to - at, max(wide, int(sizes[at:to].max())), to
        if rows:
            yield block()

    batch_rows(numbers.sparkSession)
    return kept(numbers.mapInArrow(frugal(build), "block long, n long, ids binary, kind string, exact binary, slices binary, low binary, shift binary"), "blocks")


def grouped(blocks: DataFrame, every: int) -> DataFrame:
    """The index's rows whose vec_id is divisible by `every`, as groups of queries: block and place of each, vec_id, v."""
    import pyarrow as pa

    schema = pa.schema([("queries", pa.int64()), ("places", pa.binary()), ("wide", pa.int64()), ("vectors", pa.binary())])

    def gather(batches):
        some, count = [], 0

        def group(q):
            wide = max(len(v) for _, v in q)
            v = np.zeros((len(q), wide), dtype="<i8")
            for k, (_, x) in enumerate(q):
                v[k, : len(x)] = x
            out = [len(q), np.array([p for p, _ in q], dtype="<i8").tobytes(), wide, v.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema)], schema=schema)

        for b in batches:
            for block, n, ids, kind, exact in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(ids, dtype="<i8")
                v = np.frombuffer(exact, dtype=kind).reshape(n, -1)
                for at in np.flatnonzero(ids % every == 0).tolist():
                    some.append(((block, at, int(ids[at])), v[at].astype(np.int64)))
                    if len(some) == GROUP:
                        yield group(some)
                        some = []
        if some:
            yield group(some)

    batch_rows(blocks.sparkSession, 4)
    return kept(blocks.select("block", "n", "ids", "kind", "exact").mapInArrow(frugal(gather), "queries long, places binary, wide long, vectors binary"), "queries")


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of each row whose vec_id is divisible by `every`."""
    import pyarrow as pa

    spark = vectors.sparkSession
    blocks = index(whole_numbers(vectors))
    queries = grouped(blocks, every)
    n = max(1, blocks.count())
    # each group goes to every bucket of blocks; a bucket is a block or a few, and few bytes are much work
    bucket: Column = F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    tasks = max(n, parts(spark))
    asks = queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(tasks, "bucket")
    met = asks.join(blocks.withColumn("bucket", bucket).repartition(tasks, "bucket").hint("merge"), "bucket").drop("bucket")
    schema = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def find(batches):
        last, block = None, None
        for b in batches:
            for _, places, wide, asked, number, n, ids, kind, exact, slices, low, shift in zip(*(c.to_pylist() for c in b.columns)):
                if number != last:
                    low = np.frombuffer(low, dtype="<i8")
                    block = Block(np.frombuffer(ids, dtype="<i8"), np.frombuffer(exact, dtype=kind).reshape(n, -1), np.frombuffer(slices, dtype=np.uint64).reshape(len(low) * SLICES, -1), low, np.frombuffer(shift, dtype="<u8"))
                    last = number
                found = []
                for (of, at, query_id), q in zip(np.frombuffer(places, dtype="<i8").reshape(-1, 3).tolist(), np.frombuffer(asked, dtype="<i8").reshape(-1, wide)):
                    vec_ids, scores = block.top(q, k, at if of == number else -1)
                    found.append((np.full(len(vec_ids), of), np.full(len(vec_ids), at), np.full(len(vec_ids), query_id), vec_ids, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], schema=schema)

    batch_rows(spark, 4)
    each = met.mapInArrow(frugal(find), "block long, place long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same of table `embeddings` in DuckDB's dialect.
SQL = """
with fine as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v, row_number() over () as n from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.n, q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
    from fine q join fine c on q.n <> c.n where q.vec_id % 100 = 0),
ranked as (select query_id, row_number() over (partition by n order by score desc, vec_id) as rank, vec_id, score from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""
