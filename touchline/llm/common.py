"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, through Spark's reader alone, so that any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (tests); never on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        where = "file://" + tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, a 64-bit number whatever whole number it is stored as, and text; no other column, whatever its name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_open = threading.local()


def kept(df: DataFrame, what: str) -> DataFrame:
    """`df` as a written table in the shared folder: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return out


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are kept within are removed at the end, but those that the given function is called with."""
    outer, mine, stay = getattr(_open, "paths", None), [], set()

    def stays(df: DataFrame) -> DataFrame:
        stay.add(df.kept_at)
        return df

    _open.paths = mine
    try:
        yield stays
    finally:
        _open.paths = outer
        for path in mine:
            if path not in stay:
                drop_path(spark, path)
            elif outer is not None:
                outer.append(path)


def trim() -> None:
    """Gives memory that is free back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def batch_rows(spark: SparkSession, n: int = 1000) -> None:
    """Rows that the next job's Python workers get at once: few where rows hold whole texts, which may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def frugal(batches):
    """A function over batches, whose worker gives free memory back now and then: workers live on between stages."""

    @functools.wraps(batches)
    def run(it):
        def each():
            seen = 0
            for b in it:
                yield b
                seen += b.nbytes
                if seen > 32 << 20:
                    trim()
                    seen = 0

        yield from batches(each())
        trim()

    return run


#: Rows of ids (8 bytes each) that are still broadcast.
MOST_IDS = 1_000_000


def few_rows(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast where a count shows that it is small; else it is joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs now: it does so when their handles are garbage, a moment later."""
    import gc
    import time

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder through Hadoop's file systems (any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body) -> Column:
    """Binds `value` once for `body`, which may use it many times inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the folder is TOUCHLINE_TOKENIZERS or the installed package."""
    if folder := os.environ.get("TOUCHLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class LongMap:
    """A hash table of 64-bit numbers that is read and filled many entries at a time."""

    def __init__(self):
        import numpy as np

        self.size, self.bits = 0, 10
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)

    def _place(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys):
        """The values of keys (0 or more); -1 where there is none."""
        import numpy as np

        out = np.full(len(keys), -1, dtype=np.int64)
        at, rest, mask = self._place(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(rest):
            found = self.keys[at]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            go = ~hit & (found >= 0)
            rest, at = rest[go], at[go] + 1 & mask
        return out

    def put(self, keys, values) -> None:
        """Adds keys that differ from each other and from all before."""
        import numpy as np

        if (self.size + len(keys)) * 3 > 1 << self.bits:
            old = self.keys >= 0
            keys, values = np.concatenate((self.keys[old], keys)), np.concatenate((self.values[old], values))
            self.size = 0
            while len(keys) * 3 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        self.size += len(keys)
        at, mask = self._place(keys), (1 << self.bits) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], at[rest] + 1 & mask


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` hasn't."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def named(docs: DataFrame, to: str) -> DataFrame:
    """`docs` and column `to`, a number for each row: its doc_id where no other row has it; else, and for a row without
    one, a number above all doc_ids (where there is no room, below), in the order of (doc_id, text, the other columns)."""
    odd = kept(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(to)), "odd")
    if odd.isEmpty():
        return docs.withColumn(to, F.col("doc_id"))
    odd = few_rows(odd)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    fresh = F.monotonically_increasing_id()  # ascends with the order
    fresh = F.lit((high or 0) + 1) + fresh if (high or 0) < 2**62 else F.lit(low - 2**62) + fresh
    same = docs.doc_id.eqNullSafe(odd[to])
    order = [F.col("doc_id").asc_nulls_last(), "text", *(F.to_json(F.struct(c)) for c in docs.columns if c not in ("doc_id", "text")), F.monotonically_increasing_id()]
    rows = kept(docs.join(odd, same, "left_semi").orderBy(*order).withColumn(to, fresh), "numbered")
    return docs.join(odd, same, "left_anti").withColumn(to, F.col("doc_id")).unionByName(rows)
