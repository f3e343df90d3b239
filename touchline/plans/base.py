"""Registration of queries with their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.scalar import r6
from touchline.sources.synthetic import ctes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to 6 places, so that both engines agree beyond the order of summation."""
    return df.select(*(r6(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))


def query(name: str, tables: str, sql: str | None = None, done: bool = False):
    """Registers f(*DataFrames of `tables`) under `name`; `sql` may use the projected tables by name. `done`: f rounds itself."""
    names = tables.split()

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(*(table(spark, sf_dir, t) for t in names))
            return out if done else rounded(out)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = twin(names, sql)
        return f

    return register


def streamed(name: str, source: str, projected: str, sql: str):
    """Registers f(spark, path of table `source`) under `name`, for queries that open the table as a stream."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, f"{sf_dir}/{source}.parquet"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name], ORACLES[name] = run, twin(projected.split(), sql)
        return f

    return register


def opened(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A table's files as a stream, so many of them a micro-batch. The table may be a folder or one file, which a stream
    takes as a pattern alone."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def twin(names: list[str], sql: str) -> str:
    """The SQL with its rounding written out and the projected tables in front."""
    projected = [t for t in names if t.startswith("syn_")]
    text = re.sub(r"\bR\[(.*?)\]R", r"(round(\1, 6) + 0.0)", sql.strip(), flags=re.S)
    if not projected:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes(*projected)}, {text[14:].strip()}"
    if text.upper().startswith("WITH"):
        return f"WITH {ctes(*projected)}, {text[4:].strip()}"
    return f"WITH {ctes(*projected)} {text}"
