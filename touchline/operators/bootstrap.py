"""Bootstrap intervals of means and of a logistic model's coefficients.

A resample is given by weights: how often a row is drawn, Poisson(1), from a hash of the row's own key, the draw and a
seed. So a weight is the same in every pass over the rows and on every executor, and rows with equal values are drawn apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from touchline.functions.scalar import num
from touchline.sources.scratch import kept

#: Groups whose sums a task holds before it gives them on.
MOST_GROUPS = 2_000
#: Chances that a row is drawn 0, 0 to 1, 0 to 2, ... times.
BELOW = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(8)])


def weights(rows: np.ndarray, draws: np.ndarray, seed: int = 0) -> np.ndarray:
    """rows x draws: how often each row (a hash of its key) is drawn; the bits are mixed as by splitmix64."""
    apart = np.array([seed * 0xD1342543DE82EF95 & (1 << 64) - 1], dtype=np.uint64)
    z = rows.astype(np.uint64)[:, None] ^ ((draws.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + apart)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(BELOW, u, side="right").astype(np.float64)


def logistic_draws(df: DataFrame, features: list[str], label: str, key: list[str], draws: int = 300, seed: int = 0, penalty: float = 1.0, steps: int = 25) -> DataFrame:
    """draw, intercept and a weight a feature: L2 logistic regressions (loss + penalty / 2 * |weights|^2) of `draws`
    resamples; draw -1 is the fit of the rows as they are. Rows with nulls are left out; `key` tells rows apart.

    All fits take Newton's steps together. A step is one pass over the rows, in which each task adds up the gradients and
    normal equations of all resamples for its rows; their sums, draws x features^2 numbers, are all that leaves the tasks.
    """
    k = len(features) + 1
    data = df.dropna(subset=[*features, label]).select(F.xxhash64(*key).alias("row"), *(F.col(c).cast("double") for c in features), F.col(label).cast("double").alias("label"))
    data = kept(data, "resampled")
    each, upper = np.arange(draws), np.triu_indices(k)
    ridge = np.diag([0.0] + [penalty] * (k - 1))

    def pass_over(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each resample: loss, gradient and second derivatives at its beta, without the penalty."""

        def sums(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros((draws + 1, 1 + k + len(upper[0])))
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    some = b.slice(at, 4096)
                    x = np.column_stack([np.ones(some.num_rows), *(some.column(c).to_numpy() for c in range(1, k))])
                    y = some.column(k).to_numpy()
                    w = np.concatenate((np.ones((len(x), 1)), weights(some.column(0).to_numpy(), each, seed)), axis=1)
                    z = x @ beta.T
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    total[:, 0] += (w * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
                    total[:, 1 : 1 + k] += (w * (p - y[:, None])).T @ x
                    total[:, 1 + k :] += (w * p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["draw", "sums"])

        size = 1 + k + len(upper[0])
        found = data.mapInArrow(sums, "draw long, sums array<double>").groupBy("draw").agg(F.array(*(F.sum(F.col("sums")[j]) for j in range(size))).alias("s"))
        got = np.array([r.s for r in sorted(found.collect())])
        second = np.zeros((draws + 1, k, k))
        second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = got[:, 1 + k :]
        return got[:, 0], got[:, 1 : 1 + k], second

    def value(loss: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return loss + penalty / 2 * (beta[:, 1:] ** 2).sum(axis=1)

    beta = np.zeros((draws + 1, k))
    loss, slope, second = pass_over(beta)
    for _ in range(steps):
        step = np.linalg.solve(second + ridge + 1e-12 * np.eye(k), (slope + beta @ ridge)[:, :, None])[:, :, 0]
        if np.abs(step).max() < 1e-8 * (1 + np.abs(beta).max()):
            break
        ahead = beta - step
        new = pass_over(ahead)
        worse = value(new[0], ahead) > value(loss, beta) + 1e-9 * (1 + np.abs(loss))
        halvings = 0
        while worse.any() and halvings < 20:  # a step too far for some: theirs are halved
            ahead[worse] = (ahead[worse] + beta[worse]) / 2
            new, halvings = pass_over(ahead), halvings + 1
            worse = value(new[0], ahead) > value(loss, beta) + 1e-9 * (1 + np.abs(loss))
        beta, (loss, slope, second) = ahead, new
    rows = [(d - 1, *map(float, beta[d])) for d in range(draws + 1)]
    return df.sparkSession.createDataFrame(rows, ", ".join(["draw long", "intercept double", *(f"{f} double" for f in features)]))


def coefficient_intervals(df: DataFrame, features: list[str], label: str, key: list[str], draws: int = 300, seed: int = 0) -> DataFrame:
    """name, coef, lo, hi (2.5 and 97.5 % points of the resamples' coefficients), differs (0 is outside)."""
    fits = logistic_draws(df, features, label, key, draws, seed)
    names = ["intercept", *features]
    long = fits.select("draw", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names))).alias("c")).select("draw", "c.name", "c.v")
    again = F.when(F.col("draw") >= 0, F.col("v"))
    out = long.groupBy("name").agg(F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("coef"), F.percentile(again, F.lit(0.025)).alias("lo"), F.percentile(again, F.lit(0.975)).alias("hi"))
    return out.withColumn("differs", F.col("lo") * F.col("hi") > 0)


def mean_intervals(df: DataFrame, by: list[str], value: str, key: list[str], draws: int = 400, seed: int = 0) -> DataFrame:
    """by, n, mean, lo, hi: the mean of each group and the 2.5 and 97.5 % points of its resamples' means.

    Rows are weighted where they are, in one pass, and only sums a task, group and draw are shuffled. `key` tells rows apart;
    nulls of `value` are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.xxhash64(*key).alias("_row"), F.col(value).cast("double").alias("_v"))
    each, kinds = np.arange(1, draws + 1), [rows.schema[c] for c in by]

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        groups: dict[tuple, np.ndarray] = {}

        def told():
            keys = [pa.array([g[k] for g in groups], t) for k, t in enumerate(types)]
            flat = [pa.array([x for s in groups.values() for x in s[k]], pa.float64()) for k in range(2)]
            ends = pa.array(np.arange(0, len(groups) * (draws + 1) + 1, draws + 1), pa.int32())
            out = pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(ends, f) for f in flat)], names=[*by, "_s", "_w"])
            groups.clear()
            return out

        for b in batches:
            types = [b.schema.field(c).type for c in by]
            code = np.zeros(b.num_rows, dtype=np.int64)
            for c in by:
                known = b.column(c).dictionary_encode()
                code = code * (len(known.dictionary) + 1) + pc.fill_null(known.indices, len(known.dictionary)).to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            hashed, v = (b.column(c).to_numpy()[order] for c in ("_row", "_v"))
            code, first = code[order], np.flatnonzero(np.diff(code[order], prepend=-1))
            names = list(zip(*(b.column(c).take(pa.array(order[first])).to_pylist() for c in by)))
            for at in range(0, len(v), 512):
                w = np.concatenate((np.ones((len(v[at : at + 512]), 1)), weights(hashed[at : at + 512], each, seed)), axis=1)
                here = code[at : at + 512]
                starts = np.flatnonzero(np.diff(here, prepend=-1))
                n = np.add.reduceat(w, starts)
                w *= v[at : at + 512, None]
                for g, s, m in zip(here[starts], np.add.reduceat(w, starts), n):
                    if names[g] in groups:
                        groups[names[g]] += (s, m)
                    else:
                        groups[names[g]] = np.array((s, m))
            if len(groups) > MOST_GROUPS:
                yield told()
        if groups:
            yield told()

    listed = StructType([*kinds, StructField("_s", ArrayType(DoubleType())), StructField("_w", ArrayType(DoubleType()))])
    found = rows.mapInArrow(sums, listed).select(*by, F.posexplode(F.arrays_zip("_s", "_w")).alias("_draw", "_x"))
    found = found.groupBy(*by, "_draw").agg(F.sum("_x._s").alias("_s"), F.sum("_x._w").alias("_w"))
    mean, again = F.col("_s") / F.nullif("_w", num(0)), F.col("_draw") > 0  # draw 0: the rows as they are
    return found.groupBy(*by).agg(F.max(F.when(~again, F.col("_w"))).cast("long").alias("n"), F.max(F.when(~again, mean)).alias("mean"), F.percentile(F.when(again, mean), F.lit(0.025)).alias("lo"), F.percentile(F.when(again, mean), F.lit(0.975)).alias("hi"))
