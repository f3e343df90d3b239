"""Fitted models and their evaluation, on Spark ML."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions.scalar import num
from touchline.sources.scratch import kept

#: Rows that one task of a fit takes at least, and groups whose ids still go through the driver.
ROWS_PER_TASK, MOST_GROUPS = 50_000, 100_000
#: Tasks of a fit at most: each round's statistics come from every one of them.
MOST_TASKS = 2_000
#: Rows of fits that run side by side: a small fit is hundreds of short jobs that leave most cores idle, a large one fills them.
ROWS_AT_ONCE = 6_000_000


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def scaled(df: DataFrame, features: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns less their mean, over their population deviation; the numbers used."""
    stats = df.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    use = {f: (stats[f"m_{f}"] or 0.0, stats[f"s_{f}"] or 1.0) for f in features}
    return df.withColumns({f: (F.col(f) - num(m)) / num(s) for f, (m, s) in use.items()}), use


def logistic(df: DataFrame, features: list[str], label: str, standardize: bool = True):
    """L2 logistic regression with penalty 1 / n (a unit of regularisation over all rows); (intercept, {feature: weight}) in the
    features' own units, so that it can be used as a column expression."""
    d = df.dropna(subset=[*features, label])
    d, use = scaled(d, features) if standardize else (d, {f: (0.0, 1.0) for f in features})
    d = assembled(d.withColumn("label", F.col(label).cast("double")), features).select("features", "label").persist()
    model = LogisticRegression(regParam=1.0 / max(1, d.count()), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-8).fit(d)
    d.unpersist()
    weights = {f: float(w) / use[f][1] for f, w in zip(features, model.coefficients)}
    return float(model.intercept) - sum(weights[f] * use[f][0] for f in features), weights


def side_by_side(df: DataFrame, fits: list[Callable]) -> list:
    """Results of `fits`, each on `df` or most of it: as many at once as their rows allow, one after another beyond."""
    at_once = max(1, min(len(fits), ROWS_AT_ONCE // max(1, df.count())))
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda f: f(), [inheritable_thread_target(df.sparkSession)(f) for f in fits]))


def boosted(df: DataFrame, features: list[str], label: str, rounds: int = 300, seed: int = 0, key: list[str] | None = None, held: float = 0.1, least: float = 1e-4):
    """Gradient boosting with the completion model's settings; judge it by calibration, not by values.

    With `key`, a share of the rows (by a hash of it) is held out, and the rounds end before `rounds` where a round lowers
    its loss by less than the share `least`. Trees are grown level by level over all partitions; a small table goes into few.
    """
    here = df.dropna(subset=[*features, label]).withColumn("label", F.col(label).cast("double"))
    aside = F.pmod(F.xxhash64(*(key or [F.lit(0)]), F.lit(seed)), F.lit(1000)) < F.lit(int(1000 * held)) if key else F.lit(False)
    d = assembled(here.withColumn("held", aside), features).select("features", "label", "held")
    d = kept(d, "rows")
    d = d.repartition(max(1, min(-(-d.count() // ROWS_PER_TASK), MOST_TASKS))).persist()
    settings = {"validationIndicatorCol": "held", "validationTol": least} if key and not d.where("held").isEmpty() else {}
    model = GBTClassifier(maxIter=rounds, stepSize=0.06, minInstancesPerNode=60, maxDepth=5, maxBins=255, seed=seed, **settings).fit(d)
    d.unpersist()
    return model


def boosted_probability(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(assembled(df, features)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _tree(lines: list[str], x: list[Column]) -> Column:
    """The column of a printed tree, whose lines are used up: `If (feature 0 <= 0.5)`, a tree, `Else (..)`, a tree, or
    `Predict: 1.0`."""
    line = lines.pop(0)
    if line.startswith("Predict"):
        return num(float(line.rpartition(" ")[2]))
    _, _, feature, sign, bound = line.strip("()").replace("(", "").split()
    if sign != "<=":
        raise ValueError(f"not a numeric split: {line}")
    low = _tree(lines, x)
    lines.pop(0)  # Else
    return F.when(x[int(feature)] <= num(float(bound)), low).otherwise(_tree(lines, x))


def boosted_expression(model, features: list[str]):
    """The fitted trees as a column function of {feature: column}, for columns bound in lambdas too: the chance of label 1.

    The features should be plain references (bound before), as each tree reads them several times.
    """
    trees: list[list[str]] = []
    for line in map(str.strip, model.toDebugString.split("\n")):
        if line.startswith("Tree "):
            trees.append([])
        elif trees and line:
            trees[-1].append(line)
    weights = list(model.treeWeights)

    def predict(columns: dict[str, Column]) -> Column:
        x = [columns[f] for f in features]
        parts = [_tree(list(t), x) * num(w) for t, w in zip(trees, weights)]
        while len(parts) > 1:  # a sum of little depth
            parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) - len(parts) % 2 :]
        return num(1) / (num(1) + F.exp(parts[0] * -2.0))

    return predict


def folds(df: DataFrame, group: str, n: int = 5, seed: int = 0) -> DataFrame:
    """`df` with fold: its groups, sorted, shuffled with the seed and cut into n near-equal parts. Beyond MOST_GROUPS groups
    each falls to a fold by its hash, which makes the parts near-equal too."""
    ids = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(MOST_GROUPS + 1).collect()]
    if len(ids) > MOST_GROUPS:
        return df.where(F.col(group).isNotNull()).withColumn("fold", F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(n)).cast("int"))
    ids = np.array(sorted(ids))
    np.random.default_rng(seed).shuffle(ids)
    rows = [(x.item(), k) for k, part in enumerate(np.array_split(ids, n)) for x in part]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"{group} {dict(df.dtypes)[group]}, fold int")), group)


def out_of_fold(df: DataFrame, group: str, features: list[str], label: str, n: int = 5, seed: int = 0, kind: str = "logistic", **how) -> DataFrame:
    """`df` with fold and p, predicted by a model of the other folds: logistic, or boosted (`how` as for `boosted`)."""
    from touchline.operators.passing import fixed_model

    d = folds(df, group, n, seed)
    if kind == "boosted":
        fits = side_by_side(df, [functools.partial(boosted, d.where(F.col("fold") != k), features, label, **how) for k in range(n)])
        parts = [boosted_probability(model, d.where(F.col("fold") == k).dropna(subset=features), features) for k, model in enumerate(fits)]
        return functools.reduce(DataFrame.unionByName, parts)
    p = F.lit(None).cast("double")
    fits = side_by_side(df, [functools.partial(logistic, d.where(F.col("fold") != k), features, label) for k in range(n)])
    for k, (b, w) in enumerate(fits):
        p = F.when(F.col("fold") == k, fixed_model(b, w)({f: F.col(f) for f in features})).otherwise(p)
    return d.withColumn("p", p)


def reliability(df: DataFrame, label: str, p: str, bins: int = 10, least: int = 30) -> DataFrame:
    """bin, n, mean prediction and label, whether the bin counts, and their gap; bins without rows are left out."""
    b = F.greatest(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    d = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(label).alias("mean_observed"))
    return d.withColumn("counts", F.col("n") >= least).withColumn("gap", F.abs(F.col("mean_predicted") - F.col("mean_observed")))


def quality_of(df: DataFrame, label: str, p: str = "p", gate: float = 0.10) -> DataFrame:
    """One row: n, brier, baseline (of the label's mean), worst_gap of the bins that count, passed."""
    sums = df.where(F.col(p).isNotNull()).groupBy(F.greatest(F.least(F.floor(F.col(p) * 10), F.lit(9)), F.lit(0)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(F.col(label).cast("double")).alias("sy"), F.sum((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("se"))
    mean = F.sum("sy") / F.sum("n")
    out = sums.agg(F.sum("n").alias("n"), (F.sum("se") / F.sum("n")).alias("brier"), (mean * (num(1) - mean)).alias("baseline"), F.max(F.when(F.col("n") >= 30, F.abs(F.col("sp") - F.col("sy")) / F.col("n"))).alias("worst_gap"))
    return out.withColumn("passed", F.col("worst_gap") <= gate)


def compared(df: DataFrame, group: str, features: list[str], label: str, key: list[str], n: int = 5, seed: int = 0, rounds: int = 300) -> DataFrame:
    """kind, n, brier, baseline, worst_gap, passed, chosen: both kinds of model judged out of fold; the one whose worst gap
    is least is chosen, the first of equals."""
    df, tried = kept(df, "features"), []
    for kind, how in (("logistic", {}), ("boosted", {"rounds": rounds, "key": key})):
        tried.append(quality_of(out_of_fold(df, group, features, label, n, seed, kind, **how), label).first())
    gaps = [1.0 if r.worst_gap is None else r.worst_gap for r in tried]
    rows = [(kind, *r, gaps.index(min(gaps)) == k) for k, (kind, r) in enumerate(zip(("logistic", "boosted"), tried))]
    return df.sparkSession.createDataFrame(rows, "kind string, n long, brier double, baseline double, worst_gap double, passed boolean, chosen boolean")


def completion_model(df: DataFrame, group: str, features: list[str], label: str, key: list[str], **how):
    """The kind of model that `compared` chooses, fitted to all rows, as a column function; and the comparison."""
    from touchline.operators.passing import fixed_model

    df = kept(df, "features")
    table = compared(df, group, features, label, key, **how)
    if table.where("chosen").first().kind == "logistic":
        return fixed_model(*logistic(df, features, label)), table
    return boosted_expression(boosted(df, features, label, how.get("rounds", 300), how.get("seed", 0), key), features), table


def discount(df: DataFrame) -> tuple:
    """Reception model of scored by zone and control, and a column function for the discount: chance at the mean zone value
    over the mean chance of all rows."""
    from touchline.functions.scalar import logistic as curve

    b, w = logistic(df, ["zone_xt", "control_target"], "scored", standardize=False)
    zone = df.agg(F.avg("zone_xt")).first()[0]
    mean = df.agg(F.avg(curve(num(b) + F.col("zone_xt") * w["zone_xt"] + F.col("control_target") * w["control_target"]))).first()[0]
    return (b, w, zone, mean), lambda control: curve(num(b + w["zone_xt"] * zone) + control * w["control_target"]) / num(mean)


def principal_axes(df: DataFrame, columns: list[str], share: float = 0.90) -> tuple[DataFrame, int]:
    """pc1 .. pck of the fewest components that hold over `share` of the variance. Rows with nulls are left out."""
    d = assembled(df.dropna(subset=columns), columns)
    model = PCA(k=len(columns), inputCol="features", outputCol="pc").fit(d)
    k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share, side="right")) + 1
    k = min(k, len(columns))
    return model.transform(d).withColumn("pc", vector_to_array("pc")).select("*", *(F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k))).drop("features", "pc"), k


def ols(df: DataFrame, features: list[str], target: str):
    d = assembled(df.dropna(subset=[*features, target]), features)
    return LinearRegression(featuresCol="features", labelCol=target, solver="normal", regParam=0.0).fit(d), d


def coefficients(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """name, coef, se, t, p, lo, hi (95 %); the intercept last."""
    model, d = ols(df, features, target)
    s, spark = model.summary, df.sparkSession
    free = float(s.degreesOfFreedom)
    q = float(spark._jvm.org.apache.commons.math3.distribution.TDistribution(free).inverseCumulativeProbability(0.975))
    rows = zip([*features, "intercept"], [*map(float, model.coefficients), float(model.intercept)], map(float, s.coefficientStandardErrors), map(float, s.tValues), map(float, s.pValues))
    return spark.createDataFrame([(n, c, e, t, p, c - q * e, c + q * e) for n, c, e, t, p in rows], "name string, coef double, se double, t double, p double, lo double, hi double")


def surplus(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """`df` with predicted_log_value, residual, surplus (what the price falls short of the prediction), predicted_value."""
    model, d = ols(df, features, target)
    d = model.transform(d).drop("features").withColumnRenamed("prediction", "predicted_log_value").withColumn("residual", F.col(target) - F.col("predicted_log_value"))
    return d.withColumn("surplus", -F.col("residual")).withColumn("predicted_value", F.exp("predicted_log_value"))


def cross_validated_r2(df: DataFrame, key: str, features: list[str], target: str, n: int = 5, seed: int = 0) -> DataFrame:
    """fold, r2 out of sample, the total taken about the test fold's own mean. Rows fall to folds by a hash of their key."""
    d = df.dropna(subset=[*features, target]).withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int"))
    out = None
    for k in range(n):
        model, _ = ols(d.where(F.col("fold") != k), features, target)
        p = num(model.intercept)
        for f, c in zip(features, model.coefficients):
            p = p + F.col(f) * float(c)
        test = d.where(F.col("fold") == k).agg(F.sum((F.col(target) - p) * (F.col(target) - p)).alias("res"), (F.var_pop(target) * F.count(target)).alias("tot")).select(F.lit(k).alias("fold"), (num(1) - F.col("res") / F.col("tot")).alias("r2"))
        out = test if out is None else out.union(test)
    return out


def nearest_neighbours_accuracy(pairs: DataFrame, labels: DataFrame, key: str, label: str, k: int = 3) -> DataFrame:
    """accuracy, majority, n: leave-one-out vote of the k nearest; ties go to the least label."""
    both = pairs.union(pairs.select("q", "p", "d"))
    w = Window.partitionBy("p").orderBy("d", "q")
    near = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).join(labels.select(F.col(key).alias("q"), label), "q")
    vote = near.groupBy("p", label).agg(F.count("*").alias("n")).groupBy("p").agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), label)).alias("guess"))
    d = vote.join(labels.select(F.col(key).alias("p"), label), "p")
    majority = labels.groupBy(label).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("majority"))
    return d.agg(F.avg((F.col("guess") == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n")).crossJoin(F.broadcast(majority))
