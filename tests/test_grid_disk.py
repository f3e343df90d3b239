"""The grid of all snapshots shuffles no frames where the table's files fill the cores."""

from pyspark.sql import functions as F

from touchline.plans.registry import queries


def test_control_grid_shuffles_no_snapshots(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(64)
    orders.repartition(2 * cores, "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)  # a file a partition
    try:
        got = queries()["g05_control_grid"](spark, str(tmp_path))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.agg(F.count("*"), F.count_distinct("pass_id")).first() == (64 * 1700, 64)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
