"""Domain tables projected from the star-schema tables by integer arithmetic, in Spark and as SQL views.

The same definitions serve both engines; they stand in for provider files where none are at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK: dict[str, tuple[str, str]] = {
    # name: (source table, Spark SQL)
    "syn_passes": ("lineitem", """
        SELECT CAST(l_orderkey % 34 AS INT) match_id, CAST(l_suppkey % 18 AS INT) team, CAST(l_partkey % 25 AS INT) passer,
          CAST((l_partkey + l_linenumber) % 25 AS INT) recipient, l_returnflag = 'N' completed,
          CAST(l_partkey * 37 % 1050 AS DOUBLE) / 10D - 52.5D start_x, CAST(l_suppkey * 53 % 680 AS DOUBLE) / 10D - 34D start_y,
          CAST(l_orderkey * 29 % 1050 AS DOUBLE) / 10D - 52.5D end_x, CAST(l_orderkey * 31 % 680 AS DOUBLE) / 10D - 34D end_y FROM lineitem"""),
    "syn_snapshots": ("orders", """
        SELECT o_orderkey pass_id, CAST(o_orderkey % 34 AS INT) match_id, CAST(o_custkey % 18 AS INT) team, CAST(o_custkey % 25 AS INT) passer,
          CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END completed, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END scored,
          CAST(o_orderkey * 13 % 1050 AS DOUBLE) / 10D - 52.5D start_x, CAST(o_custkey * 19 % 680 AS DOUBLE) / 10D - 34D start_y,
          CAST(o_orderkey * 29 % 1050 AS DOUBLE) / 10D - 52.5D end_x, CAST(o_custkey * 43 % 680 AS DOUBLE) / 10D - 34D end_y,
          transform(sequence(1, 20), k -> named_struct('k', k, 'teammate', k % 2 = 1, 'actor', k = 1,
            'x', CAST((o_orderkey * 31 + k * 97) % 1050 AS DOUBLE) / 10D - 52.5D, 'y', CAST((o_custkey * 17 + k * 61) % 680 AS DOUBLE) / 10D - 34D)) frame FROM orders"""),
    "syn_tracking": ("events", """
        SELECT CAST(user_id AS INT) player_id, CAST(event_id % 2 + 1 AS INT) period, event_id frame,
          CAST((user_id * 53 + event_id * 7) % 1050 AS DOUBLE) / 10D - 52.5D x FROM events"""),
    "syn_log": ("events", """
        SELECT CAST(user_id % 34 AS INT) match_id, event_id seq, CAST(floor(event_id / 7) AS BIGINT) possession, CAST((event_id * 13) % 2 AS INT) team,
          CASE event_type WHEN 'purchase' THEN 'Shot' WHEN 'error' THEN 'Miscontrol' ELSE 'Pass' END type, event_type = 'purchase' AND event_id % 3 = 0 goal,
          event_type = 'error' lost, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST((user_id * 29 + event_id * 7) % 1200 AS DOUBLE) / 10D END x,
          CAST((user_id * 31 + event_id * 3) % 800 AS DOUBLE) / 10D y FROM events"""),
    "syn_attempts": ("events", """
        SELECT event_id seq, CAST(user_id % 3 AS INT) game_id, CAST(event_id % 2 + 1 AS INT) period, CASE WHEN user_id % 2 = 0 THEN 'Home' ELSE 'Away' END team,
          CASE WHEN event_id % 50 = 7 THEN NULL ELSE CAST((user_id * 3 + event_id) % 11 AS INT) END passer, CAST((user_id + event_id * 5) % 11 AS INT) recipient,
          CASE event_type WHEN 'purchase' THEN 'SHOT' WHEN 'click' THEN 'BALL LOST' ELSE 'PASS' END type,
          CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'INTERCEPTION' WHEN event_id % 4 = 2 THEN 'ON TARGET-GOAL' ELSE 'interception' END subtype,
          CAST((user_id * 7 + event_id * 3) % 1000 AS DOUBLE) / 1000D sx, CAST((user_id * 5 + event_id * 11) % 1000 AS DOUBLE) / 1000D sy,
          CAST((user_id * 3 + event_id * 13) % 1000 AS DOUBLE) / 1000D ex, CAST((user_id * 17 + event_id) % 1000 AS DOUBLE) / 1000D ey FROM events"""),
    "syn_valuations": ("orders", """
        SELECT o_custkey player_id, CAST(o_orderdate AS DATE) AS day, o_orderkey tiebreak, CAST(o_totalprice AS DOUBLE) value FROM orders"""),
    "syn_players": ("customer", """
        SELECT c_custkey player_id, c_name name, CAST(c_nationkey AS INT) team, CAST(c_acctbal AS DOUBLE) a, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 100D b,
          CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE CAST(c_custkey * 61 % 997 AS DOUBLE) / 100D END quality FROM customer"""),
    "syn_roles": ("supplier", """
        SELECT CAST(s_suppkey AS INT) player_id, CAST(s_nationkey AS INT) team, CAST(s_acctbal AS DOUBLE) / 1000D a, CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 100D b,
          CASE WHEN s_suppkey % 20 = 0 THEN NULL ELSE CAST(s_suppkey * 61 % 997 AS DOUBLE) / 100D END quality FROM supplier"""),
    "syn_names": ("documents", """
        SELECT doc_id, lang club, text name FROM documents"""),
}

def duck(sql: str) -> str:
    """The definitions in the other engine's dialect."""
    import re

    sql = re.sub(r"(\d)D\b", r"\1", sql)
    sql = re.sub(r"transform\(sequence\(1, 20\), k -> named_struct\('k', k, 'teammate', (.*?), 'actor', (.*?),\s*'x', (.*?), 'y', (.*?)\)\) frame", r"list_transform(range(1, 21), lambda k: {'k': k, 'teammate': \1, 'actor': \2, 'x': \3, 'y': \4}) frame", sql, flags=re.S)
    return re.sub(r"CAST\(floor\(event_id / 7\) AS BIGINT\)", "CAST(floor(event_id / 7.0) AS BIGINT)", sql)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, where its files give fewer partitions: each of its rows costs much."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projected table, or a plain one."""
    if name not in SPARK:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, sql = SPARK[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(sql.replace(f"FROM {source}", "FROM {rows}"), rows=spread(rows) if name == "syn_snapshots" else rows)


def ctes(*names: str) -> str:
    """WITH list of the named tables for the other engine."""
    return ", ".join(f"{n} AS ({duck(SPARK[n][1])})" for n in names)
