"""The test tables in the roles of the library, once as DataFrames and once as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnsift.functions import hour_fraction, log_amount, row_hash60
from txnsift.plans.archetypes import TRIP_COLUMNS as TRIP_FEATURES  # noqa: F401

V = [f"V{i}" for i in range(1, 65)]


def row_hash60_sql(expressions: list[str]) -> str:
    """The row hash of the library in SQL: each value behind its length, a null as a dash."""
    parts = ", ".join(f"coalesce(length(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')" for e in expressions)
    return f"CAST('0x' || substr(md5(concat({parts})), 1, 15) AS BIGINT)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds_since(start: str, column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{start}', {column})") / F.lit(1e6)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions: txn_id, user_id, time_s, amount, label (error), rare (error of a tenth of users)."""
    is_error = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        F.col("event_id").alias("txn_id"),
        "user_id",
        seconds_since("2024-01-01", "ts").alias("time_s"),
        F.col("value").alias("amount"),
        is_error.cast("int").alias("label"),
        (is_error & (F.col("user_id") % 10 == 0)).cast("int").alias("rare"),
    )


EV = """ev AS (SELECT event_id AS txn_id, user_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS time_s,
  value AS amount, CAST(event_type = 'error' AS INTEGER) AS label,
  CAST(event_type = 'error' AND user_id % 10 = 0 AS INTEGER) AS rare FROM events)"""

LINE_FEATURES = ["quantity", "amount", "discount", "tax", "log_amount", "weekday"]


#: What tells order lines apart at every size, for Spark and as SQL.
LINE_KEY_SQL = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(round(l_extendedprice * 100) AS BIGINT)", "epoch_us(l_shipdate)",
]


def line_key():
    return row_hash60(
        [
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', l_shipdate)"),
        ]
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The largest table as transactions: numeric features, time, amount and a 0/1 label."""
    return table(spark, sf, "lineitem").select(
        line_key().alias("txn_id"),
        seconds_since("1995-01-01", "l_shipdate").alias("time_s"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        log_amount("l_extendedprice").alias("log_amount"),
        F.weekday("l_shipdate").cast("double").alias("weekday"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


LI = f"""li AS (SELECT {row_hash60_sql(LINE_KEY_SQL)} AS txn_id,
  (epoch_us(l_shipdate) - 788918400000000) / 1e6 AS time_s, l_quantity AS quantity, l_extendedprice AS amount,
  l_discount AS discount, l_tax AS tax, ln(1 + l_extendedprice) AS log_amount,
  CAST(isodow(l_shipdate) - 1 AS DOUBLE) AS weekday, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Wide features: vec_id, V1..V64, label (vector class 0), group (vector class)."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate(V)],
        (F.col("label") == 0).cast("int").alias("label"),
        F.col("label").cast("int").alias("grp"),
    )


VE = (
    "ve AS (SELECT vec_id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {v}" for i, v in enumerate(V))
    + ", CAST(label = 0 AS INTEGER) AS label, CAST(label AS INTEGER) AS grp FROM embeddings)"
)
# the same table in long form, and scaled by mean and population deviation
VL = f"vl AS (UNPIVOT (SELECT * FROM ve) ON {', '.join(V)} INTO NAME feature VALUE x)"
VZ = """vs AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM vl GROUP BY feature),
vz AS (SELECT vec_id, label, grp, feature, CASE WHEN s > 0 THEN (x - m) / s ELSE 0.0 END AS z
  FROM vl JOIN vs USING (feature))"""


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as trips; distance and tip are null where the source value is zero."""
    line = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    days = F.abs(F.expr("timestampdiff(SECOND, o_orderdate, l_shipdate)") / F.lit(86400.0))
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.log("l_extendedprice").alias("log_fare"),
        F.when(F.col("l_tax") > 0, F.log("l_quantity")).alias("log_distance"),
        days.alias("trip_duration_min"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("tip_pct"),
        F.weekday("l_shipdate").cast("double").alias("hour_of_day"),
        F.col("l_linenumber").cast("double").alias("passenger_count"),
        (F.col("l_returnflag") == "R").cast("double").alias("is_airport"),
        (F.col("l_linenumber") % 4).cast("int").alias("cluster"),
        line_key().alias("trip_id"),
    )


TR = """tr AS (SELECT ln(l_extendedprice) AS log_fare, CASE WHEN l_tax > 0 THEN ln(l_quantity) END AS log_distance,
  abs(datediff_s / 86400.0) AS trip_duration_min, CASE WHEN l_discount > 0 THEN l_discount END AS tip_pct,
  CAST(isodow(l_shipdate) - 1 AS DOUBLE) AS hour_of_day, CAST(l_linenumber AS DOUBLE) AS passenger_count,
  CAST(l_returnflag = 'R' AS DOUBLE) AS is_airport, CAST(l_linenumber % 4 AS INTEGER) AS cluster
  FROM (SELECT l.*, CAST(trunc((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6) AS BIGINT) AS datediff_s
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey))"""


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))


def event_features(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the derived features next to the raw amount."""
    return events(spark, sf).select(
        "*", log_amount("amount").alias("log_amount"), hour_fraction("time_s").alias("hour_of_day")
    )


EF = "ef AS (SELECT *, ln(1 + amount) AS log_amount, (time_s % 86400) / 3600.0 AS hour_of_day FROM ev)"


def hash60_sql(seed: int | str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"
