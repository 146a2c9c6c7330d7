"""Scans, sinks, run store and the query suite; every round trip goes through the scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import ORACLES, query
from catalog.bindings import EF, EV, LI, event_features, events, lines, row_hash60_sql, table
from catalog.profiling import HOUR_SQL
from txnsift.operators import features, profile, quality
from txnsift.plans import profiling as suite
from txnsift.session import scratch_path
from txnsift.sources import files, runs

EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double"
EVENT_SUMS = """SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS user_sum, round(sum(value), 2) AS total,
    max(value) AS highest FROM events GROUP BY event_type"""


def _event_sums(df):
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("user_id").alias("user_sum"),
        F.round(F.sum("value"), 2).alias("total"),
        F.max("value").alias("highest"),
    )


def _schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


@query("s1_csv_scan", EVENT_SUMS)
def _(spark, sf):
    source = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    path = files.write_table(source, scratch_path(spark, "events") + ".csv")
    return _event_sums(files.read_csv(spark, path, _schema(spark, EVENT_SCHEMA)))


@query("s2_csv_set", EVENT_SUMS)
def _(spark, sf):
    base = scratch_path(spark, "pages")
    source = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    for i, kinds in enumerate([["view", "signup"], ["error", "click"], ["purchase"]]):
        files.write_table(source.where(F.col("event_type").isin(kinds)), f"{base}/b{i}.csv")
    return _event_sums(files.read_csv_set(spark, f"{base}/b*.csv", _schema(spark, EVENT_SCHEMA)))


@query("u2_append_tables", EVENT_SUMS)
def _(spark, sf):
    source = table(spark, sf, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    parts = [source.where(early), source.where(~early).select(*reversed(source.columns))]
    return _event_sums(files.append_tables(parts))


@query(
    "s3_parquet_scan",
    """SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
    WHERE l_discount = 0 GROUP BY l_returnflag""",
)
def _(spark, sf):
    source = table(spark, sf, "lineitem").where(F.col("l_discount") == 0)
    return source.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity")
    )


@query(
    "s4_parquet_round_trip",
    f"""WITH {LI} SELECT label, count(*) AS n, CAST(sum(floor(time_s / 86400)) AS BIGINT) AS day_sum,
    CAST(bit_xor(txn_id) AS BIGINT) AS key_xor FROM li GROUP BY label""",
)
def _(spark, sf):
    matrix = features.feature_matrix(lines(spark, sf), "txn_id", "time_s", "amount", "label", ["quantity", "tax"])
    path = files.write_table(matrix, scratch_path(spark, "matrix"))
    stored = spark.read.parquet(path)
    return stored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("day").alias("day_sum"), F.bit_xor("txn_id").alias("key_xor")
    )


@query("s5_csv_round_trip", f"WITH {EV} {HOUR_SQL}")
def _(spark, sf):
    rates = profile.rate_by_hour(events(spark, sf), "time_s", "label")
    path = files.write_table(rates, scratch_path(spark, "rates") + ".csv")
    return files.read_csv(spark, path, rates.schema)


@query(
    "s6_json_round_trip",
    f"""WITH {EV} SELECT (SELECT count(*) FROM ev) AS row_count, CAST(floor(time_s / 86400) AS INTEGER) AS day,
    count(*) AS n_transactions FROM ev GROUP BY 2""",
)
def _(spark, sf):
    record = suite.summary(event_features(spark, sf), "time_s", "amount", "label", ["amount", "log_amount"])
    path = files.write_table(record, scratch_path(spark, "summary") + ".json")
    stored = files.read_json(spark, path, record.schema)
    return stored.select(F.col("class_balance.row_count").alias("row_count"), F.inline("rate_by_day")).select(
        "row_count", "day", "n_transactions"
    )


DIGEST_COLUMNS = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "decimal(18,2)"}
DIGEST_SCHEMA = quality.schema_text(DIGEST_COLUMNS.items())
EVENT_HASH = row_hash60_sql(["event_id", "user_id", "event_type", "CAST(value AS DECIMAL(18, 2))"])
EVENT_DIGEST = f"""h AS (SELECT {EVENT_HASH} AS h FROM events),
  dg AS (SELECT count(*) AS n_rows, CAST(bit_xor(h) AS BIGINT) AS xor60, CAST(sum(h) AS VARCHAR) AS sum60 FROM h)"""
DIGEST_TEXT = f"sha256(n_rows || ':' || xor60 || ':' || sum60 || ':' || '{DIGEST_SCHEMA}')"
DIGEST_SQL = f"WITH {EVENT_DIGEST} SELECT *, {DIGEST_TEXT} AS digest FROM dg"


def digest_columns():
    return [F.col(c).cast(kind).alias(c) for c, kind in DIGEST_COLUMNS.items()]


def event_digest(spark, sf):
    return quality.content_digest(table(spark, sf, "events"), digest_columns())


@query(
    "s7_lineage_json",
    f"""WITH {EVENT_DIGEST} SELECT 'r1' AS run_id, 'events' AS data_file,
    {DIGEST_TEXT} AS digest, n_rows AS row_count,
    CAST(6 AS INTEGER) AS column_count, 'bigint' AS type_of_user FROM dg""",
)
def _(spark, sf):
    found = event_digest(spark, sf).first()
    schema = table(spark, sf, "events").schema
    record = runs.lineage_record(
        spark, "r1", "events", found["digest"], found["n_rows"], schema, {"spark": spark.version}, f"{sf}/events.parquet"
    )
    path = files.write_table(record, scratch_path(spark, "lineage") + ".json")
    stored = files.read_json(spark, path, runs.LINEAGE, multi_line=True)
    return stored.select(
        "run_id", "data_file", "digest", "row_count", "column_count", F.col("col_dtypes")["user_id"].alias("type_of_user")
    )


@query(
    "s9_row_count",
    """SELECT count(*) AS n_rows, (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns
    WHERE table_name = 'lineitem') AS n_columns FROM lineitem""",
)
def _(spark, sf):
    source = table(spark, sf, "lineitem")
    return source.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(source.columns)))


RUN_SQL = f"""SELECT 'r1' AS run_id, label, count(*) AS n FROM ev WHERE time_s < 1296000 GROUP BY label
    UNION ALL SELECT 'r2', label, count(*) FROM ev WHERE time_s >= 1296000 GROUP BY label
    UNION ALL SELECT 'r2_new', label, count(*) FROM ev GROUP BY label"""


@query("s10_run_store", f"WITH {EV} {RUN_SQL}")
def _(spark, sf):
    root = scratch_path(spark, "runs")
    source = events(spark, sf)
    early = F.col("time_s") < 1296000
    for run_id, part in (("r1", source.where(early)), ("r2", source.where(~early)), ("r2", source)):
        counts = part.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        runs.write_run(counts, root, "counts", run_id)
    return runs.read_runs(spark, root, "counts")


@query("s11_reused_matrix", f"WITH {LI} SELECT label, count(*) AS n, CAST(2 AS INTEGER) AS times_read FROM li GROUP BY label")
def _(spark, sf):
    source = lines(spark, sf)
    path, n = scratch_path(spark, "matrix"), source.count()

    def build():
        return features.feature_matrix(source, "txn_id", "time_s", "amount", "label", ["quantity", "tax"])

    first, reused = runs.reuse_or_build(spark, path, n, build)
    assert not reused
    again, reused = runs.reuse_or_build(spark, path, n, build)
    both = first.select("label").unionByName(again.select("label")) if reused else first.select("label")
    counts = both.groupBy("label").agg(F.count(F.lit(1)).alias("all"))
    return counts.select("label", (F.col("all") / 2).cast("bigint").alias("n"), F.lit(2).alias("times_read"))


@query(
    "s12_query_suite",
    f"""WITH {EV}, {EF}, n AS (SELECT count(DISTINCT label) AS labels, count(DISTINCT floor((time_s % 86400) / 3600)) AS hours,
      count(DISTINCT floor(time_s / 86400)) AS days FROM ef)
    SELECT 'class_balance' AS report, labels AS n_rows FROM n UNION ALL SELECT 'time_coverage', 1
    UNION ALL SELECT 'rate_by_hour', hours FROM n UNION ALL SELECT 'amount_quantiles', labels FROM n
    UNION ALL SELECT 'zero_amount', 1 UNION ALL SELECT 'feature_ranges', 3 UNION ALL SELECT 'label_correlation', 3
    UNION ALL SELECT 'label_distributions', labels FROM n UNION ALL SELECT 'separation_scores', 3
    UNION ALL SELECT 'rate_by_day', days FROM n""",
)
def _(spark, sf):
    reports = suite.suite(event_features(spark, sf), "time_s", "amount", "label", ["amount", "log_amount", "hour_of_day"])
    paths = suite.run_suite(reports, scratch_path(spark, "suite"))
    counts = None
    for name, path in paths.items():
        one = spark.read.parquet(path).agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


#: Reports of the suite whose every value is compared: key column and metrics.
STACKED = {
    "class_balance": ("a1_class_balance", "label", ["n_rows", "pct"]),
    "rate_by_hour": ("a3_rate_by_hour", "hour_of_day", ["n_transactions", "n_positive", "positive_rate_pct"]),
    "rate_by_day": ("a4_rate_by_day", "day", ["n_transactions", "n_positive", "positive_rate_pct"]),
    "amount_quantiles": (
        "a6_exact_quantiles", "label", ["n", "p01", "p10", "p50", "p90", "p99", "p999", "mean_amount", "std_amount", "max_amount"],
    ),
}


def _stacked_sql() -> str:
    parts = []
    for report, (name, key, metrics) in STACKED.items():
        values = ", ".join(f"CAST({m} AS DOUBLE)" for m in metrics)
        parts.append(
            f"SELECT '{report}' AS report, CAST({key} AS VARCHAR) AS key, unnest({metrics}) AS metric, unnest([{values}]) AS value "
            f"FROM ({ORACLES[name]})"
        )
    return " UNION ALL ".join(parts)


@query("s12_report_values", _stacked_sql())
def _(spark, sf):
    """The stored reports of the suite as (report, key, metric, value)."""
    reports = suite.suite(event_features(spark, sf), "time_s", "amount", "label", ["amount", "log_amount", "hour_of_day"])
    paths = suite.run_suite({name: reports[name] for name in STACKED}, scratch_path(spark, "suite"))
    out = None
    for report, (_, key, metrics) in STACKED.items():
        entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        rows = spark.read.parquet(paths[report]).select(
            F.lit(report).alias("report"), F.col(key).cast("string").alias("key"), F.inline(F.array(*entries))
        )
        out = rows if out is None else out.unionByName(rows)
    return out
