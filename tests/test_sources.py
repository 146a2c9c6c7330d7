import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from txnsift.session import scratch_path
from txnsift.sources import files, runs


def test_declared_schema_matches_the_file(spark):
    df = spark.createDataFrame([(0.0, *[0.5] * 28, 9.5, 1)], files.transaction_schema())
    path = files.write_table(df, scratch_path(spark, "t") + ".csv")
    assert files.read_csv(spark, path, files.transaction_schema()).first() == df.first()
    with pytest.raises(Exception, match="CSV header"):
        files.read_csv(spark, path, files.transaction_schema(27)).collect()


def test_missing_files_are_an_error(spark):
    with pytest.raises(PySparkException):
        files.read_csv_set(spark, scratch_path(spark, "none") + "/b*.csv", files.transaction_schema()).collect()


def test_row_numbers_are_contiguous(spark):
    out = files.index_rows(spark.range(1000).where("id % 3 = 0").repartition(5).select(F.col("id").alias("v")))
    assert sorted(r["txn_id"] for r in out.collect()) == list(range(334))


def test_stored_runs_are_never_overwritten(spark):
    root = scratch_path(spark, "runs")
    paths = [runs.write_run(spark.range(n), root, "t", "2024-01-01_0000") for n in (1, 2, 3)]
    assert len(set(paths)) == 3
    counts = runs.read_runs(spark, root, "t").groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in counts} == {
        "2024-01-01_0000": 1, "2024-01-01_0000_new": 2, "2024-01-01_0000_new2": 3,
    }


def test_previous_run(spark):
    table = spark.createDataFrame([("a",), ("b",), ("d",)], "run_id string")
    assert runs.previous_run(table, "d") == "b" and runs.previous_run(table, "a") is None


def test_reuse_only_with_the_expected_rows(spark):
    path = scratch_path(spark, "m")
    assert not runs.reuse_or_build(spark, path, 5, lambda: spark.range(5))[1]
    assert runs.reuse_or_build(spark, path, 5, lambda: spark.range(5))[1]
    table, reused = runs.reuse_or_build(spark, path, 6, lambda: spark.range(6))
    assert not reused and table.count() == 6


def test_decision_log_only_grows(spark):
    path = scratch_path(spark, "decisions")
    decision = spark.createDataFrame([("m", 0.5, 10)], "model string, cutoff double, n_flagged bigint")
    for rule in ("capacity", "share"):
        runs.append_decision(decision, path, "r1", rule)
    assert sorted(r["rule"] for r in spark.read.parquet(path).collect()) == ["capacity", "share"]


def test_stored_size_and_schema(spark, sf):
    row = files.stored_size(spark, f"{sf}/events.parquet").first()
    assert row["n_files"] == 1 and row["n_bytes"] > 1000
    names = [r["column_name"] for r in files.describe_schema(spark.read.parquet(f"{sf}/events.parquet")).collect()]
    assert names == ["event_id", "ts", "user_id", "event_type", "value", "props"]
