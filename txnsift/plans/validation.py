"""Validation of one delivery: lineage, fingerprint, drift, issues and verdict, stored per run."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from txnsift.operators import profile, quality, sketches
from txnsift.sources import runs


@dataclass(frozen=True)
class Report:
    issues: DataFrame
    verdict: DataFrame
    statistics: DataFrame | None
    drift: DataFrame | None
    reused: bool


def _earlier(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame | None:
    """The table of the newest earlier run that stored one."""
    table = _stored(spark, root, name)
    previous = None if table is None else runs.previous_run(table, run_id)
    return None if previous is None else table.where(F.col("run_id") == previous)


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:
        return runs.read_runs(spark, root, name)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _last_record(spark: SparkSession, root: str, data_file: str, run_id: str) -> Row | None:
    """The newest earlier lineage record of the same source name."""
    lineage = _stored(spark, root, "lineage")
    if lineage is None:
        return None
    own = lineage.where((F.col("data_file") == data_file) & (F.col("run_id") < run_id))
    return own.orderBy(F.desc("run_id")).select("digest", "expectations", "issues_path").first()


def validate(
    df: DataFrame,
    root: str,
    run_id: str,
    data_file: str,
    numeric: Sequence[str],
    expected_columns: Sequence[str],
    label: str | None = None,
    amount: str | None = None,
    expected_rows: int | None = None,
    positive_band: tuple[int, int] | None = None,
    versions: Mapping[str, str] | None = None,
    earlier_rows: DataFrame | None = None,
    stored_at: str | None = None,
    rejected: Mapping[str, int] | None = None,
    distributions: bool = False,
) -> Report:
    """Check a delivery against expectations and the run before it, and store everything.

    The newest earlier record of the same name decides: with the same digest and the same expectations its stored
    issues, and so its verdict, are reused; another digest is a rewrite. Schema, null and
    negative-amount issues fail the delivery; other issues warn. With `earlier_rows` the drift
    check compares distributions too, not only means. With `distributions` it does so from the
    rank sketches that each run stores, without earlier rows.
    """
    spark = df.sparkSession
    digest = quality.content_digest(df, df.columns).first()
    checked = json.dumps(
        [list(expected_columns), label, amount, expected_rows, positive_band, list(numeric), earlier_rows is not None]
        + ([True] if distributions else [])
    )

    def record(issues_path: str) -> DataFrame:
        return runs.lineage_record(
            spark, run_id, data_file, digest["digest"], digest["n_rows"], df.schema, versions, stored_at, checked, issues_path, rejected
        )

    before = _last_record(spark, root, data_file, run_id)
    if before is not None and before["digest"] == digest["digest"] and before["expectations"] == checked:
        kept = spark.read.parquet(before["issues_path"]).select("check", "severity", "detail")
        runs.write_run(record(before["issues_path"]), root, "lineage", run_id)
        return Report(kept, quality.verdict(kept), None, None, True)

    stats_path = runs.write_run(profile.fingerprint(df, numeric), root, "feature_stats", run_id)
    statistics = spark.read.parquet(stats_path)
    if distributions:
        sketch = spark.read.parquet(runs.write_run(sketches.rank_sketch(df, numeric), root, "rank_sketches", run_id))
    issues = [
        quality.schema_issues(df, expected_columns),
        quality.table_issues(df, label, amount, expected_rows, positive_band),
    ]
    if before is not None:
        names = "data_file string, digest string"
        now = spark.createDataFrame([(data_file, digest["digest"])], names)
        issues.append(quality.rewrite_issues(now, spark.createDataFrame([(data_file, before["digest"])], names)))
    drift = None
    old_stats = _earlier(spark, root, "feature_stats", run_id)
    if old_stats is not None:
        ks = None if earlier_rows is None else quality.ks_drift(earlier_rows, df, numeric)
        old_sketch = _earlier(spark, root, "rank_sketches", run_id) if distributions and ks is None else None
        if old_sketch is not None:
            ks = sketches.ks_from_sketches(old_sketch.drop("run_id"), sketch)
        drift = quality.drift_report(quality.mean_drift(statistics, old_stats), ks)
        drift = spark.read.parquet(runs.write_run(drift, root, "drift", run_id))
        issues.append(quality.drift_issues(drift))
    found = issues[0]
    for more in issues[1:]:
        found = found.unionByName(more)
    issues_path = runs.write_run(found, root, "issues", run_id)
    found = spark.read.parquet(issues_path)
    verdict = quality.verdict(found)
    runs.write_run(verdict, root, "verdict", run_id)
    runs.write_run(record(issues_path), root, "lineage", run_id)
    return Report(found, verdict, statistics, drift, False)
