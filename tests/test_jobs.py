"""Composed jobs on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from catalog import bindings
from txnsift.operators import ranking
from txnsift.plans import review, scoring
from txnsift.plans.validation import validate
from txnsift.session import scratch_path
from txnsift.sources import runs

SCORES = {"amount": "amount"}


def test_decisions_are_logged(spark, sf):
    events = bindings.events(spark, sf)
    log = scratch_path(spark, "log")
    found = {
        mode: review.decide(events, SCORES, "txn_id", "label", "time_s", mode, target, log, "r1").first()
        for mode, target in (("capacity", 5), ("pct_volume", 1.0), ("recall", 0.9))
    }
    days = ranking.distinct_days(events, "time_s")
    assert found["capacity"]["n_flagged"] == 5 * days and found["pct_volume"]["n_flagged"] == 10
    assert found["recall"]["recall"] >= 0.9
    assert {r["rule"] for r in spark.read.parquet(log).collect()} == {"capacity=5", "pct_volume=1.0", "recall=0.9"}
    with pytest.raises(ValueError, match="mode"):
        review.decide(events, SCORES, "txn_id", "label", "time_s", "other", 1)


def test_the_last_two_runs_are_compared(spark, sf):
    events, root = bindings.events(spark, sf), scratch_path(spark, "runs")
    for run_id, label in (("a", "label"), ("b", "rare"), ("c", "label")):
        runs.write_run(ranking.metric_table(events, SCORES, "txn_id", label), root, "metrics", run_id)
    rows = review.compare_last_runs(spark, root, "metrics", ["roc_auc", "pr_auc"]).collect()
    assert {(r["old_run"], r["new_run"]) for r in rows} == {("b", "c")}
    assert all(r["delta"] == pytest.approx(r["new_value"] - r["old_value"]) for r in rows) and len(rows) == 2


def test_validation_keeps_its_record(spark, sf):
    events, root = bindings.events(spark, sf), scratch_path(spark, "v")
    report = validate(
        events, root, "r1", "events", ["amount"], events.columns, "label", "amount", 1000, (1, 999), {"spark": spark.version},
        stored_at=f"{sf}/events.parquet",
    )
    assert report.verdict.first()["verdict"] == "PASS" and not report.reused and report.drift is None
    lineage = runs.read_runs(spark, root, "lineage").first()
    assert lineage["row_count"] == 1000 and lineage["file_size_bytes"] > 0 and lineage["timestamp_utc"]
    assert lineage["columns"] == events.columns and lineage["versions"] == {"spark": spark.version}
    again = validate(events, root, "r2", "events", ["amount"], events.columns, "label", "amount", 1000, (1, 999))
    assert again.reused and again.verdict.first()["verdict"] == "PASS"
    stricter = validate(events, root, "r3", "events", ["amount"], events.columns, "label", "amount", 999, (1, 999))
    assert not stricter.reused and stricter.verdict.first()["verdict"] == "WARN"


def test_a_delivery_gets_its_own_verdict(spark, sf):
    """A dirty file, a clean one, both again: each under its own name and record."""
    events, root = bindings.events(spark, sf), scratch_path(spark, "v")
    dirty = events.withColumn("amount", -F.col("amount"))
    found = []
    for run_id, name, rows in (("r1", "f", dirty), ("r2", "g", events), ("r3", "g", events), ("r4", "f", dirty), ("r5", "f", events)):
        report = validate(rows, root, run_id, name, ["amount"], events.columns, "label", "amount")
        checks = {r["check"] for r in report.issues.collect()} - {"DRIFT FLAGGED"}
        found.append((report.verdict.first()["verdict"] == "FAIL", report.reused, checks))
    assert found == [
        (True, False, {"NEGATIVE AMOUNT"}), (False, False, set()), (False, True, set()), (True, True, {"NEGATIVE AMOUNT"}),
        (False, False, {"DIGEST REWRITE"}),
    ]


def test_scores_and_capture_on_the_same_rows(spark, sf):
    from catalog.models import scaled_vectors

    names = bindings.V[:6]
    matrix = scaled_vectors(spark, sf).select("vec_id", "label", *names)
    anomaly = scoring.anomaly_scores(matrix, "vec_id", "label", names)
    assert anomaly.count() == matrix.count()
    assert anomaly.where("if_score IS NULL OR lof_score IS NULL OR ocsvm_score IS NULL").count() == 0
    ceiling = scoring.supervised_scores(matrix, "vec_id", "label", names, rounds=5)
    assert ceiling.count() == 100
    ratios = scoring.capture(anomaly, ceiling, "vec_id", "label")
    assert {r["metric"] for r in ratios.collect()} == set(scoring.CAPTURE_METRICS)
    assert scoring.score_summary(anomaly).first()["n_rows"] == 500
    assert anomaly.select(F.max("if_score")).first()[0] < 1
