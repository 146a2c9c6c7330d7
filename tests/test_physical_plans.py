"""What the optimiser has to do with the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import bindings
from txnsift.operators import neighbours, profile, ranking, ranks
from txnsift.session import materialize


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_zero_filter_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(profile.zero_amounts(bindings.lines(spark, sf), "discount", "label"))
    assert "EqualTo(l_discount,0.0)" in plan
    assert "ReadSchema: struct<l_discount:double,l_returnflag:string>" in plan


@pytest.mark.parametrize("fn", [profile.feature_ranges, lambda d, f: profile.label_correlation(d, f, "label")])
def test_many_features_cost_one_scan(spark, sf, fn):
    plan = plan_of(fn(bindings.vectors(spark, sf), bindings.V))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_rows_are_never_moved_to_one_partition(spark, sf):
    events = bindings.events(spark, sf)
    curve = ranking.cumulative_counts(events, {"amount": "amount"}, "label")
    quantiles = ranks.exact_quantiles(events, ["amount"], {"m": 0.5}, ["label"])
    for df in (curve, quantiles):
        assert "SinglePartition" not in plan_of(df)


def test_a_global_rank_moves_only_range_totals_to_one_partition(spark, sf):
    events = bindings.events(spark, sf).select("txn_id", "amount")
    lines = plan_of(ranks.global_rank(events, "amount", "txn_id")).splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1
    # below it: one count per range
    assert "HashAggregate(keys=[__range" in lines[single[0] + 1]


def test_a_top_fraction_is_a_filter(spark, sf):
    long = ranking.long_scores(bindings.events(spark, sf), {"m": "amount"}, "txn_id", "label")
    assert "Exchange" not in plan_of(ranking.top_fraction(long, 0.01))


def final_plan(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def test_quantiles_rank_only_bracketed_values_from_one_scan(spark, sf):
    plan = final_plan(ranks.exact_quantiles(bindings.lines(spark, sf), ["amount", "tax"], {"m": 0.5}, ["label"]))
    # the other scans read the stored statistics
    assert plan.count("ReadSchema: struct<l_") == 1 and "ReusedExchange" in plan


def test_a_curve_reads_its_rows_once(spark, sf):
    events = bindings.events(spark, sf)
    curve = ranking.cumulative_counts(events, {"amount": "amount", "time": "time_s"}, "label")
    plan = final_plan(ranking.curve_summary(curve, {"top": ranking.fraction_size(0.01)}))
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan


def scans_of_lines(spark, run):
    """Scans of the order lines in the plans of all jobs of `run`."""
    store = spark._jsparkSession.sharedState().statusStore()
    wait = spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty

    def executions():
        wait()
        found = store.executionsList()  # the store drops old ones, so their number says nothing
        return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}

    last = max(executions(), default=-1)
    run()
    texts = [text for i, text in executions().items() if i > last]
    return sum(text.count("ReadSchema: struct<l_") for text in texts)


def test_ranks_and_statistics_are_stored_by_one_scan(spark, sf):
    rows = bindings.lines(spark, sf).select("txn_id", "discount", "amount", "label")
    # a rank is read back from its stored ranges; the sample that finds them is a scan of two columns
    assert scans_of_lines(spark, lambda: ranks.global_rank(rows, "discount", "txn_id").collect()) == 1
    # sketches, moments and counters together; the ranked values are the second and last scan (see above)
    stats = lambda: ranks.column_stats(rows, ["discount", "amount"], ["label"], "column", [0.5], 10_000)
    assert scans_of_lines(spark, stats) == 1


def test_suite_reports_come_from_two_small_tables(spark, sf):
    from txnsift.plans.profiling import suite

    features = ["amount", "log_amount", "hour_of_day"]
    reports = suite(bindings.event_features(spark, sf), "time_s", "amount", "label", features)
    for name in set(reports) - {"amount_quantiles", "zero_amount"}:
        assert "events.parquet" not in plan_of(reports[name]())


def test_copies_are_limited_before_the_shuffle(spark, sf):
    from txnsift.operators.neighbours import distinct_points

    plan = plan_of(distinct_points(bindings.lines(spark, sf), "txn_id", ["quantity", "discount"], 20))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_distances_to_many_centroids_compile(spark):
    """64 features and 10 centroids: written out, the sums pass the limits of generated code."""
    from txnsift.operators.clustering import nearest_center

    names = [f"v{i}" for i in range(64)]
    rows = spark.range(2000).select("id", *[(F.rand(i) * 10).alias(n) for i, n in enumerate(names)])
    rows = materialize(rows, "wide")
    centers = [[float((7 * c + i) % 10) for i in range(64)] for c in range(10)]
    out = rows.select("id", nearest_center(names, centers).alias("c"))
    code = out._jdf.queryExecution().debug().codegenToSeq()
    sizes = [len(code.apply(i)._2()) for i in range(code.size())]
    assert sizes and max(sizes) < 200_000
    table = np.array([tuple(r) for r in rows.orderBy("id").collect()])[:, 1:]
    wanted = ((table[:, None] - np.array(centers)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [r.c for r in out.orderBy("id").collect()] == wanted.tolist()


def test_trips_are_stored_without_a_key_that_nothing_reads(spark, sf, monkeypatch):
    from catalog import QUERIES, checks

    stored, write = [], checks.materialize
    monkeypatch.setattr(checks, "materialize", lambda df, name: stored.append(df) or write(df, name))
    QUERIES["k7_profile_of_fixed_centers"](spark, sf)
    assert stored[0].columns == checks.TRIP_FEATURES
    assert "md5" not in stored[0]._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_a_salted_join_are_not_broadcast(spark):
    """Sixteen copies of each row, of which the estimated size holds one."""
    many = spark.range(1000).select(F.col("id").alias("point"), (F.col("id") % 7).alias("neighbour"))
    one = materialize(spark.range(7).select(F.col("id").alias("neighbour"), F.lit(1.0).alias("density")), "salted-one")
    joined = neighbours.join_on_neighbour(many, one)
    assert "SortMergeJoin" in plan_of(joined) and "BroadcastHashJoin" not in plan_of(joined)
    assert joined.count() == 1000
