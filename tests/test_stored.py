"""Sketches, digest trees, quarantine, bucketed tables, tall QR and the neighbour graph on planted tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnsift.operators import merkle, neighbour_graph, quality, sketches
from txnsift.operators.clustering import fit_components
from txnsift.operators.neighbours import knn, local_outlier_factor
from txnsift.sources import files, keyed


def test_bins_rise_with_values(spark):
    inf = float("inf")
    values = [-inf, -1e300, -2.0, -1.999, -1e-300, -5e-324, 0.0, 5e-324, 1e-300, 0.5, 1.0, 1.0001, 1.999999, 2.0, 1e300, inf, float("nan")]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    found = [r["b"] for r in rows.select("i", sketches.rank_bin(F.col("x")).alias("b")).orderBy("i").collect()]
    assert found == sorted(found) and len(set(found)) >= 15


def test_sketch_bounds_hold_the_exact_distance(spark):
    rng = np.random.default_rng(3)
    a = np.r_[np.zeros(300), rng.normal(size=600)]
    b = np.r_[np.zeros(100), rng.normal(0.2, 1.3, 500)]
    early, late = (spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double") for x in (a, b))
    exact = quality.ks_drift(early, late, ["x"]).first()
    for digits in (1, 4, 10):
        one, two = (sketches.rank_sketch(t, ["x"], digits) for t in (early, late))
        found = sketches.ks_from_sketches(one, two, digits=digits).first()
        assert found["ks_stat"] - 1e-12 <= exact["ks_stat"] <= found["ks_high"] + 1e-12
        assert found["n_null"] == 2
    assert found["ks_high"] - found["ks_stat"] < 0.005
    empty = early.where("false")
    assert sketches.ks_from_sketches(sketches.rank_sketch(empty, ["x"]), sketches.rank_sketch(late, ["x"])).count() == 0


def test_leaves_round_down(spark):
    keys = [None, -(2**63), -1001, -1000, -1, 0, 999, 1000, 2**63 - 1]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    found = [r[0] for r in rows.select(merkle.leaf_of(F.col("k"), 1000)).collect()]
    assert found == [merkle.NO_KEY if k is None else k // 1000 for k in keys]


def test_changed_ranges(spark):
    old = spark.createDataFrame([(i, f"v{i}") for i in range(-50, 200)] + [(None, "n")], "k bigint, v string")
    now = old.where("k <> 77").unionByName(spark.createDataFrame([(None, "m"), (2**62, "far"), (-50, "v-50"), (-50, "v-50")], old.schema))
    trees = [merkle.digest_tree(t, "k", ["v"], 10) for t in (now, old, old.repartition(3))]
    rows = merkle.changed_ranges(trees[0], trees[1], 10)
    found = {(r["first_key"], r["rows_now"], r["rows_old"]) for r in rows.collect()}
    assert found == {(None, 1, 1), (70, 9, 10), (2**62 // 10 * 10, 1, 0), (-50, 12, 10)}
    assert merkle.changed_ranges(trees[1], trees[2], 10).count() == 0
    again = merkle.rows_of_ranges(now.withColumn("__leaf", F.lit(1)), "k", rows, 10)
    assert again.columns == ["k", "v", "__leaf"] and again.count() == sum(r["rows_now"] for r in rows.collect())


def test_quarantine_sets_bad_lines_aside(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "bad.csv").write_text("a,b\n3,z\nfour,w\n5\n6,p,q\n,r\n")
    schema = spark.createDataFrame([], "a bigint, b string").schema
    good, rejects = files.read_csv_quarantine(spark, str(tmp_path / "*.csv"), schema)
    assert sorted((r["a"] or 0, r["b"]) for r in good.collect()) == [(0, "r"), (1, "x"), (2, "y"), (3, "z")]
    assert sorted(r["record"] for r in rejects.collect()) == ["5", "6,p,q", "four,w"]
    (lost,) = files.reject_counts(rejects).collect()
    assert lost["file"].endswith("bad.csv") and lost["n_rejected"] == 3


def test_bucketed_tables_join_without_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(1000)
        left = keyed.store_keyed(rows.withColumn("x", F.col("id") * 2), "id", "left", 4)
        right = keyed.store_keyed(rows.where("id % 2 = 0").withColumn("y", F.col("id") * 3), "id", "right", 4)
        joined = left.join(right, "id")
        assert joined.count() == 500
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components_of_columns_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    far = x + 1e8
    rows = spark.createDataFrame([tuple(map(float, r)) for r in far], "a double, b double, c double, d double").repartition(20)
    found = fit_components(rows, list("abcd"), 4)
    near = far - 1e8  # what is left of the digits
    _, s, axes = np.linalg.svd(near - near.mean(axis=0))
    assert np.allclose(found.variance_ratio, s**2 / (s**2).sum(), atol=1e-9)
    assert np.allclose(np.abs((np.array(found.loadings) * axes).sum(axis=1)), 1, atol=1e-9)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12)).round(4)
    names = [f"f{i}" for i in range(12)]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point bigint, " + ", ".join(f"{n} double" for n in names)), names


def test_graph_finds_the_neighbours(spark, cloud):
    points, names = cloud
    exact = knn(points, names, 10)
    found = neighbour_graph.approximate_knn(points, names, 10)
    assert neighbour_graph.recall(found, exact).first()["recall"] >= 0.9
    assert found.groupBy("point").count().where("count <> 10").count() == 0
    assert found.where("point = neighbour").count() == 0


def test_graph_of_few_points(spark, cloud):
    points, names = cloud
    few = points.where("point < 5")
    assert neighbour_graph.approximate_knn(few, names, 10).count() == 20
    assert neighbour_graph.approximate_knn(points.where("false"), names, 10).count() == 0
    exact = local_outlier_factor(few, "point", names, 3)
    other = local_outlier_factor(few, "point", names, 3, search=neighbour_graph.approximate_knn)
    wanted, got = dict(map(tuple, exact.collect())), dict(map(tuple, other.collect()))
    assert got == pytest.approx(wanted)
