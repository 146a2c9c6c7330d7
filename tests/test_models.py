import numpy as np
import pytest
from pyspark.sql import functions as F

from txnsift.operators import clustering, features, outliers, supervised
from txnsift.plans import archetypes, scoring

NAMES = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def planted(spark):
    """Two dense groups and eight far points (label 1)."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(-3, 1, (700, 4)), rng.normal(3, 1, (700, 4)), rng.choice([-1, 1], (8, 4)) * 14.0])
    rows = [(i, int(i >= 1400), *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, label int, " + ", ".join(f"{n} double" for n in NAMES))
    return features.scaled_features(df, NAMES, ["id", "label"]).cache()


def top_ids(df, score, n):
    return {r["id"] for r in df.orderBy(F.col(score).desc(), "id").limit(n).collect()}


def test_forest_ranks_planted_points_first(planted):
    scored = outliers.fit_isolation_forest(planted, NAMES, "id", trees=100).score(planted).cache()
    assert top_ids(scored, "if_score", 8) == set(range(1400, 1408))
    low, high = scored.agg(F.min("if_score"), F.max("if_score")).first()
    assert 0 < low < high < 1


def test_forest_does_not_depend_on_partitions(planted):
    a = outliers.fit_isolation_forest(planted.repartition(8), NAMES, "id", trees=20)
    b = outliers.fit_isolation_forest(planted.coalesce(1), NAMES, "id", trees=20)
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.path, b.path)


def test_forest_on_more_rows_than_its_pool(spark):
    df = spark.range(20_000).select("id", F.sin("id").alias("f0"), F.cos(F.col("id") * 3).alias("f1"))
    forest = outliers.fit_isolation_forest(df, ["f0", "f1"], "id", trees=10, sample_size=64)
    assert len(forest.path) == 10 and forest.sample_size == 64


def plain_walk(feature, threshold, path, x):
    total = np.zeros(len(x))
    inner = feature.shape[1]
    first = np.arange(len(x)) * x.shape[1]
    for f, t, leaf in zip(feature, threshold, path, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x.reshape(-1).take(first + f.take(node)) > t.take(node))
        total += leaf.take(node - inner)
    return total


def made_up_trees(rng, trees, depth, n_features):
    inner = 2**depth - 1
    threshold = np.round(rng.normal(size=(trees, inner)), 2)
    threshold[rng.random((trees, inner)) < 0.2] = np.inf
    return rng.integers(0, n_features, (trees, inner)), threshold, rng.random((trees, inner + 1)) * 10


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 8])
def test_walk_down_the_trees_equals_a_plain_one(depth):
    rng = np.random.default_rng(depth)
    trees = made_up_trees(rng, 30, depth, 3)
    x = np.round(rng.normal(size=(9000, 3)), 2)  # many values are thresholds
    x[::7, 1], x[::11, 2], x[::13, 0] = np.nan, np.inf, -np.inf
    walk = outliers.TreeWalk(*trees, 3)
    assert np.array_equal(walk.path_sums(x), plain_walk(*trees, x))
    assert not len(walk.path_sums(x[:0]))


def test_more_thresholds_than_ranks_of_two_bytes():
    rng = np.random.default_rng(1)
    feature, threshold, path = made_up_trees(rng, 300, 8, 1)
    threshold = np.where(np.isfinite(threshold), rng.normal(size=threshold.shape), np.inf)
    walk = outliers.TreeWalk(feature, threshold, path, 1)
    assert walk.rank.itemsize == (4 if len(walk.cuts[0]) >= 1 << 16 else 2)
    values = threshold[np.isfinite(threshold)][:500, None]
    assert np.array_equal(walk.path_sums(values), plain_walk(feature, threshold, path, values))
    wide = np.tile(threshold, (2, 1)) + np.repeat([0.0, 1e-7], 300)[:, None]
    walk = outliers.TreeWalk(np.tile(feature, (2, 1)), wide, np.tile(path, (2, 1)), 1)
    assert walk.rank.itemsize == 4
    assert np.array_equal(walk.path_sums(values), plain_walk(np.tile(feature, (2, 1)), wide, np.tile(path, (2, 1)), values))


def test_walk_takes_less_time_than_a_plain_one():
    """Scoring was most of the time on large tables: a gather and a 64-bit comparison for each level and row."""
    import time

    rng = np.random.default_rng(2)
    trees, x = made_up_trees(rng, 100, 8, 6), rng.normal(size=(32_768, 6))
    walk, seconds = outliers.TreeWalk(*trees, 6), {}
    for name, run in (("plain", lambda: [plain_walk(*trees, x[i : i + 4096]) for i in range(0, len(x), 4096)]), ("walk", lambda: walk.path_sums(x))):
        seconds[name] = []
        for _ in range(3):
            start = time.process_time()
            run()
            seconds[name].append(time.process_time() - start)
    assert min(seconds["walk"]) < 0.75 * min(seconds["plain"])


def test_expected_path_of_a_full_sample():
    # fixed value: 2 (ln 255 + gamma) - 2 * 255 / 256
    assert outliers.expected_path(256) == pytest.approx(10.2447709, abs=1e-6)


def test_one_class_machine(planted):
    nu = 0.02
    machine = outliers.fit_one_class_svm(planted, NAMES, "id", "label", nu=nu)
    assert machine.gap <= 1e-3 and machine.weights.sum() == pytest.approx(nu * 1408)
    assert machine.weights.max() <= 1 + 1e-9
    scored = machine.score(planted).cache()
    assert set(range(1400, 1408)) <= top_ids(scored, "ocsvm_score", 28)
    # the threshold passes through the support rows below the cap
    free = machine.support[(machine.weights > 1e-6) & (machine.weights < 1 - 1e-6)]
    gaps = ((free[:, None, :] - machine.support[None, :, :]) ** 2).sum(axis=2)
    level = np.exp(-machine.gamma * gaps) @ machine.weights
    assert np.ptp(level) < 1e-3 * level.mean()
    outside = scored.where(F.col("ocsvm_score") > F.lit(-float(level.mean()) + 1e-3 * level.mean())).count()
    assert outside <= nu * 1408 + 1


def test_one_class_machine_of_all_rows_keeps_few_kernel_values(planted, monkeypatch):
    """Without a sample, and with kernel values of 16 points at most in memory: the machine is the same."""
    whole = outliers.fit_one_class_svm(planted, NAMES, "id", "label", nu=0.02)
    monkeypatch.setattr(outliers, "GRAM_ROWS", 16)
    monkeypatch.setattr(outliers, "stratified_sample", None)
    lean = outliers.fit_one_class_svm(planted, NAMES, "id", "label", nu=0.02, sample_rows=None)
    assert lean.weights.sum() == pytest.approx(0.02 * 1408) and lean.gap <= 1e-3
    x = np.array([tuple(r) for r in planted.select(*NAMES).collect()])
    a, b = (outliers._kernel_sums(x, m.support, m.weights, m.gamma, 500) for m in (whole, lean))
    assert np.abs(a - b).max() < 2e-2 * a.max()


def test_anomaly_scores_fit_on_all_rows(planted, monkeypatch):
    monkeypatch.setattr(outliers, "stratified_sample", None)
    scores = scoring.anomaly_scores(planted, "id", "label", NAMES)
    assert scores.where("ocsvm_score IS NOT NULL").count() == 1408


def test_sweep_lowers_inertia_and_finds_the_groups(planted):
    dense = planted.where("label = 0").cache()
    fits = clustering.kmeans_sweep(dense, NAMES, "id", ks=[2, 3, 4], restarts=3)
    inertia = [fits[k].inertia for k in (2, 3, 4)]
    assert inertia == sorted(inertia, reverse=True)
    for k in fits:
        found = clustering.total_inertia(dense, fits[k]).first()["inertia"]
        assert found == pytest.approx(fits[k].inertia, rel=1e-9)
    sweep = clustering.sweep_table(fits, dense, NAMES)
    assert clustering.best_k(sweep) == 2
    sizes = fits[2].assign(dense).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes)[0] > 690


def test_seedings_settle_on_growing_samples_and_then_on_all_rows(planted, monkeypatch):
    scans, plain = [], clustering._assignment_sums

    def counted(*given):
        out = plain(*given)
        scans.append(int(next(iter(out.values()))[0].sum()))
        return out

    monkeypatch.setattr(clustering, "WARM_VALUES", 64)
    monkeypatch.setattr(clustering, "_assignment_sums", counted)
    fits = clustering.kmeans_sweep(planted, NAMES, "id", ks=[2, 3], restarts=3)
    assert scans[-1] == scans[-2] == 1408 and any(0 < n < 700 for n in scans)
    x = np.array([tuple(r) for r in planted.select(*NAMES).collect()])
    for fit in fits.values():  # whatever the samples were, the centroids are the means of all their rows
        centers = np.array(fit.centers)
        own = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([x[own == i].mean(axis=0) for i in range(fit.k)])
        assert ((means - centers) ** 2).sum() <= 1e-4 * x.var(axis=0).mean()


def test_silhouettes_equal_brute_force(planted):
    df = planted.withColumn("c", (F.col("f0") > 0).cast("int")).cache()
    data = np.array([tuple(r) for r in df.select(*NAMES, "c").collect()])
    x, c = data[:, :4], data[:, 4]

    def mean_silhouette(power):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) ** power
        s = []
        for i in range(len(x)):
            a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
            b = d[i, c != c[i]].mean()
            s.append((b - a) / max(a, b))
        return np.mean(s)

    assert clustering.silhouette(df, NAMES, ["c"]).first()["silhouette"] == pytest.approx(mean_silhouette(1))
    assert clustering.silhouette_squared(df, NAMES, "c").first()["silhouette"] == pytest.approx(mean_silhouette(2))


def test_one_cluster_has_silhouette_zero_and_sweep_minus_one(spark, planted):
    df = planted.withColumn("c", F.lit(0))
    assert clustering.silhouette(df, NAMES, ["c"]).first()["silhouette"] == 0.0
    fits = clustering.kmeans_sweep(planted.limit(50), NAMES, "id", ks=[1], restarts=1)
    assert clustering.sweep_table(fits, planted.limit(50), NAMES).first()["silhouette"] == -1.0


def test_components(planted):
    found = clustering.fit_components(planted, NAMES)
    loadings = np.array(found.loadings)
    assert sum(found.variance_ratio) == pytest.approx(1.0)
    assert list(found.variance_ratio) == sorted(found.variance_ratio, reverse=True)
    assert np.allclose(loadings @ loadings.T, np.eye(4), atol=1e-9)
    x, y = clustering.map_table(planted, found, ["id"]).agg(F.avg("x"), F.avg("y")).first()
    assert abs(x) < 1e-9 and abs(y) < 1e-9


def test_logistic_regression_reaches_the_optimum(planted):
    """Compare with Newton steps on the same weighted, penalised objective."""
    df = planted.withColumn("label", (F.col("f0") + F.sin("id") > 0.8).cast("int")).cache()
    rows = np.array([tuple(r) for r in df.select(*NAMES, "label").collect()])
    x, y = np.hstack([rows[:, :4], np.ones((len(rows), 1))]), rows[:, 4]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, ridge = np.zeros(5), np.diag([1.0, 1, 1, 1, 0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ beta)
    wanted = 1 / (1 + np.exp(-x @ beta))
    found = supervised.logistic_scores(df, df, NAMES, "label").select("lr_score").collect()
    assert np.allclose([r["lr_score"] for r in found], wanted, atol=1e-4)


def test_boosted_trees_separate_the_classes(planted):
    df = planted.withColumn("label", (F.col("f0") * F.col("f1") > 1.2).cast("int")).cache()
    out = supervised.boosted_scores(df, df, NAMES, "label", rounds=10)
    means = {r["label"]: r["m"] for r in out.groupBy("label").agg(F.avg("gbt_score").alias("m")).collect()}
    assert means[1] > 0.5 > means[0]


def test_archetype_names_follow_the_rule_order(spark):
    columns = [f"{c}_mean" for c in archetypes.TRIP_COLUMNS]
    # log_fare, log_distance, duration, tip, hour, passengers, airport
    cases = [
        ((3.5, 2.0, 40.0, 0.3, 23.0, 1.0, 0.4), "Airport runs"),
        ((3.5, 2.0, 40.0, 0.3, 23.0, 1.0, 0.1), "Long premium rides"),
        ((2.0, 0.2, 9.0, 0.3, 23.0, 1.0, 0.1), "Short urban hops"),
        ((2.6, 1.2, 15.0, 0.3, 3.0, 1.0, 0.1), "Late-night rides"),
        ((2.6, 1.2, 15.0, 0.3, 14.0, 1.0, 0.1), "High-tip daytime"),
        ((2.4, 1.2, 15.0, 0.3, 14.0, 1.0, 0.1), "Standard weekday commutes"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], ", ".join(f"{c} double" for c in columns)).coalesce(1)
    assert [r["l"] for r in df.select(archetypes.archetype_label("_mean").alias("l")).collect()] == [w for _, w in cases]


def test_archetypes_need_enough_complete_rows(spark):
    df = spark.createDataFrame(
        [(i, *[None] * 7) for i in range(20)], "trip_id bigint, " + ", ".join(f"{c} double" for c in archetypes.TRIP_COLUMNS)
    )
    with pytest.raises(ValueError, match="rows remain"):
        archetypes.run(df, "trip_id")
    with pytest.raises(ValueError, match="missing columns"):
        archetypes.run(df.drop("tip_pct"), "trip_id")


def test_silhouette_sends_a_block_once_for_each_group(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(300, 3)), rng.integers(0, 4, 300)
    df = spark.createDataFrame([(*map(float, r), int(g)) for r, g in zip(x, c, strict=True)], "a double, b double, c double, g int")
    monkeypatch.setattr(clustering, "GROUPS", 3)
    found = clustering.silhouette(df, ["a", "b", "c"], ["g"], block=20).first()
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    total = np.stack([dist[:, c == j].sum(axis=1) for j in range(4)], axis=1)
    size, rows = np.bincount(c), np.arange(300)
    own, mean = total[rows, c] / (size[c] - 1), total / size
    mean[rows, c] = np.inf
    near = mean.min(axis=1)
    assert found["n_rows"] == 300
    assert abs(found["silhouette"] - ((near - own) / np.maximum(own, near)).mean()) < 1e-9


def test_seedings_settle_before_all_rows_are_scanned(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(m, 1.0, (1500, 2)) for m in ((0, 0), (2.5, 0), (0, 2.5))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, a double, b double")
    scans, sums = [], clustering._assignment_sums
    monkeypatch.setattr(clustering, "_assignment_sums", lambda *a: scans.append(len(a[2])) or sums(*a))
    fits = clustering.kmeans_sweep(df, ["a", "b"], "id", ks=(3, 4), restarts=4)
    assert len(scans) <= 5
    for fit in fits.values():
        near = ((x[:, None] - np.array(fit.centers)[None]) ** 2).sum(axis=2)
        means = np.array([x[near.argmin(axis=1) == j].mean(axis=0) for j in range(fit.k)])
        assert ((means - np.array(fit.centers)) ** 2).sum() <= 2e-4 * x.var(axis=0).mean()
        assert abs(near.min(axis=1).sum() - fit.inertia) < 1e-6 * fit.inertia


def test_the_map_holds_every_row():
    import inspect

    from txnsift.plans import modelling

    assert inspect.signature(modelling.cluster_rows).parameters["map_rows"].default is None
