"""The one-class machine on random features: kernel, optimum and planted rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import catalog
from txnsift.operators import fourier

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 3))
    x[:6] = [[9, 9, 9], [-9, 9, 0], [0, -9, 9], [9, 0, -9], [-9, -9, -9], [0, 0, 12]]
    rows = [(i, *map(float, r), int(i % 50 == 0)) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id bigint, a double, b double, c double, label int")


def test_products_approach_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    frequencies, phases = fourier.draw_frequencies(5, 20_000, 0.3, 1)
    z = fourier.random_features(x, frequencies, phases)
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_weights_are_optimal(cloud):
    """No other weights near the found ones have a lower objective, with the hinge as it is."""
    x, df = cloud
    nu = 0.05
    machine = fourier.fit_fourier_one_class(df, NAMES, "id", "label", nu=nu, sample_rows=None, n_features=64)
    z = fourier.random_features(x, machine.frequencies, machine.phases)
    mass = nu * len(x)

    def objective(w, rho):
        return 0.5 * w @ w - rho + np.maximum(0, rho - z @ w).sum() / mass

    best = objective(machine.weights, machine.rho)
    rng = np.random.default_rng(3)
    for size in (1e-1, 1e-2):
        for _ in range(50):
            step = size * rng.normal(size=65) * np.append(np.full(64, np.linalg.norm(machine.weights) / 8), machine.rho)
            assert objective(machine.weights + step[:-1], machine.rho + step[-1]) > best - 0.01 * abs(best)
    assert abs((z @ machine.weights < machine.rho).mean() - nu) < 0.02


def test_planted_rows_come_first_on_any_partitioning(cloud):
    _, df = cloud
    one = fourier.fit_fourier_one_class(df, NAMES, "id", "label", nu=0.02, sample_rows=None).score(df)
    top = [r.id for r in one.orderBy(F.desc("ocsvm_score")).limit(6).collect()]
    assert sorted(top) == list(range(6))
    two = fourier.fit_fourier_one_class(df.repartition(3), NAMES, "id", "label", nu=0.02, sample_rows=None).score(df)
    gap = one.join(two.select("id", F.col("ocsvm_score").alias("other")), "id").agg(F.max(F.abs(F.col("ocsvm_score") - F.col("other"))))
    assert gap.first()[0] < 0.05


def test_no_rows(cloud):
    _, df = cloud
    with pytest.raises(ValueError, match="no rows"):
        fourier.fit_fourier_one_class(df.filter("id < 0"), NAMES, "id", "label", sample_rows=None)


def test_cosines():
    x = np.concatenate((np.random.default_rng(4).uniform(-200, 200, 100_000), [0.0, np.pi, -np.pi / 2, np.nan]))
    found = x.copy()
    fourier._cosine(found)
    assert np.allclose(found, np.cos(x), rtol=0, atol=1e-12, equal_nan=True)


def test_newton_steps_read_few_rows_and_end_at_the_same_weights(cloud, monkeypatch):
    """A sample to start from and scans that choose rows: the gradient over all rows vanishes as without them."""
    x, df = cloud
    options = dict(nu=0.05, sample_rows=None, n_features=64)
    plain = fourier.fit_fourier_one_class(df, NAMES, "id", "label", **options)
    seen, sums = [], fourier._sums
    monkeypatch.setattr(fourier, "WARM_ROWS", 500)
    monkeypatch.setattr(fourier, "_sums", lambda rows, *rest: seen.append(rows.count()) or sums(rows, *rest))
    found = fourier.fit_fourier_one_class(df, NAMES, "id", "label", **options)
    assert seen[0] == 500 and seen.count(500) > 2
    assert abs(found.rho - plain.rho) < 1e-3 * plain.rho
    assert np.linalg.norm(found.weights - plain.weights) < 1e-3 * np.linalg.norm(plain.weights)


def test_the_check_with_planted_rows_fits_on_all_rows(spark, sf, monkeypatch):
    catalog.load()
    monkeypatch.setattr(fourier, "stratified_sample", None)
    found = catalog.QUERIES["n3_fourier_planted_rows"](spark, sf).first()
    assert tuple(found) == (6005, 0, 5)
