"""One-class machine on random Fourier features.

The radial kernel exp(-gamma |x - y|^2) is close to the inner product of z(x) = sqrt(2 / D) cos(x W + b), with frequencies W
drawn from its spectrum (in orthogonal blocks, which halves the error). On z the machine is linear: it minimises
|w|^2 / 2 - rho + sum max(0, rho - w z) / (nu n). The hinge is smoothed, less in each round, and every round takes Newton steps from sums over all
rows (loss, gradient, curvature), added up by a tree of tasks. Their size is D^2, whatever the number of rows; no row
reaches the driver, and neither memory nor steps grow with the sample.

Only rows near the margin or below it have a share in the sums, and they are few. Of a large table, a hashed sample gives the weights
to start from; then a scan of all rows stores those that can matter at these weights, and the Newton steps read those.
The scan is repeated at the weights found, and the fit ends where the gradient over what a fresh scan of all rows has found is below the
tolerance. Scans that only choose rows, or start a fit, use single precision with room for its error.

Features must not be null. A fit whose gradient does not fall below the tolerance is an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnsift.operators.boosting import matrix
from txnsift.operators.ranks import melt
from txnsift.operators.sampling import stratified_sample
from txnsift.session import materialize

#: Random features; widths of the smoothed hinge, as shares of its first margin; Newton steps of each width.
N_FEATURES, WIDTHS, STEPS = 512, (0.1, 0.02), 40
#: Rows whose random features are computed at once, and values of a cosine that fit into the processor's cache.
PIECE, CACHED = 8192, 1 << 15
#: Rows of the sample that gives a large table's first weights, scans of all rows at most, bound on t below which a row has no share.
WARM_ROWS, SCANS, NONE_BELOW = 100_000, 20, -30.0
#: Error of a product in single precision, as a share of the length of the weights.
SINGLE = 1e-4
#: cos(pi y) for |y| <= 1/2, by powers of y^2 from the highest.
_POWERS = [(-1.0) ** i * math.pi ** (2 * i) / math.factorial(2 * i) for i in range(10, -1, -1)]


@dataclass(frozen=True)
class FourierOneClass:
    features: tuple[str, ...]
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    rho: float
    mass: float
    gradient: float

    def value(self, x: np.ndarray) -> np.ndarray:
        return random_features(x, self.frequencies, self.phases) @ self.weights

    def score(self, df: DataFrame, name: str = "ocsvm_score") -> DataFrame:
        """`df` with a score that is higher for more anomalous rows, on the scale of the kernel machine."""
        features, model = list(self.features), self

        def run(batches):
            for batch in batches:
                x = matrix(batch, features)
                parts = [model.value(x[at : at + PIECE]) for at in range(0, len(x), PIECE)]
                yield batch.append_column(name, pa.array(-model.mass * np.concatenate([np.zeros(0), *parts])))

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def random_features(x: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    out = x @ frequencies + phases
    flat = out.reshape(-1)
    for at in range(0, len(flat), CACHED):
        _cosine(flat[at : at + CACHED])
    out *= out.dtype.type(math.sqrt(2.0 / len(phases)))
    return out


def _cosine(x: np.ndarray) -> None:
    """Cosines in place. In doubles by a power series, several times as fast as the library's and within 1e-14 of it."""
    if x.dtype != np.float64:
        np.cos(x, out=x)
        return
    x *= 1.0 / (2.0 * math.pi)
    x -= np.rint(x)
    x *= x
    total = np.full_like(x, _POWERS[0])
    for c in _POWERS[1:]:
        total *= x
        total += c
    np.multiply(total, total, out=x)  # cos 2a = 2 cos^2 a - 1
    x *= 2.0
    x -= 1.0


def draw_frequencies(d: int, n: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(d, n) frequencies with the spectrum of the kernel, orthogonal within blocks of d, and n phases."""
    rng, blocks = np.random.default_rng(seed), []
    for _ in range(-(-n // d)):
        turned, triangle = np.linalg.qr(rng.standard_normal((d, d)))
        lengths = np.sqrt(rng.chisquare(d, d))
        blocks.append(turned * np.sign(np.diag(triangle)) * lengths)
    return math.sqrt(2.0 * gamma) * np.hstack(blocks)[:, :n], rng.uniform(0.0, 2.0 * math.pi, n)


def _sums(rows: DataFrame, features: list[str], frequencies, phases, theta: np.ndarray, width: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Over all rows: the smoothed loss, its gradient by the margin (and by w), and the curvature, as sums."""
    n = len(phases)

    def run(batches):
        loss, first, second = 0.0, np.zeros(n + 1), np.zeros((n + 1, n + 1))
        for batch in batches:
            x = matrix(batch, features)
            for at in range(0, len(x), PIECE):
                z = random_features(x[at : at + PIECE], frequencies, phases)
                t = (theta[-1] - z @ theta[:-1]) / width
                near = t > NONE_BELOW  # beyond, all three are zero
                z, t = z[near], t[near]
                loss += width * float(np.logaddexp(0.0, t).sum())
                p = 1.0 / (1.0 + np.exp(-t))
                g = np.hstack((-z, np.ones((len(z), 1))))
                first += p @ g
                second += (g * (p * (1.0 - p) / width)[:, None]).T @ g
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([loss], first, second.ravel())).tobytes()], pa.binary())], ["sums"])

    total = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)
    return float(total[0]), total[1 : n + 2], total[n + 2 :].reshape(n + 1, n + 1)


def _single(frequencies: np.ndarray, phases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return frequencies.astype(np.float32), phases.astype(np.float32)


def _mean_features(rows: DataFrame, features: list[str], frequencies, phases, n: int) -> np.ndarray:
    """The mean random features of all rows."""
    single = _single(frequencies, phases)

    def run(batches):
        total = np.zeros(len(phases))
        for batch in batches:
            x = matrix(batch, features).astype(np.float32)
            for at in range(0, len(x), PIECE):
                z = random_features(x[at : at + PIECE], *single)
                total += np.ones(len(z), np.float32) @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add) / n


def _products(rows: DataFrame, features: list[str], frequencies, phases, weights: np.ndarray) -> DataFrame:
    """`rows` with `s`, their product with the weights in single precision."""
    single, w = _single(frequencies, phases), weights.astype(np.float32)

    def run(batches):
        for batch in batches:
            x = matrix(batch, features).astype(np.float32)
            parts = [(random_features(x[at : at + PIECE], *single) @ w).astype(np.float64) for at in range(0, len(x), PIECE)]
            yield batch.append_column("s", pa.array(np.concatenate([np.zeros(0), *parts])))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("s", T.DoubleType())]))


def _descend(rows: DataFrame, features: list[str], frequencies, phases, theta: np.ndarray, width: float, mass: float, tol: float):
    """(weights and margin, largest entry of the gradient, Newton steps taken) of the loss of one width."""
    n = len(phases)

    def objective(loss: float, at: np.ndarray) -> float:
        return 0.5 * float(at[:-1] @ at[:-1]) - float(at[-1]) + loss / mass

    loss, first, second = _sums(rows, features, frequencies, phases, theta, width)
    for taken in range(STEPS + 1):
        gradient = np.append(theta[:-1], -1.0) + first / mass
        slope = float(np.abs(gradient).max())
        if slope <= tol or taken == STEPS:
            break
        curvature = second / mass + np.diag(np.append(np.ones(n), 1e-9))
        step, share, before = np.linalg.solve(curvature, gradient), 1.0, objective(loss, theta)
        while True:  # the loss is convex: a short enough step falls
            after = theta - share * step
            loss, first, second = _sums(rows, features, frequencies, phases, after, width)
            if objective(loss, after) <= before - 1e-4 * share * float(step @ gradient) or share < 1e-6:
                break
            share /= 4.0
        theta = after
    return theta, slope, taken


def fit_fourier_one_class(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    label: str,
    nu: float = 0.002,
    sample_rows: int | None = None,
    seed: int = 42,
    n_features: int = N_FEATURES,
    tol: float = 1e-5,
) -> FourierOneClass:
    """Fitted on all rows; `sample_rows` asks for a class-stratified sample instead. Labels serve the sample only."""
    features = list(features)
    slim = [F.col(f).cast("double").alias(f) for f in features]
    if sample_rows is not None:
        chosen = stratified_sample(df.select(key, label, *features), key, label, sample_rows, seed)
        rows = materialize(chosen.select(*slim), "one-class-rows")
    else:
        rows = df.select(*slim)  # read in place by a few scans, so it should be a stored table
    stats = melt(rows, features).agg(F.var_pop("value").alias("v"), F.count("value").alias("n")).first()
    n = stats["n"] // len(features) if features else 0
    if not n:
        raise ValueError("no rows to fit on")
    gamma = 1.0 / (len(features) * stats["v"]) if stats["v"] else 1.0
    frequencies, phases = draw_frequencies(len(features), n_features, gamma, seed)
    mass, machine = max(nu * n, 1.0), (features, frequencies, phases)

    # the mean of all rows as first weights, and the nu-quantile of its products as first margin
    theta = np.append(_mean_features(rows, *machine, n), 0.0)
    theta[-1] = _products(rows, *machine, theta[:-1]).agg(F.percentile_approx("s", nu, 1000)).first()[0]
    unit = max(abs(theta[-1]), 1e-3)
    widths = [w * unit for w in WIDTHS]
    if n <= WARM_ROWS:
        stored = materialize(rows, "one-class-rows") if sample_rows is None else rows
        for width in widths:
            theta, slope, _ = _descend(stored, *machine, theta, width, mass, tol)
    else:
        few = stratified_sample(df.select(key, label, *features), key, label, WARM_ROWS, seed)
        few = materialize(few.select(*slim), "one-class-start")
        for width in widths:
            theta, _, _ = _descend(few, *machine, theta, width, max(nu * WARM_ROWS, 1.0), tol)
        for _ in range(SCANS):
            theta, slope, taken = _descend(_tail(rows, *machine, theta, widths[-1], unit), *machine, theta, widths[-1], mass, tol)
            if not taken:  # the rows were chosen at these very weights, so this is the gradient over all rows
                break
        else:
            raise RuntimeError(f"the weights have not settled after {SCANS} scans")
    if slope > tol:
        raise RuntimeError(f"the gradient is still {slope:.2g}")
    return FourierOneClass(tuple(features), frequencies, phases, theta[:-1], float(theta[-1]), mass, slope)


def _tail(rows: DataFrame, features: list[str], frequencies, phases, theta: np.ndarray, width: float, room: float) -> DataFrame:
    """The rows that have a share in the sums at `theta`, and those that are farther off by at most `room`; stored."""
    reach = float(theta[-1]) - NONE_BELOW * width + room + SINGLE * float(np.linalg.norm(theta[:-1]))
    chosen = _products(rows, features, frequencies, phases, theta[:-1]).where(F.col("s") < F.lit(reach)).drop("s")
    return materialize(chosen, "one-class-tail")
