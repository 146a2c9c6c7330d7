"""k-means sweeps, silhouettes, cluster profiles and principal components."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnsift.functions import HASH_BOUND, hash60, percent
from txnsift.operators.features import Scaler, fit_scaler
from txnsift.operators.tallqr import centred_factor
from txnsift.session import materialize, small_rows

#: Candidates that one seeding scan adds, and seeding scans. They bound the driver's part, not the rows that are read.
SEED_CANDIDATES, SEED_SCANS = 256, 4
#: Values of the hashed sample on which seedings settle before the first scan of all rows, and how much larger the next one is.
WARM_VALUES, LEVEL = 1 << 19, 16
#: Terms of a distance to all centroids above which it is a loop over arrays.
UNROLLED_TERMS = 64
#: Rows of a block of the pairwise silhouette.
PAIRWISE_BLOCK = 2_048
#: Groups of blocks of which all pairs meet, and most rows of a group.
GROUPS, GROUP_ROWS = 16, 1 << 16


@dataclass(frozen=True)
class Clustering:
    """Centroids of one fit; `inertia` is the summed squared distance over all rows."""

    features: tuple[str, ...]
    centers: tuple[tuple[float, ...], ...]
    inertia: float

    @property
    def k(self) -> int:
        return len(self.centers)

    def column(self) -> Column:
        """Number of the nearest centroid, as a JVM expression; the lower number wins a tie."""
        return nearest_center(self.features, self.centers)

    def assign(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        return df.withColumn(name, self.column())


def squared_distance(features: Sequence[str], center: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for f, c in zip(features, center):
        gap = F.col(f).cast("double") - F.lit(float(c))
        total = total + gap * gap
    return total


def nearest_center(features: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centroid, the lower one on ties.

    Many terms are a loop over a constant table of centroids: written out, they pass the size of generated code.
    """
    if len(features) * len(centers) > UNROLLED_TERMS:
        x = F.array(*[F.col(f).cast("double") for f in features])
        table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
        squares = lambda c: F.zip_with(x, c, lambda a, b: (a - b) * (a - b))
        distances = F.transform(table, lambda c: F.aggregate(squares(c), F.lit(0.0), lambda total, v: total + v))
        return F.array_position(distances, F.array_min(distances)).cast("int") - 1
    options = [
        F.struct(squared_distance(features, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)
    ]
    if len(options) == 1:
        return F.lit(0)
    return F.least(*options)["i"]


# -- k-means -------------------------------------------------------------------------------------


def _candidates(points: DataFrame, features: Sequence[str], key: str, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Seeding candidates with the number of rows nearest to each, and the mean variance of the features.

    Each scan of all rows draws `SEED_CANDIDATES` rows with chances in proportion to their squared distance from the
    candidates so far: every row runs a race of exponential clocks, each task keeps its first arrivals, and the
    first ones of all tasks win. The last scan weighs the candidates.
    """
    d = len(features)
    stats = points.agg(
        *[F.avg(f).alias(f"m{j}") for j, f in enumerate(features)], *[F.var_pop(f).alias(f"v{j}") for j, f in enumerate(features)]
    ).first()
    if stats[0] is None:
        raise ValueError("no rows to cluster")
    chosen = np.array([stats[:d]], dtype=np.float64)
    picked = []
    for scan in range(SEED_SCANS):
        draw = (hash60(f"{seed}:{scan}", F.col(key)) + 0.5) / float(HASH_BOUND)
        drawn = points.select(draw.alias("__u"), *features).mapInPandas(
            _racers(chosen), "at double, " + ", ".join(f"x{j} double" for j in range(d))
        )
        first = drawn.orderBy("at", *[f"x{j}" for j in range(d)]).limit(SEED_CANDIDATES)
        picked += [list(r[1:]) for r in first.collect()]
        chosen = np.array(picked, dtype=np.float64).reshape(-1, d) if picked else chosen
    chosen = np.unique(chosen, axis=0)
    weights = _assignment_sums(points.select(*features), features, {0: chosen})[0][0]
    return chosen[weights > 0], weights[weights > 0], float(np.mean(stats[d:]))


def _racers(chosen: np.ndarray):
    def race(batches: Iterable[pd.DataFrame]):
        best = np.zeros((0, chosen.shape[1] + 1))
        for batch in batches:
            data = batch.to_numpy(dtype=np.float64)
            for start in range(0, len(data), 2048):
                u, x = data[start : start + 2048, 0], data[start : start + 2048, 1:]
                gap = ((x * x).sum(axis=1)[:, None] - 2.0 * x @ chosen.T + (chosen * chosen).sum(axis=1)).min(axis=1)
                far = gap > 1e-12
                rows = np.column_stack([-np.log(u[far]) / gap[far], x[far]])
                best = np.vstack([best, rows])
                best = best[np.argsort(best[:, 0], kind="stable")[:SEED_CANDIDATES]]
        yield pd.DataFrame(best, columns=["at", *[f"x{j}" for j in range(chosen.shape[1])]])

    return race


def _seed_centers(rows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Distance-weighted seeding among weighted candidates."""
    centers: list[np.ndarray] = []
    gap = np.ones(len(rows))
    for _ in range(k):
        odds = np.cumsum(gap * weights)
        total = odds[-1]
        pick = rng.integers(len(rows)) if total <= 0 else min(np.searchsorted(odds, rng.random() * total), len(rows) - 1)
        centers.append(rows[pick])
        far = ((rows - rows[pick]) ** 2).sum(axis=1)
        gap = far if len(centers) == 1 else np.minimum(gap, far)
    return np.array(centers)


def _partial_sums(x: np.ndarray, centers: np.ndarray, starts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Per centroid: rows, feature sums and summed squared lengths of the (weighted) rows nearest to it.

    `centers` stacks all models, `starts` marks where each begins; a row joins one centroid of each.
    """
    total = np.zeros((len(centers), x.shape[1] + 2))
    offset = (centers * centers).sum(axis=1)[:, None]
    for start in range(0, len(x), 2048):
        part = x[start : start + 2048]
        gap = offset - 2.0 * (centers @ part.T)
        one = np.zeros_like(gap)
        at = np.arange(len(part))
        for a, b in zip(starts[:-1], starts[1:]):
            one[a + gap[a:b].argmin(axis=0), at] = 1.0 if weights is None else weights[start : start + 2048]
        total += one @ np.hstack([np.ones((len(part), 1)), part, (part * part).sum(axis=1)[:, None]])
    return total


def _warm_starts(
    spark: SparkSession, rows: np.ndarray, weights: np.ndarray, sample: np.ndarray, plans: list[tuple], limit: float
) -> dict[int, np.ndarray]:
    """Seed every (model, k, seeds) plan and settle it on the weighted candidates and on a sample of rows, one plan per task.

    The full rows then need few steps. Plans that settle on the same centroids would move alike and are kept once.
    """
    shared = spark.sparkContext.broadcast((rows, weights, sample))

    def settle(batches: Iterable[pd.DataFrame]):
        x, w, more = shared.value
        for batch in batches:
            for model, k, seed, restart in batch.itertuples(index=False):
                c = _seed_centers(x, w, min(k, len(x)), np.random.default_rng([seed, k, restart]))
                for data, weight, stop in ((x, w, limit), (more, None, 0.01 * limit)):
                    path = _Path(c)
                    for _ in range(300 if len(data) else 0):
                        t = _partial_sums(data, c, np.array([0, len(c)]), weight)
                        moved = np.where(t[:, :1] > 0, t[:, 1:-1] / np.maximum(t[:, :1], 1.0), c)
                        if ((moved - c) ** 2).sum() <= stop:
                            c = moved
                            break
                        cost = t[:, -1] - 2.0 * (c * t[:, 1:-1]).sum(axis=1) + t[:, 0] * (c * c).sum(axis=1)
                        c = moved if weight is not None else path.step(moved, cost.sum())
                yield pd.DataFrame({"model": [model], "k": [k], "centers": [c.reshape(-1).tolist()]})

    plan = spark.createDataFrame(plans, "model int, k int, seed bigint, restart int")
    found = plan.repartition(len(plans), "model").mapInPandas(settle, "model int, k int, centers array<double>")
    rows_of = {r["model"]: (r["k"], np.array(r["centers"]).reshape(-1, rows.shape[1])) for r in found.collect()}
    return _kept_once(rows_of, limit)


def _kept_once(models: dict[int, tuple[int, np.ndarray]], limit: float) -> dict[int, np.ndarray]:
    """The centroids of {model: (k, centroids)}, without models that are nearer to an earlier one than where a model stops."""
    out, seen = {}, {}
    for m in sorted(models):
        k, c = models[m]
        c = c[np.lexsort(c.T[::-1])]
        alike = seen.setdefault((k, len(c)), [])
        if all(((c - other) ** 2).sum() > limit for other in alike):
            alike.append(c)
            out[m] = c
    return out


def _assignment_sums(points: DataFrame, features: Sequence[str], models: dict[int, np.ndarray]) -> dict:
    """{model: (rows, sums, cost)} with one entry per centroid, for all models in one scan."""
    d = len(features)
    order = sorted(models)
    stacked = np.vstack([models[m] for m in order])
    starts = np.cumsum([0, *[len(models[m]) for m in order]])
    sums = [f"s{j}" for j in range(d)]
    columns = ["n", *sums, "q"]
    schema = ", ".join(["slot int", *[f"{c} double" for c in columns]])

    def partial(batches: Iterable[pd.DataFrame]):
        total = np.zeros((len(stacked), d + 2))
        for batch in batches:
            total += _partial_sums(batch.to_numpy(dtype=np.float64), stacked, starts)
        out = pd.DataFrame(total, columns=columns)
        yield out.assign(slot=np.arange(len(out)))[out["n"] > 0]

    folded = points.mapInPandas(partial, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns])
    total = np.zeros((len(stacked), d + 2))
    for row in small_rows(folded, "centroids of all models"):
        total[row["slot"]] = row[1:]
    rows, moved, length = total[:, 0], total[:, 1:-1], total[:, -1]
    cost = length - 2.0 * (stacked * moved).sum(axis=1) + rows * (stacked * stacked).sum(axis=1)
    cuts = starts[1:-1]
    return dict(zip(order, zip(np.split(rows, cuts), np.split(moved, cuts), np.split(cost, cuts))))


class _Path:
    """Moves centroids to the means of their rows with momentum, dropped whenever the cost rises.

    Plain means creep for hundreds of scans where clusters overlap; momentum saves most of them.
    """

    def __init__(self, start: np.ndarray):
        self.mean, self.cost, self.age = start, np.inf, 0

    def step(self, mean: np.ndarray, cost: float) -> np.ndarray:
        self.age = self.age + 1 if cost <= self.cost else 0
        ahead = self.age / (self.age + 3.0) * (mean - self.mean)
        self.mean, self.cost = mean, cost
        return mean + ahead


def _settled(points: DataFrame, features: Sequence[str], centers: dict[int, np.ndarray], limit: float, max_iter: int) -> tuple[dict, set]:
    """Centroids that are the means of their rows up to `limit`, and the models for which `max_iter` scans were not enough."""
    centers, active = dict(centers), set(centers)
    paths = {m: _Path(c) for m, c in centers.items()}
    for _ in range(max_iter):
        if not active:
            break
        found = _assignment_sums(points, features, {m: centers[m] for m in active})
        for m, (rows_in, sums, cost) in found.items():
            mean = np.where(rows_in[:, None] > 0, sums / np.maximum(rows_in, 1.0)[:, None], centers[m])
            if ((mean - centers[m]) ** 2).sum() <= limit:
                centers[m] = mean
                active.discard(m)
            else:
                centers[m] = paths[m].step(mean, cost.sum())
    return centers, active


def kmeans_sweep(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    ks: Sequence[int] = range(3, 9),
    restarts: int = 10,
    seed: int = 42,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> dict[int, Clustering]:
    """The fit with the lowest inertia over `restarts` seedings, for every k.

    All restarts of all k move together: one scan of the rows per step serves every model, and only sums per centroid
    leave the executors. `df` is read in place by every scan, so it should be a stored table. Seeds are drawn from all
    rows; they settle on hashed samples of growing size first, so that few scans of all rows are left. A model stops where
    its centroids are the means of their rows up to `tol` of the mean variance; one that has not done so after `max_iter`
    steps is an error.
    """
    points = df.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    rows, weights, variance = _candidates(points, features, key, seed)
    plans = [(i, k, seed, r) for i, (k, r) in enumerate((k, r) for k in ks for r in range(restarts))]
    wanted = {model: k for model, k, _, _ in plans}
    limit = tol * variance
    n = max(1.0, float(weights.sum()))  # the weights count all rows
    sizes = [max(1, WARM_VALUES // max(1, len(features)))]
    while 4 * LEVEL * sizes[-1] <= n:
        sizes.append(LEVEL * sizes[-1])

    def part(rows: DataFrame, size: int) -> DataFrame:
        return rows.where(F.col("__hash") <= F.lit(int(min(1.0, size / n) * HASH_BOUND)))

    hashed, levels = points.select(hash60(f"{seed}:warm", F.col(key)).alias("__hash"), *features), []
    for size in sizes[:0:-1]:  # each sample is a part of the next larger one
        hashed = materialize(part(hashed, size), "kmeans-level")
        levels.insert(0, hashed.select(*features))
    few = part(hashed, sizes[0]).select(*features)
    sample = few.toPandas().to_numpy(dtype=np.float64).reshape(-1, len(features))  # some `WARM_VALUES` numbers
    sample = sample[np.lexsort(sample.T[::-1])]  # the same sums on every partitioning
    centers = _warm_starts(df.sparkSession, rows, weights, sample, plans, limit)
    for level in levels:  # starts for all rows only: whatever they are, a model ends where all rows settle
        centers, _ = _settled(level, features, centers, 0.1 * limit, max_iter)
        centers = _kept_once({m: (wanted[m], c) for m, c in centers.items()}, limit)

    points = points.select(*features)
    centers, active = _settled(points, features, centers, limit, max_iter)
    if active:
        raise RuntimeError(f"{len(active)} models have not settled after {max_iter} steps")
    inertia = {m: cost.sum() for m, (_, _, cost) in _assignment_sums(points, features, centers).items()}
    best: dict[int, Clustering] = {}
    for m in sorted(centers):
        k = wanted[m]
        if k not in best or inertia[m] < best[k].inertia:
            best[k] = Clustering(tuple(features), tuple(map(tuple, centers[m].tolist())), float(inertia[m]))
    return best


def total_inertia(df: DataFrame, clustering: Clustering) -> DataFrame:
    """Rows and summed squared distance to the nearest centroid."""
    gaps = [squared_distance(clustering.features, c) for c in clustering.centers]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.least(*gaps)).alias("inertia"))


def group_centers(df: DataFrame, features: Sequence[str], group: str) -> Clustering:
    """Group means as centroids, numbered in group order."""
    means = df.groupBy(group).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    rows = sorted(small_rows(means, "groups"), key=lambda r: r[group])
    return Clustering(tuple(features), tuple(tuple(r[f] for f in features) for r in rows), float("nan"))


# -- silhouettes ---------------------------------------------------------------------------------


def silhouette(sample: DataFrame, features: Sequence[str], clusters: Sequence[str], block: int = PAIRWISE_BLOCK) -> DataFrame:
    """Mean Euclidean silhouette per assignment column: (assignment, n_rows, silhouette).

    Rows are packed into stored blocks and the blocks dealt to groups. Two groups meet in one task call of bounded memory, which adds distances
    up per row and cluster in both directions; the sums of a block over all others are added and scored together. A block is sent
    once for each group, `GROUPS` times up to `GROUPS` x `GROUP_ROWS` rows, whatever their number. All
    assignments share the distances, no pair of rows is emitted and nothing but cluster sizes reaches the driver.
    """
    names, d = list(clusters), len(features)
    labels = F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("int").alias("c")) for j, c in enumerate(names)]))
    counts = sorted(small_rows(sample.select(labels).groupBy("j", "c").agg(F.count(F.lit(1)).alias("n")), "clusters"))
    slots = {(j, c): i for i, (j, c, _) in enumerate(counts)}
    sizes = np.array([n for _, _, n in counts], dtype=np.float64)
    of = np.array([j for j, _, _ in counts], dtype=np.int64)
    total = int(sizes[of == 0].sum())
    n_blocks = max(1, -(-total // block))

    def pack(batches: Iterable[pd.DataFrame]):
        held = [b.to_numpy(dtype=np.float64) for b in batches]
        data = np.vstack(held) if held else np.zeros((0, d + len(names)))
        if len(data):
            own = [[slots[j, int(c)] for j, c in enumerate(row)] for row in data[:, d:]]
            at = TaskContext.get().partitionId()
            yield pd.DataFrame({"block": [at], "x": [data[:, :d].tobytes()], "own": [np.array(own, np.int32).tobytes()]})

    columns = [F.col(f).cast("double").alias(f) for f in features] + [F.col(c).cast("double").alias(f"__{c}") for c in names]
    dealt = sample.select(*columns).repartition(n_blocks)
    blocks = materialize(dealt.mapInPandas(pack, "block int, x binary, own binary"), "silhouette-blocks")
    groups = min(n_blocks, max(GROUPS, -(-total // GROUP_ROWS)))
    tiles = blocks.withColumn("group", F.pmod("block", F.lit(groups))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tiles = tiles.withColumn("low", F.least("group", "other")).withColumn("high", F.greatest("group", "other"))

    def add_up(tile: pd.DataFrame) -> pd.DataFrame:
        held = []
        for at, x, own, group in tile.sort_values("block")[["block", "x", "own", "group"]].itertuples(index=False):
            points = np.frombuffer(x).reshape(-1, d)
            member = np.zeros((len(points), len(sizes)))
            member[np.arange(len(points))[:, None], np.frombuffer(own, np.int32).reshape(len(points), -1)] = 1.0
            held.append((at, own, group, points, (points * points).sum(axis=1), member, np.zeros(member.shape)))
        low, high = int(tile["low"].iloc[0]), int(tile["high"].iloc[0])
        for i, (_, _, g, x, x2, own_member, own_sums) in enumerate(held):
            for j, (_, _, h, y, y2, member, sums) in enumerate(held):
                if (low == high and j < i) or (low != high and (g != low or h != high)):
                    continue
                gap = -2.0 * (x @ y.T) + x2[:, None] + y2[None, :]
                gap = np.sqrt(np.maximum(gap, 0.0))
                if i == j:
                    np.fill_diagonal(gap, 0.0)
                else:
                    sums += gap.T @ own_member
                own_sums += gap @ member
        rows = [(at, own, sums.tobytes()) for at, own, _, _, _, _, sums in held]
        return pd.DataFrame(rows, columns=["left", "lo", "sums"])

    def score(parts: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(v).reshape(-1, len(sizes)) for v in parts["sums"])
        owners = np.frombuffer(parts["lo"].iloc[0], np.int32).reshape(len(sums), -1)
        rows, out = np.arange(len(sums)), []
        for j in range(len(names)):
            own, mine = owners[:, j], np.where(of == j, sums / sizes, np.inf)
            a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
            mine[rows, own] = np.inf
            b = mine.min(axis=1)
            valid = (sizes[own] > 1) & np.isfinite(b)
            b = np.where(valid, b, 0.0)
            s = np.where(valid, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            out.append((names[j], s.sum(), len(s)))
        return pd.DataFrame(out, columns=["assignment", "total", "n"])

    partial = tiles.groupBy("low", "high").applyInPandas(add_up, "left int, lo binary, sums binary")
    scored = partial.groupBy("left").applyInPandas(score, "assignment string, total double, n bigint")
    return scored.groupBy("assignment").agg(
        F.sum("n").alias("n_rows"), F.try_divide(F.sum("total"), F.sum("n").cast("double")).alias("silhouette")
    )


def silhouette_squared(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """Silhouette with squared Euclidean distances over all rows: (n_rows, silhouette).

    Cluster sizes, sums and squared lengths give every mean distance, so two scans suffice.
    """
    length = sum([F.col(f) * F.col(f) for f in features], F.lit(0.0))
    stats = small_rows(
        df.groupBy(cluster).agg(
            F.count(F.lit(1)).alias("__n"), F.sum(length).alias("__q"), *[F.sum(f).alias(f) for f in features]
        ),
        "clusters",
    )
    distances = []
    for row in stats:
        dot = sum([F.col(f) * F.lit(row[f]) for f in features], F.lit(0.0))
        total = F.lit(float(row["__n"])) * F.col("__len") - 2.0 * dot + F.lit(row["__q"])
        distances.append((row[cluster], row["__n"], total))
    rows = df.withColumn("__len", length)
    own, other = F.lit(None).cast("double"), []
    size = F.lit(None).cast("bigint")
    for c, n, total in distances:
        here = F.col(cluster) == F.lit(c)
        own = F.when(here, total / F.lit(float(max(n - 1, 1)))).otherwise(own)
        size = F.when(here, F.lit(n)).otherwise(size)
        other.append(F.when(~here, total / F.lit(float(n))))
    a, b = F.col("__a"), F.col("__b")
    nearest = F.least(*other) if len(other) > 1 else F.lit(None).cast("double")
    scored = rows.select(own.alias("__a"), nearest.alias("__b"), size.alias("__n"))
    s = F.when((F.col("__n") > 1) & b.isNotNull(), F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def sweep_table(
    fits: dict[int, Clustering], sample: DataFrame, features: Sequence[str]
) -> DataFrame:
    """(k, inertia, silhouette) per k; a fit that leaves one cluster scores -1."""
    spark = sample.sparkSession
    names = {f"k{k}": k for k in fits}
    assigned = sample.withColumns({name: fits[k].column() for name, k in names.items()})
    found = {r["assignment"]: r["silhouette"] for r in silhouette(assigned, features, list(names)).collect()}
    rows = [(k, fits[k].inertia, found[name] if fits[k].k > 1 else -1.0) for name, k in names.items()]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def best_k(sweep: DataFrame) -> int:
    """The k with the highest silhouette, the first on ties."""
    return sweep.orderBy(F.col("silhouette").desc(), "k").first()["k"]


# -- profiles ------------------------------------------------------------------------------------


def drivers_column(features: Sequence[str], n: int = 3) -> Column:
    """Names of the n columns with the largest absolute value, joined by `|`; ties keep their order."""
    entries = [
        F.struct((-F.abs(F.col(f))).alias("a"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(features)
    ]
    return F.concat_ws("|", F.transform(F.slice(F.array_sort(F.array(*entries)), 1, n), lambda e: e["f"]))


def top_drivers(
    df: DataFrame, features: Sequence[str], group: str, n: int = 3, name: str = "top3_driving_features"
) -> DataFrame:
    means = df.groupBy(group).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    return means.select(group, drivers_column(features, n).alias(name))


def cluster_profile(
    df: DataFrame, features: Sequence[str], cluster: str, label: str, amount_feature: str = "log_amount"
) -> DataFrame:
    """Per cluster: size, share, mean scaled amount, positive rate and the three main features."""
    total = F.sum("size").over(Window.partitionBy())
    means = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg(F.col(label).cast("double")).alias("__rate"),
        *[F.avg(F.col(f).cast("double")).alias(f) for f in features],
    )
    return means.select(
        cluster,
        "size",
        percent(F.col("size"), total, 3).alias("pct_of_total"),
        F.round(amount_feature, 4).alias(f"mean_{amount_feature}"),
        F.round("__rate", 6).alias("positive_rate"),
        drivers_column(features).alias("top3_driving_features"),
    )


def highest_rate_cluster(profile: DataFrame, cluster: str) -> DataFrame:
    """The cluster with the highest positive rate and its lift over the rate of all rows."""
    positives = F.col("positive_rate") * F.col("size")
    base = F.try_divide(F.sum(positives).over(Window.partitionBy()), F.sum("size").over(Window.partitionBy()))
    ranked = profile.withColumn("__base", base).orderBy(F.col("positive_rate").desc(), cluster).limit(1)
    return ranked.select(cluster, "positive_rate", F.round(F.try_divide("positive_rate", "__base"), 4).alias("lift"))


# -- principal components ------------------------------------------------------------------------


@dataclass(frozen=True)
class Components:
    features: tuple[str, ...]
    scaler: Scaler
    loadings: tuple[tuple[float, ...], ...]
    variance_ratio: tuple[float, ...]

    def columns(self, n: int) -> list[Column]:
        centred = F.array(*[F.col(f).cast("double") - F.lit(self.scaler.mean[f]) for f in self.features])
        out = []
        for loadings in self.loadings[:n]:
            products = F.zip_with(centred, F.array(*map(F.lit, loadings)), lambda a, b: a * b)
            out.append(F.aggregate(products, F.lit(0.0), lambda total, v: total + v))
        return out


def fit_components(df: DataFrame, features: Sequence[str], n: int = 50) -> Components:
    """Principal components of the centred features; the largest loading of each is positive.

    They come from the singular values of the table's triangular factor, not from a covariance, so columns far from zero
    keep their digits.
    """
    scaler = fit_scaler(df, features)
    n = min(n, len(features))
    factor, _ = centred_factor(df, features, [scaler.mean[f] for f in features])
    _, singular, axes = np.linalg.svd(factor, full_matrices=True)
    variance = np.zeros(len(features))
    variance[: len(singular)] = singular**2
    total = variance.sum()
    ratio = variance / total if total > 0 else variance
    loadings = axes[:n]
    signs = np.sign(loadings[np.arange(n), np.abs(loadings).argmax(axis=1)])
    return Components(
        tuple(features),
        scaler,
        tuple(map(tuple, (loadings * signs[:, None]).tolist())),
        tuple(map(float, ratio[:n])),
    )


def map_table(df: DataFrame, components: Components, keep: Sequence[str]) -> DataFrame:
    """Two-dimensional positions for display: `keep` columns plus x and y."""
    x, y = components.columns(2)
    return df.select(*keep, x.alias("x"), y.alias("y"))
