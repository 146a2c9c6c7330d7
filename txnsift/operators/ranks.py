"""Exact order statistics, prefix sums and ranks without a single-partition window.

Every function splits the ordered values into zones, works inside each zone in parallel and adds
the totals of the zones before it. Equal values are collapsed before the shuffle, so a value that
holds a third of all rows costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnsift.session import materialize, null_safe_join, small_rows

MAX_ZONES = 4096
#: Parts into which the values inside a bracket are cut, so that no task ranks a whole bracket.
PARTS = 64


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), name: str = "feature") -> DataFrame:
    """One row per (row, column): (by..., name, value double). One scan whatever the column count."""
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(by), list(columns), name, "value"
    )


def prefix_sums(
    counts: DataFrame, by: Sequence[str], zone: str, order: str, sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Inclusive running sums `cum_<s>` and totals `all_<s>` over (zone, order) within `by`.

    `counts` holds one row per (by, zone, order); zones must be ordered like `order`.
    """
    by = list(by)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    across = Window.partitionBy(*by).orderBy(direction(zone))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = (
        counts.groupBy(*by, zone)
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(
            *by,
            zone,
            *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__off_{s}") for s in sums],
            *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums],
        )
    )
    inside = (
        Window.partitionBy(*by, zone)
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = counts.select("*", *[F.sum(s).over(inside).alias(f"__in_{s}") for s in sums])
    joined = null_safe_join(running, offsets, [*by, zone])
    return joined.select(
        *counts.columns,
        *[(F.col(f"__in_{s}") + F.col(f"__off_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
    )


def zone_count(df: DataFrame) -> int:
    """Zones for a full ordering: a few per shuffle partition, within fixed limits."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_ZONES, 2 * partitions))


def with_zones(df: DataFrame, columns: Sequence[str], zones: int | None = None) -> DataFrame:
    """Add `<c>__zone` per column: the number of its value range, ranges holding like row counts."""
    zones = zones or zone_count(df)
    probs = [i / zones for i in range(1, zones)]
    inputs = df
    for c in columns:
        inputs = inputs.withColumn(f"{c}__in", F.col(c).cast("double"))
    names = [f"{c}__in" for c in columns]
    cuts = inputs.select(*names).stat.approxQuantile(names, probs, 1.0 / (2 * zones))
    splits = []
    for values in cuts:
        inner = sorted({v for v in values if v == v and abs(v) != float("inf")})
        splits.append([-float("inf"), *(inner or [0.0]), float("inf")])
    bucketizer = Bucketizer(
        splitsArray=splits, inputCols=names, outputCols=[f"{c}__zone" for c in columns], handleInvalid="keep"
    )
    return bucketizer.transform(inputs).drop(*names)


# -- selection of exact order statistics --------------------------------------------------------


#: Parts of the rows that are sketched apart, so that no task merges the sketches of all rows.
SKETCH_PARTS = 16


def column_stats(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], name: str, probs: Sequence[float], accuracy: int
) -> DataFrame:
    """Per (by, column), stored: n, nulls, zeros, negatives, mean, std, lowest, highest, and bounds per probability.

    One scan. Rows are sketched in `SKETCH_PARTS` parts dealt by a hash. A sketch errs by at most n/accuracy ranks of
    its part; its bounds are taken 2/accuracy to either side, so they hold the part's own order statistic, and the
    lowest and highest bounds of all parts hold that of all rows. Parts too short for that margin to exceed a few
    ranks give their whole range.
    """
    margin = 2.0 / accuracy
    points = sorted({min(1.0, max(0.0, p + s * margin)) for p in probs for s in (-1, 1)})
    position = {p: i for i, p in enumerate(points)}
    levels = F.array(*[F.lit(p) for p in points])
    aggregates, entries = [], []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        parts = {
            "n": F.count(value), "nulls": F.count_if(value.isNull()), "zeros": F.count_if(value == 0),
            "negatives": F.count_if(value < 0), "mean": F.avg(value), "squares": F.var_pop(value) * F.count(value),
            "lowest": F.min(value), "highest": F.max(value), "sketch": F.percentile_approx(value, levels, F.lit(accuracy)),
        }
        aggregates += [column.alias(f"__{part}{i}") for part, column in parts.items()]
        entries.append(F.struct(F.lit(c).alias(name), *[F.col(f"__{part}{i}").alias(part) for part in parts]))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(SKETCH_PARTS)).alias("__salt")
    sketched = df.withColumn("__salt", salt).groupBy(*by, "__salt").agg(*aggregates).select(*by, F.inline(F.array(*entries)))
    wide = F.col("n") > 4 * accuracy
    bounds = []
    for i, p in enumerate(probs):
        low, high = max(0.0, p - margin), min(1.0, p + margin)
        low_value = F.col("sketch")[position[low]] if low > 0 else F.col("lowest")
        high_value = F.col("sketch")[position[high]] if high < 1 else F.col("highest")
        bounds.append(F.min(F.when(wide, low_value).otherwise(F.col("lowest"))).alias(f"__lo{i}"))
        bounds.append(F.max(F.when(wide, high_value).otherwise(F.col("highest"))).alias(f"__hi{i}"))
    counts = [F.sum(c).alias(c) for c in ("n", "nulls", "zeros", "negatives")]
    total = F.sum(F.col("n") * F.col("mean"))
    mean = F.try_divide(total, F.sum("n").cast("double"))
    moments = F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "squares")))  # one per part
    stats = sketched.groupBy(*by, name).agg(
        *counts, mean.alias("mean"), moments.alias("__moments"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), *bounds
    )
    squares = F.aggregate(
        "__moments",
        F.lit(0.0),
        lambda total, m: total + m["squares"] + m["n"] * (m["mean"] - F.col("mean")) * (m["mean"] - F.col("mean")),
    )
    std = F.when(F.col("n") > 1, F.sqrt(squares / (F.col("n") - 1)))
    named = [c for i in range(len(probs)) for c in (f"__lo{i}", f"__hi{i}")]
    return materialize(
        stats.select(*by, name, "n", "nulls", "zeros", "negatives", "mean", std.alias("std"), "lowest", "highest", *named), "column-stats"
    )


def _part(value: Column, low: Column, high: Column) -> Column:
    """Place of a value between two bounds, as a whole number below PARTS that rises with the value."""
    place = F.try_divide((value - low) * F.lit(float(PARTS)), high - low)
    return F.coalesce(F.least(F.floor(place), F.lit(PARTS - 1)), F.lit(0)).cast("int")


def _ranked_candidates(long: DataFrame, keys: list[str], bounds: DataFrame, brackets: int) -> DataFrame:
    """Values inside any bracket with how many rows lie below (`before`) and up to them (`after`).

    Rows outside every bracket are only counted: they collapse to a row per zone and map task.
    """
    value = F.col("value").cast("double")
    passed_low = sum([(value >= F.col(f"__lo{i}")).cast("int") for i in range(brackets)], F.lit(0))
    passed_high = sum([(value > F.col(f"__hi{i}")).cast("int") for i in range(brackets)], F.lit(0))
    # brackets rise with their probability, so the last one entered holds every inside value
    part = F.lit(0)
    for i in range(brackets):
        part = F.when(value >= F.col(f"__lo{i}"), _part(value, F.col(f"__lo{i}"), F.col(f"__hi{i}"))).otherwise(part)
    inside = passed_low > passed_high
    zoned = null_safe_join(long, bounds, keys).select(
        *keys,
        "n",
        (
            (passed_low * F.lit(brackets + 1) + passed_high) * F.lit(PARTS) + F.when(inside, part).otherwise(F.lit(0))
        ).alias("zone"),
        F.when(inside, F.col("value")).alias("value"),
    )
    counts = zoned.groupBy(*keys, "n", "zone", "value").agg(F.count(F.lit(1)).alias("rows"))
    ranked = prefix_sums(counts, [*keys, "n"], "zone", "value", ["rows"])
    return ranked.where(F.col("value").isNotNull()).select(
        *keys, "n", "value", (F.col("cum_rows") - F.col("rows")).alias("before"), F.col("cum_rows").alias("after")
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
    name: str = "feature",
) -> DataFrame:
    """Exact linearly interpolated quantiles: (by..., feature, n, <one column per entry of probs>)."""
    found = quantiles_and_stats(df, columns, probs, by, accuracy, name).where(F.col("n") > 0)
    return found.select(*by, name, "n", *probs)


def quantiles_and_stats(
    df: DataFrame,
    columns: Sequence[str],
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
    name: str = "feature",
) -> DataFrame:
    """The statistics of `column_stats` with exact quantiles (null where a column has no value).

    Two scans and no full sort: a sketch brackets each quantile, then only the values inside the brackets (about
    4/accuracy of the rows each) are shuffled and ranked; all others are counted. A rank outside its bracket would be
    an error of the sketch, and fails the query.
    """
    keys = [*by, name]
    levels = list(probs.values())
    stats = column_stats(df, columns, by, name, levels, accuracy)
    # a generator instead of unpivot: its exchange is recognised as the same for both readers in
    # prefix_sums, so the rows are scanned once
    entries = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(*by, F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    bounds = stats.where(F.col("n") > 0).select(*keys, "n", *[c for c in stats.columns if c.startswith("__")])
    ranked = _ranked_candidates(long, keys, bounds, len(levels))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("after")), F.col("value")))

    picks = []
    for i, p in enumerate(levels):
        spot = (F.col("n") - 1) * F.lit(float(p))
        picks += [at(F.floor(spot)).alias(f"__a{i}"), at(F.ceil(spot)).alias(f"__b{i}")]
    picked = ranked.groupBy(*keys, "n").agg(*picks)
    out = []
    missed = F.raise_error(F.lit("no value found at the rank of a quantile")).cast("double")
    for i, (label, p) in enumerate(probs.items()):
        spot = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.coalesce(F.col(f"__a{i}"), missed), F.coalesce(F.col(f"__b{i}"), missed)
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(label))
    plain = stats.select(*[c for c in stats.columns if not c.startswith("__")])
    return null_safe_join(plain, picked.select(*keys, *out), keys, "left")


def _sketched_brackets(wanted: DataFrame, group: str, probs: Mapping, sizes: Mapping, accuracy: int) -> dict:
    """{group: (low, high)} certain to hold the value at the group's rank, from a sketch."""
    margin = 2.0 / accuracy
    points = sorted({min(1.0, max(0.0, p + s * margin)) for p in probs.values() for s in (-1, 1)})
    value = F.col("value").cast("double")
    sketches = small_rows(
        wanted.groupBy(group).agg(
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
            F.percentile_approx(value, F.array(*[F.lit(p) for p in points]), F.lit(accuracy)).alias("sketch"),
        ),
        "groups of an order statistic",
    )
    brackets = {}
    for row in sketches:
        g = row[group]
        at = dict(zip(points, row["sketch"]))
        is_wide = sizes[g] > 4 * accuracy
        low, high = max(0.0, probs[g] - margin), min(1.0, probs[g] + margin)
        brackets[g] = (
            at[low] if is_wide and low > 0 else row["lowest"],
            at[high] if is_wide and high < 1 else row["highest"],
        )
    return brackets


def _uniform_brackets(probs: Mapping, sizes: Mapping, bound: int) -> dict:
    """Brackets for values spread evenly over [0, bound): twelve deviations to either side.

    A miss is all but impossible and would show as a missing rank, never as a wrong one.
    """
    out = {}
    for g, p in probs.items():
        spread = 12.0 * (p * (1.0 - p) / sizes[g]) ** 0.5 + 12.0 / sizes[g]
        out[g] = (max(0.0, p - spread) * bound, min(1.0, p + spread) * bound)
    return out


def _is(group: str, g) -> Column:
    return F.col(group).eqNullSafe(F.lit(g))


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def kth_smallest(
    long: DataFrame, group: str, ranks: Mapping, sizes: Mapping, accuracy: int = 10_000, uniform: int | None = None
) -> dict:
    """Exact k-th smallest `value` per group of `long` (group, value): {group: (value, before, after)}.

    `ranks` gives k (from 1) and `sizes` the row count per group; both are small driver-side maps.
    Values known to be spread evenly over [0, uniform), such as hashes, need no sketch.
    """
    groups = [g for g in ranks if 0 < ranks[g] <= sizes.get(g, 0)]
    if not groups:
        return {}
    probs = {g: ranks[g] / sizes[g] for g in groups}
    value = F.col("value").cast("double")
    wanted = long.where(_any([_is(group, g) for g in groups]) & F.col("value").isNotNull())
    if uniform is None:
        brackets = _sketched_brackets(wanted, group, probs, sizes, accuracy)
    else:
        brackets = _uniform_brackets(probs, sizes, uniform)
    low, high, rank = F.lit(None), F.lit(None), F.lit(None)
    for g, (lo, hi) in brackets.items():
        here = _is(group, g)
        low = F.when(here, F.lit(float(lo))).otherwise(low)
        high = F.when(here, F.lit(float(hi))).otherwise(high)
        rank = F.when(here, F.lit(int(ranks[g]))).otherwise(rank)
    zoned = wanted.select(
        group,
        F.when(value < low, -1).when(value <= high, _part(value, low, high)).otherwise(PARTS).alias("zone"),
        F.when((value >= low) & (value <= high), F.col("value")).alias("value"),
    )
    counts = zoned.groupBy(group, "zone", "value").agg(F.count(F.lit(1)).alias("rows"))
    ranked = prefix_sums(counts, [group], "zone", "value", ["rows"]).where(F.col("value").isNotNull())
    hits = ranked.where((F.col("cum_rows") - F.col("rows") < rank) & (rank <= F.col("cum_rows"))).collect()
    found = {r[group]: (r["value"], r["cum_rows"] - r["rows"], r["cum_rows"]) for r in hits}
    missed = {g: ranks[g] for g in groups if g not in found}
    if missed and uniform is not None:
        found.update(kth_smallest(long, group, missed, sizes, accuracy))
    elif missed:
        raise RuntimeError(f"no value found at rank {missed}")
    return found


def group_sizes(df: DataFrame, group: str) -> dict:
    """{group: rows}; the groups have to be few (classes, models)."""
    return {r[group]: r["n"] for r in small_rows(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "groups")}


def first_k_filter(
    df: DataFrame,
    group: str,
    order: str,
    key: str,
    ranks: Mapping,
    accuracy: int = 10_000,
    sizes: Mapping | None = None,
    uniform: int | None = None,
) -> Column:
    """Condition that keeps, per group, exactly the first k rows by (order, key) ascending.

    `order` and `key` are numeric columns; `key` is unique. The condition holds literals only, so
    applying it is a filter without shuffle. Ties on `order`, however many, are cut by `key`.
    """
    sizes = group_sizes(df, group) if sizes is None else sizes
    keep_all = [g for g in sizes if ranks.get(g, 0) >= sizes[g]]
    partial = {g: k for g, k in ranks.items() if 0 < k < sizes.get(g, 0)}
    values = df.select(group, F.col(order).alias("value"))
    cuts = kth_smallest(values, group, partial, sizes, accuracy, uniform)
    tied = {g: (partial[g] - before, after - before) for g, (_, before, after) in cuts.items() if after > partial[g]}
    key_cuts: dict = {}
    if tied:
        at_cut = _any([_is(group, g) & (F.col(order) == F.lit(cuts[g][0])) for g in tied])
        key_cuts = kth_smallest(
            df.where(at_cut).select(group, F.col(key).alias("value")),
            group,
            {g: k for g, (k, _) in tied.items()},
            {g: n for g, (_, n) in tied.items()},
            accuracy,
        )
    condition = _any([_is(group, g) for g in keep_all])
    for g, (cut, _, _) in cuts.items():
        inside = F.col(order) <= F.lit(cut)
        if g in key_cuts:
            inside = (F.col(order) < F.lit(cut)) | (
                (F.col(order) == F.lit(cut)) & (F.col(key) <= F.lit(key_cuts[g][0]))
            )
        condition = condition | (_is(group, g) & inside)
    return F.coalesce(condition, F.lit(False))


def global_rank(df: DataFrame, order: str, key: str, descending: bool = True, name: str = "rank") -> DataFrame:
    """Add the 1-based position of every row by (order, key ascending), computed in parallel.

    Rows need a value and a key; others are left out. Rows are dealt by ranges of (order, key), so a value that many rows
    share is split by key, sorted in their range and stored once with their place in it; the rows of the ranges before,
    one number per range, are added when the table is read back.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    present = df.where(F.col(order).isNotNull() & F.col(key).isNotNull())
    ranged = present.repartitionByRange(zone_count(df), direction, F.col(key).asc()).sortWithinPartitions(direction, F.col(key).asc())
    # the low 33 bits count the rows of a partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("__range"), place.alias("__place")), "ranked")
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy().orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("__range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(starts), "__range").select(
        *df.columns, (F.col("__before") + F.col("__place") + 1).cast("bigint").alias(name)
    )
