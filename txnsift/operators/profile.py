"""Profiling aggregates over a labelled transaction table (label is 0 or 1)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnsift.functions import day_index, hour_bucket, hour_fraction, log_amount, percent, threshold_flag
from txnsift.operators.ranks import melt, quantiles_and_stats
from txnsift.session import null_safe_join

#: Fixed quantile levels of the amount report and of the feature fingerprint.
AMOUNT_LEVELS = {"p01": 0.01, "p10": 0.10, "p50": 0.50, "p90": 0.90, "p99": 0.99, "p999": 0.999}
FINGERPRINT_LEVELS = {"q01": 0.01, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q99": 0.99}


def _count() -> Column:
    return F.count(F.lit(1))


def _positives(label: str) -> Column:
    return F.sum(F.col(label).cast("bigint"))


def group_share(df: DataFrame, group: str, digits: int = 4) -> DataFrame:
    """Rows per group and their share of all rows in percent; the total is taken over the groups."""
    total = F.sum("n_rows").over(Window.partitionBy())
    return df.groupBy(group).agg(_count().alias("n_rows")).withColumn("pct", percent(F.col("n_rows"), total, digits))


def time_coverage(df: DataFrame, time_s: str) -> DataFrame:
    return df.agg(F.min(time_s).alias("min_time_s"), F.max(time_s).alias("max_time_s")).withColumn(
        "span_hours", F.round((F.col("max_time_s") - F.col("min_time_s")) / F.lit(3600.0), 2)
    )


def rate_by(df: DataFrame, bucket: Column, name: str, label: str) -> DataFrame:
    """Rows, positives and positive rate in percent per bucket."""
    return (
        df.groupBy(bucket.alias(name))
        .agg(_count().alias("n_transactions"), _positives(label).alias("n_positive"))
        .withColumn("positive_rate_pct", percent(F.col("n_positive"), F.col("n_transactions")))
    )


def rate_by_hour(df: DataFrame, time_s: str, label: str) -> DataFrame:
    return rate_by(df, hour_bucket(time_s), "hour_of_day", label)


def rate_by_day(df: DataFrame, time_s: str, label: str) -> DataFrame:
    return rate_by(df, day_index(time_s), "day", label)


def calendar(df: DataFrame, time_s: str, label: str) -> DataFrame:
    """(label, day, hour_of_day, n_rows, min_time_s, max_time_s): the cube behind all time reports."""
    return df.groupBy(label, day_index(time_s).alias("day"), hour_bucket(time_s).alias("hour_of_day")).agg(
        _count().alias("n_rows"), F.min(time_s).alias("min_time_s"), F.max(time_s).alias("max_time_s")
    )


def balance_from_calendar(cube: DataFrame, label: str) -> DataFrame:
    total = F.sum("n_rows").over(Window.partitionBy())
    return cube.groupBy(label).agg(F.sum("n_rows").alias("n_rows")).withColumn("pct", percent(F.col("n_rows"), total))


def rates_from_calendar(cube: DataFrame, bucket: str, label: str) -> DataFrame:
    positives = F.sum(F.when(F.col(label) == 1, F.col("n_rows")).otherwise(F.lit(0)))
    return (
        cube.groupBy(bucket)
        .agg(F.sum("n_rows").alias("n_transactions"), positives.alias("n_positive"))
        .withColumn("positive_rate_pct", percent(F.col("n_positive"), F.col("n_transactions")))
    )


def coverage_from_calendar(cube: DataFrame) -> DataFrame:
    return cube.agg(F.min("min_time_s").alias("min_time_s"), F.max("max_time_s").alias("max_time_s")).withColumn(
        "span_hours", F.round((F.col("max_time_s") - F.col("min_time_s")) / F.lit(3600.0), 2)
    )


def peak_bucket(rates: DataFrame, bucket: str, rate: str = "positive_rate_pct") -> DataFrame:
    """The bucket with the highest rate; the lowest bucket wins a tie."""
    best = F.max(F.struct(F.col(rate).alias("rate"), (-F.col(bucket)).alias("low")))
    return rates.agg(best.alias("best")).select(
        (-F.col("best.low")).cast("bigint").alias(f"peak_{bucket}"), F.col("best.rate").alias("peak_rate_pct")
    )


def approx_quantiles_by_label(df: DataFrame, amount: str, label: str, accuracy: int = 10_000) -> DataFrame:
    """Sketched amount quantiles per class in one scan; the rank error is at most n / accuracy."""
    levels = list(AMOUNT_LEVELS.items())
    sketch = F.percentile_approx(amount, F.array(*[F.lit(p) for _, p in levels]), F.lit(accuracy))
    return (
        df.groupBy(label)
        .agg(
            _count().alias("n"),
            sketch.alias("sketch"),
            F.round(F.avg(amount), 2).alias("mean_amount"),
            F.round(F.max(amount), 2).alias("max_amount"),
        )
        .select(
            label,
            "n",
            *[F.round(F.col("sketch")[i], 2).alias(name) for i, (name, _) in enumerate(levels)],
            "mean_amount",
            "max_amount",
        )
    )


def exact_quantiles_by_label(df: DataFrame, amount: str, label: str, accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated amount quantiles per class with mean, sample stddev and maximum."""
    found = quantiles_and_stats(df, [amount], AMOUNT_LEVELS, by=[label], accuracy=accuracy)
    return found.select(
        label,
        (F.col("n") + F.col("nulls")).alias("n"),
        *[F.round(name, 2).alias(name) for name in AMOUNT_LEVELS],
        F.round("mean", 2).alias("mean_amount"),
        F.round("std", 2).alias("std_amount"),
        F.round("highest", 2).alias("max_amount"),
    )


def zero_amounts(df: DataFrame, amount: str, label: str) -> DataFrame:
    """Rows with a zero amount, their positives and their rate (null when there are none)."""
    return (
        df.where(F.col(amount) == F.lit(0.0))
        .agg(_count().alias("n_zero_amount"), F.coalesce(_positives(label), F.lit(0)).alias("n_positive"))
        .withColumn("positive_rate_pct", percent(F.col("n_positive"), F.col("n_zero_amount")))
    )


def zero_uplift(df: DataFrame, amount: str, label: str) -> DataFrame:
    """How zero amounts compare with all rows: share of rows, share of positives, rate ratio."""
    zero = F.col(amount) == F.lit(0.0)
    counts = df.agg(
        _count().alias("n"),
        _positives(label).alias("p"),
        F.count_if(zero).alias("zn"),
        F.sum(F.when(zero, F.col(label).cast("bigint")).otherwise(F.lit(0))).alias("zp"),
    )
    zero_rate = F.try_divide(F.col("zp").cast("double"), F.col("zn").cast("double"))
    base_rate = F.try_divide(F.col("p").cast("double"), F.col("n").cast("double"))
    return counts.select(
        percent(F.col("zn"), F.col("n")).alias("zero_row_share_pct"),
        percent(F.col("zp"), F.col("p")).alias("zero_positive_share_pct"),
        F.round(F.try_divide(zero_rate, base_rate), 4).alias("uplift"),
    )


def feature_ranges(df: DataFrame, features: Sequence[str], mean_limit: float = 0.1) -> DataFrame:
    """Min, max, mean, sample stddev per feature; features with |mean| above the limit are flagged."""
    return (
        melt(df, features)
        .groupBy("feature")
        .agg(
            F.min("value").alias("min_val"),
            F.max("value").alias("max_val"),
            F.avg("value").alias("__mean"),
            F.stddev("value").alias("__std"),
        )
        .select(
            "feature",
            "min_val",
            "max_val",
            F.round("__mean", 6).alias("mean_val"),
            F.round("__std", 6).alias("std_val"),
            threshold_flag("__mean", mean_limit).alias("mean_flag"),
        )
    )


def label_correlation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of each feature with the label; null when either side is constant."""
    spread = F.stddev_pop("value") * F.stddev_pop(F.col(label).cast("double"))
    shared = F.covar_pop("value", F.col(label).cast("double"))
    return (
        melt(df, features, by=[label])
        .where(F.col("value").isNotNull())
        .groupBy("feature")
        .agg(F.when(spread > 0, F.try_divide(shared, spread)).alias("corr"))
        .select("feature", F.round("corr", 6).alias("corr_with_label"), F.round(F.abs("corr"), 6).alias("abs_corr"))
    )


def label_moments(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(label, feature, n, mean, std, var_pop, min, max) from one scan: one row per class and feature.

    Ranges, correlations with the label, class distributions and separation all follow from it.
    """
    value = F.col("value")
    return (
        melt(df, features, by=[label])
        .groupBy(label, "feature")
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev(value).alias("std"),
            F.var_pop(value).alias("var_pop"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
    )


def _pooled(moments: DataFrame, label: str) -> DataFrame:
    """Per feature: row counts, mean and squared deviations over both classes."""

    def pick(c: str, v: int) -> Column:
        return F.coalesce(F.max(F.when(F.col(label) == v, F.col(c))), F.lit(0.0))

    sides = moments.withColumn("n", F.col("n").cast("double")).groupBy("feature").agg(
        *[pick(c, v).alias(f"{c}{v}") for c in ("n", "mean", "var_pop") for v in (0, 1)],
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    n = F.col("n0") + F.col("n1")
    gap = F.col("mean1") - F.col("mean0")
    return sides.select(
        "*",
        n.alias("n"),
        F.try_divide(F.col("n0") * F.col("mean0") + F.col("n1") * F.col("mean1"), n).alias("mean"),
        gap.alias("gap"),
        (
            F.col("n0") * F.col("var_pop0")
            + F.col("n1") * F.col("var_pop1")
            + F.coalesce(F.try_divide(F.col("n0") * F.col("n1") * gap * gap, n), F.lit(0.0))
        ).alias("squares"),
    )


def ranges_from_moments(moments: DataFrame, label: str, mean_limit: float = 0.1) -> DataFrame:
    """`feature_ranges` from class moments, for a 0/1 label without nulls."""
    return _pooled(moments, label).select(
        "feature",
        F.col("min").alias("min_val"),
        F.col("max").alias("max_val"),
        F.round("mean", 6).alias("mean_val"),
        F.round(F.sqrt(F.try_divide(F.col("squares"), F.when(F.col("n") > 1, F.col("n") - 1))), 6).alias("std_val"),
        threshold_flag("mean", mean_limit).alias("mean_flag"),
    )


def correlation_from_moments(moments: DataFrame, label: str) -> DataFrame:
    """`label_correlation` from class moments: the covariance with a 0/1 label is n0 n1 gap / n^2."""
    spread = F.sqrt(F.col("squares") * F.col("n0") * F.col("n1") / F.col("n"))
    corr = F.when(spread > 0, F.try_divide(F.col("n0") * F.col("n1") * F.col("gap") / F.col("n"), spread))
    return (
        _pooled(moments, label)
        .where(F.col("n") > 0)
        .select("feature", corr.alias("corr"))
        .select("feature", F.round("corr", 6).alias("corr_with_label"), F.round(F.abs("corr"), 6).alias("abs_corr"))
    )


def rounded_moments(moments: DataFrame, label: str) -> DataFrame:
    return moments.select(label, "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def label_distributions(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row per class with `<feature>_mean` and `<feature>_std` columns."""
    return distributions_from_moments(label_moments(df, features, label), features, label)


def distributions_from_moments(moments: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    cells = rounded_moments(moments, label)
    picks = []
    for f in features:
        here = F.col("feature") == F.lit(f)
        picks.append(F.max(F.when(here, F.col("mean"))).alias(f"{f}_mean"))
        picks.append(F.max(F.when(here, F.col("std"))).alias(f"{f}_std"))
    return cells.groupBy(label).agg(*picks)


def separation_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Normalised mean difference per feature, from the rounded class means and deviations."""
    return separation_from_moments(label_moments(df, features, label), label)


def separation_from_moments(moments: DataFrame, label: str) -> DataFrame:
    moments = rounded_moments(moments, label)

    def pick(c: str, v: int) -> Column:
        return F.max(F.when(F.col(label) == v, F.col(c)))

    sides = moments.groupBy("feature").agg(
        pick("mean", 0).alias("mean_negative"),
        pick("mean", 1).alias("mean_positive"),
        pick("std", 0).alias("s0"),
        pick("std", 1).alias("s1"),
    )
    pooled = F.sqrt((F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")) / F.lit(2.0))
    diff = F.col("mean_positive") - F.col("mean_negative")
    return sides.select(
        "feature",
        "mean_negative",
        "mean_positive",
        F.round(diff, 6).alias("mean_diff"),
        F.round(pooled, 6).alias("pooled_std"),
        F.when(pooled > 0, F.round(F.try_divide(F.abs(diff), pooled), 6)).otherwise(F.lit(0.0)).alias("sep_score"),
    )


def fingerprint(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Per numeric column: moments, range, five exact quantiles, null, zero and negative counts."""
    found = quantiles_and_stats(df, columns, FINGERPRINT_LEVELS, accuracy=accuracy, name="column")
    return found.select(
        "column",
        "mean",
        "std",
        F.col("lowest").alias("min"),
        F.col("highest").alias("max"),
        *FINGERPRINT_LEVELS,
        F.col("nulls").alias("null_count"),
        F.col("zeros").alias("zero_count"),
        F.col("negatives").alias("negative_count"),
    )


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Total nulls and the names of the columns that hold them, in column order."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = sum([F.col(c) for c in columns], F.lit(0).cast("bigint"))
    names = F.concat_ws(",", *[F.when(F.col(c) > 0, F.lit(c)) for c in columns])
    return counts.select(total.alias("total_nulls"), names.alias("null_columns"))


def group_profile(
    df: DataFrame, features: Sequence[str], group: str, count_name: str = "n_rows", accuracy: int = 10_000
) -> DataFrame:
    """Per group: row count, share in percent, mean and exact median of every feature."""
    total = F.sum(count_name).over(Window.partitionBy())
    found = quantiles_and_stats(df, features, {"median": 0.5}, by=[group], accuracy=accuracy)
    wide = found.groupBy(group).agg(
        F.max(F.col("n") + F.col("nulls")).alias(count_name),
        *[F.max(F.when(F.col("feature") == f, F.col(s))).alias(f"{f}_{s}") for f in features for s in ("mean", "median")],
    )
    flat = [f"{f}_{s}" for f in features for s in ("mean", "median")]
    return (
        wide.withColumn("share_pct", percent(F.col(count_name), total, 2))
        .select(group, count_name, "share_pct", *flat)
    )


def band_share(df: DataFrame, time_s: str, label: str, first_hour: int, last_hour: int) -> DataFrame:
    """Share of all positives and of all rows that fall into an hour range (both ends included)."""
    inside = F.col("hour_of_day").between(first_hour, last_hour)
    return (
        rate_by_hour(df, time_s, label)
        .agg(
            F.sum("n_positive").alias("p"),
            F.sum("n_transactions").alias("n"),
            F.sum(F.when(inside, F.col("n_positive")).otherwise(0)).alias("bp"),
            F.sum(F.when(inside, F.col("n_transactions")).otherwise(0)).alias("bn"),
        )
        .select(
            percent(F.col("bp"), F.col("p")).alias("positive_share_pct"),
            percent(F.col("bn"), F.col("n")).alias("volume_share_pct"),
        )
    )


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Negatives, positives and their ratio (the usual positive class weight)."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label) == 1).alias("n_positive")
    ).withColumn(
        "negatives_per_positive",
        F.round(F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive").cast("double")), 2),
    )


def score_range(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    return (
        melt(df, scores, name="score")
        .groupBy("score")
        .agg(F.min("value").alias("min_score"), F.max("value").alias("max_score"))
    )


def summary_record(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One record from one-row tables (as structs) and small tables (as arrays of structs).

    Parts are appended and folded by one aggregate, so no join is needed.
    """
    stacked = None
    for name, df in parts.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    return stacked.agg(*[F.first(name, ignorenulls=True).alias(name) for name in parts])


def feature_table(df: DataFrame, time_s: str, amount: str, passthrough: Sequence[str]) -> DataFrame:
    """Add the two derived features and the day next to the given columns."""
    return df.select(
        *passthrough,
        log_amount(amount).alias("log_amount"),
        hour_fraction(time_s).alias("hour_of_day"),
        day_index(time_s).alias("day"),
    )
