"""Profiling suite: named reports over one table, written or summarised together."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnsift.functions import percent
from txnsift.operators import profile
from txnsift.session import materialize


def suite(
    df: DataFrame, time_s: str, amount: str, label: str, features: Sequence[str]
) -> dict[str, Callable[[], DataFrame]]:
    """Reports by name, in running order.

    Two small tables, each from one scan and stored once, carry all reports but two: counts per
    class, day and hour, and moments per class and feature. The label has to be 0 or 1.
    """
    cube, moments = shared_tables(df, time_s, label, features)
    return {
        "class_balance": lambda: profile.balance_from_calendar(cube, label),
        "time_coverage": lambda: profile.coverage_from_calendar(cube),
        "rate_by_hour": lambda: profile.rates_from_calendar(cube, "hour_of_day", label),
        "amount_quantiles": lambda: profile.exact_quantiles_by_label(df, amount, label),
        "zero_amount": lambda: profile.zero_amounts(df, amount, label),
        "feature_ranges": lambda: profile.ranges_from_moments(moments, label),
        "label_correlation": lambda: profile.correlation_from_moments(moments, label),
        "label_distributions": lambda: profile.distributions_from_moments(moments, features, label),
        "separation_scores": lambda: profile.separation_from_moments(moments, label),
        "rate_by_day": lambda: profile.rates_from_calendar(cube, "day", label),
    }


def shared_tables(df: DataFrame, time_s: str, label: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The stored cube of counts and the stored class moments."""
    cube = materialize(profile.calendar(df, time_s, label), "calendar")
    return cube, materialize(profile.label_moments(df, features, label), "moments")


def run_suite(reports: Mapping[str, Callable[[], DataFrame]], folder: str) -> dict[str, str]:
    """Write every report as parquet below `folder`; returns the path per report."""
    paths = {}
    for name, plan in reports.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        plan().write.mode("overwrite").parquet(paths[name])
    return paths


def summary(df: DataFrame, time_s: str, amount: str, label: str, features: Sequence[str]) -> DataFrame:
    """The headline record: one row, one struct or array of structs per report."""
    cube, moments = shared_tables(df, time_s, label, features)
    positives = F.sum(F.when(F.col(label) == 1, F.col("n_rows")).otherwise(F.lit(0)))
    counts = cube.agg(F.sum("n_rows").alias("row_count"), positives.alias("n_positive")).withColumn(
        "positive_pct", percent(F.col("n_positive"), F.col("row_count"))
    )
    hours = profile.rates_from_calendar(cube, "hour_of_day", label)
    correlations = profile.correlation_from_moments(moments, label)
    separation = profile.separation_from_moments(moments, label)
    ranges = profile.ranges_from_moments(moments, label)
    parts = {
        "class_balance": counts,
        "time_coverage": profile.coverage_from_calendar(cube),
        "peak_hour": profile.peak_bucket(hours, "hour_of_day"),
        "rate_by_day": profile.rates_from_calendar(cube, "day", label),
        "amount": profile.approx_quantiles_by_label(df, amount, label),
        "zero_amount": profile.zero_amounts(df, amount, label),
        "flagged_features": ranges.where(F.col("mean_flag") == "FLAG").select("feature"),
        "top_correlations": correlations.orderBy(F.col("abs_corr").desc(), "feature").limit(6),
        "top_separation": separation.orderBy(F.col("sep_score").desc(), "feature").limit(6),
    }
    record = profile.summary_record(parts)
    single = ("class_balance", "time_coverage", "peak_hour", "zero_amount")
    lists = {name: F.col(name)[0] for name in single}
    lists["rate_by_day"] = F.array_sort("rate_by_day")
    lists["top_correlations"] = _sorted_by("top_correlations", "abs_corr")
    lists["top_separation"] = _sorted_by("top_separation", "sep_score")
    return record.withColumns(lists)


def _sorted_by(array: str, field: str):
    """The array of structs by descending field, then by feature name."""
    keyed = F.transform(array, lambda s: F.struct((-s[field]).alias("o"), s["feature"].alias("f"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])
