"""Standard scaling and the scaled feature matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnsift.operators.profile import feature_table
from txnsift.operators.ranks import melt


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations per feature; two numbers per feature on the driver."""

    mean: dict[str, float]
    std: dict[str, float]

    def column(self, feature: str) -> Column:
        mean, std = self.mean.get(feature), self.std.get(feature)
        if not std:
            return F.lit(0.0)
        return (F.col(feature).cast("double") - F.lit(mean)) / F.lit(std)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: self.column(f) for f in self.mean})


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """One scan; a feature without variance scales to zero."""
    rows = (
        melt(df, features)
        .groupBy("feature")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
        .collect()
    )
    found = {r["feature"]: r for r in rows}
    return Scaler(
        {f: found[f]["mean"] if f in found else None for f in features},
        {f: found[f]["std"] if f in found else None for f in features},
    )


def scaled_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep` columns as they are plus every feature scaled."""
    return fit_scaler(df, features).transform(df.select(*keep, *features))


def feature_matrix(
    df: DataFrame,
    key: str,
    time_s: str,
    amount: str,
    label: str,
    raw: Sequence[str],
    expected_rows: int | None = None,
) -> DataFrame:
    """Key, label, day and all features (raw ones, log amount, hour of day), the features scaled.

    Raw time and amount are not kept. With `expected_rows` a different row count is an error.
    """
    if expected_rows is not None:
        found = df.count()
        if found != expected_rows:
            raise ValueError(f"expected {expected_rows} rows, got {found}")
    features = [*raw, "log_amount", "hour_of_day"]
    table = feature_table(df, time_s, amount, [key, label, *raw])
    return scaled_features(table, features, [key, label, "day"])
