"""Trip archetypes: clean, scale, sweep, cluster, profile and name the groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnsift.functions import first_match
from txnsift.operators import clustering, quality
from txnsift.operators.features import fit_scaler
from txnsift.operators.profile import group_profile
from txnsift.operators.sampling import row_cap
from txnsift.session import materialize

TRIP_COLUMNS = [
    "log_fare", "log_distance", "trip_duration_min", "tip_pct", "hour_of_day", "passenger_count", "is_airport",
]

MIN_ROWS = 10
TARGET_ROWS = 200_000


def archetype_label(suffix: str = "") -> Column:
    """Archetype name from group means. The limits, their order and the names are fixed values."""

    def c(name: str) -> Column:
        return F.col(f"{name}{suffix}")

    rules = [
        (c("is_airport") > 0.3, "Airport runs"),
        ((c("log_fare") > 3.2) & (c("trip_duration_min") > 30), "Long premium rides"),
        ((c("trip_duration_min") <= 10) & (c("log_distance") < 0.5), "Short urban hops"),
        ((c("hour_of_day") >= 22) | (c("hour_of_day") <= 4), "Late-night rides"),
        ((c("tip_pct") > 0.25) & (c("log_fare") > 2.5), "High-tip daytime"),
    ]
    return first_match(rules, "Standard weekday commutes")


@dataclass(frozen=True)
class Archetypes:
    profile: DataFrame
    sweep: DataFrame
    best_k: int
    rows_before: int
    rows_after: int

    @property
    def illustrative_only(self) -> bool:
        """Whether the input was smaller than nine tenths of the intended sample."""
        return self.rows_before < 0.9 * TARGET_ROWS


def name_groups(profile: DataFrame, cluster: str) -> DataFrame:
    """Put the archetype name, from the group means, next to each profiled cluster."""
    rest = [c for c in profile.columns if c != cluster]
    return profile.select(cluster, archetype_label("_mean").alias("label"), *rest)


def run(
    df: DataFrame,
    key: str,
    features: Sequence[str] = TRIP_COLUMNS,
    not_null: Sequence[str] = ("log_distance", "tip_pct"),
    ks: Sequence[int] = range(3, 9),
    restarts: int = 10,
    silhouette_rows: int = 5000,
    seed: int = 42,
) -> Archetypes:
    """Drop incomplete rows, scale, sweep k, cluster all rows with the best k, profile and name."""
    quality.require_columns(df, [key, *features])
    # stored once, so that whatever produced the trips (often a join) runs a single time
    stored = materialize(df.select(key, *features), "trips")
    counts = quality.null_drop_counts(stored, not_null).first()
    if counts["rows_after"] < MIN_ROWS:
        raise ValueError(f"only {counts['rows_after']} rows remain after dropping nulls")
    clean = stored.dropna(subset=list(not_null))
    scaler = fit_scaler(clean, features)
    scaled = scaler.transform(clean)
    fits = clustering.kmeans_sweep(scaled, features, key, ks, restarts, seed)
    sweep = clustering.sweep_table(fits, row_cap(scaled, key, silhouette_rows, seed), features)
    best = clustering.best_k(sweep)
    # the scaled values decide the cluster, the original values describe it
    renamed = [f"{f}__z" for f in features]
    both = clean.withColumns({f"{f}__z": scaler.column(f) for f in features})
    nearest = clustering.nearest_center(renamed, fits[best].centers)
    profile = group_profile(both.withColumn("cluster", nearest).select("cluster", *features), features, "cluster", "trip_count")
    return Archetypes(name_groups(profile, "cluster"), sweep, best, counts["rows_before"], counts["rows_after"])
