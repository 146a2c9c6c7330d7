"""Deterministic samples and splits: the order is a seeded hash of the key, never a random draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnsift.functions import HASH_BOUND, hash60
from txnsift.operators.ranks import first_k_filter, global_rank, group_sizes


def sample_quotas(sizes: dict, wanted: int) -> dict:
    """Positives in proportion, rounded down; negatives fill the rest. Never more than exists."""
    n, positives = sum(sizes.values()), sizes.get(1, 0)
    if n == 0:
        return {}
    take_pos = min(positives, wanted * positives // n)
    return {1: take_pos, 0: min(sizes.get(0, 0), wanted - take_pos)}


def split_quotas(sizes: dict, fraction: float) -> dict:
    """Test rows per class: ceil(fraction * n) in total, shared by largest remainder."""
    n = sum(sizes.values())
    total = -int(-(n * fraction) // 1)
    exact = {c: total * m / n for c, m in sizes.items()}
    out = {c: int(x) for c, x in exact.items()}
    rest = total - sum(out.values())
    for c in sorted(exact, key=lambda c: (out[c] - exact[c], str(c)))[:rest]:
        out[c] += 1
    return out


def _first_by_hash(df: DataFrame, key: str, label: str, quotas: dict, sizes: dict, seed: int):
    hashed = df.withColumn("__hash", hash60(seed, key))
    slim = hashed.select(label, "__hash", key)
    return hashed, first_k_filter(slim, label, "__hash", key, quotas, sizes=sizes, uniform=HASH_BOUND)


def stratified_sample(df: DataFrame, key: str, label: str, wanted: int, seed: int = 42) -> DataFrame:
    """Exactly the wanted number of rows with the class ratio kept, without replacement.

    Per class the rows with the smallest seeded hash are kept; applying the sample is a filter.
    """
    sizes = group_sizes(df, label)
    hashed, keep = _first_by_hash(df, key, label, sample_quotas(sizes, wanted), sizes, seed)
    return hashed.where(keep).drop("__hash")


def stratified_split(
    df: DataFrame, key: str, label: str, fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the class ratio kept; test holds ceil(fraction * n) rows."""
    sizes = group_sizes(df, label)
    hashed, is_test = _first_by_hash(df, key, label, split_quotas(sizes, fraction), sizes, seed)
    return hashed.where(~is_test).drop("__hash"), hashed.where(is_test).drop("__hash")


def row_cap(df: DataFrame, key: str, wanted: int, seed: int = 42, n: int | None = None) -> DataFrame:
    """The min(wanted, n) rows with the smallest seeded hash, for metrics on a bounded sample."""
    n = df.count() if n is None else n
    if n <= wanted:
        return df
    grouped = df.withColumn("__all", F.lit(1))
    hashed, keep = _first_by_hash(grouped, key, "__all", {1: wanted}, {1: n}, seed)
    return hashed.where(keep).drop("__hash", "__all")


def shuffled_positions(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(key, position): a seeded permutation of all rows, ranked in parallel."""
    hashed = df.select(key, hash60(seed, key).alias("__hash"))
    return global_rank(hashed, "__hash", key, descending=False, name="position").select(key, "position")


def member_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in `ids`."""
    return df.join(ids.select(key), key, "left_semi")


def join_scores(tables: list[DataFrame], labels: DataFrame, key: str) -> DataFrame:
    """Score tables and labels side by side, matched on the row key."""
    out = labels
    for t in tables:
        out = out.join(t, key)
    return out
