"""Mergeable rank sketches: counts per bin of a fixed relative width, stored with a run so that its rows need not be kept.

Bins split every power of two into 2^digits equal parts, the same for all tables, so sketches merge by adding counts. Each bin
keeps its smallest and largest value. Distribution functions are exact at bin edges; between them the masses of the bin bound them. A
column has at most 4200 x 2^digits bins, whatever the number of rows; a value that very many rows share is one bin of one value and
costs no accuracy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnsift.operators.quality import KS_P_LIMIT, kolmogorov_tail
from txnsift.operators.ranks import melt, prefix_sums

#: Parts of a power of two, as a number of binary digits.
DIGITS = 10
#: Above minus the least exponent of a double, so that bins of positive numbers are positive.
EXPONENTS = 1100


def rank_bin(value: Column, digits: int = DIGITS) -> Column:
    """Number of the bin of a double: rises with the value; zero is 0, infinities and NaN have bins of their own at the ends."""
    size, parts = F.abs(value), float(1 << digits)
    power = F.floor(F.log2(size))
    place = F.floor((power + F.lit(EXPONENTS)) * parts + (size / F.pow(F.lit(2.0), power) - 1) * parts)
    last = F.lit((2 * EXPONENTS) << digits).cast("bigint")
    found = F.when(size == float("inf"), last).otherwise(place)
    return F.when(F.isnan(value), last + 1).when(value == 0, F.lit(0).cast("bigint")).when(value < 0, -found).otherwise(found)


def rank_sketch(df: DataFrame, columns: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """(column, bin, n_rows, low, high), from one scan; the bin of nulls is null.

    An empty table has an empty sketch.
    """
    values = melt(df, columns, name="column").withColumn("bin", rank_bin(F.col("value"), digits))
    return values.groupBy("column", "bin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The sketch of all rows behind a table of sketches (of deliveries, of partitions), of equal digits."""
    return sketches.groupBy("column", "bin").agg(
        F.sum("n_rows").alias("n_rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def ks_from_sketches(earlier: DataFrame, current: DataFrame, p_limit: float = KS_P_LIMIT, digits: int = DIGITS) -> DataFrame:
    """Per column: ks_stat, ks_high, ks_pvalue, n_null, flagged, undecided, from the sketches of both runs.

    The distance of the raw rows lies between ks_stat (at bin edges) and ks_high. `undecided` is 1 where the flag would
    differ between them. Nulls take no part; n_null counts them. Columns without a value on one side are left out.
    """
    n = F.col("n_rows")
    sides = earlier.select("*", n.alias("a"), F.lit(0).cast("bigint").alias("b")).unionByName(
        current.select("*", F.lit(0).cast("bigint").alias("a"), n.alias("b"))
    )
    bins = sides.groupBy("column", "bin").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    nulls = bins.groupBy("column").agg(F.sum(F.when(F.col("bin").isNull(), F.col("a") + F.col("b")).otherwise(0)).alias("n_null"))
    held = bins.where(F.col("bin").isNotNull()).withColumn("zone", F.shiftright("bin", digits))
    curve = prefix_sums(held, ["column"], "zone", "bin", ["a", "b"]).where("all_a > 0 AND all_b > 0")
    mass_a, mass_b = F.col("a") / F.col("all_a"), F.col("b") / F.col("all_b")
    end = F.col("cum_a") / F.col("all_a") - F.col("cum_b") / F.col("all_b")
    start = (F.col("cum_a") - F.col("a")) / F.col("all_a") - (F.col("cum_b") - F.col("b")) / F.col("all_b")
    inside = F.greatest(F.abs(start + mass_a), F.abs(start - mass_b), F.abs(end))
    high = F.when((F.col("low") < F.col("high")) & (F.col("a") + F.col("b") > 1), inside).otherwise(F.abs(end))
    scale = F.sqrt(F.col("all_a") * F.col("all_b") / (F.col("all_a") + F.col("all_b")))
    stats = curve.groupBy("column").agg(F.max(F.abs(end)).alias("ks_stat"), F.max(high).alias("ks_high"), F.max(scale).alias("scale"))
    p, p_high = (kolmogorov_tail(F.col("scale") * F.col(c)) for c in ("ks_stat", "ks_high"))
    judged = stats.join(nulls, "column").select("column", "ks_stat", "ks_high", p.alias("ks_pvalue"), p_high.alias("p_high"), "n_null")
    return judged.select(
        "column", "ks_stat", "ks_high", "ks_pvalue", "n_null",
        (F.col("ks_pvalue") < p_limit).cast("int").alias("flagged"),
        ((F.col("ks_pvalue") < p_limit) != (F.col("p_high") < p_limit)).cast("int").alias("undecided"),
    )
