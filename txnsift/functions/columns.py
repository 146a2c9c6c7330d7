"""Column expressions: everything here stays inside JVM code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
SECONDS_PER_HOUR = 3600
#: Upper end of the hashes of `hash60`.
HASH_BOUND = 1 << 60


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_amount(amount: Column | str) -> Column:
    """Natural log of one plus the amount."""
    return F.log1p(_col(amount))


def hour_fraction(time_s: Column | str) -> Column:
    """Hour of day with fraction, from seconds since the first midnight."""
    return F.pmod(_col(time_s), F.lit(float(SECONDS_PER_DAY))) / F.lit(float(SECONDS_PER_HOUR))


def hour_bucket(time_s: Column | str) -> Column:
    """Whole hour of day, 0 to 23."""
    return F.floor(hour_fraction(time_s)).cast("int")


def day_index(time_s: Column | str) -> Column:
    """Whole days since the first midnight."""
    return F.floor(_col(time_s) / F.lit(float(SECONDS_PER_DAY))).cast("int")


def threshold_flag(value: Column | str, limit: float, hit: str = "FLAG", miss: str = "ok") -> Column:
    """`hit` where the absolute value is above `limit`, else `miss`."""
    return F.when(F.abs(_col(value)) > F.lit(float(limit)), F.lit(hit)).otherwise(F.lit(miss))


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    """`100 * part / whole`, rounded; null for an empty whole."""
    return F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits)


def percent_text(part: Column, whole: Column) -> Column:
    """Ratio as text with one decimal, such as `96.8%`; `N/A` for a zero denominator."""
    return F.when(whole == 0, F.lit("N/A")).otherwise(
        F.format_string("%.1f%%", F.try_divide(part * F.lit(100.0), whole))
    )


def inverted(score: Column | str) -> Column:
    """Turn a lower-is-stranger score into a higher-is-stranger one."""
    return -_col(score)


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds; a rule over nulls counts as not holding."""
    out = None
    for condition, label in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def reason_text(reasons: Sequence[tuple[Column, Column]], default: str = "ok") -> Column:
    """Texts of all reasons that hold, joined by `; `, or `default`."""
    joined = F.concat_ws("; ", *[F.when(cond, text) for cond, text in reasons])
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def hash60(seed: int | str, key: Column | str) -> Column:
    """Seeded 60-bit hash of a key as a non-negative bigint; equal on every engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def row_hash60(columns: Sequence[Column | str]) -> Column:
    """60-bit hash of a row: each value as text behind its length, a null as a dash, so no two rows share a text."""
    texts = [_col(c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("bigint")
