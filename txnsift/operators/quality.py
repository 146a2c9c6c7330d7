"""Data-quality checks, content digests, drift between runs and the verdict."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnsift.functions import reason_text, row_hash60
from txnsift.operators.ranking import cumulative_counts

# Limits of the drift checks, texts of their reasons, and the checks that fail a table.
MEAN_DRIFT_LIMIT = 2.0
KS_P_LIMIT = 0.01
MEAN_DRIFT_TEXT = "mean-drift=%.3f>"
KS_TEXT = "KS p=%.4f<"
HARD_CHECKS = ("SCHEMA", "NULL", "NEGATIVE")

ISSUES = T.StructType(
    [
        T.StructField("check", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that `df` lacks, in the given order."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")


def null_drop_counts(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows before and after dropping rows with a null in `subset`, from one aggregate."""
    complete = F.lit(True)
    for c in subset:
        complete = complete & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(complete).alias("rows_after"))


def class_rows(df: DataFrame, label: str, value) -> DataFrame:
    return df.where(F.col(label) == F.lit(value))


def schema_text(columns: Iterable[tuple[str, str]]) -> str:
    """Names and types, each behind its length."""
    return "".join(f"{len(part)}:{part}" for column in columns for part in column)


def content_digest(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Row count, order-independent xor and sum of 60-bit row hashes, and a digest of them with names and types.

    The sum tells tables apart that differ by an even number of copies, which the xor cannot see.
    """
    chosen = df.select(*columns)
    described = schema_text(chosen.dtypes)
    plain = chosen.toDF(*[f"c{i}" for i in range(len(chosen.columns))])
    hashed = plain.select(row_hash60(plain.columns).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0).cast("bigint")).alias("xor60"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("sum60"),
    ).withColumn("digest", F.sha2(F.concat_ws(":", "n_rows", "xor60", "sum60", F.lit(described)), 256))


def mean_drift(current: DataFrame, earlier: DataFrame, limit: float = MEAN_DRIFT_LIMIT) -> DataFrame:
    """|mean - earlier mean| / earlier std per shared column; null score for a zero deviation.

    Both sides are statistics tables with one row per column.
    """
    prev = earlier.select("column", F.col("mean").alias("prev_mean"), F.col("std").alias("prev_std"))
    score = F.try_divide(F.abs(F.col("mean") - F.col("prev_mean")), F.col("prev_std"))
    hit = F.coalesce(F.col("drift_score") > F.lit(float(limit)), F.lit(False))
    text = F.format_string(f"{MEAN_DRIFT_TEXT}{limit:.1f}", "drift_score")
    return (
        current.join(prev, "column")
        .select("column", score.alias("drift_score"))
        .withColumn("flagged", hit.cast("int"))
        .withColumn("flag_reason", reason_text([(hit, text)]))
    )


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """Limit probability that the scaled two-sample distance exceeds x."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * k * k * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def ks_drift(earlier: DataFrame, current: DataFrame, columns: Sequence[str], p_limit: float = KS_P_LIMIT) -> DataFrame:
    """Two-sample distance and asymptotic p-value per column, from the raw rows of both runs.

    Nulls take no part; n_null counts them. Columns without a value on one side are left out.
    """
    both = earlier.select(*columns, F.lit(0).alias("side")).unionByName(current.select(*columns, F.lit(1).alias("side")))
    gap = F.abs(F.col("tp") / F.col("all_pos") - F.col("fp") / F.col("all_neg"))
    size = F.sqrt(F.col("all_pos") * F.col("all_neg") / (F.col("all_pos") + F.col("all_neg")))
    curve = cumulative_counts(both, {c: c for c in columns}, "side").where("all_pos > 0 AND all_neg > 0")
    stats = curve.groupBy(F.col("model").alias("column")).agg(F.max(gap).alias("ks_stat"), F.max(size).alias("scale"))
    nulls = both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("none")) for c in columns])))
    nulls = nulls.groupBy("column").agg(F.count_if("none").alias("n_null"))
    p = kolmogorov_tail(F.col("scale") * F.col("ks_stat"))
    return stats.join(nulls, "column").select("column", "ks_stat", p.alias("ks_pvalue"), "n_null").withColumn(
        "flagged", (F.col("ks_pvalue") < p_limit).cast("int")
    )


def drift_report(mean: DataFrame, ks: DataFrame | None = None) -> DataFrame:
    """One row per column with both drift measures and the reasons that flagged it."""
    if ks is None:
        empty = F.lit(None).cast("double")
        return mean.select("column", "drift_score", empty.alias("ks_stat"), empty.alias("ks_pvalue"), "flagged", "flag_reason")
    joined = mean.select("column", "drift_score").join(ks.select("column", "ks_stat", "ks_pvalue"), "column", "left")
    by_mean = F.coalesce(F.col("drift_score") > MEAN_DRIFT_LIMIT, F.lit(False))
    by_ks = F.coalesce(F.col("ks_pvalue") < KS_P_LIMIT, F.lit(False))
    reasons = [
        (by_mean, F.format_string(f"{MEAN_DRIFT_TEXT}{MEAN_DRIFT_LIMIT:.1f}", "drift_score")),
        (by_ks, F.format_string(f"{KS_TEXT}{KS_P_LIMIT}", "ks_pvalue")),
    ]
    return joined.select(
        "*", (by_mean | by_ks).cast("int").alias("flagged"), reason_text(reasons).alias("flag_reason")
    )


# -- checks --------------------------------------------------------------------------------------


def _severity(check: str) -> str:
    return "hard" if check.startswith(HARD_CHECKS) else "soft"


def _issue(df: DataFrame, check: str, detail: Column, when: Column) -> DataFrame:
    return df.where(when).select(
        F.lit(check).alias("check"), F.lit(_severity(check)).alias("severity"), detail.alias("detail")
    )


def schema_issues(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """A hard issue unless the columns equal the expected list in order."""
    spark = df.sparkSession
    rows = []
    if list(df.columns) != list(expected):
        rows.append(("SCHEMA MISMATCH", "hard", f"columns are {list(df.columns)}, not {list(expected)}"))
    return spark.createDataFrame(rows, ISSUES)


def table_issues(
    df: DataFrame,
    label: str | None = None,
    amount: str | None = None,
    expected_rows: int | None = None,
    positive_band: tuple[int, int] | None = None,
) -> DataFrame:
    """Row count, null, class balance and negative amount issues, all from one scan."""
    columns = df.columns
    facts = [F.count(F.lit(1)).alias("n")]
    facts += [F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)]
    facts.append((F.sum(F.col(label).cast("bigint")) if label else F.lit(None).cast("bigint")).alias("positives"))
    facts.append((F.min(amount) if amount else F.lit(None).cast("double")).alias("lowest"))
    total = sum([F.col(f"null_{i}") for i in range(len(columns))], F.lit(0).cast("bigint"))
    names = F.concat_ws(",", *[F.when(F.col(f"null_{i}") > 0, F.lit(c)) for i, c in enumerate(columns)])
    seen = df.agg(*facts)
    checks = [
        (
            "NULL VALUES",
            F.concat(total.cast("string"), F.lit(" nulls found in columns "), names),
            total > 0,
        )
    ]
    if expected_rows is not None:
        text = F.concat(F.lit(f"expected {expected_rows}, got "), F.col("n").cast("string"))
        checks.append(("ROW COUNT", text, F.col("n") != expected_rows))
    if positive_band is not None and label:
        low, high = positive_band
        text = F.concat(F.lit("positive count="), F.col("positives").cast("string"))
        checks.append(("CLASS BALANCE", text, (F.col("positives") < low) | (F.col("positives") > high)))
    if amount:
        text = F.concat(F.lit("min="), F.col("lowest").cast("string"))
        checks.append(("NEGATIVE AMOUNT", text, F.col("lowest") < 0))
    # one array of candidate issues per table keeps this a single scan
    entries = [
        F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(F.lit(c).alias("check"), F.lit(_severity(c)).alias("severity"), text.alias("detail")),
        )
        for c, text, cond in checks
    ]
    return seen.select(F.inline(F.array_compact(F.array(*entries))))


def rewrite_issues(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """A soft issue where the same source name now has another digest.

    Both sides are lineage tables with `data_file` and `digest`.
    """
    old = earlier.select("data_file", F.col("digest").alias("old_digest"))
    return _issue(
        current.join(old, "data_file"),
        "DIGEST REWRITE",
        F.concat(F.lit("content changed under the name "), F.col("data_file")),
        F.col("digest") != F.col("old_digest"),
    )


def drift_issues(drift: DataFrame) -> DataFrame:
    detail = F.concat(F.col("column"), F.lit(": "), F.col("flag_reason"))
    return _issue(drift, "DRIFT FLAGGED", detail, F.col("flagged") == 1)


def verdict(issues: DataFrame) -> DataFrame:
    """FAIL with any hard issue, WARN with any other, PASS without; plus the issue counts."""
    return issues.agg(
        F.count_if(F.col("severity") == "hard").alias("n_hard"), F.count_if(F.col("severity") != "hard").alias("n_soft")
    ).select(
        F.when(F.col("n_hard") > 0, "FAIL").when(F.col("n_soft") > 0, "WARN").otherwise("PASS").alias("verdict"),
        "n_hard",
        "n_soft",
    )
