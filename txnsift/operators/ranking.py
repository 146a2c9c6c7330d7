"""Exact ranking evaluation and review thresholds.

Input tables are long: (model, key, score, label). All models are evaluated together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnsift.functions import day_index, percent_text
from txnsift.operators.ranks import exact_quantiles, first_k_filter, kth_smallest, prefix_sums, with_zones
from txnsift.session import small_rows

#: Fixed fractions of the standard metric table.
TOP_FRACTIONS = {"top1pct": 0.01, "top01pct": 0.001}

#: Number of top rows as an expression of the row count.
TopSize = Callable[[Column], Column]


def long_scores(df: DataFrame, scores: Mapping[str, str], key: str, label: str) -> DataFrame:
    """Wide scores to (model, key, score, label); `scores` maps model name to score column."""
    entries = [F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in scores.items()]
    return df.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.inline(F.array(*entries)))


def cumulative_counts(df: DataFrame, scores: Mapping[str, str], label: str) -> DataFrame:
    """Per model and distinct score: positives, negatives and their running sums from the top.

    Columns: model, score, pos, neg, tp, fp, all_pos, all_neg. The score ranges come from a sketch;
    equal scores collapse before the shuffle. Rows of null score are not ranked and count nowhere (see
    `unranked_counts`).
    """
    columns = list(dict.fromkeys(scores.values()))
    zoned = with_zones(df.select(label, *columns), columns)
    entries = [
        F.struct(
            F.lit(m).alias("model"),
            F.col(c).cast("double").alias("score"),
            F.col(f"{c}__zone").cast("int").alias("zone"),
        )
        for m, c in scores.items()
    ]
    counts = (
        zoned.select(F.col(label).cast("int").alias("label"), F.inline(F.array(*entries)))
        .where("score IS NOT NULL")
        .groupBy("model", "zone", "score")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )
    return prefix_sums(counts, ["model"], "zone", "score", ["pos", "neg"], descending=True).select(
        "model",
        "score",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        "all_pos",
        "all_neg",
    )


def unranked_counts(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """Rows without a score per model, which no curve or metric counts."""
    entries = [F.struct(F.lit(m).alias("model"), F.col(c).isNull().alias("none")) for m, c in scores.items()]
    return df.select(F.inline(F.array(*entries))).groupBy("model").agg(F.count_if("none").alias("n_unranked"))


def pr_curve(curve: DataFrame) -> DataFrame:
    """(model, precision, recall, threshold) per distinct score plus the closing point (1, 0)."""
    points = curve.select(
        "model",
        F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")).alias("recall"),
        F.col("score").alias("threshold"),
    )
    closing = curve.select("model").distinct().select(
        "model", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(closing)


def curve_areas(curve: DataFrame) -> DataFrame:
    """ROC-AUC with half credit for ties, average precision, trapezoidal PR-AUC, per model."""
    return curve_summary(curve, {}).select("model", "roc_auc", "average_precision", "pr_auc")


def curve_summary(curve: DataFrame, sizes: Mapping[str, TopSize]) -> DataFrame:
    """One row per model from one pass over the curve: its areas and, per named top size, its cut.

    A cut is the struct (k, score, pos, neg, tp, fp) of the distinct score the k-th row falls on.
    Each distinct score carries what its predecessor had reached, so no second window is needed, and
    its fields are picked one by one, because an aggregate over structs would sort the curve.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    all_pos, all_neg = F.col("all_pos").cast("double"), F.col("all_neg").cast("double")
    here = F.try_divide(tp, tp + fp)
    earlier = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), F.lit(1.0))
    cuts = []
    for name, size in sizes.items():
        k = size(F.col("all_pos") + F.col("all_neg"))
        last = F.col("tp") + F.col("fp")
        hit = (last - F.col("pos") - F.col("neg") < k) & (k <= last)
        cuts.append(F.max(F.when(hit, k)).alias(f"{name}__k"))
        cuts += [F.max(F.when(hit, F.col(c))).alias(f"{name}__{c}") for c in ("score", "pos", "neg", "tp", "fp")]
    sums = curve.groupBy("model", "all_pos", "all_neg").agg(
        F.sum(pos * (all_neg - fp + neg / 2)).alias("won"),
        F.sum(pos * here).alias("ap"),
        F.sum(pos * (here + earlier) / 2).alias("pr"),
        *cuts,
    )
    return sums.select(
        "model",
        "all_pos",
        "all_neg",
        F.try_divide(F.col("won"), all_pos * all_neg).alias("roc_auc"),
        F.try_divide(F.col("ap"), all_pos).alias("average_precision"),
        F.try_divide(F.col("pr"), all_pos).alias("pr_auc"),
        *[
            F.when(
                F.col(f"{name}__k").isNotNull(),
                F.struct(*[F.col(f"{name}__{c}").alias(c) for c in ("k", "score", "pos", "neg", "tp", "fp")]),
            ).alias(name)
            for name in sizes
        ],
    )


def fraction_size(fraction: float) -> TopSize:
    """ceil(n * fraction) rows, at least one."""
    return lambda n: F.greatest(F.lit(1), F.least(n, F.ceil(n * F.lit(float(fraction)))))


def fixed_size(rows: int) -> TopSize:
    return lambda n: F.least(n, F.lit(int(rows)))


def _hits(df: DataFrame, scores: Mapping[str, str], key: str, label: str, summary: list, name: str) -> dict:
    """{model: positives among the top rows}; only cuts inside a group of ties read the rows again."""
    found, tied = {}, {}
    for row in summary:
        cut = row[name]
        if cut is None:
            continue
        need = cut["k"] - (cut["tp"] + cut["fp"] - cut["pos"] - cut["neg"])
        found[row["model"]] = cut["tp"] - cut["pos"]
        if need == cut["pos"] + cut["neg"] or cut["neg"] == 0:
            found[row["model"]] += min(need, cut["pos"])
        elif cut["pos"]:
            tied[row["model"]] = (cut["score"], need, cut["pos"] + cut["neg"])
    if tied:
        at_cut, below = F.lit(False), F.lit(False)
        long = long_scores(df, {m: scores[m] for m in tied}, key, label)
        for m, (score, _, _) in tied.items():
            at_cut = at_cut | ((F.col("model") == F.lit(m)) & (F.col("score") == F.lit(score)))
        ties = long.where(at_cut)
        ranks = {m: need for m, (_, need, _) in tied.items()}
        sizes = {m: size for m, (_, _, size) in tied.items()}
        cuts = kth_smallest(ties.select("model", F.col("key").alias("value")), "model", ranks, sizes)
        for m, (last, _, _) in cuts.items():
            below = below | ((F.col("model") == F.lit(m)) & (F.col("key") <= F.lit(last)))
        taken = ties.groupBy("model").agg(F.count_if(below & (F.col("label") == 1)).alias("hits"))
        for row in small_rows(taken, "models"):
            found[row["model"]] += row["hits"]
    return found


_TOP = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("top", T.StringType()),
        T.StructField("k", T.LongType()),
        T.StructField("cutoff", T.DoubleType()),
        T.StructField("hits", T.LongType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_positive", T.LongType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("average_precision", T.DoubleType()),
        T.StructField("pr_auc", T.DoubleType()),
    ]
)


def top_counts(
    df: DataFrame, scores: Mapping[str, str], key: str, label: str, sizes: Mapping[str, TopSize]
) -> DataFrame:
    """(model, top, k, cutoff, hits, n_rows, n_positive, areas): one row per model and named top size.

    Two scans (score ranges, curve) serve all models, sizes and areas; ties at a cut are broken by
    ascending key and cost a third, filtered scan only where they mix both classes.
    """
    summary = small_rows(curve_summary(cumulative_counts(df, scores, label), sizes), "models")
    rows = []
    for name in sizes:
        hits = _hits(df, scores, key, label, summary, name)
        for r in summary:
            if r[name] is not None:
                counts = (r["all_pos"] + r["all_neg"], r["all_pos"])
                areas = (r["roc_auc"], r["average_precision"], r["pr_auc"])
                rows.append((r["model"], name, r[name]["k"], r[name]["score"], hits[r["model"]], *counts, *areas))
    return df.sparkSession.createDataFrame(rows, _TOP)


def top_metrics(
    df: DataFrame,
    scores: Mapping[str, str],
    key: str,
    label: str,
    fractions: Mapping[str, float] = TOP_FRACTIONS,
) -> DataFrame:
    """One row per model: precision_<f>, recall_<f>, k_<f> per named fraction, and the three areas."""
    counts = top_counts(df, scores, key, label, {n: fraction_size(f) for n, f in fractions.items()})
    out = []
    for name in fractions:
        here = F.col("top") == F.lit(name)
        hits = F.max(F.when(here, F.col("hits"))).cast("double")
        k = F.max(F.when(here, F.col("k")))
        out += [
            F.try_divide(hits, k.cast("double")).alias(f"precision_{name}"),
            (hits / F.greatest(F.max("n_positive"), F.lit(1))).alias(f"recall_{name}"),
            k.alias(f"k_{name}"),
        ]
    base = (F.max("n_positive") / F.max("n_rows")).alias("base_rate")
    areas = [F.max(a).alias(a) for a in ("roc_auc", "average_precision", "pr_auc")]
    return counts.groupBy("model").agg(*out, base, *areas)


def metric_table(df: DataFrame, scores: Mapping[str, str], key: str, label: str) -> DataFrame:
    """One row per model: precision at 1 % and 0.1 %, recall at 1 %, ROC-AUC, PR-AUC, four places."""
    names = ("precision_top1pct", "precision_top01pct", "recall_top1pct", "roc_auc", "pr_auc")
    return top_metrics(df, scores, key, label).select("model", *[F.round(c, 4).alias(c) for c in names])


def lift_table(df: DataFrame, scores: Mapping[str, str], key: str, label: str, fraction: float = 0.01) -> DataFrame:
    """Base rate, precision in the top fraction and their ratio, per model."""
    return top_metrics(df, scores, key, label, {"top": fraction}).select(
        "model",
        "base_rate",
        F.col("precision_top").alias("precision"),
        F.try_divide("precision_top", "base_rate").alias("lift"),
    )


def base_rates(long: DataFrame) -> dict[str, tuple[int, int]]:
    """{model: (rows, positives)} on the driver; one row per model."""
    rows = small_rows(
        long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("p")),
        "models",
    )
    return {r["model"]: (r["n"], r["p"] or 0) for r in rows}


def top_k(long: DataFrame, ks: Mapping[str, int], key: str = "key", sizes: Mapping | None = None) -> DataFrame:
    """Exactly the k highest-scored rows per model; ties are cut by ascending key.

    Only the cut-offs are computed globally; the selection itself is a filter without shuffle.
    """
    ordered = long.withColumn("__down", -F.col("score"))
    slim = ordered.select("model", "__down", key)
    return ordered.where(first_k_filter(slim, "model", "__down", key, ks, sizes=sizes)).drop("__down")


def top_size(n: int, fraction: float) -> int:
    return min(n, max(1, math.ceil(n * fraction)))


def top_fraction(long: DataFrame, fraction: float) -> DataFrame:
    """The ceil(n * fraction), at least one, highest-scored rows per model."""
    sizes = {m: n for m, (n, _) in base_rates(long).items()}
    return top_k(long, {m: top_size(n, fraction) for m, n in sizes.items()}, sizes=sizes)


def capture_ratios(unsupervised: DataFrame, supervised: DataFrame, metrics: Sequence[str], by: str = "roc_auc") -> DataFrame:
    """Per metric: best unsupervised value, best supervised value, their ratio as text and number.

    The best row of each side is the one with the highest `by`, first by model name on ties; the
    ratio is null (text `N/A`) where the supervised value is zero.
    """

    def best(df: DataFrame, name: str) -> DataFrame:
        top = df.orderBy(F.col(by).desc(), F.col("model")).limit(1)
        return top.unpivot(["model"], list(metrics), "metric", name).withColumnRenamed("model", f"{name}_model")

    joined = best(unsupervised, "unsupervised").join(best(supervised, "supervised"), "metric")
    return joined.select(
        "metric",
        "unsupervised_model",
        "supervised_model",
        "unsupervised",
        "supervised",
        F.try_divide("unsupervised", "supervised").alias("ratio"),
        percent_text(F.col("unsupervised"), F.col("supervised")).alias("capture"),
    )


def mean_capture(ratios: DataFrame) -> DataFrame:
    return ratios.agg(F.round(F.avg("ratio") * F.lit(100.0), 1).alias("mean_capture_pct"))


def best_row(df: DataFrame, metric: str, tie_break: str) -> DataFrame:
    """The row with the highest metric; the first by `tie_break` on equal values."""
    return df.orderBy(F.col(metric).desc(), F.col(tie_break)).limit(1)


def contamination_flags(df: DataFrame, score: str, contamination: float) -> DataFrame:
    """Add `is_outlier`: score strictly above its exact (1 - contamination) quantile."""
    cut = exact_quantiles(df, [score], {"cut": 1.0 - contamination}).first()
    limit = F.lit(None).cast("double") if cut is None else F.lit(cut["cut"])
    return df.withColumn("is_outlier", F.coalesce((F.col(score) > limit).cast("int"), F.lit(0)))


# -- review thresholds ---------------------------------------------------------------------------


def distinct_days(df: DataFrame, time_s: str) -> int:
    return df.select(day_index(time_s).alias("day")).distinct().count()


def _decision(counts: DataFrame, days: int) -> DataFrame:
    return counts.select(
        "model",
        "cutoff",
        F.col("k").alias("n_flagged"),
        F.col("hits").alias("n_captured"),
        F.round(F.col("hits") / F.col("k"), 6).alias("precision"),
        F.round(F.col("hits") / F.greatest("n_positive", F.lit(1)), 6).alias("recall"),
        F.round(F.col("k") / F.lit(float(days)), 4).alias("workload_per_day"),
    )


def threshold_by_capacity(
    df: DataFrame, scores: Mapping[str, str], key: str, label: str, per_day: int, days: int
) -> DataFrame:
    """Flag the highest scores a team reviewing `per_day` rows a day can handle."""
    return _decision(top_counts(df, scores, key, label, {"capacity": fixed_size(per_day * days)}), days)


def threshold_by_share(
    df: DataFrame, scores: Mapping[str, str], key: str, label: str, fraction: float, days: int
) -> DataFrame:
    """Flag a fixed share of the volume."""
    return _decision(top_counts(df, scores, key, label, {"share": fraction_size(fraction)}), days)


def threshold_by_recall(curve: DataFrame, recall: float, days: int) -> DataFrame:
    """The highest cut-off that reaches the wanted recall, per model, with its precision and load."""
    reached = curve.where(F.col("tp") >= F.lit(recall) * F.col("all_pos"))
    # counts only grow as the score falls, so the highest cut-off has the lowest counts
    best = reached.groupBy("model", "all_pos").agg(
        F.max("score").alias("cutoff"), F.min("tp").alias("tp"), F.min("fp").alias("fp")
    )
    flagged = F.col("tp") + F.col("fp")
    return best.select(
        "model",
        "cutoff",
        flagged.alias("n_flagged"),
        F.col("tp").alias("n_captured"),
        F.round(F.col("tp") / flagged, 6).alias("precision"),
        F.round(F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")), 6).alias("recall"),
        F.round(flagged / F.lit(float(days)), 4).alias("workload_per_day"),
    )


def compare_runs(old: DataFrame, new: DataFrame, metrics: Sequence[str], key: str = "model") -> DataFrame:
    """(model, metric, old, new, delta) over two metric tables; rows of either side are kept."""
    a = old.unpivot([key], list(metrics), "metric", "old_value")
    b = new.unpivot([key], list(metrics), "metric", "new_value")
    return a.join(b, [key, "metric"], "full_outer").withColumn("delta", F.col("new_value") - F.col("old_value"))
