"""Projections, filters, aggregates and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import query
from catalog.bindings import (
    EF, EV, LI, TR, TRIP_FEATURES, V, VE, VL, customers, event_features, events, lines, trips, vectors,
)
from txnsift.functions import (
    day_index, hour_bucket, hour_fraction, inverted, log_amount, reason_text, threshold_flag,
)
from txnsift.operators import profile, quality
from txnsift.plans.archetypes import archetype_label


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- projections and filters -----------------------------------------------------------------------


@query("p1_log_amount", f"WITH {EV} SELECT txn_id, round(ln(1 + amount), 6) AS log_amount FROM ev")
def _(spark, sf):
    return events(spark, sf).select("txn_id", F.round(log_amount("amount"), 6).alias("log_amount"))


@query("p2_hour_fraction", f"WITH {EV} SELECT txn_id, round((time_s % 86400) / 3600.0, 6) AS hour_of_day FROM ev")
def _(spark, sf):
    return events(spark, sf).select("txn_id", F.round(hour_fraction("time_s"), 6).alias("hour_of_day"))


@query("p3_hour_bucket", f"WITH {EV} SELECT txn_id, CAST(floor((time_s % 86400) / 3600) AS INTEGER) AS hour FROM ev")
def _(spark, sf):
    return events(spark, sf).select("txn_id", hour_bucket("time_s").alias("hour"))


@query("p4_day_index", f"WITH {EV} SELECT txn_id, CAST(floor(time_s / 86400) AS INTEGER) AS day FROM ev")
def _(spark, sf):
    return events(spark, sf).select("txn_id", day_index("time_s").alias("day"))


@query(
    "p5_feature_projection",
    f"""WITH {EV} SELECT txn_id, label, round(ln(1 + amount), 6) AS log_amount,
    round((time_s % 86400) / 3600.0, 6) AS hour_of_day, CAST(floor(time_s / 86400) AS INTEGER) AS day FROM ev""",
)
def _(spark, sf):
    table = profile.feature_table(events(spark, sf), "time_s", "amount", ["txn_id", "label"])
    return _round(table, 6, "log_amount", "hour_of_day")


@query("p6_equality_filter", f"WITH {LI} SELECT txn_id, amount, tax, label FROM li WHERE tax = 0")
def _(spark, sf):
    return lines(spark, sf).where(F.col("tax") == 0).select("txn_id", "amount", "tax", "label")


@query(
    "p7_threshold_flag",
    """SELECT c_custkey, CASE WHEN abs(c_acctbal) > 5000 THEN 'FLAG' ELSE 'ok' END AS flag FROM customer""",
)
def _(spark, sf):
    return customers(spark, sf).select("c_custkey", threshold_flag("c_acctbal", 5000).alias("flag"))


@query(
    "p8_null_drop",
    f"""WITH {TR} SELECT count(*) AS rows_before,
    count(*) FILTER (WHERE log_distance IS NOT NULL AND tip_pct IS NOT NULL) AS rows_after FROM tr""",
)
def _(spark, sf):
    return quality.null_drop_counts(trips(spark, sf), ["log_distance", "tip_pct"])


@query(
    "p8_kept_rows",
    f"""WITH {TR} SELECT cluster, count(*) AS n, round(avg(log_distance), 6) AS mean_log_distance FROM tr
    WHERE log_distance IS NOT NULL AND tip_pct IS NOT NULL GROUP BY cluster""",
)
def _(spark, sf):
    kept = trips(spark, sf).dropna(subset=["log_distance", "tip_pct"])
    return kept.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("log_distance"), 6).alias("mean_log_distance")
    )


@query("p10_class_split", f"WITH {EV} SELECT txn_id, time_s, amount FROM ev WHERE label = 1")
def _(spark, sf):
    return quality.class_rows(events(spark, sf), "label", 1).select("txn_id", "time_s", "amount")


@query("p11_score_inversion", f"WITH {EV} SELECT txn_id, -amount AS score FROM ev")
def _(spark, sf):
    return events(spark, sf).select("txn_id", inverted("amount").alias("score"))


# The limits, their order and the names of the archetypes.
LABEL_SQL = """CASE WHEN is_airport > 0.3 THEN 'Airport runs'
  WHEN log_fare > 3.2 AND trip_duration_min > 30 THEN 'Long premium rides'
  WHEN trip_duration_min <= 10 AND log_distance < 0.5 THEN 'Short urban hops'
  WHEN hour_of_day >= 22 OR hour_of_day <= 4 THEN 'Late-night rides'
  WHEN tip_pct > 0.25 AND log_fare > 2.5 THEN 'High-tip daytime'
  ELSE 'Standard weekday commutes' END"""


@query("p12_rule_cascade", f"WITH {TR} SELECT {LABEL_SQL} AS label, count(*) AS n FROM tr GROUP BY 1")
def _(spark, sf):
    return trips(spark, sf).groupBy(archetype_label().alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_reason_text",
    f"""WITH {EV} SELECT txn_id, coalesce(nullif(concat_ws('; ', CASE WHEN amount > 400 THEN 'amount>400' END,
    CASE WHEN (time_s % 86400) / 3600.0 < 6 THEN 'night' END, CASE WHEN rare = 1 THEN 'rare' END), ''), 'ok') AS reason
    FROM ev""",
)
def _(spark, sf):
    reasons = [
        (F.col("amount") > 400, F.lit("amount>400")),
        (hour_fraction("time_s") < 6, F.lit("night")),
        (F.col("rare") == 1, F.lit("rare")),
    ]
    return events(spark, sf).select("txn_id", reason_text(reasons).alias("reason"))


# -- aggregates ------------------------------------------------------------------------------------


@query(
    "a1_class_balance",
    f"""WITH {EV} SELECT label, count(*) AS n_rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct
    FROM ev GROUP BY label""",
)
def _(spark, sf):
    return profile.group_share(events(spark, sf), "label")


@query(
    "a2_time_coverage",
    f"""WITH {EV} SELECT min(time_s) AS min_time_s, max(time_s) AS max_time_s,
    round((max(time_s) - min(time_s)) / 3600.0, 2) AS span_hours FROM ev""",
)
def _(spark, sf):
    return profile.time_coverage(events(spark, sf), "time_s")


def _rate_sql(bucket: str, name: str) -> str:
    return f"""SELECT {bucket} AS {name}, count(*) AS n_transactions, CAST(sum(label) AS BIGINT) AS n_positive,
    round(sum(label) * 100.0 / count(*), 4) AS positive_rate_pct FROM ev GROUP BY 1"""


HOUR_SQL = _rate_sql("CAST(floor((time_s % 86400) / 3600) AS INTEGER)", "hour_of_day")


@query("a3_rate_by_hour", f"WITH {EV} {HOUR_SQL}")
def rate_by_hour(spark, sf):
    return profile.rate_by_hour(events(spark, sf), "time_s", "label")


@query("a4_rate_by_day", f"WITH {EV} " + _rate_sql("CAST(floor(time_s / 86400) AS INTEGER)", "day"))
def _(spark, sf):
    return profile.rate_by_day(events(spark, sf), "time_s", "label")


@query("a5_approx_quantiles")
def _(spark, sf):
    return profile.approx_quantiles_by_label(events(spark, sf), "amount", "label")


QUANTILES_SQL = f"""WITH {EV} SELECT label, count(*) AS n, round(quantile_cont(amount, 0.01), 2) AS p01,
    round(quantile_cont(amount, 0.1), 2) AS p10, round(quantile_cont(amount, 0.5), 2) AS p50,
    round(quantile_cont(amount, 0.9), 2) AS p90, round(quantile_cont(amount, 0.99), 2) AS p99,
    round(quantile_cont(amount, 0.999), 2) AS p999, round(avg(amount), 2) AS mean_amount,
    round(stddev(amount), 2) AS std_amount, round(max(amount), 2) AS max_amount FROM ev GROUP BY label"""


@query("a6_exact_quantiles", QUANTILES_SQL)
def _(spark, sf):
    return profile.exact_quantiles_by_label(events(spark, sf), "amount", "label")


@query("a6_quantiles_from_narrow_brackets", QUANTILES_SQL)
def _(spark, sf):
    """Sketches so coarse that even the smaller class is bracketed in every part."""
    return profile.exact_quantiles_by_label(events(spark, sf), "amount", "label", accuracy=25)


@query(
    "a7_zero_amount",
    f"""WITH {LI} SELECT count(*) AS n_zero_amount, CAST(coalesce(sum(label), 0) AS BIGINT) AS n_positive,
    round(sum(label) * 100.0 / nullif(count(*), 0), 4) AS positive_rate_pct FROM li WHERE discount = 0""",
)
def _(spark, sf):
    return profile.zero_amounts(lines(spark, sf), "discount", "label")


@query(
    "a8_zero_uplift",
    f"""WITH {LI}, c AS (SELECT count(*) AS n, sum(label) AS p, count(*) FILTER (WHERE tax = 0) AS zn,
      sum(label) FILTER (WHERE tax = 0) AS zp FROM li)
    SELECT round(zn * 100.0 / n, 4) AS zero_row_share_pct, round(zp * 100.0 / p, 4) AS zero_positive_share_pct,
    round((CAST(zp AS DOUBLE) / zn) / (CAST(p AS DOUBLE) / n), 4) AS uplift FROM c""",
)
def _(spark, sf):
    return profile.zero_uplift(lines(spark, sf), "tax", "label")


@query(
    "a9_feature_ranges",
    f"""WITH {VE}, {VL} SELECT feature, min(x) AS min_val, max(x) AS max_val, round(avg(x), 6) AS mean_val,
    round(stddev(x), 6) AS std_val, CASE WHEN abs(avg(x)) > 0.1 THEN 'FLAG' ELSE 'ok' END AS mean_flag
    FROM vl GROUP BY feature""",
)
def _(spark, sf):
    return profile.feature_ranges(vectors(spark, sf), V)


EFL = "efl AS (UNPIVOT (SELECT label, amount, log_amount, hour_of_day FROM ef) ON amount, log_amount, hour_of_day INTO NAME feature VALUE x)"


@query(
    "a9_derived_ranges",
    f"""WITH {EV}, {EF}, {EFL} SELECT feature, round(min(x), 6) AS min_val, round(max(x), 6) AS max_val,
    round(avg(x), 6) AS mean_val, round(stddev(x), 6) AS std_val,
    CASE WHEN abs(avg(x)) > 0.1 THEN 'FLAG' ELSE 'ok' END AS mean_flag FROM efl GROUP BY feature""",
)
def _(spark, sf):
    table = profile.feature_ranges(event_features(spark, sf), ["amount", "log_amount", "hour_of_day"])
    return _round(table, 6, "min_val", "max_val")


def _corr_sql(source: str) -> str:
    return f"""SELECT feature, round(c, 6) AS corr_with_label, round(abs(c), 6) AS abs_corr FROM (
    SELECT feature, CASE WHEN stddev_pop(x) * stddev_pop(label) > 0
      THEN covar_pop(x, label) / (stddev_pop(x) * stddev_pop(label)) END AS c FROM {source} GROUP BY feature)"""


@query("a10_label_correlation", f"WITH {VE}, {VL} {_corr_sql('vl')}")
def _(spark, sf):
    return profile.label_correlation(vectors(spark, sf), V, "label")


@query("a10_derived_correlation", f"WITH {EV}, {EF}, {EFL} {_corr_sql('efl')}")
def _(spark, sf):
    return profile.label_correlation(event_features(spark, sf), ["amount", "log_amount", "hour_of_day"], "label")


@query(
    "a11_label_distributions",
    f"WITH {VE} SELECT label, "
    + ", ".join(f"round(avg({v}), 6) AS {v}_mean, round(stddev({v}), 6) AS {v}_std" for v in V)
    + " FROM ve GROUP BY label",
)
def _(spark, sf):
    return profile.label_distributions(vectors(spark, sf), V, "label")


SEPARATION_SQL = """SELECT feature, mean_negative, mean_positive, round(mean_positive - mean_negative, 6) AS mean_diff,
    round(pooled, 6) AS pooled_std,
    CASE WHEN pooled > 0 THEN round(abs(mean_positive - mean_negative) / pooled, 6) ELSE 0.0 END AS sep_score
    FROM (SELECT *, sqrt((s0 * s0 + s1 * s1) / 2) AS pooled FROM (
      SELECT feature, round(avg(x) FILTER (WHERE label = 0), 6) AS mean_negative,
        round(avg(x) FILTER (WHERE label = 1), 6) AS mean_positive,
        round(stddev(x) FILTER (WHERE label = 0), 6) AS s0, round(stddev(x) FILTER (WHERE label = 1), 6) AS s1
      FROM vl GROUP BY feature))"""


@query("a12_separation", f"WITH {VE}, {VL} {SEPARATION_SQL}")
def _(spark, sf):
    return profile.separation_scores(vectors(spark, sf), V, "label")


@query(
    "a13_peak_hour",
    f"""WITH {EV}, h AS ({HOUR_SQL}) SELECT CAST(hour_of_day AS BIGINT) AS peak_hour_of_day,
    positive_rate_pct AS peak_rate_pct FROM h ORDER BY positive_rate_pct DESC, hour_of_day LIMIT 1""",
)
def _(spark, sf):
    return profile.peak_bucket(rate_by_hour(spark, sf), "hour_of_day")


@query(
    "a14_summary_record",
    f"""WITH {EV}, h AS ({HOUR_SQL}), {EF}, {EFL}, c AS ({_corr_sql('efl')})
    SELECT (SELECT count(*) FROM ev) AS row_count, (SELECT CAST(sum(label) AS BIGINT) FROM ev) AS n_positive,
    (SELECT round(avg(label) * 100.0, 4) FROM ev) AS positive_pct,
    (SELECT round((max(time_s) - min(time_s)) / 3600.0, 2) FROM ev) AS span_hours,
    (SELECT CAST(hour_of_day AS BIGINT) FROM h ORDER BY positive_rate_pct DESC, hour_of_day LIMIT 1) AS peak_hour,
    (SELECT count(*) FROM ev WHERE amount = 0) AS n_zero_amount,
    (SELECT feature FROM c ORDER BY abs_corr DESC, feature LIMIT 1) AS top_feature""",
)
def _(spark, sf):
    from txnsift.plans.profiling import summary

    record = summary(event_features(spark, sf), "time_s", "amount", "label", ["amount", "log_amount", "hour_of_day"])
    return record.select(
        F.col("class_balance")["row_count"].alias("row_count"),
        F.col("class_balance")["n_positive"].alias("n_positive"),
        F.col("class_balance")["positive_pct"].alias("positive_pct"),
        F.col("time_coverage")["span_hours"].alias("span_hours"),
        F.col("peak_hour")["peak_hour_of_day"].alias("peak_hour"),
        F.col("zero_amount")["n_zero_amount"].alias("n_zero_amount"),
        F.col("top_correlations")[0]["feature"].alias("top_feature"),
    )


@query(
    "a15_fingerprint",
    """WITH l AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
      ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME "column" VALUE x)
    SELECT "column", round(avg(x), 5) AS mean, round(stddev(x), 5) AS std, min(x) AS min, max(x) AS max,
    round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.25), 6) AS q25,
    round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75,
    round(quantile_cont(x, 0.99), 6) AS q99, count(*) - count(x) AS null_count,
    count(*) FILTER (WHERE x = 0) AS zero_count, count(*) FILTER (WHERE x < 0) AS negative_count
    FROM l GROUP BY "column" """,
)
def _(spark, sf):
    from catalog.bindings import table

    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = profile.fingerprint(table(spark, sf, "lineitem").select(*columns), columns)
    out = _round(out, 5, "mean", "std")
    return _round(out, 6, "q01", "q25", "q50", "q75", "q99")


@query(
    "a15_fingerprint_with_nulls",
    f"""WITH {TR}, l AS (FROM (SELECT log_distance, tip_pct, trip_duration_min FROM tr)
      UNPIVOT INCLUDE NULLS (x FOR "column" IN (log_distance, tip_pct, trip_duration_min)))
    SELECT "column", round(avg(x), 5) AS mean, round(quantile_cont(x, 0.5), 6) AS q50,
    round(quantile_cont(x, 0.99), 6) AS q99, count(*) - count(x) AS null_count,
    count(*) FILTER (WHERE x = 0) AS zero_count, count(*) FILTER (WHERE x < 0) AS negative_count
    FROM l GROUP BY "column" """,
)
def _(spark, sf):
    columns = ["log_distance", "tip_pct", "trip_duration_min"]
    out = profile.fingerprint(trips(spark, sf).select(*columns), columns)
    out = _round(_round(out, 5, "mean"), 6, "q50", "q99")
    return out.select("column", "mean", "q50", "q99", "null_count", "zero_count", "negative_count")


@query(
    "a16_null_audit",
    f"""WITH {TR} SELECT 2 * count(*) - count(log_distance) - count(tip_pct) AS total_nulls,
    concat_ws(',', CASE WHEN count(log_distance) < count(*) THEN 'log_distance' END,
      CASE WHEN count(tip_pct) < count(*) THEN 'tip_pct' END) AS null_columns FROM tr""",
)
def _(spark, sf):
    return profile.null_audit(trips(spark, sf), TRIP_FEATURES)


@query(
    "a17_group_profile",
    f"""WITH {LI} SELECT CAST(weekday AS INTEGER) AS grp, count(*) AS n_rows,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share_pct, """
    + ", ".join(
        f"round(avg({c}), 4) AS {c}_mean, round(quantile_cont({c}, 0.5), 4) AS {c}_median"
        for c in ("quantity", "amount", "discount", "tax")
    )
    + " FROM li GROUP BY 1",
)
def _(spark, sf):
    features = ["quantity", "amount", "discount", "tax"]
    table = lines(spark, sf).withColumn("grp", F.col("weekday").cast("int"))
    out = profile.group_profile(table, features, "grp")
    return _round(out, 4, *[f"{f}_{s}" for f in features for s in ("mean", "median")])


@query(
    "a9_ranges_from_class_moments",
    f"""WITH {VE}, {VL} SELECT feature, min(x) AS min_val, max(x) AS max_val, round(avg(x), 6) AS mean_val,
    round(stddev(x), 6) AS std_val, CASE WHEN abs(avg(x)) > 0.1 THEN 'FLAG' ELSE 'ok' END AS mean_flag
    FROM vl GROUP BY feature""",
)
def _(spark, sf):
    return profile.ranges_from_moments(profile.label_moments(vectors(spark, sf), V, "label"), "label")


@query("a10_correlation_from_class_moments", f"WITH {EV}, {EF}, {EFL} {_corr_sql('efl')}")
def _(spark, sf):
    moments = profile.label_moments(event_features(spark, sf), ["amount", "log_amount", "hour_of_day"], "label")
    return profile.correlation_from_moments(moments, "label")


@query(
    "a18_band_share",
    f"""WITH {EV}, h AS ({HOUR_SQL}) SELECT
    round(sum(n_positive) FILTER (WHERE hour_of_day BETWEEN 2 AND 4) * 100.0 / sum(n_positive), 4) AS positive_share_pct,
    round(sum(n_transactions) FILTER (WHERE hour_of_day BETWEEN 2 AND 4) * 100.0 / sum(n_transactions), 4)
      AS volume_share_pct FROM h""",
)
def _(spark, sf):
    return profile.band_share(events(spark, sf), "time_s", "label", 2, 4)


@query(
    "a19_imbalance",
    f"""WITH {EV} SELECT count(*) FILTER (WHERE rare = 0) AS n_negative, count(*) FILTER (WHERE rare = 1) AS n_positive,
    round(CAST(count(*) FILTER (WHERE rare = 0) AS DOUBLE) / count(*) FILTER (WHERE rare = 1), 2)
      AS negatives_per_positive FROM ev""",
)
def _(spark, sf):
    return profile.imbalance(events(spark, sf), "rare")


@query(
    "a20_score_range",
    f"""WITH {VE} SELECT 'V1' AS score, min(V1) AS min_score, max(V1) AS max_score FROM ve
    UNION ALL SELECT 'V2', min(V2), max(V2) FROM ve UNION ALL SELECT 'V3', min(V3), max(V3) FROM ve""",
)
def _(spark, sf):
    return profile.score_range(vectors(spark, sf), ["V1", "V2", "V3"])


# -- windows, sorts, limits, unions ----------------------------------------------------------------


@query(
    "w1_total_over_groups",
    """SELECT event_type, count(*) AS n_rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct
    FROM events GROUP BY event_type""",
)
def _(spark, sf):
    from catalog.bindings import table

    return profile.group_share(table(spark, sf, "events"), "event_type")


@query(
    "o1_sorted_correlations",
    f"WITH {VE}, {VL}, c AS ({_corr_sql('vl')}) SELECT *, row_number() OVER (ORDER BY abs_corr DESC, feature) AS place FROM c",
)
def _(spark, sf):
    table = profile.label_correlation(vectors(spark, sf), V, "label")
    # the window runs over one row per feature
    return table.withColumn(
        "place", F.row_number().over(Window.partitionBy().orderBy(F.col("abs_corr").desc(), "feature")).cast("bigint")
    )


@query(
    "o2_top_rows",
    f"WITH {VE}, {VL}, s AS ({SEPARATION_SQL}) SELECT feature, sep_score FROM s ORDER BY sep_score DESC, feature LIMIT 10",
)
def _(spark, sf):
    table = profile.separation_scores(vectors(spark, sf), V, "label")
    return table.orderBy(F.col("sep_score").desc(), "feature").limit(10).select("feature", "sep_score")


@query(
    "u1_union_of_feature_rows",
    f"""WITH {LI} """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, min({c}) AS min_val, max({c}) AS max_val, round(avg({c}), 5) AS mean_val FROM li"
        for c in ("quantity", "discount", "tax", "weekday")
    ),
)
def _(spark, sf):
    out = profile.feature_ranges(lines(spark, sf), ["quantity", "discount", "tax", "weekday"])
    return out.select("feature", "min_val", "max_val", F.round("mean_val", 5).alias("mean_val"))


