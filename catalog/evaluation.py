"""Ranking evaluation, thresholds and run comparison on score columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.bindings import EF, EV, LI, event_features, events, lines
from txnsift.operators import ranking
from txnsift.operators.ranks import global_rank

# Two scores over all events: a model named `amount` and one named `hour` with fewer distinct values.
SCORES = {"amount": "amount", "hour": "hour_score"}


def _scored(spark, sf):
    return event_features(spark, sf).withColumn("hour_score", F.floor("hour_of_day").cast("double"))


SC = f"""{EV}, {EF}, sc AS (SELECT 'amount' AS model, txn_id AS key, amount AS score, rare AS label FROM ef
  UNION ALL SELECT 'hour', txn_id, CAST(floor(hour_of_day) AS DOUBLE), rare FROM ef)"""
RK = """rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, key) AS place,
  count(*) OVER (PARTITION BY model) AS n, sum(label) OVER (PARTITION BY model) AS p FROM sc)"""
CV = """cv AS (SELECT model, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY model) AS all_pos, sum(neg) OVER (PARTITION BY model) AS all_neg
  FROM (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
        FROM sc GROUP BY model, score)
  WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
 cw AS (SELECT *, tp / (tp + fp) AS prec, lag(tp / (tp + fp), 1, 1.0) OVER (PARTITION BY model ORDER BY score DESC) AS prev
        FROM cv),
 ar AS (SELECT model, sum(pos * (all_neg - fp + neg / 2.0)) / (max(all_pos) * max(all_neg)) AS roc_auc,
    sum(pos * prec) / max(all_pos) AS average_precision, sum(pos * (prec + prev) / 2) / max(all_pos) AS pr_auc
  FROM cw GROUP BY model)"""


def _curve(spark, sf):
    return ranking.cumulative_counts(_scored(spark, sf), SCORES, "rare")


def _long(spark, sf):
    return ranking.long_scores(_scored(spark, sf), SCORES, "txn_id", "rare")


@query(
    "w2_score_rank",
    f"WITH {EV} SELECT txn_id, row_number() OVER (ORDER BY amount DESC, txn_id) AS place FROM ev",
)
def _(spark, sf):
    return global_rank(events(spark, sf).select("txn_id", "amount"), "amount", "txn_id", name="place").select(
        "txn_id", "place"
    )


@query(
    "w2_rank_with_ties",
    f"WITH {LI} SELECT txn_id, row_number() OVER (ORDER BY discount DESC, txn_id) AS place FROM li",
)
def _(spark, sf):
    return global_rank(lines(spark, sf).select("txn_id", "discount"), "discount", "txn_id", name="place").select(
        "txn_id", "place"
    )


@query(
    "w3_top_drivers",
    f"""WITH {LI}, m AS (UNPIVOT (SELECT CAST(weekday AS INTEGER) AS grp, avg(quantity) AS quantity,
      avg(discount) AS discount, avg(tax) AS tax, avg(log_amount) AS log_amount FROM li GROUP BY 1)
      ON quantity, discount, tax, log_amount INTO NAME feature VALUE x)
    SELECT grp, string_agg(feature, '|' ORDER BY place) AS top_features FROM (
      SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(x) DESC, list_position(
        ['quantity', 'discount', 'tax', 'log_amount'], feature)) AS place FROM m) WHERE place <= 3 GROUP BY grp""",
)
def _(spark, sf):
    from txnsift.operators.clustering import top_drivers

    table = lines(spark, sf).withColumn("grp", F.col("weekday").cast("int"))
    return top_drivers(table, ["quantity", "discount", "tax", "log_amount"], "grp", 3, name="top_features")


@query(
    "w4_cumulative_counts",
    f"""WITH {SC}, {CV} SELECT model, score, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
    CAST(all_pos AS BIGINT) AS all_pos, CAST(all_neg AS BIGINT) AS all_neg FROM cv""",
)
def _(spark, sf):
    return _curve(spark, sf).withColumn("score", F.col("score") + F.lit(0.0))


@query("o3_top_fraction", f"WITH {SC}, {RK} SELECT model, key, score, label FROM rk WHERE place <= ceil(n * 1e-2)")
def _(spark, sf):
    return ranking.top_fraction(_long(spark, sf), 0.01).select("model", "key", "score", "label")


TOP_SQL = """SELECT model, round(avg(label) FILTER (WHERE place <= ceil(n * 1e-2)), 6) AS precision_top1pct,
    round(sum(label) FILTER (WHERE place <= ceil(n * 1e-2)) / greatest(max(p), 1), 6) AS recall_top1pct,
    round(avg(label) FILTER (WHERE place <= ceil(n * 1e-3)), 6) AS precision_top01pct,
    round(sum(label) FILTER (WHERE place <= ceil(n * 1e-3)) / greatest(max(p), 1), 6) AS recall_top01pct
    FROM rk GROUP BY model"""


def _top(spark, sf):
    out = ranking.top_metrics(_scored(spark, sf), SCORES, "txn_id", "rare")
    names = [f"{m}_{f}" for f in ("top1pct", "top01pct") for m in ("precision", "recall")]
    return out.select("model", *[F.round(c, 6).alias(c) for c in names])


@query("e1_precision_at_fraction", f"WITH {SC}, {RK} SELECT model, precision_top1pct, precision_top01pct FROM ({TOP_SQL})")
def _(spark, sf):
    return _top(spark, sf).select("model", "precision_top1pct", "precision_top01pct")


@query("e2_recall_at_fraction", f"WITH {SC}, {RK} SELECT model, recall_top1pct, recall_top01pct FROM ({TOP_SQL})")
def _(spark, sf):
    return _top(spark, sf).select("model", "recall_top1pct", "recall_top01pct")


@query("e3_roc_auc", f"WITH {SC}, {CV} SELECT model, round(roc_auc, 9) AS roc_auc FROM ar")
def _(spark, sf):
    return ranking.curve_areas(_curve(spark, sf)).select("model", F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "e4_pr_curve",
    f"""WITH {SC}, {CV} SELECT model, round(prec, 9) AS precision, round(tp / all_pos, 9) AS recall, score AS threshold
    FROM cw UNION ALL SELECT DISTINCT model, 1.0::DOUBLE, 0.0::DOUBLE, NULL FROM sc""",
)
def _(spark, sf):
    return ranking.pr_curve(_curve(spark, sf)).select(
        "model", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "threshold"
    )


@query("e5_average_precision", f"WITH {SC}, {CV} SELECT model, round(average_precision, 9) AS average_precision FROM ar")
def _(spark, sf):
    return ranking.curve_areas(_curve(spark, sf)).select("model", F.round("average_precision", 9).alias("average_precision"))


@query("e6_pr_auc", f"WITH {SC}, {CV} SELECT model, round(pr_auc, 9) AS pr_auc FROM ar")
def _(spark, sf):
    return ranking.curve_areas(_curve(spark, sf)).select("model", F.round("pr_auc", 9).alias("pr_auc"))


@query(
    "e7_base_rate_and_lift",
    f"""WITH {SC}, {RK} SELECT model, round(avg(label), 9) AS base_rate,
    round(avg(label) FILTER (WHERE place <= ceil(n * 1e-2)), 9) AS precision,
    round(avg(label) FILTER (WHERE place <= ceil(n * 1e-2)) / avg(label), 6) AS lift FROM rk GROUP BY model""",
)
def _(spark, sf):
    table = ranking.lift_table(_scored(spark, sf), SCORES, "txn_id", "rare")
    return table.select(
        "model", F.round("base_rate", 9).alias("base_rate"), F.round("precision", 9).alias("precision"), F.round("lift", 6).alias("lift")
    )


METRIC_SQL = f"""SELECT t.model, round(precision_top1pct, 4) AS precision_top1pct,
    round(precision_top01pct, 4) AS precision_top01pct, round(recall_top1pct, 4) AS recall_top1pct,
    round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc FROM ({TOP_SQL}) t JOIN ar ON t.model = ar.model"""


def metrics(spark, sf):
    return ranking.metric_table(_scored(spark, sf), SCORES, "txn_id", "rare")


@query("e8_metric_table", f"WITH {SC}, {RK}, {CV} {METRIC_SQL}")
def _(spark, sf):
    return metrics(spark, sf)


@query(
    "o4_best_model",
    f"WITH {SC}, {RK}, {CV}, mt AS ({METRIC_SQL}) SELECT model, roc_auc FROM mt ORDER BY roc_auc DESC, model LIMIT 1",
)
def _(spark, sf):
    return ranking.best_row(metrics(spark, sf), "roc_auc", "model").select("model", "roc_auc")


FOUR = ["precision_top1pct", "precision_top01pct", "recall_top1pct", "roc_auc"]


@query(
    "e9_capture_ratios",
    f"""WITH {SC}, {RK}, {CV}, mt AS ({METRIC_SQL}),
    u AS (UNPIVOT (SELECT * FROM mt WHERE model = 'hour') ON {', '.join(FOUR)} INTO NAME metric VALUE u),
    s AS (UNPIVOT (SELECT * FROM mt WHERE model = 'amount') ON {', '.join(FOUR)} INTO NAME metric VALUE s)
    SELECT metric, u.u AS unsupervised, s.s AS supervised, round(u.u / nullif(s.s, 0), 6) AS ratio,
    CASE WHEN s.s = 0 THEN 'N/A' ELSE printf('%.1f%%', u.u / s.s * 100) END AS capture FROM u JOIN s USING (metric)""",
)
def _(spark, sf):
    table = metrics(spark, sf)
    ratios = ranking.capture_ratios(table.where("model = 'hour'"), table.where("model = 'amount'"), FOUR)
    return ratios.select("metric", "unsupervised", "supervised", F.round("ratio", 6).alias("ratio"), "capture")


@query(
    "e9_mean_capture",
    f"""WITH {SC}, {RK}, {CV}, mt AS ({METRIC_SQL}),
    u AS (UNPIVOT (SELECT * FROM mt WHERE model = 'hour') ON {', '.join(FOUR)} INTO NAME metric VALUE u),
    s AS (UNPIVOT (SELECT * FROM mt WHERE model = 'amount') ON {', '.join(FOUR)} INTO NAME metric VALUE s)
    SELECT round(avg(u.u / nullif(s.s, 0)) * 100.0, 1) AS mean_capture_pct FROM u JOIN s USING (metric)""",
)
def _(spark, sf):
    table = metrics(spark, sf)
    return ranking.mean_capture(
        ranking.capture_ratios(table.where("model = 'hour'"), table.where("model = 'amount'"), FOUR)
    )


@query(
    "n4_contamination_flags",
    f"""WITH {EV}, c AS (SELECT quantile_cont(amount, 0.998) AS cut FROM ev)
    SELECT txn_id, amount, CAST(amount > cut AS INTEGER) AS is_outlier FROM ev, c""",
)
def _(spark, sf):
    return ranking.contamination_flags(events(spark, sf).select("txn_id", "amount"), "amount", 0.002)


def _decision_sql(condition: str) -> str:
    return f"""dd AS (SELECT count(DISTINCT floor(time_s / 86400)) AS days FROM ev)
    SELECT model, min(score) AS cutoff, count(*) AS n_flagged, CAST(sum(label) AS BIGINT) AS n_captured,
    round(sum(label) / count(*), 6) AS precision, round(sum(label) / greatest(max(p), 1), 6) AS recall,
    round(count(*) / CAST(max(days) AS DOUBLE), 4) AS workload_per_day
    FROM rk, dd WHERE {condition} GROUP BY model"""


@query("t1_threshold_by_capacity", f"WITH {SC}, {RK}, {_decision_sql('place <= 25 * days')}")
def _(spark, sf):
    days = ranking.distinct_days(events(spark, sf), "time_s")
    return ranking.threshold_by_capacity(_scored(spark, sf), SCORES, "txn_id", "rare", 25, days)


@query("t2_threshold_by_share", f"WITH {SC}, {RK}, {_decision_sql('place <= ceil(n * 1e-2)')}")
def _(spark, sf):
    days = ranking.distinct_days(events(spark, sf), "time_s")
    return ranking.threshold_by_share(_scored(spark, sf), SCORES, "txn_id", "rare", 0.01, days)


@query(
    "t3_threshold_by_recall",
    f"""WITH {SC}, {CV}, dd AS (SELECT count(DISTINCT floor(time_s / 86400)) AS days FROM ev),
    best AS (SELECT model, max(score) AS cutoff FROM cv WHERE tp >= 0.9 * all_pos GROUP BY model)
    SELECT cv.model, cutoff, CAST(tp + fp AS BIGINT) AS n_flagged, CAST(tp AS BIGINT) AS n_captured,
    round(tp / (tp + fp), 6) AS precision, round(tp / all_pos, 6) AS recall,
    round((tp + fp) / CAST(days AS DOUBLE), 4) AS workload_per_day
    FROM cv JOIN best ON cv.model = best.model AND cv.score = best.cutoff, dd""",
)
def _(spark, sf):
    days = ranking.distinct_days(events(spark, sf), "time_s")
    return ranking.threshold_by_recall(_curve(spark, sf), 0.9, days)


RUN_SPLIT = 15 * 86400.0


@query(
    "r1_compare_runs",
    f"""WITH {EV}, m AS (SELECT time_s < {RUN_SPLIT} AS early, label AS model, avg(amount) AS mean_amount,
      max(amount) AS max_amount FROM ev GROUP BY 1, 2),
    l AS (UNPIVOT m ON mean_amount, max_amount INTO NAME metric VALUE x)
    SELECT model, metric, round(max(x) FILTER (WHERE early), 4) AS old_value,
    round(max(x) FILTER (WHERE NOT early), 4) AS new_value,
    round(max(x) FILTER (WHERE NOT early) - max(x) FILTER (WHERE early), 4) AS delta FROM l GROUP BY model, metric""",
)
def _(spark, sf):
    table = events(spark, sf)

    def run(condition):
        return (
            table.where(condition)
            .groupBy(F.col("label").alias("model"))
            .agg(F.avg("amount").alias("mean_amount"), F.max("amount").alias("max_amount"))
        )

    old, new = run(F.col("time_s") < RUN_SPLIT), run(F.col("time_s") >= RUN_SPLIT)
    out = ranking.compare_runs(old, new, ["mean_amount", "max_amount"])
    return out.select("model", "metric", *[F.round(c, 4).alias(c) for c in ("old_value", "new_value", "delta")])
