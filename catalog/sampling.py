"""Deterministic samples, splits, scaling and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.bindings import EV, LI, V, VE, VL, VZ, event_features, events, hash60_sql, lines, vectors
from txnsift.operators import features, sampling


def _sample_sql(wanted: int, label: str, source: str, key: str) -> str:
    """Rows ranked by seeded hash within the class, up to the quota of the class."""
    return f"""z AS (SELECT count(*) AS n, sum({label}) AS p FROM {source}),
    q AS (SELECT least(p, ({wanted} * p) // n) AS qp, n, p FROM z),
    r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {hash60_sql(42, key)}, {key}) AS place FROM {source}),
    smp AS (SELECT r.* FROM r, q WHERE place <= CASE WHEN {label} = 1 THEN qp ELSE least(n - p, {wanted} - qp) END)"""


@query(
    "m1_stratified_sample",
    f"WITH {EV}, {_sample_sql(2000, 'rare', 'ev', 'txn_id')} SELECT txn_id, rare FROM smp",
)
def _(spark, sf):
    return sampling.stratified_sample(events(spark, sf), "txn_id", "rare", 2000).select("txn_id", "rare")


@query(
    "m1_stratified_sample_lines",
    f"""WITH {LI}, {_sample_sql(20000, 'label', 'li', 'txn_id')}
    SELECT label, count(*) AS n, CAST(bit_xor(txn_id) AS BIGINT) AS key_xor FROM smp GROUP BY label""",
)
def _(spark, sf):
    sample = sampling.stratified_sample(lines(spark, sf), "txn_id", "label", 20_000)
    return sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("txn_id").alias("key_xor"))


SPLIT_SQL = f"""c AS (SELECT label, count(*) AS m FROM ev GROUP BY label),
    t AS (SELECT CAST(ceil(sum(m) * 0.2) AS BIGINT) AS total, sum(m) AS n FROM c),
    e AS (SELECT label, m, total, total * m / n AS x, CAST(floor(total * m / n) AS BIGINT) AS f FROM c, t),
    g AS (SELECT *, total - sum(f) OVER () AS rest, row_number() OVER (ORDER BY f - x, label) AS o FROM e),
    quota AS (SELECT label, f + CASE WHEN o <= rest THEN 1 ELSE 0 END AS take FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash60_sql(42, 'txn_id')}, txn_id) AS place FROM ev)"""


@query(
    "m2_stratified_split",
    f"""WITH {EV}, {SPLIT_SQL} SELECT txn_id, label, CASE WHEN place <= take THEN 'test' ELSE 'train' END AS part
    FROM r JOIN quota USING (label)""",
)
def _(spark, sf):
    train, test = sampling.stratified_split(events(spark, sf), "txn_id", "label")
    parts = [p.select("txn_id", "label", F.lit(n).alias("part")) for p, n in ((train, "train"), (test, "test"))]
    return parts[0].unionByName(parts[1])


@query(
    "m3_shuffled_positions",
    f"WITH {EV} SELECT txn_id, row_number() OVER (ORDER BY {hash60_sql(42, 'txn_id')}, txn_id) AS position FROM ev",
)
def _(spark, sf):
    return sampling.shuffled_positions(events(spark, sf), "txn_id")


@query(
    "m4_row_cap",
    f"""WITH {LI} SELECT txn_id, amount FROM li ORDER BY {hash60_sql(42, 'txn_id')}, txn_id LIMIT 5000""",
)
def _(spark, sf):
    return sampling.row_cap(lines(spark, sf), "txn_id", 5000).select("txn_id", "amount")


@query(
    "j3_sample_membership",
    f"""WITH {EV}, {_sample_sql(2000, 'rare', 'ev', 'txn_id')}
    SELECT rare, count(*) AS n, round(sum(amount), 2) AS total FROM ev
    WHERE txn_id IN (SELECT txn_id FROM smp) GROUP BY rare""",
)
def _(spark, sf):
    table = events(spark, sf)
    ids = sampling.stratified_sample(table.select("txn_id", "rare"), "txn_id", "rare", 2000)
    return (
        sampling.member_rows(table, ids, "txn_id")
        .groupBy("rare")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("total"))
    )


@query(
    "j4_scores_with_labels",
    f"""WITH {EV} SELECT txn_id, label, amount AS amount_score, round((time_s % 86400) / 3600.0, 6) AS hour_score FROM ev""",
)
def _(spark, sf):
    table = event_features(spark, sf)
    amount = table.select("txn_id", F.col("amount").alias("amount_score"))
    hour = table.select("txn_id", F.round("hour_of_day", 6).alias("hour_score"))
    return sampling.join_scores([amount, hour], table.select("txn_id", "label"), "txn_id")


@query(
    "f1_standard_scaling",
    f"WITH {VE}, {VL}, {VZ} SELECT vec_id, feature, round(z, 6) AS z FROM vz",
)
def _(spark, sf):
    scaled = features.scaled_features(vectors(spark, sf), V, ["vec_id"])
    return scaled.unpivot(["vec_id"], V, "feature", "z").select("vec_id", "feature", F.round("z", 6).alias("z"))


@query(
    "f2_feature_matrix",
    f"""WITH {LI}, d AS (SELECT *, (time_s % 86400) / 3600.0 AS h FROM li),
    s AS (SELECT avg(quantity) AS qm, stddev_pop(quantity) AS qs, avg(discount) AS dm, stddev_pop(discount) AS ds,
      avg(tax) AS tm, stddev_pop(tax) AS ts, avg(log_amount) AS lm, stddev_pop(log_amount) AS ls,
      avg(h) AS hm, stddev_pop(h) AS hs FROM d)
    SELECT txn_id, label, CAST(floor(time_s / 86400) AS INTEGER) AS day, round((quantity - qm) / qs, 4) AS quantity,
    round((discount - dm) / ds, 4) AS discount, round((tax - tm) / ts, 4) AS tax,
    round((log_amount - lm) / ls, 4) AS log_amount,
    CASE WHEN hs > 0 THEN round((h - hm) / hs, 4) ELSE 0.0 END AS hour_of_day FROM d, s""",
)
def _(spark, sf):
    matrix = features.feature_matrix(
        lines(spark, sf), "txn_id", "time_s", "amount", "label", ["quantity", "discount", "tax"]
    )
    scaled = ["quantity", "discount", "tax", "log_amount", "hour_of_day"]
    return matrix.withColumns({c: F.round(c, 4) for c in scaled})
