"""Digests, drift, checks and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.bindings import EV, customers, event_features, events, table
from catalog.sources import DIGEST_SCHEMA, DIGEST_SQL, EVENT_HASH, digest_columns, event_digest
from txnsift.functions import row_hash60
from txnsift.operators import profile, quality
from txnsift.plans.validation import validate
from txnsift.session import scratch_path

SPLIT = 1296000
NUMERIC = ["amount", "user_id", "time_s"]


def _runs(spark, sf):
    source = events(spark, sf)
    return source.where(F.col("time_s") < SPLIT), source.where(F.col("time_s") >= SPLIT)


@query("d1_content_digest", DIGEST_SQL)
def _(spark, sf):
    return event_digest(spark, sf)


STATS = f"""l AS (UNPIVOT (SELECT time_s < {SPLIT} AS early, amount, CAST(user_id AS DOUBLE) AS user_id, time_s FROM ev)
    ON amount, user_id, time_s INTO NAME "column" VALUE x),
  st AS (SELECT early, "column", avg(x) AS mean, stddev(x) AS std FROM l GROUP BY early, "column"),
  dr AS (SELECT c."column", c.mean, p.mean AS prev_mean, p.std AS prev_std, abs(c.mean - p.mean) / p.std AS score
    FROM st c JOIN st p ON c."column" = p."column" AND NOT c.early AND p.early)"""


def _mean_drift(spark, sf):
    early, late = _runs(spark, sf)
    return quality.mean_drift(profile.fingerprint(late, NUMERIC), profile.fingerprint(early, NUMERIC))


@query("j1_statistics_join", f"WITH {EV}, {STATS} SELECT \"column\", round(score, 6) AS drift_score FROM dr")
def _(spark, sf):
    return _mean_drift(spark, sf).select("column", F.round("drift_score", 6).alias("drift_score"))


@query(
    "d4_mean_drift",
    f"""WITH {EV}, {STATS} SELECT "column", round(score, 6) AS drift_score, CAST(score > 1.5 AS INTEGER) AS flagged,
    CASE WHEN score > 1.5 THEN printf('mean-drift=%.3f>1.5', score) ELSE 'ok' END AS flag_reason FROM dr""",
)
def _(spark, sf):
    early, late = _runs(spark, sf)
    out = quality.mean_drift(profile.fingerprint(late, NUMERIC), profile.fingerprint(early, NUMERIC), limit=1.5)
    return out.select("column", F.round("drift_score", 6).alias("drift_score"), "flagged", "flag_reason")


KS = f"""ke AS (SELECT time_s >= {SPLIT} AS late, amount, CAST(user_id AS DOUBLE) AS user_id, time_s,
      (time_s % 86400) / 3600.0 AS hour_of_day FROM ev),
    kl AS (UNPIVOT ke ON amount, user_id, time_s, hour_of_day INTO NAME "column" VALUE x),
    kg AS (SELECT "column", x, count(*) FILTER (WHERE late) AS a, count(*) FILTER (WHERE NOT late) AS b FROM kl GROUP BY 1, 2),
    kc AS (SELECT "column", sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY "column") AS na,
      sum(b) OVER (PARTITION BY "column") AS nb FROM kg WINDOW w AS (PARTITION BY "column" ORDER BY x DESC)),
    km AS (SELECT "column", max(abs(ca / na - cb / nb)) AS ks, max(sqrt(na * nb / (na + nb))) AS scale FROM kc GROUP BY 1),
    ks AS (SELECT "column", round(ks, 9) AS ks_stat, CASE WHEN ks * scale < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
      2 * (SELECT sum((CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * i * i * ks * scale * ks * scale))
           FROM range(1, 101) t(i)))) END AS ks_pvalue FROM km)"""


@query(
    "d5_ks_drift",
    f"""WITH {EV}, {KS} SELECT "column", ks_stat, round(ks_pvalue, 6) AS ks_pvalue FROM ks WHERE "column" <> 'time_s'""",
)
def _(spark, sf):
    source = event_features(spark, sf).withColumn("user_id", F.col("user_id").cast("double"))
    early, late = source.where(F.col("time_s") < SPLIT), source.where(F.col("time_s") >= SPLIT)
    out = quality.ks_drift(early, late, ["amount", "user_id", "hour_of_day"])
    return out.select("column", F.round("ks_stat", 9).alias("ks_stat"), F.round("ks_pvalue", 6).alias("ks_pvalue"))


@query(
    "d7_row_count_check",
    """SELECT 'ROW COUNT' AS "check", 'soft' AS severity, 'expected 1, got ' || count(*) AS detail FROM events
    HAVING count(*) <> 1""",
)
def _(spark, sf):
    return quality.table_issues(table(spark, sf, "events"), expected_rows=1)


@query(
    "d8_positive_band",
    f"""WITH {EV} SELECT 'CLASS BALANCE' AS "check", 'soft' AS severity, 'positive count=' || sum(rare) AS detail FROM ev
    HAVING sum(rare) NOT BETWEEN 1 AND 10""",
)
def _(spark, sf):
    return quality.table_issues(events(spark, sf), label="rare", positive_band=(1, 10))


@query(
    "d9_negative_amount",
    """SELECT 'NEGATIVE AMOUNT' AS "check", 'hard' AS severity, 'min=' || min(c_acctbal) AS detail FROM customer
    HAVING min(c_acctbal) < 0""",
)
def _(spark, sf):
    return quality.table_issues(customers(spark, sf), amount="c_acctbal")


def _delivered(spark, sf):
    """Two deliveries under one name: the events of the first half, then those of the second."""
    root = scratch_path(spark, "validation")
    early, late = _runs(spark, sf)
    columns = ["txn_id", "user_id", "time_s", "amount", "label", "rare"]
    checks = dict(numeric=NUMERIC, expected_columns=columns, label="rare", amount="amount", positive_band=(1, 10))
    validate(early, root, "2024-01-16_0000", "events", **checks)
    return root, late, checks


ISSUE_SQL = f"""SELECT 'CLASS BALANCE' AS "check", 'soft' AS severity, 'positive count=' || sum(rare) AS detail FROM ev
    WHERE time_s >= {SPLIT} HAVING sum(rare) NOT BETWEEN 1 AND 10
    UNION ALL SELECT 'DIGEST REWRITE', 'soft', 'content changed under the name events'"""


def _digest_sql(rows: str) -> str:
    return f"""(SELECT sha256(count(*) || ':' || CAST(bit_xor(h) AS BIGINT) || ':' || CAST(sum(h) AS VARCHAR) || ':' ||
      '{DIGEST_SCHEMA}') FROM (SELECT {EVENT_HASH} AS h FROM {rows}))"""


HALF = "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16')"
EDITED = "(SELECT * REPLACE (CASE WHEN event_id = 7 THEN value + 1 ELSE value END AS value) FROM events)"


@query(
    "d10_silent_rewrite",
    f"""SELECT 'content changed under the name ' || name AS detail FROM (VALUES
      ('edited', {_digest_sql(EDITED)}, {_digest_sql('events')}), ('shorter', {_digest_sql(HALF)}, {_digest_sql('events')}),
      ('same', {_digest_sql('events')}, {_digest_sql('events')})) t(name, now, old) WHERE now <> old""",
)
def _(spark, sf):
    """One column list throughout: a value edited, rows missing, and the same rows in another order as control."""
    source = table(spark, sf, "events")
    edited = source.withColumn("value", F.when(F.col("event_id") == 7, F.col("value") + 1).otherwise(F.col("value")))
    versions = {
        "edited": edited,
        "shorter": source.where("ts < TIMESTAMP_NTZ'2024-01-16'"),
        "same": source.repartition(5, "user_id"),
    }

    def record(name, rows):
        return quality.content_digest(rows, digest_columns()).select(F.lit(name).alias("data_file"), "digest")

    now, old = None, None
    for name, rows in versions.items():
        now = record(name, rows) if now is None else now.unionByName(record(name, rows))
        old = record(name, source) if old is None else old.unionByName(record(name, source))
    return quality.rewrite_issues(now, old).select("detail")


@query(
    "d1_digest_separators",
    """SELECT count(*) AS n_rows, count(DISTINCT md5(concat(coalesce(length(a) || ':' || a, '-'),
      coalesce(length(b) || ':' || b, '-')))) AS n_hashes FROM (
      SELECT DISTINCT a, b FROM (SELECT event_type || '|' || user_id AS a, CAST(event_id % 5 AS VARCHAR) AS b FROM events
        UNION ALL SELECT event_type, user_id || '|' || event_id % 5 FROM events
        UNION ALL SELECT event_type, NULL FROM events UNION ALL SELECT event_type, '\\N' FROM events
        UNION ALL SELECT event_type, '-' FROM events UNION ALL SELECT event_type, '' FROM events))""",
)
def _(spark, sf):
    """Rows that a separator, or a text for null, would confuse: every one has a hash of its own."""
    source = table(spark, sf, "events")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    fifth = (F.col("event_id") % 5).cast("string")
    shapes = [
        (F.concat(kind, F.lit("|"), user), fifth), (kind, F.concat(user, F.lit("|"), fifth)),
        (kind, F.lit(None).cast("string")), (kind, F.lit("\\N")), (kind, F.lit("-")), (kind, F.lit("")),
    ]
    pairs = source.select(F.inline(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in shapes]))).distinct()
    return pairs.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(row_hash60(["a", "b"])).alias("n_hashes"))


@query(
    "d5_ks_with_nulls",
    f"""WITH {EV}, n AS (SELECT time_s >= {SPLIT} AS late, CASE WHEN time_s < {SPLIT} OR txn_id % 3 > 0 THEN amount END AS x FROM ev),
    g AS (SELECT x, count(*) FILTER (WHERE late) AS a, count(*) FILTER (WHERE NOT late) AS b FROM n WHERE x IS NOT NULL GROUP BY 1),
    c AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM g
      WINDOW w AS (ORDER BY x DESC))
    SELECT 'amount' AS "column", round(max(abs(ca / na - cb / nb)), 9) AS ks_stat,
      (SELECT count(*) FILTER (WHERE x IS NULL) FROM n) AS n_null FROM c""",
)
def _(spark, sf):
    early, late = _runs(spark, sf)
    late = late.withColumn("amount", F.when(F.col("txn_id") % 3 > 0, F.col("amount")))
    out = quality.ks_drift(early, late, ["amount"])
    return out.select("column", F.round("ks_stat", 9).alias("ks_stat"), "n_null")


@query(
    "d13_clean_after_dirty",
    f"""WITH {EV} SELECT CASE WHEN min(amount) < 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, CAST(1 AS INTEGER) AS reused,
    CAST(0 AS BIGINT) AS n_issues, 'FAIL' AS verdict_of_dirty FROM ev WHERE time_s < {SPLIT}""",
)
def _(spark, sf):
    """A file with a negative amount, then a clean one, then the clean one again: its own verdict comes back."""
    root = scratch_path(spark, "validation")
    clean, dirty = _runs(spark, sf)
    dirty = dirty.withColumn("amount", -F.col("amount"))
    checks = dict(numeric=NUMERIC, expected_columns=clean.columns, label="rare", amount="amount")
    first = validate(dirty, root, "r1", "dirty", **checks).verdict
    validate(clean, root, "r0", "clean", **checks)  # the run before, without drift
    again = validate(clean, root, "r3", "clean", **checks)
    return again.verdict.select(
        "verdict",
        F.lit(int(again.reused)).alias("reused"),
        (F.col("n_hard") + F.col("n_soft")).alias("n_issues"),
        F.lit(first.first()["verdict"]).alias("verdict_of_dirty"),
    )


@query(
    "d13_changed_expectations",
    f"""WITH {EV} SELECT CAST(0 AS INTEGER) AS reused, 'SCHEMA MISMATCH' AS "check" FROM ev HAVING count(*) > 0""",
)
def _(spark, sf):
    """The same rows under the same name, but another list of expected columns: checked anew."""
    root, _, checks = _delivered(spark, sf)
    early, _ = _runs(spark, sf)
    report = validate(early, root, "2024-01-17_0000", "events", **(checks | {"expected_columns": ["txn_id"]}))
    hard = report.issues.where("severity = 'hard'")
    return hard.select(F.lit(int(report.reused)).alias("reused"), "check")


@query(
    "d11_verdict",
    f"""WITH {EV}, {STATS}, i AS ({ISSUE_SQL} UNION ALL SELECT 'DRIFT FLAGGED', 'soft', "column" FROM dr WHERE score > 2.0)
    SELECT CASE WHEN count(*) FILTER (WHERE severity = 'hard') > 0 THEN 'FAIL' WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END
      AS verdict, count(*) FILTER (WHERE severity = 'hard') AS n_hard, count(*) FILTER (WHERE severity <> 'hard') AS n_soft
    FROM i""",
)
def _(spark, sf):
    root, late, checks = _delivered(spark, sf)
    return validate(late, root, "2024-01-31_0000", "events", **checks).verdict


@query(
    "d12_issue_report",
    f"""WITH {EV}, {STATS} {ISSUE_SQL} UNION ALL SELECT 'DRIFT FLAGGED', 'soft',
    "column" || ': ' || printf('mean-drift=%.3f>2.0', score) FROM dr WHERE score > 2.0""",
)
def _(spark, sf):
    root, late, checks = _delivered(spark, sf)
    return validate(late, root, "2024-01-31_0000", "events", **checks).issues


@query(
    "d13_unchanged_delivery",
    f"""WITH {EV} SELECT CAST(1 AS INTEGER) AS reused, count(*) AS n_issues FROM (
    SELECT sum(rare) FROM ev WHERE time_s < {SPLIT} HAVING sum(rare) NOT BETWEEN 1 AND 10)""",
)
def _(spark, sf):
    root, _, checks = _delivered(spark, sf)
    early, _ = _runs(spark, sf)
    report = validate(early, root, "2024-01-17_0000", "events", **checks)
    return report.issues.agg(F.lit(int(report.reused)).alias("reused"), F.count(F.lit(1)).alias("n_issues"))


@query(
    "d12_drift_with_distributions",
    f"""WITH {EV}, {STATS}, {KS} SELECT "column", round(score, 6) AS drift_score, round(ks_pvalue, 6) AS ks_pvalue,
    CAST(score > 2.0 OR ks_pvalue < 0.01 AS INTEGER) AS flagged,
    coalesce(nullif(concat_ws('; ', CASE WHEN score > 2.0 THEN printf('mean-drift=%.3f>2.0', score) END,
      CASE WHEN ks_pvalue < 0.01 THEN printf('KS p=%.4f<0.01', ks_pvalue) END), ''), 'ok') AS flag_reason
    FROM dr JOIN ks USING ("column") WHERE "column" IN ('amount', 'time_s')""",
)
def _(spark, sf):
    early, late = _runs(spark, sf)
    columns = ["amount", "time_s"]
    mean = quality.mean_drift(profile.fingerprint(late, columns), profile.fingerprint(early, columns))
    report = quality.drift_report(mean, quality.ks_drift(early, late, columns))
    return report.select(
        "column",
        F.round("drift_score", 6).alias("drift_score"),
        F.round("ks_pvalue", 6).alias("ks_pvalue"),
        "flagged",
        "flag_reason",
    )
