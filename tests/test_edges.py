"""Empty inputs, constant columns, missing classes, published arithmetic."""

import pytest
from pyspark.sql import functions as F

from txnsift.functions import percent_text
from txnsift.operators import features, profile, quality, ranking


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 0, 10.0, 5.0), (2, 0, 0.0, 5.0), (3, 1, 30.0, 5.0), (4, 0, 40.0, 5.0)]
    return spark.createDataFrame(rows, "id bigint, label int, amount double, flat double")


def test_no_zero_amounts_gives_a_null_rate(small):
    row = profile.zero_amounts(small.where("amount > 5"), "amount", "label").first()
    assert (row["n_zero_amount"], row["n_positive"], row["positive_rate_pct"]) == (0, 0, None)


def test_constant_column(small):
    corr = {r["feature"]: r["corr_with_label"] for r in profile.label_correlation(small, ["amount", "flat"], "label").collect()}
    assert corr["flat"] is None and corr["amount"] is not None
    assert [r["flat"] for r in features.scaled_features(small, ["flat"], ["id"]).collect()] == [0.0] * 4


def test_constant_label(small):
    found = profile.label_correlation(small.where("label = 0"), ["amount"], "label").first()
    assert found["corr_with_label"] is None


def test_one_row_class_has_no_deviation(small):
    row = profile.label_distributions(small, ["amount"], "label").where("label = 1").first()
    assert row["amount_mean"] == 30.0 and row["amount_std"] is None


def test_published_separation(spark):
    """Published class means and deviation of one component give the published score."""
    moments = spark.createDataFrame(
        [(0, "V14", 0.012064, 3.091436), (1, "V14", -6.971723, 3.091436)], "label int, feature string, mean double, std double"
    )
    row = profile.separation_from_moments(moments, "label").first()
    assert (row["mean_diff"], row["pooled_std"], row["sep_score"]) == (-6.983787, 3.091436, pytest.approx(2.259076, abs=1e-6))


def test_zero_pooled_deviation_scores_zero(spark):
    moments = spark.createDataFrame([(0, "a", 1.0, 0.0), (1, "a", 2.0, 0.0)], "label int, feature string, mean double, std double")
    assert profile.separation_from_moments(moments, "label").first()["sep_score"] == 0.0


def test_published_cluster_sizes(spark):
    """Published sizes times published rates give all 492 positives; the peak lift follows."""
    sizes = spark.createDataFrame(
        [(0, 20341, 0.006244), (1, 37878, 0.000106), (2, 226588, 0.001593)], "cluster int, size bigint, positive_rate double"
    )
    total = sizes.agg(F.sum(F.round(F.col("size") * F.col("positive_rate")))).first()[0]
    assert total == 492
    from txnsift.operators.clustering import highest_rate_cluster

    assert highest_rate_cluster(sizes, "cluster").first()["cluster"] == 0


def test_capture_text():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(0.949, 0.98), (0.5, 0.0)], "u double, s double").coalesce(1)
    assert [r[0] for r in df.select(percent_text(F.col("u"), F.col("s"))).collect()] == ["96.8%", "N/A"]


def test_capture_skips_zero_denominators(spark):
    u = spark.createDataFrame([("a", 0.2, 0.1), ("b", 0.4, 0.9)], "model string, p double, roc_auc double")
    s = spark.createDataFrame([("c", 0.0, 0.9)], "model string, p double, roc_auc double")
    ratios = ranking.capture_ratios(u, s, ["p", "roc_auc"])
    found = {r["metric"]: (r["unsupervised_model"], r["capture"]) for r in ratios.collect()}
    assert found == {"p": ("b", "N/A"), "roc_auc": ("b", "100.0%")}
    assert ranking.mean_capture(ratios).first()[0] == 100.0


def test_zero_earlier_deviation_is_not_flagged(spark):
    now = spark.createDataFrame([("a", 9.0, 1.0)], "column string, mean double, std double")
    old = spark.createDataFrame([("a", 1.0, 0.0)], "column string, mean double, std double")
    row = quality.mean_drift(now, old).first()
    assert (row["drift_score"], row["flagged"], row["flag_reason"]) == (None, 0, "ok")


def test_digest_sees_copies_and_order_does_not_matter(small):
    def digest(df):
        return quality.content_digest(df, df.columns).first()["digest"]

    assert digest(small) == digest(small.orderBy(F.col("id").desc()).repartition(3))
    twice = small.unionByName(small.limit(1)).unionByName(small.limit(1))
    assert digest(twice) != digest(small)
    assert digest(small.withColumn("amount", F.when(F.col("id") == 2, None).otherwise(F.col("amount")))) != digest(small)


@pytest.mark.parametrize(
    "change, verdict",
    [
        ({}, "PASS"),
        ({"expected_rows": 5}, "WARN"),
        ({"positive_band": (2, 3)}, "WARN"),
        ({"negative": True}, "FAIL"),
        ({"null": True}, "FAIL"),
    ],
)
def test_verdicts(small, change, verdict):
    df = small
    if change.pop("negative", False):
        df = df.withColumn("amount", -F.col("amount"))
    if change.pop("null", False):
        df = df.withColumn("flat", F.when(F.col("id") > 1, F.col("flat")))
    issues = quality.table_issues(df, "label", "amount", **change)
    assert quality.verdict(issues).first()["verdict"] == verdict


def test_schema_mismatch_fails(small):
    assert quality.verdict(quality.schema_issues(small, ["id"])).first()["verdict"] == "FAIL"
    assert quality.verdict(quality.schema_issues(small, small.columns)).first()["verdict"] == "PASS"


def test_row_count_guard(small):
    with pytest.raises(ValueError, match="expected 5 rows"):
        features.feature_matrix(small.withColumn("t", F.lit(0.0)), "id", "t", "amount", "label", ["flat"], expected_rows=5)


def test_empty_table(spark, small):
    empty = small.where("id < 0")
    assert profile.group_share(empty, "label").count() == 0
    assert profile.fingerprint(empty, ["amount"]).count() == 0
    assert quality.verdict(quality.table_issues(empty, "label", "amount")).first()["verdict"] == "PASS"


def test_nulls_in_a_group_column_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "g int, v double")
    found = {r["g"]: r["v_median"] for r in profile.group_profile(df, ["v"], "g").collect()}
    assert found == {None: 2.0, 1: 5.0}
