import numpy as np
import pytest
from pyspark.sql import functions as F

from txnsift.operators import ranking, ranks, sampling


@pytest.fixture(scope="module")
def numbers(spark):
    """20,000 rows; a third share one value, some are null, two groups of unlike size."""
    rng = np.random.default_rng(3)
    v = np.where(rng.random(20_000) < 1 / 3, 5.0, np.round(rng.normal(0, 10, 20_000), 2))
    rows = [(i, int(i % 7 == 0), float(x) if i % 11 else None) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id bigint, g int, v double").repartition(6), rows


@pytest.mark.parametrize("accuracy", [50, 500, 10_000])
def test_exact_quantiles_for_any_sketch(numbers, accuracy):
    df, rows = numbers
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.999, "f": 1.0}
    out = {r["g"]: r for r in ranks.exact_quantiles(df, ["v"], probs, ["g"], accuracy).collect()}
    for g in (0, 1):
        values = [v for _, k, v in rows if k == g and v is not None]
        assert out[g]["n"] == len(values)
        for name, p in probs.items():
            assert out[g][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantiles_of_several_columns_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (4.0, None)], "a double, b double")
    out = {r["feature"]: r["m"] for r in ranks.exact_quantiles(df, ["a", "b"], {"m": 0.5}).collect()}
    assert out == {"a": 2.0, "b": 4.0}


@pytest.mark.parametrize("k", [1, 100, 3000, 5000, 9000])
@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_top_k_is_exact_under_mass_ties(numbers, k, accuracy):
    df, rows = numbers
    known = [(i, g, v) for i, g, v in rows if v is not None]
    base = df.where("v IS NOT NULL").withColumn("down", -F.col("v"))
    keep = ranks.first_k_filter(base, "g", "down", "id", {0: k, 1: k}, accuracy)
    found = {(r["g"], r["id"]) for r in base.where(keep).collect()}
    wanted = set()
    for g in (0, 1):
        best = sorted((-v, i) for i, h, v in known if h == g)[:k]
        wanted |= {(g, i) for _, i in best}
    assert found == wanted


def test_global_rank_spreads_a_hot_value(numbers):
    df, rows = numbers
    base = df.where("v IS NOT NULL").select("id", "v")
    found = {r["id"]: r["rank"] for r in ranks.global_rank(base, "v", "id").collect()}
    order = sorted((-v, i) for i, _, v in rows if v is not None)
    assert found == {i: place for place, (_, i) in enumerate(order, 1)}


def test_large_keys_keep_their_low_bits(spark):
    base = (1 << 59) + 1
    df = spark.range(1000).select((F.col("id") + base).alias("id"), F.lit(0).alias("g"))
    keep = ranks.first_k_filter(df, "g", "id", "id", {0: 333})
    assert sorted(r["id"] for r in df.where(keep).collect()) == [base + i for i in range(333)]


def test_samples_do_not_depend_on_partitions(numbers):
    df, _ = numbers
    a = {r["id"] for r in sampling.stratified_sample(df, "id", "g", 777).collect()}
    b = {r["id"] for r in sampling.stratified_sample(df.coalesce(1), "id", "g", 777).collect()}
    assert a == b and len(a) == 777


def test_split_covers_all_rows_once(numbers):
    df, rows = numbers
    train, test = sampling.stratified_split(df, "id", "g")
    assert test.count() == 4000 and train.count() == 16_000
    assert train.join(test, "id").count() == 0


def test_sample_larger_than_the_table_is_the_table(numbers):
    df, rows = numbers
    assert sampling.stratified_sample(df, "id", "g", 50_000).count() == len(rows)
    assert sampling.row_cap(df, "id", 50_000).count() == len(rows)


def _areas(spark, rows):
    df = spark.createDataFrame(rows, "key bigint, label int, score double")
    curve = ranking.cumulative_counts(df, {"m": "score"}, "label")
    return ranking.curve_areas(curve).first()


def test_areas_on_a_known_case(spark):
    found = _areas(spark, [(1, 0, 0.1), (2, 0, 0.4), (3, 1, 0.35), (4, 1, 0.8)])
    assert found["roc_auc"] == pytest.approx(0.75)
    assert found["average_precision"] == pytest.approx(0.8333333333)
    assert found["pr_auc"] == pytest.approx(0.7916666667)


def test_areas_when_all_scores_tie(spark):
    found = _areas(spark, [(i, i % 2, 1.0) for i in range(10)])
    assert found["roc_auc"] == pytest.approx(0.5)
    assert found["average_precision"] == pytest.approx(0.5)


def test_areas_of_a_single_class_are_null(spark):
    assert _areas(spark, [(i, 0, float(i)) for i in range(5)])["roc_auc"] is None


def test_published_counts_give_published_metrics(spark):
    """492 positives in 284,807 rows: 281 of them in the top 1 %, 101 in the top 0.1 %."""
    n = 284_807
    assert ranking.top_size(n, 0.01) == 2849 and ranking.top_size(n, 0.001) == 285
    hit = (F.col("key") < 101) | F.col("key").between(1000, 1179) | F.col("key").between(10_000, 10_210)
    df = spark.range(n).select(F.col("id").alias("key")).select("key", (-F.col("key")).cast("double").alias("score"), hit.cast("int").alias("label"))
    assert df.where("label = 1").count() == 492
    row = ranking.metric_table(df, {"m": "score"}, "key", "label").first()
    assert (row["precision_top1pct"], row["precision_top01pct"], row["recall_top1pct"]) == (0.0986, 0.3544, 0.5711)


def test_rows_without_label_are_split_too(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3 - 1).cast("int").alias("g"))
    train, test = sampling.stratified_split(df, "id", "g")
    assert {r["g"]: r["count"] for r in test.groupBy("g").count().collect()} == {None: 20, 0: 20, 1: 20}
    assert train.count() == 240


def test_unlabelled_rows_do_not_break_a_curve(spark):
    found = _areas(spark, [(1, None, 0.9), (2, 0, 0.1), (3, 0, 0.4), (4, 1, 0.35), (5, 1, 0.8)])
    assert found["roc_auc"] == pytest.approx(0.75)
