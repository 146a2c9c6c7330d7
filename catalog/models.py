"""Outlier scores, clustering, components and supervised baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.bindings import EV, LINE_FEATURES, V, VE, VL, VZ, events, lines, table, trips, vectors
from txnsift.operators import clustering, fourier, outliers, sampling, supervised
from txnsift.operators.features import scaled_features
from txnsift.operators.neighbours import local_outlier_factor
from txnsift.plans import archetypes, scoring
from txnsift.session import materialize

def scaled_vectors(spark, sf):
    return scaled_features(vectors(spark, sf), V, ["vec_id", "label", "grp"])


def scaled_lines(spark, sf):
    """The scaled matrix of the largest table, stored once. The fixture is one small file: more files use all cores."""
    scaled = scaled_features(lines(spark, sf), LINE_FEATURES, ["txn_id", "label"])
    return materialize(scaled.repartition(2 * spark.sparkContext.defaultParallelism), "lines-scaled")


# -- outlier scores --------------------------------------------------------------------------------


@query("n1_isolation_forest")
def _(spark, sf):
    matrix = scaled_vectors(spark, sf)
    forest = outliers.fit_isolation_forest(matrix, V, "vec_id")
    return forest.score(matrix).select("vec_id", "label", "if_score")


@query("n1_isolation_forest_lines")
def _(spark, sf):
    matrix = scaled_lines(spark, sf)
    forest = outliers.fit_isolation_forest(matrix, LINE_FEATURES, "txn_id")
    return forest.score(matrix).select("txn_id", "label", "if_score")


def _lof_sql(points: str, k: int) -> str:
    """Brute-force factors from `points`, rows of (id, list of coordinates)."""
    return f"""pt AS ({points}),
    d AS (SELECT a.id AS i, b.id AS j, list_distance(a.z, b.z) AS d FROM pt a JOIN pt b ON a.id <> b.id),
    nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d) WHERE r <= {k}),
    kd AS (SELECT i, max(d) AS kd FROM nn GROUP BY i),
    den AS (SELECT nn.i, 1.0 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS den FROM nn JOIN kd ON kd.i = nn.j GROUP BY nn.i),
    lof AS (SELECT nn.i AS id, avg(o.den) / any_value(s.den) AS lof FROM nn JOIN den o ON o.i = nn.j
      JOIN den s ON s.i = nn.i GROUP BY nn.i)"""


@query(
    "n2_local_outlier_factor",
    f"""WITH {VE}, {VL}, {VZ}, {_lof_sql("SELECT vec_id AS id, list(z ORDER BY feature) AS z FROM vz GROUP BY vec_id", 20)}
    SELECT id AS vec_id, round(lof, 6) AS lof FROM lof""",
)
def _(spark, sf):
    out = local_outlier_factor(scaled_vectors(spark, sf), "vec_id", V, 20)
    return out.select("vec_id", F.round("lof", 6).alias("lof"))


@query("n2_lines")
def _(spark, sf):
    """The largest table. Brute-force SQL over its pairs is too slow; a test compares all rows of the smallest size."""
    out = local_outlier_factor(scaled_lines(spark, sf), "txn_id", LINE_FEATURES, 20)
    return out.select("txn_id", "lof")


PART_POINTS = """SELECT p_partkey AS id, [CAST(p_size AS DOUBLE), CAST(floor(p_retailprice / 50) AS DOUBLE)] AS z FROM part"""


@query(
    "n2_factor_with_copies",
    f"WITH {_lof_sql(PART_POINTS, 20)} SELECT id AS p_partkey, round(lof, 6) AS lof FROM lof",
)
def _(spark, sf):
    points = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("a"), F.floor(F.col("p_retailprice") / 50).cast("double").alias("b")
    )
    return local_outlier_factor(points, "p_partkey", ["a", "b"], 20).select("p_partkey", F.round("lof", 6).alias("lof"))


@query("n3_one_class_svm")
def _(spark, sf):
    matrix = scaled_lines(spark, sf)
    machine = outliers.fit_one_class_svm(matrix, LINE_FEATURES, "txn_id", "label")
    return machine.score(matrix).select("txn_id", "label", "ocsvm_score")


@query("n3_fourier_one_class")
def _(spark, sf):
    """The one-class machine on random features, fitted on all rows of the largest table."""
    matrix = scaled_lines(spark, sf)
    machine = fourier.fit_fourier_one_class(matrix, LINE_FEATURES, "txn_id", "label", sample_rows=None)
    return machine.score(matrix).select("txn_id", "label", "ocsvm_score")


@query("e8_anomaly_metric_table")
def _(spark, sf):
    from txnsift.operators.ranking import metric_table

    scores = scoring.anomaly_scores(scaled_vectors(spark, sf), "vec_id", "label", V)
    return metric_table(scores, scoring.UNSUPERVISED, "vec_id", "label")


# -- clustering ------------------------------------------------------------------------------------

CENTERS = """ctr AS (SELECT grp AS c, feature, avg(z) AS m FROM vz GROUP BY 1, 2),
  cd AS (SELECT v.vec_id, ctr.c, sum((v.z - ctr.m) * (v.z - ctr.m)) AS d FROM vz v JOIN ctr USING (feature) GROUP BY 1, 2),
  asg AS (SELECT vec_id, d, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS cluster,
    row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place FROM cd)"""


def _assigned(spark, sf):
    """Vectors assigned to the nearest mean of the given groups."""
    matrix = scaled_vectors(spark, sf)
    return clustering.group_centers(matrix, V, "grp").assign(matrix)


@query("k1_kmeans_sweep")
def _(spark, sf):
    matrix = scaled_lines(spark, sf)
    fits = clustering.kmeans_sweep(matrix, LINE_FEATURES, "txn_id")
    sample = sampling.stratified_sample(matrix, "txn_id", "label", 30_000)
    return clustering.sweep_table(fits, sample, LINE_FEATURES)


@query(
    "k1_inertia_of_centers",
    f"WITH {VE}, {VL}, {VZ}, {CENTERS} SELECT count(*) AS n_rows, round(sum(d), 4) AS inertia FROM asg WHERE place = 1",
)
def _(spark, sf):
    matrix = scaled_vectors(spark, sf)
    out = clustering.total_inertia(matrix, clustering.group_centers(matrix, V, "grp"))
    return out.select("n_rows", F.round("inertia", 4).alias("inertia"))


def _silhouette_sql(distance: str, pairs: str, by: str = "") -> str:
    """Brute-force silhouette over `pairs` (i, ci, cj, d), one row per ordered pair of rows."""
    part = f"{by}, " if by else ""
    return f"""m AS (SELECT {part} i, ci, cj, sum({distance}) / (count(*) - CASE WHEN ci = cj THEN 1 ELSE 0 END) AS mean_d,
      count(*) AS n FROM ({pairs}) GROUP BY {part} i, ci, cj),
    ab AS (SELECT {part} i, max(CASE WHEN ci = cj THEN mean_d END) AS a, min(CASE WHEN ci <> cj THEN mean_d END) AS b,
      max(CASE WHEN ci = cj THEN n END) AS n FROM m GROUP BY {part} i),
    sil AS (SELECT {part} count(*) AS n_rows, avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette
      FROM ab {'GROUP BY ' + by if by else ''})"""


LISTS = "pt AS (SELECT vec_id AS id, any_value(grp) AS grp, list(z ORDER BY feature) AS z FROM vz GROUP BY vec_id)"
PAIRS = "SELECT a.id AS i, a.grp AS ci, b.grp AS cj, list_distance(a.z, b.z) AS d FROM pt a, pt b"


@query(
    "k2_silhouette",
    f"""WITH {VE}, {VL}, {VZ}, {LISTS}, {_silhouette_sql('d', PAIRS)}
    SELECT n_rows, round(silhouette, 6) AS silhouette FROM sil""",
)
def _(spark, sf):
    out = clustering.silhouette(scaled_vectors(spark, sf), V, ["grp"])
    return out.select("n_rows", F.round("silhouette", 6).alias("silhouette"))


@query(
    "k2_silhouette_squared",
    f"""WITH {VE}, {VL}, {VZ}, {LISTS}, {_silhouette_sql('d * d', PAIRS)}
    SELECT n_rows, round(silhouette, 6) AS silhouette FROM sil""",
)
def _(spark, sf):
    out = clustering.silhouette_squared(scaled_vectors(spark, sf), V, "grp")
    return out.select("n_rows", F.round("silhouette", 6).alias("silhouette"))


KS_PAIRS = """SELECT k, a.id AS i, a.grp % k AS ci, b.grp % k AS cj, list_distance(a.z, b.z) AS d
  FROM pt a, pt b, (SELECT unnest([3, 4, 5, 6, 7, 8]) AS k)"""


@query(
    "k3_best_k",
    f"""WITH {VE}, {VL}, {VZ}, {LISTS}, {_silhouette_sql('d', KS_PAIRS, 'k')}
    SELECT CAST(k AS INTEGER) AS k, round(silhouette, 6) AS silhouette FROM sil ORDER BY silhouette DESC, k LIMIT 1""",
)
def _(spark, sf):
    names = {f"k{k}": F.col("grp") % k for k in range(3, 9)}
    sample = scaled_vectors(spark, sf).withColumns(names)
    scored = clustering.silhouette(sample, V, list(names)).withColumn("k", F.substring("assignment", 2, 9).cast("int"))
    best = scored.orderBy(F.col("silhouette").desc(), "k").limit(1)
    return best.select("k", F.round("silhouette", 6).alias("silhouette"))


@query(
    "k4_assignment",
    f"WITH {VE}, {VL}, {VZ}, {CENTERS} SELECT vec_id, cluster FROM asg WHERE place = 1",
)
def _(spark, sf):
    return _assigned(spark, sf).select("vec_id", "cluster")


PROFILE_SQL = f"""{VE}, {VL}, {VZ}, {CENTERS},
  am AS (SELECT cluster, feature, avg(z) AS m FROM vz JOIN asg USING (vec_id) WHERE place = 1 GROUP BY 1, 2),
  dr AS (SELECT cluster, string_agg(feature, '|' ORDER BY o) AS top3_driving_features FROM (SELECT *, row_number() OVER (
      PARTITION BY cluster ORDER BY abs(m) DESC, CAST(substr(feature, 2) AS INTEGER)) AS o FROM am) WHERE o <= 3 GROUP BY 1),
  pr AS (SELECT a.cluster, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (), 3) AS pct_of_total,
    round(avg(z), 4) AS mean_V1, round(avg(label), 6) AS positive_rate
    FROM asg a JOIN vz ON vz.vec_id = a.vec_id AND feature = 'V1' WHERE place = 1 GROUP BY 1)"""


@query("k5_cluster_profile", f"WITH {PROFILE_SQL} SELECT pr.*, top3_driving_features FROM pr JOIN dr ON pr.cluster = dr.cluster")
def _(spark, sf):
    return clustering.cluster_profile(_assigned(spark, sf), V, "cluster", "label", "V1")


@query(
    "k6_highest_rate_cluster",
    f"""WITH {PROFILE_SQL} SELECT cluster, positive_rate,
    round(positive_rate / (SELECT sum(positive_rate * size) / sum(size) FROM pr), 4) AS lift
    FROM pr ORDER BY positive_rate DESC, cluster LIMIT 1""",
)
def _(spark, sf):
    profile = clustering.cluster_profile(_assigned(spark, sf), V, "cluster", "label", "V1")
    return clustering.highest_rate_cluster(profile, "cluster")


@query("k7_trip_archetypes")
def _(spark, sf):
    return archetypes.run(trips(spark, sf).drop("cluster"), "trip_id").profile


@query("k8_principal_components")
def _(spark, sf):
    ratios = clustering.fit_components(scaled_vectors(spark, sf), V).variance_ratio
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(ratios)], "component int, variance_ratio double")


@query("k9_map_table")
def _(spark, sf):
    matrix = _assigned(spark, sf)
    shown = sampling.stratified_sample(matrix, "vec_id", "label", 30_000)  # as many points as a map shows
    return clustering.map_table(shown, clustering.fit_components(matrix, V), ["vec_id", "cluster", "label"])


# -- supervised ------------------------------------------------------------------------------------


@query(
    "l1_class_weights",
    f"""WITH {EV}, c AS (SELECT rare, count(*) AS n_rows FROM ev GROUP BY rare)
    SELECT rare, n_rows, round((SELECT sum(n_rows) FROM c) / (2.0 * n_rows), 6) AS weight FROM c""",
)
def _(spark, sf):
    out = supervised.class_weights(events(spark, sf), "rare")
    return out.select("rare", "n_rows", F.round("weight", 6).alias("weight"))


@query("l2_logistic_regression")
def _(spark, sf):
    train, test = sampling.stratified_split(scaled_vectors(spark, sf), "vec_id", "label")
    return supervised.logistic_scores(train, test, V, "label").select("vec_id", "label", "lr_score")


@query("l3_boosted_trees")
def _(spark, sf):
    train, test = sampling.stratified_split(scaled_vectors(spark, sf), "vec_id", "label")
    return supervised.boosted_scores(train, test, V, "label").select("vec_id", "label", "gbt_score")


@query("e9_supervised_capture")
def _(spark, sf):
    matrix = materialize(scaled_vectors(spark, sf), "vectors-scaled")
    anomaly = scoring.anomaly_scores(matrix, "vec_id", "label", V)
    ceiling = scoring.supervised_scores(matrix, "vec_id", "label", V)
    return scoring.capture(anomaly, ceiling, "vec_id", "label")


