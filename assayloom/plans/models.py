"""Queries over multivariate models. Eigenvectors have no SQL twin; those queries are tested against NumPy."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.operators import features as ft, models as op
from assayloom.plans import bindings as b
from assayloom.plans.features import LONG, feature_long, labels
from assayloom.plans.registry import query
from assayloom.plans.screening import r6


@query("A26_pca_scores")
def _(spark, sf):
    return op.pca(feature_long(spark, sf), labels(spark, sf), 3, "pareto").scores


@query("A26_pca_loadings")
def _(spark, sf):
    return op.pca(feature_long(spark, sf), labels(spark, sf)).loadings


@query("W9_cumulative_variance")
def _(spark, sf):
    return op.cumulative_variance(op.pca(feature_long(spark, sf), labels(spark, sf)).variance)


@query("T5_top_loadings")
def _(spark, sf):
    return op.top_loadings(op.pca(feature_long(spark, sf), labels(spark, sf)).loadings, 8)


AXES = """dims AS (SELECT vec_id AS sample, i AS component, CAST(embedding[i] AS DOUBLE) AS score, 'C' || (label % 5) AS label
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
 pairs AS (SELECT a.sample, a.label || ':' || (a.component // 2) AS label, a.score AS x, b.score AS y FROM dims a JOIN dims b ON a.sample = b.sample AND b.component = a.component + 1 WHERE a.component % 2 = 1)"""


def dimensions(spark, sf):
    """Every entry of every embedding as the score of a component."""
    rows = b.table(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("sample"), F.concat(F.lit("C"), F.col("label") % 5).alias("label"),
                       F.posexplode("embedding").alias("c", "v")).select("sample", "label", (F.col("c") + 1).alias("component"), F.col("v").cast("double").alias("score"))


# the quantile of the beta distribution by bisection; its first parameter is 32, so the distribution is a sum of 32 terms
@query("A27_hotelling_t2", f"""WITH RECURSIVE {AXES}, v AS (SELECT component, var_samp(score) AS v FROM dims GROUP BY 1),
 t AS (SELECT sample, sum(score * score / v) AS t2 FROM dims JOIN v USING (component) GROUP BY 1),
 n AS (SELECT count(*)::DOUBLE AS n, (count(*) - 65) / 2.0 AS b FROM t),
 s(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END FROM (
   SELECT k, lo, hi, 1 - (SELECT sum(exp(n.b * ln(1 - (lo + hi) / 2) + lgamma(n.b + j) - lgamma(n.b) - lgamma(j + 1) + j * ln((lo + hi) / 2))) FROM n, (SELECT unnest(range(0, 32)) AS j)) < 0.95 AS below
   FROM s WHERE k < 60)),
 l AS (SELECT (n - 1) ** 2 / n * lo AS limit_95 FROM s, n WHERE k = 60)
 SELECT sample, round(t2, 6) AS t2, round(limit_95, 6) AS limit_95, t2 > limit_95 AS outlier FROM t, l""")
def _(spark, sf):
    return op.hotelling_t2(dimensions(spark, sf).drop("label")).select("sample", *r6("t2", "limit_95"), "outlier")


@query("A28_confidence_ellipse", f"""WITH {AXES}, m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c, count(*) AS n FROM pairs GROUP BY 1)
 SELECT label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(2 * sqrt(5.991 * ((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b))), 6) AS width,
  round(2 * sqrt(5.991 * ((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b))), 6) AS height, round(degrees(atan2(2 * b, a - c) / 2), 6) AS angle FROM m WHERE n >= 3""")
def _(spark, sf):
    """One ellipse per class and pair of neighbouring dimensions, so that all dimensions are read."""
    d = dimensions(spark, sf).groupBy("sample", "label", F.floor((F.col("component") - 1) / 2).alias("pair")).agg(
        F.max(F.when(F.col("component") % 2 == 1, F.col("score"))).alias("x"), F.max(F.when(F.col("component") % 2 == 0, F.col("score"))).alias("y"))
    points = d.select(F.concat_ws(":", "label", F.col("pair").cast("string")).alias("label"), "x", "y")
    return op.confidence_ellipse(points).select("label", *r6("cx", "cy", "width", "height", "angle"))


@query("A29_hierarchical_clusters")
def _(spark, sf):
    return op.hierarchical_clusters(feature_long(spark, sf), 5).labels


@query("A29_ward_merges")
def _(spark, sf):
    return op.hierarchical_clusters(feature_long(spark, sf), 5).merges


@query("T8_cluster_order")
def _(spark, sf):
    return op.cluster_order(feature_long(spark, sf))


@query("A30_pls_da")
def _(spark, sf):
    return op.pls_da(feature_long(spark, sf), labels(spark, sf, 5)).summary


@query("A30_pls_vip")
def _(spark, sf):
    return op.pls_da(feature_long(spark, sf), labels(spark, sf, 5)).vip


@query("A30_pls_scores")
def _(spark, sf):
    return op.pls_da(feature_long(spark, sf), labels(spark, sf, 5)).scores


@query("A30_pls_explained")
def _(spark, sf):
    return op.pls_da(feature_long(spark, sf), labels(spark, sf, 5)).explained


@query("A31_lda_cv")
def _(spark, sf):
    return op.lda_cv(feature_long(spark, sf), labels(spark, sf, 5)).summary


@query("A32_permutation_test")
def _(spark, sf):
    return op.pls_da(feature_long(spark, sf), labels(spark, sf, 5), n_permutations=50).permuted


@query("T4_top_features_by_vip")
def _(spark, sf):
    long = feature_long(spark, sf)
    return ft.top_features(long, op.pls_da(long, labels(spark, sf, 5)).vip, 20)


@query("A33_confusion", f"""WITH {LONG}, p AS (SELECT 'T' || (l_partkey % 3) AS truth, 'T' || (CASE WHEN l_orderkey % 5 = 0 THEN l_suppkey % 3 ELSE l_partkey % 3 END) AS pred FROM lineitem)
 SELECT truth, pred, count(*) AS n FROM p GROUP BY 1, 2""")
def _(spark, sf):
    return op.classification_report(predictions(spark, sf))[0]


def predictions(spark, sf):
    part, supp = F.col("l_partkey") % 3, F.col("l_suppkey") % 3
    return b.table(spark, sf, "lineitem").select(F.concat(F.lit("T"), part).alias("truth"), F.concat(F.lit("T"), F.when(F.col("l_orderkey") % 5 == 0, supp).otherwise(part)).alias("pred"))


@query("A33_accuracy", """WITH p AS (SELECT l_partkey % 3 AS truth, CASE WHEN l_orderkey % 5 = 0 THEN l_suppkey % 3 ELSE l_partkey % 3 END AS pred FROM lineitem)
 SELECT round(sum(h) / sum(n), 9) AS accuracy, round(avg(h / n), 9) AS balanced_accuracy FROM (SELECT truth, sum(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS h, count(*) AS n FROM p GROUP BY 1)""")
def _(spark, sf):
    r = op.classification_report(predictions(spark, sf))[1]
    return r.select(F.round("accuracy", 9).alias("accuracy"), F.round("balanced_accuracy", 9).alias("balanced_accuracy"))
