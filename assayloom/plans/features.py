"""Queries over the samples-by-features table."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions import text as tx
from assayloom.operators import features as op, profile as pr
from assayloom.ordered import average_rank
from assayloom.plans import bindings as b
from assayloom.plans.registry import query
from assayloom.plans.screening import r6
from assayloom.session import cut

LONG = """feat AS (SELECT vec_id AS sample, i - 1 AS feature, abs(CAST(e AS DOUBLE)) AS value, label FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)),
 long AS (SELECT sample, feature, value FROM feat),
 dense AS (SELECT s.sample, f.feature, coalesce(l.value, 0) AS value FROM (SELECT DISTINCT sample FROM long) s CROSS JOIN (SELECT DISTINCT feature FROM long) f LEFT JOIN long l USING (sample, feature)),
 lab2 AS (SELECT vec_id AS sample, CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS label FROM embeddings),
 lab5 AS (SELECT vec_id AS sample, 'C' || (label % 5) AS label FROM embeddings)"""


def feature_long(spark, sf):
    """All embedding entries as peak-like features, by their absolute value."""
    rows = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("feature", "value"))
    return rows.select("sample", F.col("feature").cast("long").alias("feature"), F.abs(F.col("value").cast("double")).alias("value"))


def labels(spark, sf, k: int = 2):
    label = F.col("label") % k
    name = F.when(label == 0, "A").otherwise("B") if k == 2 else F.concat(F.lit("C"), label)
    return b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), name.alias("label"), F.col("vec_id").alias("ord"))


@query("P11_drop_constant_features", f"WITH {LONG} SELECT sample, feature, round(value, 6) AS value FROM long WHERE feature IN (SELECT feature FROM dense GROUP BY 1 HAVING stddev_pop(value) > 0)")
def _(spark, sf):
    return op.drop_constant_features(feature_long(spark, sf)).select("sample", "feature", *r6("value"))


for _method, _div in (("auto", "stddev_pop(value) OVER w"), ("pareto", "sqrt(stddev_pop(value) OVER w)"), ("center", "1")):
    @query(f"P18_scale_{_method}", f"WITH {LONG} SELECT sample, feature, round((value - avg(value) OVER w) / {_div}, 6) AS value FROM dense WINDOW w AS (PARTITION BY feature)")
    def _(spark, sf, method=_method):
        return op.scale_features(feature_long(spark, sf), method).select("sample", "feature", *r6("value"))


# every third entry left out, so that cells are absent
HOLES = "holes AS (SELECT sample, feature, value FROM long WHERE (sample + feature) % 3 <> 0), size AS (SELECT count(DISTINCT sample) AS n FROM holes)"


@query("P18_scaled_cells", f"""WITH {LONG}, {HOLES}, m AS (SELECT feature, sum(value) / max(n) AS mean, sqrt(greatest(sum(value * value) / max(n) - (sum(value) / max(n)) ** 2, 0)) AS std FROM holes, size GROUP BY 1)
 SELECT sample, feature, round((value - mean) / std, 6) AS value FROM holes JOIN m USING (feature) UNION ALL SELECT NULL, feature, round(-mean / std, 6) FROM m""")
def _(spark, sf):
    """Cells present, and for each feature, under no sample, what its absent cells are worth."""
    cells, absent = op.scaled_cells(feature_long(spark, sf).where("(sample + feature) % 3 <> 0"), "auto")
    rows = cells.unionByName(absent.withColumn("sample", F.lit(None).cast("long")))
    return rows.select("sample", "feature", *r6("value"))


TOTAL = "tot AS (SELECT sample, feature, 100.0 * value / sum(value) OVER (PARTITION BY sample) AS value FROM dense)"


@query("P19_normalize_total", f"WITH {LONG}, {TOTAL} SELECT sample, feature, round(value, 6) AS value FROM tot")
def _(spark, sf):
    return op.normalize_samples(feature_long(spark, sf), "total").select("sample", "feature", *r6("value"))


@query("P19_normalize_max", f"WITH {LONG} SELECT sample, feature, round(100.0 * value / max(value) OVER (PARTITION BY sample), 6) AS value FROM long")
def _(spark, sf):
    return op.normalize_samples(feature_long(spark, sf), "max").select("sample", "feature", *r6("value"))


@query("P19_normalize_pqn", f"""WITH {LONG}, {TOTAL}, ref AS (SELECT feature, median(value) AS ref FROM tot GROUP BY 1),
 fac AS (SELECT sample, median(value / ref) AS f FROM tot JOIN ref USING (feature) WHERE value > 0 AND ref > 0 GROUP BY 1)
 SELECT sample, feature, round(value / coalesce(f, 1), 6) AS value FROM tot LEFT JOIN fac USING (sample)""")
def _(spark, sf):
    return op.normalize_samples(feature_long(spark, sf), "pqn").select("sample", "feature", *r6("value"))


@query("P20_transform_log", f"WITH {LONG} SELECT sample, feature, round(log10(value + (SELECT min(value) / 2 FROM long WHERE value > 0)), 6) AS value FROM dense")
def _(spark, sf):
    return op.transform_values(op.densify(feature_long(spark, sf)), "log").select("sample", "feature", *r6("value"))


@query("P20_transform_sqrt", f"WITH {LONG} SELECT sample, feature, round(sqrt(value), 6) AS value FROM dense")
def _(spark, sf):
    return op.transform_values(op.densify(feature_long(spark, sf)), "sqrt").select("sample", "feature", *r6("value"))


DOTS = """d AS (SELECT a.sample AS a, b.sample AS b, sum(a.value * b.value) AS dot FROM dense a JOIN dense b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2),
 o AS (SELECT sample, sum(value * value) AS ss, sum(value) AS s, count(*) AS p FROM dense GROUP BY 1)"""


@query("A22_similarity_cosine", f"WITH {LONG}, {DOTS} SELECT a, b, round(dot / (sqrt(x.ss) * sqrt(y.ss)), 6) AS similarity FROM d JOIN o x ON a = x.sample JOIN o y ON b = y.sample")
def _(spark, sf):
    return op.similarity_matrix(feature_long(spark, sf), "cosine").select("a", "b", *r6("similarity"))


@query("A22_similarity_pearson", f"""WITH {LONG}, {DOTS} SELECT a, b, round((dot - x.s * y.s / x.p) / sqrt((x.ss - x.s * x.s / x.p) * (y.ss - y.s * y.s / y.p)), 6) AS similarity FROM d JOIN o x ON a = x.sample JOIN o y ON b = y.sample""")
def _(spark, sf):
    return op.similarity_matrix(feature_long(spark, sf), "pearson").select("a", "b", *r6("similarity"))


@query("A23_replicate_rsd", f"WITH {LONG} SELECT feature, label AS \"group\", round(CASE WHEN avg(value) > 0 THEN 100.0 * stddev_samp(value) / avg(value) END, 6) AS rsd FROM dense JOIN lab5 USING (sample) GROUP BY 1, 2")
def _(spark, sf):
    groups = labels(spark, sf, 5).withColumnRenamed("label", "group")
    return op.replicate_rsd(feature_long(spark, sf), groups).select("feature", "group", *r6("rsd"))


CLASS2 = """cm AS (SELECT feature, avg(value) FILTER (label = 'A') AS m1, avg(value) FILTER (label = 'B') AS m2, var_samp(value) FILTER (label = 'A') AS v1, var_samp(value) FILTER (label = 'B') AS v2,
  count(*) FILTER (label = 'A') AS n1, count(*) FILTER (label = 'B') AS n2, avg(value) AS g, var_pop(value) * count(*) AS sst FROM dense JOIN lab2 USING (sample) GROUP BY 1)"""


@query("A24_univariate_two_classes", f"""WITH {LONG}, {CLASS2}, pseudo AS (SELECT min(value) / 2 AS p FROM long WHERE value > 0)
 SELECT feature, round(m1, 6) AS "mean_A", round(m2, 6) AS "mean_B", round((n1 * (m1 - g) ** 2 + n2 * (m2 - g) ** 2) / sst, 6) AS eta_squared, round(log2((m2 + p) / (m1 + p)), 6) AS log2_fold_change,
  round((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohen_d, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
  round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) AS df FROM cm, pseudo""")
def _(spark, sf):
    df = op.univariate_parametric(feature_long(spark, sf), labels(spark, sf))
    return df.select("feature", *r6("mean_A", "mean_B", "eta_squared", "log2_fold_change", "cohen_d", "t", "df"))


@query("A24_univariate_anova", f"""WITH {LONG}, c AS (SELECT feature, label, avg(value) AS m, var_pop(value) * count(*) AS ss, count(*) AS n FROM dense JOIN lab5 USING (sample) GROUP BY 1, 2),
 g AS (SELECT feature, sum(m * n) / sum(n) AS g FROM c GROUP BY 1), x AS (SELECT feature, sum(n * (m - g) ** 2) AS ssb, sum(ss) AS ssw, sum(n) AS n, count(*) AS k FROM c JOIN g USING (feature) GROUP BY 1)
 SELECT feature, round(ssb / (ssb + ssw), 6) AS eta_squared, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f FROM x""")
def _(spark, sf):
    return op.univariate_parametric(feature_long(spark, sf), labels(spark, sf, 5)).select("feature", *r6("eta_squared", "f"))


RANKS = "rk AS (SELECT feature, sample, value, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, value) AS t FROM dense JOIN {0} USING (sample))"


@query("A25_mann_whitney", f"""WITH {LONG}, {RANKS.format('lab2')}, x AS (SELECT feature, sum(r) FILTER (label = 'A') AS r1, count(*) FILTER (label = 'A') AS n1, count(*) FILTER (label = 'B') AS n2, count(*) AS n, sum(t * t - 1) AS tie FROM rk GROUP BY 1),
 y AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM x)
 SELECT feature, u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))), 6) AS z FROM y""")
def _(spark, sf):
    return op.univariate_rank(feature_long(spark, sf), labels(spark, sf)).select("feature", "u", *r6("z"))


@query("A25_kruskal_wallis", f"""WITH {LONG}, {RANKS.format('lab5')}, x AS (SELECT feature, label, sum(r) AS r, count(*) AS c, sum(t * t - 1) AS tie FROM rk GROUP BY 1, 2)
 SELECT feature, round((12 / (sum(c) * (sum(c) + 1)) * sum(r * r / c) - 3 * (sum(c) + 1)) / (1 - sum(tie) / (CAST(sum(c) AS DOUBLE) ** 3 - sum(c))), 6) AS h FROM x GROUP BY 1""")
def _(spark, sf):
    return op.univariate_rank(feature_long(spark, sf), labels(spark, sf, 5)).select("feature", *r6("h"))


@query("X2_univariate_p_values")
def univariate_table(spark, sf):
    """p and q of both tests per feature; checked against published table values in the tests."""
    a = op.univariate_parametric(feature_long(spark, sf), labels(spark, sf))
    r = op.univariate_rank(feature_long(spark, sf), labels(spark, sf))
    df = op.benjamini_hochberg(cut(a.join(r, "feature")), "p_welch", out="q_welch")
    return op.benjamini_hochberg(df, "p_mannwhitney", out="q_mannwhitney")


PVALUES = """pv AS (SELECT l_returnflag AS test, l_orderkey * 10 + l_linenumber AS feature, CASE WHEN l_linenumber = 7 THEN NULL ELSE ((l_orderkey * 7919 + l_partkey * 31) % 100003) / 100003 END AS p FROM lineitem)"""


def p_values(spark, sf):
    return b.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("test"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("feature"),
        F.when(F.col("l_linenumber") != 7, ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31) % 100003) / 100003).alias("p"))


@query("W1_benjamini_hochberg", f"""WITH {PVALUES}, r AS (SELECT *, p * count(p) OVER (PARTITION BY test) / count(p) OVER (PARTITION BY test ORDER BY p) AS raw FROM pv WHERE p IS NOT NULL)
 SELECT test, feature, p, round(least(min(raw) OVER (PARTITION BY test ORDER BY p DESC), 1), 9) AS q FROM r UNION ALL SELECT test, feature, NULL, NULL FROM pv WHERE p IS NULL""")
def _(spark, sf):
    return op.benjamini_hochberg(p_values(spark, sf), "p", ["test"]).select("test", "feature", "p", F.round("q", 9).alias("q"))


@query("W2_average_rank", f"WITH {LONG} SELECT feature, round(value, 3) AS value, count(*) AS ties, min(r) AS avg_rank FROM (SELECT feature, value, rank() OVER (PARTITION BY feature ORDER BY round(value, 3)) + (count(*) OVER (PARTITION BY feature, round(value, 3)) - 1) / 2 AS r FROM long) GROUP BY 1, 2")
def _(spark, sf):
    rows = feature_long(spark, sf).withColumn("value", F.round("value", 3))
    return average_rank(rows, ["feature"], "value")


VOLCANO = """vol AS (SELECT p_partkey AS feature, (p_partkey * 17 % 601) / 100 - 3 AS log2_fold_change, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey * 29 % 997) / 997 / 10 END AS q_welch FROM part),
 vf AS (SELECT feature, log2_fold_change AS x, round(-log10(least(greatest(q_welch, 1e-300), 1)), 6) AS y, q_welch < 0.05 AND abs(log2_fold_change) >= 1 AS significant FROM vol WHERE q_welch IS NOT NULL)"""


def volcano(spark, sf):
    k = F.col("p_partkey")
    rows = b.table(spark, sf, "part").select(k.alias("feature"), ((k * 17 % 601) / 100 - 3).alias("log2_fold_change"),
                                             F.when(k % 13 != 0, (k * 29 % 997) / 997 / 10).alias("q_welch"))
    return pr.volcano_flags(rows)


@query("P14_volcano_flags", f"WITH {VOLCANO} SELECT * FROM vf")
def _(spark, sf):
    return volcano(spark, sf).withColumn("y", F.round("y", 6))


@query("T6_top_labels", f"WITH {VOLCANO} SELECT feature, y FROM vf ORDER BY y DESC, feature LIMIT 10")
def _(spark, sf):
    return pr.top_labels(volcano(spark, sf).withColumn("y", F.round("y", 6)), "y", 10).select("feature", "y")


@query("T6_top_per_group", "SELECT * FROM (SELECT l_returnflag || l_linestatus AS sample, l_orderkey * 10 + l_linenumber AS ord, l_extendedprice AS height, CAST(row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS INT) AS rank FROM lineitem) WHERE rank <= 15")
def _(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("sample"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_extendedprice").alias("height"))
    return pr.top_per_group(rows, "sample", "height", 15, "ord")


@query("A35_favored_class", f"WITH {LONG} SELECT DISTINCT ON (feature) feature, label AS favored FROM (SELECT feature, label, avg(value) AS m FROM dense JOIN lab5 USING (sample) GROUP BY 1, 2) ORDER BY feature, m DESC, label")
def _(spark, sf):
    return op.favored_class(feature_long(spark, sf), labels(spark, sf, 5))


@query("T4_top_features", f"WITH {LONG} SELECT sample, feature, round(value, 6) AS value FROM long WHERE feature IN (SELECT feature FROM dense GROUP BY 1 ORDER BY var_pop(value) DESC, feature LIMIT 30)")
def _(spark, sf):
    return op.top_features(feature_long(spark, sf)).select("sample", "feature", *r6("value"))


SAMPLES = """smp AS (SELECT 'run ' || CASE c_custkey % 4 WHEN 0 THEN 'Asli ' WHEN 1 THEN 'kw-' ELSE 'AQ' END || c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' rep ' || (c_custkey % 9) WHEN 1 THEN '_' || (c_custkey % 50) ELSE '' END || '.csv' AS original, c_custkey AS ord, 'dir' || (c_custkey % 3) AS folder FROM customer)"""


def samples(spark, sf):
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, F.concat(F.lit(" rep "), k % 9)).when(k % 3 == 1, F.concat(F.lit("_"), k % 50)).otherwise("")
    head = F.when(k % 4 == 0, "Asli ").when(k % 4 == 1, "kw-").otherwise("AQ")
    return b.table(spark, sf, "customer").select(F.concat(F.lit("run "), head, "c_mktsegment", tail, F.lit(".csv")).alias("original"), k.alias("ord"),
                                                 F.concat(F.lit("dir"), k % 3).alias("folder"))


TAIL = r"'^(.+?)(?:[\s_\-]+(?:rep|ulangan|no\.?|#)?[\s_\-]*|[\s_\-]*(?:rep|ulangan)[\s_\-]*)?\(?\d{1,3}\)?$'"
SERIES = lambda c: f"CASE WHEN regexp_matches(trim(regexp_extract(trim({c}), {TAIL}, 1, 'i'), ' _-'), '[A-Za-z]') THEN trim(regexp_extract(trim({c}), {TAIL}, 1, 'i'), ' _-') ELSE trim({c}) END"
CLASS = lambda c: (f"CASE WHEN list_has_any(regexp_split_to_array(lower({c}), '[\\s_\\-\\.\\(\\)]+'), [{', '.join(repr(w) for w in tx.ORIGINAL_WORDS)}]) THEN 'Asli' "
                   f"WHEN list_has_any(regexp_split_to_array(lower({c}), '[\\s_\\-\\.\\(\\)]+'), [{', '.join(repr(w) for w in tx.IMITATION_WORDS)}]) THEN 'Tiruan' END")


@query("F5_infer_series_class", f"WITH {SAMPLES}, s AS (SELECT replace(original, '.csv', '') AS name FROM smp) SELECT name, {SERIES('name')} AS series, {CLASS('name')} AS class, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf):
    rows = samples(spark, sf).select(F.replace("original", F.lit(".csv"), F.lit("")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("name", tx.infer_series("name").alias("series"), tx.infer_class("name").alias("class"), "n")


@query("J1_assign_metadata", f"""WITH {SAMPLES}, n AS (SELECT original || ' #' || ord AS name, original, ord, folder FROM smp), k AS (SELECT *, regexp_replace(lower(replace(original, '.csv', '')), '[^a-z0-9]', '', 'g') AS key FROM n),
 grp AS (SELECT DISTINCT ON (key) key, series, class FROM (SELECT regexp_replace(lower(replace(original, '.csv', '')), '[^a-z0-9]', '', 'g') AS key, CASE WHEN ord % 7 = 0 THEN '' ELSE 'S' || (ord % 5) END AS series, CASE WHEN ord % 3 = 0 THEN 'T' || (ord % 2) ELSE '' END AS class, ord FROM smp WHERE folder <> 'dir1') ORDER BY key, ord DESC)
 SELECT name, coalesce(nullif(grp.series, ''), {SERIES('original')}) AS series, coalesce(nullif(grp.class, ''), CASE WHEN ord % 2 = 0 THEN folder END, {CLASS('original')}, 'Sampel') AS class FROM k LEFT JOIN grp USING (key)""")
def _(spark, sf):
    s = samples(spark, sf)
    named = s.select(F.concat_ws(" #", "original", "ord").alias("name"), "original", "ord", "folder")
    groups = s.where("folder <> 'dir1'").select(F.col("original").alias("sample"), F.when(F.col("ord") % 7 == 0, "").otherwise(F.concat(F.lit("S"), F.col("ord") % 5)).alias("series"),
                                                F.when(F.col("ord") % 3 == 0, F.concat(F.lit("T"), F.col("ord") % 2)).otherwise("").alias("class"), "ord")
    folders = named.where("ord % 2 = 0").select("name", "folder")
    return op.assign_metadata(named, groups, folders)


@query("P25_supervised_blocker", "SELECT label, count(*) AS n, CAST(NULL AS VARCHAR) AS blocker FROM (SELECT CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS label FROM embeddings) GROUP BY 1")
def _(spark, sf):
    lab = labels(spark, sf)
    return lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("blocker", F.lit(op.supervised_blocker(lab)).cast("string"))
