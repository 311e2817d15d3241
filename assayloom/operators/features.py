"""Statistics of a samples-by-features table in long form (sample, feature, value).

A cell that is absent counts as zero. Moments, medians and ranks take the zeros in by count, so the matrix is only filled in where
the result itself is dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assayloom.functions.text import DEFAULT_CLASS, infer_class, infer_series, sample_key
from assayloom.functions.udfs import p_chi2, p_f, p_norm_two_sided, p_rank_sum_exact, p_t
from assayloom.ordered import matrix_cells, quantiles, running, with_blocks
from assayloom.session import cut

_LONG = ["sample", "feature", "value"]


def densify(long: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Every cell of the matrix, absent ones as zero."""
    samples = long.select("sample").distinct() if samples is None else samples.select("sample").distinct()
    grid = matrix_cells(samples, long.select("feature").distinct(), "sample")
    return grid.join(long.select(*_LONG), ["sample", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def _n_samples(long: DataFrame) -> Column:
    return long.agg(F.count_distinct("sample").cast("double").alias("n")).scalar()


def feature_moments(long: DataFrame) -> DataFrame:
    """Mean and population deviation per feature with the absent zeros counted in."""
    part = long.groupBy("feature").agg(F.count(F.lit(1)).alias("m"), F.avg("value").alias("a"), F.var_pop("value").alias("v"),
                                       F.min("value").alias("lo"), F.max("value").alias("hi"))
    part = part.withColumn("n", _n_samples(long))
    m, a, v, n = (F.col(c) for c in ("m", "a", "v", "n"))
    part = part.withColumn("mean", a * m / n)
    var = (v * m + m * (a - F.col("mean")) ** 2 + (n - m) * F.col("mean") ** 2) / n
    constant = (F.col("lo") == F.col("hi")) & ((m == n) | (F.col("lo") == 0))
    return part.select("feature", "mean", F.when(constant, 0.0).otherwise(F.sqrt(var)).alias("std"))


# ---- sample metadata ---------------------------------------------------------------------------------------

def assign_metadata(samples: DataFrame, groups: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """Series and class per sample: group table, folder label, key words in the name, default.

    ``samples`` has name and original; ``groups`` has sample, series, class; ``folders`` has name and folder.
    """
    rows = samples.select("name", F.coalesce("original", "name").alias("original"))
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    for tag, base in (("a", "name"), ("b", "original")):
        if groups is None:
            rows = rows.withColumns({f"_s{tag}": F.lit(None).cast("string"), f"_c{tag}": F.lit(None).cast("string"), f"_h{tag}": F.lit(None)})
            continue
        table = groups.groupBy(sample_key("sample").alias("_k")).agg(
            F.max(F.struct("ord", blank("series").alias("s"), blank("class").alias("c"))).alias("_g"))
        table = table.select("_k", F.col("_g.s").alias(f"_s{tag}"), F.col("_g.c").alias(f"_c{tag}"), F.lit(True).alias(f"_h{tag}"))
        rows = rows.withColumn("_k", sample_key(base)).join(table, "_k", "left").drop("_k")
    pick = lambda x: F.when(F.col("_ha"), F.col(f"_{x}a")).otherwise(F.col(f"_{x}b"))
    if folders is None:
        rows = rows.withColumn("_folder", F.lit(None).cast("string"))
    else:
        several = folders.agg((F.count_distinct("folder") >= 2).alias("ok")).scalar()
        rows = rows.join(folders.groupBy("name").agg(F.min("folder").alias("_f")), "name", "left").withColumn("_folder", F.when(several, blank("_f")))
    return rows.select("name", F.coalesce(pick("s"), infer_series("original")).alias("series"),
                       F.coalesce(pick("c"), F.col("_folder"), infer_class("original"), F.lit(DEFAULT_CLASS)).alias("class"))


def supervised_blocker(labels: DataFrame) -> str | None:
    """Reason why a supervised model cannot run; reads one count per class."""
    row = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"), F.sum("n").alias("n")).first()
    # reasons
    if row["classes"] < 2:
        return "hanya satu kelas"
    if row["smallest"] < 2:
        return "kelas dengan satu sampel"
    if row["n"] < 6:
        return f"sampel terlalu sedikit ({row['n']}), minimal 6"
    return None


# ---- scaling -----------------------------------------------------------------------------------------------

def drop_constant_features(long: DataFrame) -> DataFrame:
    return long.join(feature_moments(long).where("std > 0").select("feature"), "feature", "left_semi").select(*long.columns)


def scaled_cells(long: DataFrame, method: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Centred cells divided by the deviation (auto), its root (pareto) or nothing (center), in two tables.

    The first has the cells present (sample, feature, value), a null value being zero; the second has, per feature, the one value that all its absent cells
    take. So the rows grow with the cells, not with samples times features.
    """
    if method not in ("auto", "pareto", "center"):
        raise ValueError(f"unknown scaling {method!r}")
    long = long.select("sample", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))
    std = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    divisor = {"auto": std, "pareto": F.sqrt(std), "center": F.lit(1.0)}[method]
    moments = feature_moments(long).select("feature", "mean", divisor.alias("_div"))
    scaled = lambda v: ((v - F.col("mean")) / F.col("_div")).alias("value")
    return long.join(moments, "feature").select("sample", "feature", scaled(F.col("value"))), moments.select("feature", scaled(F.lit(0.0)))


def scale_features(long: DataFrame, method: str = "auto") -> DataFrame:
    """``scaled_cells`` as one table with every cell of the matrix; only cells that are absent are added."""
    cells, absent = scaled_cells(long, method)
    grid = matrix_cells(long.select("sample").distinct(), absent.withColumnRenamed("value", "_absent"), "sample")
    return grid.join(cells, ["sample", "feature"], "left").select("sample", "feature", F.coalesce("value", "_absent").alias("value"))


def normalize_samples(long: DataFrame, method: str = "total", blocks: int | None = None) -> DataFrame:
    """Per-sample scale: sum 100, largest 100, probabilistic quotient, or none. Absent cells stay absent."""
    if method == "none":
        return long
    if method not in ("total", "max", "pqn"):
        raise ValueError(f"unknown normalisation {method!r}")
    size = F.max("value") if method == "max" else F.sum("value")
    if method == "max":     # an absent zero is larger than any negative cell
        size = F.greatest(F.max("value"), F.lit(0.0))
    scale = long.groupBy("sample").agg(size.alias("_s"))
    out = long.join(scale, "sample").withColumn("value", 100.0 * F.col("value") / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_s")
    if method != "pqn":
        return out
    counts = out.groupBy("feature").agg(F.count(F.lit(1)).alias("m")).withColumn("n", _n_samples(long))
    zeros = counts.select("feature", F.lit(0.0).alias("value"), (F.col("n") - F.col("m")).cast("long").alias("w")).where("w > 0")
    weighted = out.select("feature", "value", F.lit(1).cast("long").alias("w")).unionByName(zeros)
    ref = quantiles(weighted, ["feature"], "value", {"ref": 0.5}, blocks, weight="w").where("ref > 0")
    quotient = quantiles(out.where("value > 0").join(ref, "feature").withColumn("q", F.col("value") / F.col("ref")), ["sample"], "q", {"factor": 0.5}, blocks)
    return (out.join(quotient, "sample", "left").withColumn("value", F.col("value") / F.coalesce("factor", F.lit(1.0))).select(*long.columns))


def transform_values(cells: DataFrame, method: str = "none") -> DataFrame:
    """sqrt, or log10 with half the smallest positive value of the whole matrix added; works on the cells given."""
    v = F.greatest(F.col("value"), F.lit(0.0))
    if method == "none":
        return cells
    if method == "sqrt":
        return cells.withColumn("value", F.sqrt(v))
    if method != "log":
        raise ValueError(f"unknown transform {method!r}")
    offset = cells.where("value > 0").agg(F.coalesce(0.5 * F.min("value"), F.lit(1.0)).alias("o")).scalar()
    return cells.withColumn("_o", offset).withColumn("value", F.log10(v + F.col("_o"))).drop("_o")


# ---- similarity of samples ---------------------------------------------------------------------------------

BLOCK_SAMPLES, SLAB_FEATURES, BLOCK_CELLS, PAIR_ROWS = 1024, 2048, 1 << 18, 1 << 16


def _sample_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of samples as a row: its samples and features, and of every cell their places and its value."""
    at, names = pd.factorize(pdf["sample"])
    code, features = pd.factorize(pdf["feature"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "names": [np.asarray(names)], "features": [np.asarray(features)], "at": [at], "code": [code], "value": [pdf["value"].to_numpy()]})


def _block_similarity(left: tuple, right: tuple, method: str, p: int) -> np.ndarray:
    """Similarities of the samples (names, features, at, code, value) of two blocks, slab by slab of the features both have."""
    common, in_left, in_right = np.intersect1d(left[1], right[1], return_indices=True)
    dots = np.zeros((len(left[0]), len(right[0])))

    def matrix(block: tuple, columns: np.ndarray) -> np.ndarray:
        place = np.full(len(block[1]), -1)
        place[columns] = np.arange(len(columns))
        k = place[block[3]]
        m = np.zeros((len(block[0]), len(columns)))
        m[block[2][k >= 0], k[k >= 0]] = block[4][k >= 0]
        return m
    for start in range(0, len(common), SLAB_FEATURES):
        slab = slice(start, start + SLAB_FEATURES)
        dots += matrix(left, in_left[slab]) @ matrix(right, in_right[slab]).T

    def sums(block: tuple) -> tuple[np.ndarray, np.ndarray]:
        v, n = np.nan_to_num(block[4], posinf=np.inf, neginf=-np.inf), len(block[0])
        return np.bincount(block[2], v * v, n), np.bincount(block[2], v, n)
    (ss_a, s_a), (ss_b, s_b) = sums(left), sums(right)
    if method == "cosine":
        norm = lambda ss: np.maximum(np.sqrt(ss), 1e-12)
        return dots / (norm(ss_a)[:, None] * norm(ss_b)[None, :])
    c_a, c_b = (ss_a - s_a ** 2 / p)[:, None], (ss_b - s_b ** 2 / p)[None, :]
    with np.errstate(all="ignore"):
        return np.where((c_a > 0) & (c_b > 0), (dots - s_a[:, None] * s_b[None, :] / p) / np.sqrt(c_a * c_b), 0.0)


def similarity_matrix(long: DataFrame, method: str = "cosine") -> DataFrame:
    """Cosine or Pearson similarity of every pair of samples (a < b); undefined values become 0.

    The result is the full pair matrix. Samples are gathered into blocks of bounded size, written once; every two blocks meet in a task that
    multiplies them and returns their pairs. Pairs are never shuffled, so the disk used follows the input and not its square.
    """
    if method not in ("cosine", "pearson"):
        raise ValueError(f"unknown similarity {method!r}")
    kind = dict(long.dtypes)["sample"]
    shape = long.agg(F.count_distinct("sample").alias("n"), F.count_distinct("feature").alias("p")).first()
    n, p = max(shape["n"], 1), max(shape["p"], 1)
    # at least 16 blocks, for the tasks; two blocks of the largest size are a few megabytes
    size = max(1, min(BLOCK_SAMPLES, BLOCK_CELLS // p, -(-n // 16)))
    blocks = -(-n // size)
    rows = long.select("sample", "feature", F.col("value").cast("double").alias("value"), F.pmod(F.xxhash64("sample"), F.lit(blocks)).alias("block"))
    packed = rows.groupBy("block").applyInPandas(_sample_block, f"block long, names array<{kind}>, features array<{dict(long.dtypes)['feature']}>, at array<long>, code array<long>, value array<double>")
    packed = cut(packed.repartition(max(min(blocks, 16), -(-blocks // 4)), "block"))
    side = lambda k: packed.select(*[F.col(c).alias(f"{c}_{k}") for c in packed.columns])
    pairs = side("a").crossJoin(side("b")).where("block_a <= block_b")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                left, right = ([np.asarray(getattr(r, f"{c}_{k}")) for c in ("names", "features", "at", "code", "value")] for k in "ab")
                found = _block_similarity(left, right, method, p)
                later = np.triu(np.ones(found.shape, dtype=bool), 1) if r.block_a == r.block_b else np.ones(found.shape, dtype=bool)
                some = max(1, PAIR_ROWS // len(right[0]))
                for k in range(0, len(left[0]), some):
                    i, j = np.nonzero(later[k:k + some])
                    a, b = left[0][i + k], right[0][j]
                    swap = a > b
                    yield pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "similarity": found[i + k, j]})
    return pairs.mapInPandas(multiply, f"a {kind}, b {kind}, similarity double")


# ---- tests per feature --------------------------------------------------------------------------------------

def replicate_rsd(long: DataFrame, groups: DataFrame) -> DataFrame:
    """Relative deviation in percent per feature and replicate group with two members or more."""
    size = groups.groupBy("group").agg(F.count_distinct("sample").alias("n")).where("n >= 2")
    part = (long.join(groups.select("sample", "group"), "sample").groupBy("feature", "group")
            .agg(F.count(F.lit(1)).alias("m"), F.avg("value").alias("a"), F.var_pop("value").alias("v")).join(size, "group"))
    m, a, v, n = (F.col(c) for c in ("m", "a", "v", "n"))
    part = part.withColumn("mean", a * m / n)
    ss = v * m + m * (a - F.col("mean")) ** 2 + (n - m) * F.col("mean") ** 2
    return part.select("feature", "group", F.when(F.col("mean") > 0, 100.0 * F.sqrt(ss / (n - 1)) / F.col("mean")).alias("rsd"))


def class_list(labels: DataFrame) -> list[tuple[str, int]]:
    """Classes with their sizes, in name order; one row per class reaches the driver."""
    return [(r["label"], r["n"]) for r in labels.groupBy("label").agg(F.count_distinct("sample").alias("n")).orderBy("label").collect()]


def _class_moments(long: DataFrame, labels: DataFrame, classes: list[tuple[str, int]]) -> DataFrame:
    """Per feature: mean_k and ss_k (squares around the class mean) of every class, absent zeros counted in."""
    part = long.join(labels.select("sample", "label"), "sample").groupBy("feature", "label").agg(
        F.count(F.lit(1)).alias("m"), F.avg("value").alias("a"), F.var_pop("value").alias("v"))
    cols = []
    for k, (name, n) in enumerate(classes):
        m, a, v = F.col("m"), F.col("a"), F.col("v")
        mean = a * m / n
        ss = v * m + m * (a - mean) ** 2 + (n - m) * mean ** 2
        here = F.col("label") == name
        cols += [F.coalesce(F.max(F.when(here, mean)), F.lit(0.0)).alias(f"mean_{k}"), F.coalesce(F.max(F.when(here, ss)), F.lit(0.0)).alias(f"ss_{k}")]
    return part.groupBy("feature").agg(*cols)


def univariate_parametric(long: DataFrame, labels: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Per feature: class means (of the raw values), eta squared, and Welch t with effect sizes for two classes or the
    one-way F for more."""
    classes = class_list(labels)
    total = sum(n for _, n in classes)
    df = _class_moments(long, labels, classes)
    raw = long if raw is None else raw
    means = _class_moments(raw, labels, classes).select("feature", *[F.col(f"mean_{k}").alias(f"raw_{k}") for k in range(len(classes))])
    df = df.join(means, "feature")
    grand = sum(F.col(f"mean_{k}") * n for k, (_, n) in enumerate(classes)) / total
    between = sum(n * (F.col(f"mean_{k}") - grand) ** 2 for k, (_, n) in enumerate(classes))
    within = sum(F.col(f"ss_{k}") for k in range(len(classes)))
    df = df.withColumns({"_b": between, "_w": within})
    eta = F.when(F.col("_b") + F.col("_w") > 0, F.col("_b") / (F.col("_b") + F.col("_w"))).alias("eta_squared")
    shown = [F.col(f"raw_{k}").alias(f"mean_{name}") for k, (name, _) in enumerate(classes)]
    if len(classes) == 2:
        (_, n1), (_, n2) = classes
        pseudo = raw.where("value > 0").agg(F.coalesce(0.5 * F.min("value"), F.lit(1.0)).alias("p")).scalar()
        df = df.withColumn("_pseudo", pseudo)
        v1, v2 = F.col("ss_0") / max(n1 - 1, 1), F.col("ss_1") / max(n2 - 1, 1)
        diff, se2 = F.col("mean_1") - F.col("mean_0"), v1 / n1 + v2 / n2
        pooled = F.sqrt(F.col("_w") / max(n1 + n2 - 2, 1))
        able = F.lit(n1 > 1 and n2 > 1)
        t = F.when(able & (se2 > 0), -diff / F.sqrt(se2))
        dof = F.when(able & (se2 > 0), se2 ** 2 / ((v1 / n1) ** 2 / max(n1 - 1, 1) + (v2 / n2) ** 2 / max(n2 - 1, 1)))
        out = df.select("feature", *shown, eta, F.log2((F.col("raw_1") + F.col("_pseudo")) / (F.col("raw_0") + F.col("_pseudo"))).alias("log2_fold_change"),
                        F.when(able & (pooled > 0), diff / pooled).alias("cohen_d"), t.alias("t"), dof.alias("df"))
        return out.withColumn("p_welch", F.when(F.col("t").isNotNull(), p_t("t", "df")))
    d1, d2 = len(classes) - 1, total - len(classes)
    f = F.when(F.lit(d2 > 0) & (F.col("_w") > 0), (F.col("_b") / d1) / (F.col("_w") / max(d2, 1)))
    out = df.select("feature", *shown, eta, f.alias("f"))
    return out.withColumn("p_anova", F.when(F.col("f").isNotNull(), p_f("f", F.lit(float(d1)), F.lit(float(d2)))))


def univariate_rank(long: DataFrame, labels: DataFrame, blocks: int | None = None) -> DataFrame:
    """Two classes: rank-sum U and its two-sided p; more: Kruskal-Wallis H. Average ranks, ties corrected.

    Values are counted per feature and class first; ranks then run over distinct values only.
    """
    classes = class_list(labels)
    total = sum(n for _, n in classes)
    here = long.join(labels.select("sample", "label"), "sample").groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("c"))
    present = here.groupBy("feature", "label").agg(F.sum("c").alias("m"))
    grid = long.select("feature").distinct().withColumn("label", F.explode(F.array(*[F.lit(c) for c, _ in classes])))
    size = F.create_map(*[F.lit(x) for c in classes for x in c])
    zeros = (grid.join(present, ["feature", "label"], "left")
             .select("feature", "label", F.lit(0.0).alias("value"), (size[F.col("label")] - F.coalesce("m", F.lit(0))).cast("long").alias("c")).where("c > 0"))
    cells = here.unionByName(zeros)
    per = [F.sum(F.when(F.col("label") == c, F.col("c")).otherwise(0)).alias(f"c{k}") for k, (c, _) in enumerate(classes)]
    values = cells.groupBy("feature", "value").agg(F.sum("c").alias("ties"), *per)
    ranked = running(values, ["feature"], ["value"], {"cum": ("sum", "ties")}, blocks=blocks)
    rank = F.col("cum") - (F.col("ties") - 1) / 2.0
    t = F.col("ties").cast("double")
    sums = ranked.groupBy("feature").agg(F.sum(t * t * t - t).alias("ties"), *[F.sum(rank * F.col(f"c{k}")).alias(f"r{k}") for k in range(len(classes))])
    n = float(total)
    if len(classes) == 2:
        n1, n2 = classes[0][1], classes[1][1]
        u = F.col("r0") - n1 * (n1 + 1) / 2.0
        var = n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
        high = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
        out = sums.withColumn("u", u).withColumn("z", F.when(var > 0, (high - n1 * n2 / 2.0 - 0.5) / F.sqrt(var)))
        approx = F.least(F.when(F.col("z") <= 0, F.lit(2.0) - p_norm_two_sided("z")).otherwise(p_norm_two_sided("z")), F.lit(1.0))
        out = out.withColumn("p_mannwhitney", F.when(F.col("z").isNotNull(), approx))
        if min(n1, n2) <= 8:
            exact = p_rank_sum_exact("u", F.lit(n1), F.lit(n2))
            out = out.withColumn("p_mannwhitney", F.when(F.col("ties") == 0, exact).otherwise(F.col("p_mannwhitney")))
        return out.select("feature", "u", "z", "p_mannwhitney")
    fix = 1.0 - F.col("ties") / (n ** 3 - n)
    h = (12.0 / (n * (n + 1)) * sum(F.col(f"r{k}") ** 2 / c for k, (_, c) in enumerate(classes)) - 3 * (n + 1)) / fix
    out = sums.withColumn("h", F.when(fix > 0, h))
    return out.select("feature", "h").withColumn("p_kruskal", F.when(F.col("h").isNotNull(), p_chi2("h", F.lit(float(len(classes) - 1)))))


def benjamini_hochberg(df: DataFrame, p_col: str, keys: list[str] = (), out: str = "q", blocks: int | None = None) -> DataFrame:
    """False-discovery q values per test family; missing p values are kept and not counted."""
    keys = list(keys)
    valid = df.where(F.col(p_col).isNotNull() & ~F.isnan(p_col))
    counts = valid.groupBy(*keys, p_col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(with_blocks(counts, [p_col], blocks), keys, [p_col], {"_rank": ("sum", "_c")})
    if keys:
        ranked = ranked.join(valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    else:
        ranked = ranked.withColumn("_m", valid.agg(F.count(F.lit(1)).alias("m")).scalar())
    raw = ranked.withColumn("_raw", F.col(p_col) * F.col("_m") / F.col("_rank"))
    q = running(raw, keys, [p_col], {"_q": ("min", "_raw")}, reverse=True)
    q = q.select(*keys, p_col, F.least(F.greatest("_q", F.lit(0.0)), F.lit(1.0)).alias(out))
    return df.join(q, [*keys, p_col], "left")


def favored_class(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Class with the largest mean per feature, the first by name on ties."""
    size = labels.groupBy("label").agg(F.count_distinct("sample").alias("n"))
    means = (long.join(labels.select("sample", "label"), "sample").groupBy("feature", "label").agg(F.sum("value").alias("s"))
             .join(size, "label").withColumn("mean", F.col("s") / F.col("n")))
    return means.groupBy("feature").agg(F.min_by("label", F.struct((-F.col("mean")).alias("m"), F.col("label"))).alias("favored"))


def class_mean_signal(signal: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean intensity per class and grid point."""
    size = labels.groupBy("label").agg(F.count_distinct("sample").alias("n"))
    return (signal.join(labels.select("sample", "label"), "sample").groupBy("label", "i").agg(F.sum("y").alias("s"))
            .join(size, "label").select("label", "i", (F.col("s") / F.col("n")).alias("y")))


def mirror_pairs(signal: DataFrame, labels: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """Cosine and common scale of the mean signals of all class pairs, or the first ``max_pairs``, classes in order of appearance.

    ``labels`` has sample, label and ord. Only the classes reach the driver.
    """
    means = class_mean_signal(signal, labels)
    order = [r["label"] for r in labels.groupBy("label").agg(F.min("ord").alias("o")).orderBy("o").collect()]
    pairs = [(a, b) for k, a in enumerate(order) for b in order[k + 1:]][:max_pairs]
    if not pairs:
        return means.select(F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("cosine"), F.lit(0.0).alias("scale")).limit(0)
    used = sorted({c for p in pairs for c in p}, key=order.index)
    wide = means.groupBy("i").pivot("label", used).agg(F.first("y")).fillna(0.0)
    at = {c: f"_m{k}" for k, c in enumerate(used)}
    wide = wide.select("i", *[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    aggs = [F.sum(F.col(at[a]) * F.col(at[b])).alias(f"d{k}") for k, (a, b) in enumerate(pairs)]
    aggs += [F.sum(F.col(n) ** 2).alias(f"s{n}") for n in at.values()] + [F.max(n).alias(f"x{n}") for n in at.values()]
    one = wide.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"),
        (F.col(f"d{k}") / F.greatest(F.sqrt(F.col(f"s{at[a]}") * F.col(f"s{at[b]}")), F.lit(1e-12))).alias("cosine"),
        F.greatest(F.col(f"x{at[a]}"), F.col(f"x{at[b]}"), F.lit(1e-12)).alias("scale")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def top_features(long: DataFrame, vip: DataFrame | None = None, n: int = 30) -> DataFrame:
    """Cells of the features with the largest importance, or the largest variance without one."""
    score = vip.select("feature", F.col("vip").alias("score")) if vip is not None else feature_moments(long).select("feature", (F.col("std") ** 2).alias("score"))
    return long.join(score.orderBy(F.col("score").desc(), "feature").limit(n), "feature", "left_semi").select(*long.columns)
