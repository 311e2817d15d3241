"""PCA, clustering and cross-validated classifiers.

Rows are only ever touched by Spark. What reaches the driver is a few vectors as long as there are features, per class and fold: sums, squares,
class sums and components (``linear``). Predictions go back to the rows as products with such vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayloom.functions.udfs import beta_quantile
from assayloom.operators import linear
from assayloom.operators.features import class_list, scaled_cells
from assayloom.operators.linear import EVERY, Moments, fold_moments
from assayloom.ordered import numbered
from assayloom.session import cut

CHI2_95 = 5.991  # fixed value
SMALL_INDEX = 100_000       # features whose numbers are sent to all tasks; longer lists are joined by shuffle


# ---- wide rows ---------------------------------------------------------------------------------------------

def feature_names(long: DataFrame) -> list:
    """Distinct features in order; the list is as long as a vector of the models."""
    return sorted(r["feature"] for r in long.select("feature").distinct().collect())


def wide_rows(long: DataFrame, names: list, absent: np.ndarray | None = None) -> DataFrame:
    """One array per sample holding its value for every feature; absent cells take the feature's value in ``absent``, else zero."""
    spark = long.sparkSession
    base = np.zeros(len(names)) if absent is None else absent
    types = dict(long.dtypes)
    index = spark.createDataFrame([(f, k) for k, f in enumerate(names)], f"feature {types['feature']}, k int")
    cells = long.join(F.broadcast(index) if len(names) <= SMALL_INDEX else index, "feature")
    cells = cells.groupBy("sample").agg(F.collect_list(F.struct("k", F.coalesce("value", F.lit(0.0)).alias("value"))).alias("c"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, v in zip(pdf["k"], pdf["v"]):
                if len(np.unique(k)) < len(k):
                    raise ValueError("a sample has two values of one feature")
                x = base.copy()
                x[k] = v
                rows.append(x)
            yield pd.DataFrame({"sample": pdf["sample"], "x": rows})

    kind = f"sample {types['sample']}, x array<double>"
    return cells.select("sample", F.col("c.k").alias("k"), F.col("c.value").alias("v")).mapInPandas(run, kind)


def scaled_rows(long: DataFrame, names: list, scaling: str) -> DataFrame:
    """The scaled matrix as one array per sample, made from the cells present and one value per feature for the others."""
    cells, absent = scaled_cells(long, scaling)
    value = {r["feature"]: r["value"] for r in absent.collect()}        # as long as a vector of the models
    return wide_rows(cells, names, np.array([value[f] for f in names], float))


# ---- PCA ---------------------------------------------------------------------------------------------------

@dataclass
class PcaTables:
    scores: DataFrame      # sample, component, score
    loadings: DataFrame    # feature, component, loading
    variance: DataFrame    # component, ratio


def _projected(rows: DataFrame, load: np.ndarray) -> DataFrame:
    """sample and ``s``: the products of its row with the columns of ``load``."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"sample": pdf["sample"], "s": list(np.vstack(pdf["x"].to_numpy()) @ load)})
    return rows.select("sample", "x").mapInPandas(run, f"sample {dict(rows.dtypes)['sample']}, s array<double>")


def _components(scaled: DataFrame, p: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading eigenvalues and vectors of the cross products of scaled, centred rows, and their trace."""
    rows = scaled.select("x", F.lit(0).alias("fold"))
    values, vectors = linear.leading(lambda v: linear.products(rows, v), [EVERY], p, k)[EVERY]
    trace = scaled.agg(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0]
    return values, vectors, trace


def pca(long: DataFrame, labels: DataFrame, k: int = 3, scaling: str = "auto") -> PcaTables:
    """Principal components of the scaled matrix; the largest loading of a component is positive, empty components are zero.

    Tables of any number of features: the components are found by products of the matrix with a few vectors.
    """
    spark = long.sparkSession
    if labels.select("label").distinct().count() < 2:
        raise ValueError("PCA needs at least two classes")
    names = feature_names(long)
    scaled = cut(scaled_rows(long, names, scaling))
    n = scaled.count()
    if n < 3 or len(names) < 2:
        raise ValueError("PCA needs three samples and two features")
    k = min(k, len(names), n - 1)
    values, load, trace = _components(scaled, len(names), k)
    ratio = values / max(trace, 1e-300)
    empty = ratio < 1e-12
    load, ratio = np.where(empty, 0.0, load), np.where(empty, 0.0, ratio)
    scores = _projected(scaled, load).select("sample", F.posexplode("s").alias("c", "score"))
    kind = dict(long.dtypes)["feature"]
    rows = [(f, c + 1, float(load[j, c])) for j, f in enumerate(names) for c in range(k)]
    return PcaTables(
        scores.select("sample", (F.col("c") + 1).alias("component"), "score"),
        spark.createDataFrame(rows, f"feature {kind}, component int, loading double"),
        spark.createDataFrame([(c + 1, float(r)) for c, r in enumerate(ratio)], "component int, ratio double"))


def cumulative_variance(variance: DataFrame) -> DataFrame:
    """Percent and running percent per component; one row per component, so the window is tiny."""
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return variance.select("component", (100 * F.col("ratio")).alias("percent"), F.sum(100 * F.col("ratio")).over(w).alias("cumulative"))


def hotelling_t2(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """T2 per sample from component scores, its confidence limit and the outlier flag."""
    shape = scores.agg(F.count_distinct("sample").alias("n"), F.count_distinct("component").alias("a")).first()
    n, a = shape["n"], shape["a"]
    if n <= a + 1:
        raise ValueError("T2 needs more samples than components plus one")
    free = n - a - 1
    limit = (n - 1) ** 2 / n * beta_quantile(1 - alpha, a / 2.0, free / 2.0) if free > 0 else None
    var = scores.groupBy("component").agg(F.var_samp("score").alias("v")).where("v > 0")
    t2 = scores.join(F.broadcast(var), "component", "left").groupBy("sample").agg(F.coalesce(F.sum(F.col("score") ** 2 / F.col("v")), F.lit(0.0)).alias("t2"))
    return t2.select("sample", "t2", F.lit(limit).cast("double").alias("limit_95"), F.coalesce(F.col("t2") > F.lit(limit), F.lit(False)).alias("outlier"))


def confidence_ellipse(points: DataFrame, group: str = "label", x: str = "x", y: str = "y", chi2: float = CHI2_95) -> DataFrame:
    """Centre, width, height and angle (degrees) of the 2-D confidence ellipse per group with three points or more."""
    part = points.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
                                     F.var_samp(x).alias("a"), F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b")).where("n >= 3")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    half, root = (a + c) / 2, F.sqrt(((a - c) / 2) ** 2 + b ** 2)
    axis = lambda e: 2 * F.sqrt(chi2 * F.greatest(e, F.lit(0.0)))
    angle = F.degrees(F.atan2(2 * b, a - c) / 2)
    return part.select(group, "cx", "cy", axis(half + root).alias("width"), axis(half - root).alias("height"), angle.alias("angle"))


def top_loadings(loadings: DataFrame, n: int = 8) -> DataFrame:
    """Features with the largest absolute loading per component; one row per feature and component."""
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature")
    return loadings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ---- Ward clustering -----------------------------------------------------------------------------------------

LEAVES = 512            # of the tree of clustering features, at most
DIRECTIONS = 256        # components in which features are compared


def _squared_gaps(points: np.ndarray) -> np.ndarray:
    dots = points @ points.T
    own = np.diag(dots)
    return np.maximum(own[:, None] + own[None, :] - 2.0 * dots, 0.0)


def ward_merges(sq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Merge table (left, right, height, size) from squared distances of weighted points; nodes are numbered as they are made."""
    n = len(sq)
    size = sizes.astype(float).copy()
    gap = 2.0 * np.outer(size, size) / np.add.outer(size, size) * sq
    np.fill_diagonal(gap, np.inf)
    node = np.arange(n)
    out = np.zeros((max(n - 1, 0), 4))
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(gap), gap.shape))
        height, ni, nj = gap[i, j], size[i], size[j]
        out[step] = (min(node[i], node[j]), max(node[i], node[j]), math.sqrt(height), ni + nj)
        row = ((ni + size) * gap[i] + (nj + size) * gap[j] - size * height) / (ni + nj + size)
        row[[i, j]] = np.inf
        row[~np.isfinite(gap[i])] = np.inf
        gap[i], gap[:, i] = row, row
        gap[j], gap[:, j] = np.inf, np.inf
        size[i], node[i] = ni + nj, n + step
    return out


def _leaves(merges: np.ndarray, n: int) -> list[int]:
    order, stack = [], [n + len(merges) - 1] if len(merges) else list(range(n))
    while stack:
        k = int(stack.pop())
        if k < n:
            order.append(k)
        else:
            stack += [merges[k - n, 1], merges[k - n, 0]]
    return order


def _cut_tree(merges: np.ndarray, n: int, clusters: int) -> np.ndarray:
    parent = list(range(n + len(merges)))
    for step in range(max(0, n - clusters)):
        parent[int(merges[step, 0])] = parent[int(merges[step, 1])] = n + step

    def top(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k
    seen: dict[int, int] = {}
    label = np.zeros(n, dtype=int)
    for leaf in _leaves(merges, n):
        label[leaf] = seen.setdefault(top(leaf), len(seen) + 1)
    return label


@dataclass
class ClusterTables:
    merges: DataFrame     # left, right, height, size
    labels: DataFrame     # sample, cluster, leaf
    error: float          # share of the sum of squares that lies inside the leaves


class _Tree:
    """Tree of clustering features: every leaf is a count, a sum and a sum of squares per feature, all of them additive.

    Leaves are split at their mean along the feature that varies most, those with the largest sum of squares first, so the tree follows from
    the set of rows alone, however they are partitioned.
    """

    def __init__(self):
        self.feature, self.at, self.low, self.leaf = [-1], [0.0], [-1], [0]     # children stand at low and low + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of every row."""
        feature, at, low = np.array(self.feature), np.array(self.at), np.array(self.low)
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return np.array(self.leaf)[node]
            here = node[inner]
            node[inner] = low[here] + (x[inner, feature[here]] > at[here])

    def features(self, rows: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, sum and sum of squares of the leaves, one pass."""
        tree, count = self, max(self.leaf) + 1

        def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, s = np.zeros(count), np.zeros((count, 2 * p))
            for pdf in it:
                x = np.vstack(pdf["x"].to_numpy())
                leaf = tree.place(x)
                order = np.argsort(leaf, kind="stable")
                at = np.flatnonzero(np.diff(leaf[order], prepend=-1))
                used = leaf[order][at]
                n += np.bincount(leaf, minlength=count)
                s[used] += np.add.reduceat(np.hstack([x, x * x])[order], at)
            used = np.flatnonzero(n)
            if len(used):
                yield pd.DataFrame({"leaf": used, "v": list(np.hstack([n[used, None], s[used]]))})

        found = linear.vector_sum(rows.select("x").mapInPandas(partial, "leaf int, v array<double>"), ["leaf"])
        m = np.vstack([found[(k,)] for k in range(count)])
        return m[:, 0], m[:, 1:1 + p], m[:, 1 + p:]

    def split(self, n: np.ndarray, s: np.ndarray, q: np.ndarray, most: int) -> bool:
        """Split what can be split, up to ``most`` leaves; False where nothing was."""
        within = np.maximum(q - s * s / n[:, None], 0.0)
        within[within <= 1e-9 * q] = 0.0        # no more than rounding
        spread = within.sum(1)
        chosen = np.argsort(-spread, kind="stable")
        chosen = chosen[spread[chosen] > 0][:most - len(n)]
        node_of = {leaf: node for node, leaf in enumerate(self.leaf) if self.feature[node] < 0}
        for leaf in chosen:
            node, j = node_of[int(leaf)], int(within[leaf].argmax())
            self.feature[node], self.at[node], self.low[node] = j, float(s[leaf, j] / n[leaf]), len(self.feature)
            for number in (int(leaf), max(self.leaf) + 1):
                self.feature.append(-1)
                self.at.append(0.0)
                self.low.append(-1)
                self.leaf.append(number)
        return len(chosen) > 0


def _ward_of(rows: DataFrame, p: int, leaves: int) -> tuple[_Tree, np.ndarray, np.ndarray, float]:
    """The tree, Ward's merges of its leaves' means weighted by their counts, the counts, and the share of squares inside the leaves."""
    tree = _Tree()
    n, s, q = tree.features(rows, p)
    whole = float(np.maximum(q - s * s / n[:, None], 0.0).sum())
    while len(n) < leaves and tree.split(n, s, q, leaves):
        n, s, q = tree.features(rows, p)
    inside = np.maximum(q - s * s / n[:, None], 0.0)
    inside[inside <= 1e-9 * q] = 0.0
    return tree, ward_merges(_squared_gaps(s / n[:, None]), n), n, float(inside.sum()) / max(whole, 1e-300)


def hierarchical_clusters(long: DataFrame, n_clusters: int = 3, leaves: int = LEAVES, scaling: str = "auto") -> ClusterTables:
    """Ward linkage on z-scored features, over the leaves of a tree of clustering features.

    The tree is split in Spark until it has ``leaves`` leaves or every leaf holds equal rows, whatever the number of samples. With no more
    than ``leaves`` different rows each is a leaf, and the linkage is Ward's own over them; beyond, ``error`` is the share of the sum
    of squares that the leaves hide. Only the leaves (a count and a mean each) reach the driver; samples find their leaf in Spark.
    """
    spark = long.sparkSession
    names = feature_names(long)
    rows = cut(scaled_rows(long, names, scaling))
    if rows.limit(2).count() < 2:
        raise ValueError("clustering needs two samples")
    tree, merges, size, error = _ward_of(rows, len(names), leaves)
    label, leaf = _cut_tree(merges, len(size), n_clusters), {m: k for k, m in enumerate(_leaves(merges, len(size)))}
    kind = dict(long.dtypes)["sample"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.array([leaf[k] for k in range(len(size))])
        for pdf in it:
            at = tree.place(np.vstack(pdf["x"].to_numpy()))
            yield pd.DataFrame({"sample": pdf["sample"], "cluster": label[at], "leaf": places[at]})

    table = spark.createDataFrame([(int(a), int(b), float(h), int(s)) for a, b, h, s in merges], "left int, right int, height double, size long")
    return ClusterTables(table, rows.select("sample", "x").mapInPandas(run, f"sample {kind}, cluster int, leaf int"), error)


def cluster_order(long: DataFrame, leaves: int = LEAVES, directions: int = DIRECTIONS) -> DataFrame:
    """Cells with the leaf position of their row and column; needs three or more on each axis.

    Columns are compared by their coordinates along the ``directions`` leading components of the scaled matrix, so all samples count.
    """
    spark = long.sparkSession
    names = feature_names(long)
    if len(names) < 3 or long.select("sample").distinct().limit(3).count() < 3:
        raise ValueError("clustering both axes needs three samples and three features")
    rows = hierarchical_clusters(long, 1, leaves).labels.select("sample", F.col("leaf").alias("row_leaf"))
    scaled = cut(scaled_rows(long, names, "auto"))
    values, load, _ = _components(scaled, len(names), min(len(names), directions))
    kind = dict(long.dtypes)["feature"]
    points = spark.createDataFrame([(f, [float(c) for c in x]) for f, x in zip(names, load * np.sqrt(values))], f"sample {kind}, x array<double>")
    tree, merges, size, _ = _ward_of(points, load.shape[1], leaves)
    place = {m: k for k, m in enumerate(_leaves(merges, len(size)))}
    at = tree.place(load * np.sqrt(values))
    index = spark.createDataFrame([(f, place[int(a)]) for f, a in zip(names, at)], f"feature {kind}, col_leaf int")
    return long.join(rows, "sample").join(F.broadcast(index) if len(names) <= SMALL_INDEX else index, "feature")


# ---- cross-validated classifiers ------------------------------------------------------------------------------

RANK = 256              # components that permuted labels are fitted on
PERM_BLOCK = 128
ROW_BLOCK = 4_096

def stratified_folds(labels: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Fold per sample: samples of a class in hashed order, dealt round robin."""
    hashed = labels.select("sample", "label").distinct().withColumn("_h", (F.xxhash64("sample", F.lit(seed)) / 2.0 ** 11).cast("double"))
    hashed = hashed.withColumn("_h2", F.pmod(F.xxhash64("sample", F.lit(seed)), F.lit(2 ** 11)).cast("double"))
    return numbered(hashed, ["label"], ["_h", "_h2"], "_rn").select("sample", "label", ((F.col("_rn") - 1) % k).cast("int").alias("fold"))


class _Pls:
    """PLS of one training set, grown by one component per product of its cross products with a weight vector."""

    def __init__(self, m: Moments, scaling: str):
        self.n, self.share = m.n, m.cn / m.n
        self.mean, self.div, self.squares = m.scaled(scaling)
        self.c = ((m.cs - np.outer(m.cn, self.mean)) / self.div).T        # features x classes, X'Y centred
        self.w, self.p, self.q, self.tt, self.linear = [], [], [], [], []

    def weight(self) -> np.ndarray | None:
        u, sv, _ = np.linalg.svd(self.c, full_matrices=False)
        return None if not len(sv) or sv[0] < 1e-12 else u[:, 0] * np.sign(u[np.abs(u[:, 0]).argmax(), 0] or 1.0)

    def add(self, w: np.ndarray, product: np.ndarray) -> bool:
        """``product``: X'X w of the scaled matrix; deflated here by the components so far."""
        for p, tt in zip(self.p, self.tt):
            product = product - tt * p * (p @ w)
        tt = float(w @ product)
        if tt < 1e-12:
            return False
        p, q = product / tt, self.c.T @ w / tt
        self.c = self.c - tt * np.outer(p, q)
        for have, new in ((self.w, w), (self.p, p), (self.q, q), (self.tt, tt)):
            have.append(new)
        W, P, Q = np.array(self.w).T, np.array(self.p).T, np.array(self.q).T
        b = W @ np.linalg.pinv(P.T @ W) @ Q.T
        self.linear.append((b / self.div[:, None], self.share - (self.mean / self.div) @ b))
        return True

    def models(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each number of components the linear model; the class shares where there is none."""
        return self.linear or [(np.zeros((len(self.mean), len(self.share))), self.share)]

    def explained(self) -> np.ndarray:
        """Share of X's sum of squares that each component takes away."""
        return np.array([tt * float(p @ p) for p, tt in zip(self.p, self.tt)]) / max(self.squares, 1e-300)


def fit_pls(rows: DataFrame, moments: dict[int, Moments], scaling: str, k_max: int) -> dict[int, _Pls]:
    """PLS of all training sets together: one pass over the rows per component."""
    fits = {f: _Pls(m, scaling) for f, m in moments.items()}
    sets = {f: (m.n, fits[f].mean, fits[f].div) for f, m in moments.items()}
    live = {f for f in fits}
    for a in range(k_max):
        weights = {f: fits[f].weight() for f in live if a < max(1, min(k_max, int(fits[f].n) - 1, len(fits[f].mean)))}
        weights = {f: w[:, None] for f, w in weights.items() if w is not None}
        if not weights:
            break
        found = linear.scaled_products(rows, sets, weights)
        live = {f for f in weights if fits[f].add(weights[f][:, 0], found[f][:, 0])}
    return fits


def pls_from_cross(c: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Coefficients (components x classes) of PLS where the cross products are diagonal: ``c`` is X'Y, ``values`` the diagonal."""
    w_all, p_all, q_all, tt_all = [], [], [], []
    for _ in range(k):
        u, sv, _ = np.linalg.svd(c, full_matrices=False)
        if not len(sv) or sv[0] < 1e-12:
            break
        w = u[:, 0]
        s = values * w
        for p, tt in zip(p_all, tt_all):
            s = s - tt * p * (p @ w)
        tt = float(w @ s)
        if tt < 1e-12:
            break
        p, q = s / tt, c.T @ w / tt
        c = c - tt * np.outer(p, q)
        w_all.append(w); p_all.append(p); q_all.append(q); tt_all.append(tt)
    if not w_all:
        return np.zeros_like(c)
    W, P, Q = np.array(w_all).T, np.array(p_all).T, np.array(q_all).T
    return W @ np.linalg.pinv(P.T @ W) @ Q.T


def lda_from_cross(centre: np.ndarray, cn: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear discriminants where the cross products are diagonal: weights and intercepts per class; ``centre``: class means (classes x components)."""
    classes = np.flatnonzero(cn > 0)
    n, mean = cn.sum(), centre[classes]
    within = np.diag(values) - (mean * cn[classes, None]).T @ mean
    inv = np.linalg.pinv(within / max(n - len(classes), 1), rcond=1e-8, hermitian=True)
    weight, const = np.zeros((centre.shape[1], len(cn))), np.full(len(cn), -1e300)
    coef = mean @ inv
    for j, c in enumerate(classes):
        weight[:, c] = coef[j]
        const[c] = -0.5 * coef[j] @ mean[j] + math.log(cn[c] / n)
    return weight, const


def fold_components(rows: DataFrame, moments: dict[int, Moments], scaling: str, k: int) -> dict[int, tuple]:
    """Per training set mean, divisor, leading eigenvalues and vectors of its scaled cross products."""
    scaled = {f: m.scaled(scaling) for f, m in moments.items()}
    sets = {f: (m.n, *scaled[f][:2]) for f, m in moments.items()}
    p = len(next(iter(moments.values())).s)
    found = linear.leading(lambda v: linear.scaled_products(rows, sets, v), list(moments), p, k)
    return {f: (*scaled[f][:2], *found[f]) for f in moments}


def lda_model(m: Moments, base: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts per class for rows as they are."""
    mean, div, values, top = base
    centre = ((m.cs / np.maximum(m.cn, 1)[:, None] - mean) / div) @ top
    weight, const = lda_from_cross(centre, m.cn, values)
    weight = (top @ weight) / div[:, None]
    return weight, const - mean @ weight


def _score_rows(rows: DataFrame, models: dict[int, list[tuple[np.ndarray, np.ndarray]]], kept: list[str]) -> DataFrame:
    """Scores of every model of a row's fold: model number, class scores."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for fold, part in pdf.groupby("fold"):
                x = np.vstack(part["x"].to_numpy())
                for k, (b, c) in enumerate(shared.value[fold]):
                    out = part[kept].reset_index(drop=True)
                    yield out.assign(model=k, scores=list(x @ b + c))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", model int, scores array<double>")


def _argmax(scores: str = "scores") -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def classification_report(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confusion counts, and the accuracy with the mean recall over the classes present."""
    confusion = pred.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    recall = confusion.groupBy("truth").agg(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("n"))
    return confusion, recall.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))


@dataclass
class Study:
    """Everything a cross-validated model needs: rows with fold, classes, features and fold moments."""

    rows: DataFrame
    classes: list[tuple[str, int]]
    names: list
    folds: int
    moments: list[Moments]
    scaling: str


def prepare_study(long: DataFrame, labels: DataFrame, scaling: str = "pareto", folds: int | None = None, seed: int = 0) -> Study:
    classes = class_list(labels)
    if len(classes) < 2 or min(n for _, n in classes) < 2 or sum(n for _, n in classes) < 6:
        raise ValueError("a classifier needs two classes, two samples per class and six samples")
    k = max(2, min(folds or 5, min(n for _, n in classes)))
    names = feature_names(long)
    index = F.create_map(*[F.lit(x) for j, (c, _) in enumerate(classes) for x in (c, j)])
    dealt = stratified_folds(labels, k, seed).withColumn("y", index[F.col("label")].cast("int"))
    rows = cut(wide_rows(long, names).join(dealt, "sample"))
    return Study(rows, classes, names, k, fold_moments(rows, k, len(classes), len(names)), scaling)


def _training(study: Study) -> dict[int, Moments]:
    """Moments of every training set: all folds but one, and all."""
    every = linear.total(study.moments)
    return {f: every - held for f, held in enumerate(study.moments)} | {EVERY: every}


@dataclass
class ClassifierTables:
    summary: DataFrame
    confusion: DataFrame
    predictions: DataFrame
    explained: DataFrame | None = None      # component, x_variance
    vip: DataFrame | None = None
    scores: DataFrame | None = None
    permuted: DataFrame | None = None


def _summary(study: Study, method: str, k: int, q2: float | None, report: DataFrame, x_variance: float | None = None) -> DataFrame:
    return report.select(F.lit(method).alias("method"), F.lit(k).alias("n_components"), F.lit(study.folds).alias("n_splits"),
                         "accuracy", "balanced_accuracy", F.lit(q2).cast("double").alias("q2"), F.lit(x_variance).cast("double").alias("x_variance"))


def _named(study: Study, c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name, _ in study.classes]), c + 1)


def pls_da(long: DataFrame, labels: DataFrame, scaling: str = "pareto", max_components: int = 5, folds: int | None = None,
           n_permutations: int = 0, seed: int = 0, study: Study | None = None) -> ClassifierTables:
    """Cross-validated PLS discriminant analysis; the number of components is the one with the best Q2."""
    study = study or prepare_study(long, labels, scaling, folds, seed)
    training = _training(study)
    total = training[EVERY]
    k_max = max(1, min(max_components, int(total.n) - 2, len(study.names)))
    fits = fit_pls(study.rows, training, scaling, k_max)
    models = {f: [fits[f].models()[min(k, len(fits[f].models()) - 1)] for k in range(k_max)] for f in range(study.folds)}
    scored = cut(_score_rows(study.rows, models, ["sample", "y", "fold"]))
    onehot = lambda j: (F.col("y") == j).cast("double")
    miss = sum((F.col("scores")[j] - onehot(j)) ** 2 for j in range(len(study.classes)))
    press = {r["model"]: r["press"] for r in scored.groupBy("model").agg(F.sum(miss).alias("press")).collect()}
    tss = float(total.n - (total.cn ** 2).sum() / total.n)
    best, q2 = 0, -math.inf
    for k in range(k_max):
        here = 1.0 - press[k] / tss
        if here > q2 + 1e-9:
            best, q2 = k, here
    pred = scored.where(F.col("model") == best).select("sample", _named(study, F.col("y")).alias("truth"), _named(study, _argmax()).alias("pred"))
    confusion, report = classification_report(pred)
    full = fits[EVERY]
    spark, kind = long.sparkSession, dict(long.dtypes)["feature"]
    use = slice(0, best + 1)
    w, p_, q, tt = (np.array(x[use]) for x in (full.w, full.p, full.q, full.tt))
    w, p_, q = (v.reshape(len(tt), -1) if len(tt) else np.zeros((0, width)) for v, width in ((w, len(study.names)), (p_, len(study.names)), (q, len(study.classes))))
    ss = (q ** 2).sum(axis=1) * tt
    vip = np.sqrt(len(study.names) * ((w ** 2).T @ ss) / max(ss.sum(), 1e-12))
    rot = w.T @ np.linalg.pinv(p_ @ w.T) if len(tt) else np.zeros((len(study.names), 0))
    project = {f: [(rot / full.div[:, None], -(full.mean / full.div) @ rot)] for f in range(study.folds)}
    scores = _score_rows(study.rows, project, ["sample", "fold"]).select("sample", F.posexplode("scores").alias("c", "score"))
    explained = full.explained()[use]
    out = ClassifierTables(
        _summary(study, "PLS-DA", best + 1, q2, report, float(explained.sum())), confusion, pred,
        spark.createDataFrame([(c + 1, float(v)) for c, v in enumerate(explained)], "component int, x_variance double"),
        spark.createDataFrame([(f, float(v)) for f, v in zip(study.names, vip)], f"feature {kind}, vip double"),
        scores.select("sample", (F.col("c") + 1).alias("component"), "score"))
    if n_permutations:
        out.permuted = permutation_test(study, "pls", best + 1, report, n_permutations, seed)
    return out


def lda_cv(long: DataFrame, labels: DataFrame, scaling: str = "pareto", n_components: int = 10, folds: int | None = None,
           n_permutations: int = 0, seed: int = 0, study: Study | None = None) -> ClassifierTables:
    """Cross-validated linear discriminants on principal components."""
    study = study or prepare_study(long, labels, scaling, folds, seed)
    training = {f: m for f, m in _training(study).items() if f != EVERY}
    k = max(1, min(n_components, int(sum(m.n for m in study.moments)) // 3, len(study.names)))
    base = fold_components(study.rows, training, scaling, k)
    models = {f: [lda_model(m, base[f])] for f, m in training.items()}
    scored = _score_rows(study.rows, models, ["sample", "y", "fold"])
    pred = scored.select("sample", _named(study, F.col("y")).alias("truth"), _named(study, _argmax()).alias("pred"))
    confusion, report = classification_report(pred)
    out = ClassifierTables(_summary(study, "LDA", k, None, report), confusion, pred)
    if n_permutations:
        out.permuted = permutation_test(study, "lda", k, report, n_permutations, seed)
    return out


def permuted_labels(study: Study, n: int, seed: int = 0) -> DataFrame:
    """Per sample one class index per permutation: hashed order decides, class sizes stay as they are."""
    each = study.rows.select("sample").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = F.xxhash64("sample", "perm", F.lit(seed))
    each = each.withColumns({"_h": (h / 2.0 ** 11).cast("double"), "_h2": F.pmod(h, F.lit(2 ** 11)).cast("double")})
    ranked = numbered(each, ["perm"], ["_h", "_h2"], "_rn")
    limits = np.cumsum([c for _, c in study.classes])
    y = F.lit(len(limits) - 1)
    for j in range(len(limits) - 2, -1, -1):
        y = F.when(F.col("_rn") <= int(limits[j]), j).otherwise(y)
    # one short array per sample, as long as the number of permutations
    return ranked.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("perm", y.alias("y")))), lambda s: s["y"]).alias("ys"))


def permutation_test(study: Study, kind: str, k: int, report: DataFrame, n: int = 200, seed: int = 0, rank: int = RANK) -> DataFrame:
    """Accuracies under permuted labels with the observed one and p. Folds stay fixed; only class sums change.

    Samples are turned to the ``rank`` leading components of each training set (all of them, where there are no more features), where cross products
    are diagonal, so a fit needs nothing but its own class sums. Every (fold, permutation) is a row and is fitted by a task; predictions meet
    samples in blocks of both. No table that grows with the permutations reaches the driver or all tasks.
    """
    classes, p = len(study.classes), len(study.names)
    training = {f: m for f, m in _training(study).items() if f != EVERY}
    base = fold_components(study.rows, training, study.scaling, min(rank, p))
    counts = {f: m.cn for f, m in training.items()}
    sizes = np.array([c for _, c in study.classes], float)
    chunks = -(-n // PERM_BLOCK)
    slices = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: F.struct(c.alias("chunk"), F.slice("ys", c * PERM_BLOCK + 1, PERM_BLOCK).alias("ys")))
    rows = study.rows.select("sample", "x", "fold").join(permuted_labels(study, n, seed), "sample")
    sample_kind = dict(rows.dtypes)["sample"]

    def turn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = np.vstack(pdf["x"].to_numpy())
            for f, (mean, div, _, top) in base.items():
                yield pdf[["sample", "fold", "ys"]].assign(set=f, z=list(((x - mean) / div) @ top))

    turned = cut(rows.mapInPandas(turn, f"sample {sample_kind}, fold int, ys array<int>, set int, z array<double>"))
    dealt = turned.select("sample", "fold", "set", "z", F.explode(slices).alias("c")).select("sample", "fold", "set", "z", "c.chunk", "c.ys")

    def class_sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for pdf in it:
            for (f, chunk), part in pdf.groupby(["set", "chunk"]):
                z, ys = np.vstack(part["z"].to_numpy()), np.vstack(part["ys"].to_numpy())
                z = np.hstack([np.ones((len(z), 1)), z])
                sums = np.stack([(ys == c).T.astype(float) @ z for c in range(classes)], axis=1)        # perm x class x (1 + r)
                acc[f, chunk] = acc.get((f, chunk), 0.0) + sums
        for (f, chunk), m in acc.items():
            yield pd.DataFrame({"set": f, "perm": chunk * PERM_BLOCK + np.arange(len(m)), "v": list(m.reshape(len(m), -1))})

    sums = dealt.where("fold <> set").mapInPandas(class_sums, "set int, perm int, v array<double>")
    sums = sums.groupBy("set", "perm").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("set", "perm", vector_to_array("v").alias("v"))

    def fit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for f, v in zip(pdf["set"], pdf["v"]):
                m = v.reshape(classes, -1)
                cn, cs, values = m[:, 0], m[:, 1:], base[f][2]
                if kind == "pls":
                    b, const = pls_from_cross(cs.T.copy(), values, k), cn / cn.sum()
                else:
                    use = max(1, min(k, int(counts[f].sum()) - 1, p))
                    b, const = lda_from_cross((cs / np.maximum(cn, 1)[:, None])[:, :use], cn, values[:use])
                    b = np.vstack([b, np.zeros((len(values) - len(b), classes))])
                out.append(np.concatenate([const, b.ravel()]))
            yield pdf[["set", "perm"]].assign(chunk=pdf["perm"] // PERM_BLOCK, b=out)

    fitted = cut(sums.mapInPandas(fit, "set int, perm int, chunk int, b array<double>"))
    # blocks of samples and blocks of permutations
    blocks = max(1, math.ceil(sizes.sum() / ROW_BLOCK))
    held = dealt.where("fold = set").select("set", "chunk", F.pmod(F.xxhash64("sample"), F.lit(blocks)).cast("int").alias("block"), "z", "ys")
    models = fitted.select("set", "chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "perm", "b")

    def hits(samples: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if not len(samples) or not len(fits):
            return pd.DataFrame({"perm": np.zeros(0, int), "hit": np.zeros(0)})
        z, ys = np.vstack(samples["z"].to_numpy()), np.vstack(samples["ys"].to_numpy())
        out = []
        for perm, b in zip(fits["perm"], fits["b"]):
            guess = (z @ b[classes:].reshape(-1, classes) + b[:classes]).argmax(axis=1)
            out.append(float((guess == ys[:, perm % PERM_BLOCK]).sum()))
        return pd.DataFrame({"perm": fits["perm"], "hit": out})

    key = ["set", "chunk", "block"]
    per = held.groupBy(*key).cogroup(models.groupBy(*key)).applyInPandas(hits, "perm int, hit double")
    per = cut(per.groupBy("perm").agg((F.sum("hit") / float(sizes.sum())).alias("accuracy")))
    observed = report.select("accuracy").first()["accuracy"]
    at_least = per.agg(((F.sum((F.col("accuracy") >= observed).cast("int")) + 1) / (n + 1.0)).alias("p")).scalar()
    return per.select("perm", "accuracy", F.lit(observed).alias("observed"), at_least.alias("p_value"))
