"""Models against direct NumPy computations."""

import numpy as np
import pandas as pd
import pytest

from assayloom.operators import features as ft, linear, models as md
from assayloom.functions import udfs


def matrix(n=60, p=8, classes=3, seed=0, gap=2.0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(size=(n, p)) + gap * np.eye(classes, p)[y] + 3.0
    return x, y


def tables(spark, x, y):
    rows = [(f"s{i:03d}", j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j] != 0]
    labels = [(f"s{i:03d}", f"c{y[i]}", i) for i in range(len(y))]
    return spark.createDataFrame(rows, "sample string, feature long, value double").repartition(6), spark.createDataFrame(labels, "sample string, label string, ord long")


def scaled(x, method):
    c, s = x - x.mean(0), x.std(0)
    s = np.where(s == 0, 1, s)
    return c / {"auto": s, "pareto": np.sqrt(s), "center": np.ones_like(s)}[method]


@pytest.mark.parametrize("method", ["auto", "pareto", "center"])
def test_pca(spark, method):
    x, y = matrix()
    out = md.pca(*tables(spark, x, y), 3, method)
    z = scaled(x, method)
    vals, vecs = np.linalg.eigh(np.cov(z, rowvar=False))
    vals, vecs = vals[::-1], vecs[:, ::-1][:, :3]
    vecs = vecs * np.sign(vecs[np.abs(vecs).argmax(0), range(3)])
    got = out.scores.toPandas().pivot(index="sample", columns="component", values="score").sort_index().to_numpy()
    assert np.allclose(got, z @ vecs, atol=1e-8)
    assert np.allclose(out.variance.toPandas().sort_values("component")["ratio"], vals[:3] / vals.sum())


def naive_ward(points):
    """Merge heights by the definition: growth of the within-cluster sum of squares."""
    groups = [[i] for i in range(len(points))]
    out = []
    while len(groups) > 1:
        best = None
        for a in range(len(groups)):
            for b in range(a):
                na, nb = len(groups[a]), len(groups[b])
                d = np.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(points[groups[a]].mean(0) - points[groups[b]].mean(0))
                if best is None or d < best[0]:
                    best = (d, a, b)
        d, a, b = best
        out.append(d)
        groups[b] += groups.pop(a)
    return out


def test_ward(spark):
    x, y = matrix(24, 4, 3, gap=9)
    out = md.hierarchical_clusters(tables(spark, x, y)[0], 3)
    assert out.error == 0
    assert np.allclose(out.merges.toPandas()["height"], naive_ward(scaled(x, "auto")))
    got = out.labels.toPandas().sort_values("sample")["cluster"].to_numpy()
    assert pd.crosstab(got, y).astype(bool).sum().sum() == 3                    # clusters are the classes


def test_ward_over_few_leaves(spark):
    x, y = matrix(90, 4, 3, gap=12)
    out = md.hierarchical_clusters(tables(spark, x, y)[0], 3, leaves=12)
    got = out.labels.toPandas().sort_values("sample")["cluster"].to_numpy()
    assert 0 < out.error < 0.2 and len(out.merges.toPandas()) == 11 and pd.crosstab(got, y).astype(bool).sum().sum() == 3


def wide(spark, x, parts):
    return spark.createDataFrame([(f"s{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)], "sample string, x array<double>").repartition(parts)


@pytest.mark.parametrize("n, most", [(500, 0.0), (1500, 0.1)])
def test_leaves_against_ward_on_all_samples(spark, n, most):
    """500 samples are leaves of their own, and the heights Ward's; with 1,500 the last twenty heights differ by less than 10 percent (7.7 measured), those between classes not at all."""
    x, y = matrix(n, 4, 5, seed=2, gap=8)
    z = scaled(x, "auto")
    tree, merges, size, error = md._ward_of(wide(spark, z, 5), 4, md.LEAVES)
    plain = md.ward_merges(md._squared_gaps(z), np.ones(n))
    assert (error == 0) == (n <= md.LEAVES) and error < 0.02 and size.sum() == n
    assert np.abs(merges[-20:, 2] / plain[-20:, 2] - 1).max() <= most + 1e-9
    assert np.allclose(merges[-4:, 2], plain[-4:, 2])
    label = md._cut_tree(merges, len(size), 5)[tree.place(z)]
    assert pd.crosstab(label, y).astype(bool).sum().sum() == 5


def test_leaves_do_not_depend_on_partitions(spark):
    x, _ = matrix(300, 5, 3, seed=3)
    x[100:200] = x[7]           # a third of all samples is one row
    out = [md._ward_of(wide(spark, x, parts), 5, 40) for parts in (3, 200)]
    assert np.array_equal(out[0][0].place(x), out[1][0].place(x)) and np.allclose(out[0][1], out[1][1])


@pytest.mark.parametrize("basis", [256, 48])
def test_components_of_any_width_against_numpy(spark, basis, monkeypatch):
    """Also where the basis is far smaller than the matrix is wide, and scores to 1e-6."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(70, 90)) * np.linspace(3, 0.5, 90)
    x -= x.mean(0)
    rows = wide(spark, x, 4).selectExpr("sample", "x", "0 as fold")
    value, vector = linear.leading(lambda v: linear.products(rows, v), [linear.EVERY], 90, 4, basis=basis)[linear.EVERY]
    want, axes = np.linalg.eigh(x.T @ x)
    assert np.allclose(value, want[::-1][:4], rtol=1e-8)
    assert np.allclose(np.abs(x @ vector), np.abs(x @ axes[:, ::-1][:, :4]), atol=1e-6)


def test_pca_of_twenty_thousand_features(spark):
    n, p = 12, 20_000
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, p)).round(3) + np.arange(n)[:, None] % 2 * 0.5
    long = spark.createDataFrame(pd.DataFrame({"sample": np.repeat([f"s{i:02d}" for i in range(n)], p), "feature": np.tile(np.arange(p), n), "value": x.ravel()})).repartition(8)
    labels = spark.createDataFrame([(f"s{i:02d}", "ab"[i % 2], i) for i in range(n)], "sample string, label string, ord long")
    out = md.pca(long, labels, 2, "center")
    got = out.scores.toPandas().pivot(index="sample", columns="component", values="score").sort_index().to_numpy()
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), rtol=1e-6)


def test_cluster_order_covers_axes(spark):
    x, y = matrix(12, 5)
    got = md.cluster_order(tables(spark, x, y)[0]).toPandas()
    assert sorted(got["row_leaf"].unique()) == list(range(12)) and sorted(got["col_leaf"].unique()) == list(range(5))


def nipals(x, y, k):
    """PLS regression by explicit deflation of the data matrices."""
    x, y = x.copy(), y.copy()
    w_, p_, q_, t_ = [], [], [], []
    for _ in range(k):
        u, _, _ = np.linalg.svd(x.T @ y, full_matrices=False)
        w = u[:, 0]
        t = x @ w
        p, q = x.T @ t / (t @ t), y.T @ t / (t @ t)
        x, y = x - np.outer(t, p), y - np.outer(t, q)
        w_.append(w); p_.append(p); q_.append(q); t_.append(t)
    W, P, Q, T = (np.array(v).T for v in (w_, p_, q_, t_))
    return W @ np.linalg.pinv(P.T @ W) @ Q.T, W, Q, T


def test_pls_by_products_equals_pls_on_data(spark):
    x, y = matrix(50, 6)
    onehot = np.eye(3)[y]
    rows = spark.createDataFrame([([float(v) for v in r], int(c), k % 3) for k, (r, c) in enumerate(zip(x, y))], "x array<double>, y int, fold int")
    moments = linear.fold_moments(rows, 3, 3, 6)
    every = linear.total(moments)
    fits = md.fit_pls(rows, {linear.EVERY: every, 1: every - moments[1]}, "pareto", 3)
    for f, use in ((linear.EVERY, np.arange(50) >= 0), (1, np.arange(50) % 3 != 1)):
        z = scaled(x[use], "pareto")
        coef, W, Q, T = nipals(z, onehot[use] - onehot[use].mean(0), 3)
        b, c = fits[f].linear[2]
        assert np.allclose(x[use] @ b + c, z @ coef + onehot[use].mean(0), atol=1e-8)
        assert np.allclose(fits[f].tt, (T ** 2).sum(0))
        # what X loses with each component
        left, shares = z.copy(), []
        for t in T.T:
            after = left - np.outer(t, left.T @ t / (t @ t))
            shares.append(((left ** 2).sum() - (after ** 2).sum()) / (z ** 2).sum())
            left = after
        assert np.allclose(fits[f].explained(), shares)


def cv_pls(x, y, fold, k, method):
    pred = np.zeros((len(y), 3))
    for f in np.unique(fold):
        tr, te = fold != f, fold == f
        mean, std = x[tr].mean(0), x[tr].std(0)
        div = np.sqrt(std) if method == "pareto" else std
        onehot = np.eye(3)[y[tr]]
        coef, *_ = nipals((x[tr] - mean) / div, onehot - onehot.mean(0), k)
        pred[te] = (x[te] - mean) / div @ coef + onehot.mean(0)
    return pred


def test_pls_da_matches_direct_cross_validation(spark):
    x, y = matrix(60, 6, 3, gap=1.0)
    long, labels = tables(spark, x, y)
    study = md.prepare_study(long, labels)
    rows = study.rows.toPandas().sort_values("sample")
    fold = rows["fold"].to_numpy()
    assert all(np.bincount(fold[y == c]).max() - np.bincount(fold[y == c]).min() <= 1 for c in range(3))
    out = md.pls_da(long, labels, study=study, n_permutations=30)
    s = out.summary.first()
    onehot = np.eye(3)[y]
    q2 = [1 - ((onehot - cv_pls(x, y, fold, k, "pareto")) ** 2).sum() / ((onehot - onehot.mean(0)) ** 2).sum() for k in range(1, 6)]
    assert s["n_components"] == int(np.argmax(q2)) + 1 and s["q2"] == pytest.approx(max(q2))
    guess = cv_pls(x, y, fold, s["n_components"], "pareto").argmax(1)
    assert s["accuracy"] == pytest.approx((guess == y).mean())
    assert out.vip.toPandas()["vip"].pow(2).mean() == pytest.approx(1.0)
    p = out.permuted.toPandas()
    assert len(p) == 30 and p["p_value"][0] == pytest.approx(((p["accuracy"] >= s["accuracy"]).sum() + 1) / 31)


def test_permutations_keep_class_sizes(spark):
    x, y = matrix(31, 4, 3)
    study = md.prepare_study(*tables(spark, x, y))
    got = np.vstack(md.permuted_labels(study, 8).toPandas()["ys"])
    for k in range(8):
        assert np.bincount(got[:, k], minlength=3).tolist() == [n for _, n in study.classes]
    assert len({tuple(got[:, k]) for k in range(8)}) == 8


@pytest.mark.parametrize("gap,good", [(6.0, True), (0.0, False)])
def test_separable_and_noise(spark, gap, good):
    x, y = matrix(60, 5, 2, seed=4, gap=gap)
    long, labels = tables(spark, x, y)
    study = md.prepare_study(long, labels)
    for run in (md.pls_da, md.lda_cv):
        out = run(long, labels, study=study, n_permutations=40)
        p, s = out.permuted.first()["p_value"], out.summary.first()
        assert (s["accuracy"] == 1.0 and p < 0.05) if good else p > 0.05


def test_lda_direct():
    x, y = matrix(80, 5, 3, gap=1.5)
    onehot = np.eye(3)[y]
    m = linear.Moments(80.0, x.sum(0), (x * x).sum(0), onehot.sum(0), onehot.T @ x)
    z = scaled(x, "auto")
    vals, vecs = np.linalg.eigh(z.T @ z)
    top = vecs[:, ::-1][:, :4]
    b, c = md.lda_model(m, (*m.scaled("auto")[:2], vals[::-1][:4], top))
    t = z @ top
    mu = np.array([t[y == k].mean(0) for k in range(3)])
    sw = sum((t[y == k] - mu[k]).T @ (t[y == k] - mu[k]) for k in range(3)) / 77
    score = t @ np.linalg.inv(sw) @ mu.T - 0.5 * np.einsum("ij,jk,ik->i", mu, np.linalg.inv(sw), mu) + np.log(onehot.mean(0))
    assert np.allclose(x @ b + c, score, atol=1e-6)


@pytest.mark.parametrize("kind", ["pls", "lda"])
def test_permutations_against_direct_fits(spark, kind, monkeypatch):
    """Every (fold, permutation) by itself, on the data; blocks of a few permutations and samples."""
    monkeypatch.setattr(md, "PERM_BLOCK", 4)
    monkeypatch.setattr(md, "ROW_BLOCK", 16)
    x, y = matrix(45, 4, 3, gap=1.0)
    long, labels = tables(spark, x, y)
    study = md.prepare_study(long, labels, "auto")
    report = (md.pls_da if kind == "pls" else md.lda_cv)(long, labels, "auto", study=study)
    got = md.permutation_test(study, kind, 2, report.summary, 10).toPandas().sort_values("perm")
    rows = study.rows.join(md.permuted_labels(study, 10), "sample").toPandas()
    x, fold, ys = np.vstack(rows["x"]), rows["fold"].to_numpy(), np.vstack(rows["ys"])
    for k in range(10):
        hit = 0
        for f in range(study.folds):
            tr, te = fold != f, fold == f
            mean, std = x[tr].mean(0), x[tr].std(0)
            a, b, onehot = (x[tr] - mean) / std, (x[te] - mean) / std, np.eye(3)[ys[tr, k]]
            if kind == "pls":
                score = b @ nipals(a, onehot - onehot.mean(0), 2)[0] + onehot.mean(0)
            else:
                top = np.linalg.eigh(a.T @ a)[1][:, ::-1][:, :2]
                t, mu = a @ top, np.array([(a @ top)[ys[tr, k] == c].mean(0) for c in range(3)])
                sw = sum((t[ys[tr, k] == c] - mu[c]).T @ (t[ys[tr, k] == c] - mu[c]) for c in range(3)) / (tr.sum() - 3)
                score = b @ top @ np.linalg.inv(sw) @ mu.T - 0.5 * np.einsum("ij,jk,ik->i", mu, np.linalg.inv(sw), mu) + np.log(onehot.mean(0))
            hit += (score.argmax(1) == ys[te, k]).sum()
        assert got["accuracy"].iloc[k] == pytest.approx(hit / 45)


def test_small_data_is_refused(spark):
    x, y = matrix(5, 3, 2)
    long, labels = tables(spark, x, y)
    assert ft.supervised_blocker(labels) is not None
    with pytest.raises(ValueError):
        md.prepare_study(long, labels)
    assert ft.supervised_blocker(labels.where("label = 'c0'")) == "hanya satu kelas"


def test_tails_against_tables():
    assert udfs.t_two_sided(2.228, 10)[0] == pytest.approx(0.05, abs=1e-4)
    assert udfs.t_two_sided(3.169, 10)[0] == pytest.approx(0.01, abs=1e-4)
    assert udfs.f_upper(4.103, 2, 10)[0] == pytest.approx(0.05, abs=1e-4)
    assert udfs.gamma_sf(9.488 / 2, 2)[0] == pytest.approx(0.05, abs=1e-4)
    assert udfs.beta_quantile(0.95, 1, 10) == pytest.approx(1 - 0.05 ** 0.1)
    assert udfs.rank_sum_exact(0, 4, 4) == pytest.approx(2 / 70)
    assert udfs.rank_sum_exact(2, 5, 5) == pytest.approx(2 * 4 / 252)


def test_rank_tests_small(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0], [3.0, 1.0], [4.0, 0.0], [5.0, 5.0], [6.0, 2.0]])
    long, labels = tables(spark, x, np.array([0, 0, 0, 1, 1, 1]))
    got = ft.univariate_rank(long, labels).toPandas().set_index("feature")
    assert got.loc[0, "u"] == 0 and got.loc[0, "p_mannwhitney"] == pytest.approx(0.1)      # exact, no ties


def test_bh_example(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", None)], "f string, p double")
    for block in (None, 2):
        got = ft.benjamini_hochberg(df, "p", blocks=block).toPandas().set_index("f")["q"]
        assert np.allclose(got[list("abcd")], [0.02, 0.04, 0.04, 0.02]) and np.isnan(got["e"])


@pytest.mark.parametrize("blocks", [None, 50])
def test_pqn_with_zeros(spark, blocks):
    x, y = matrix(20, 7)
    x = np.where(x < 2.2, 0.0, x)
    total = 100 * x / x.sum(1, keepdims=True)
    ref = np.median(total, 0)
    want = total.copy()
    for i in range(20):
        use = (total[i] > 0) & (ref > 0)
        want[i] = total[i] / np.median(total[i][use] / ref[use])
    got = ft.densify(ft.normalize_samples(tables(spark, x, y)[0], "pqn", blocks)).toPandas().pivot(index="sample", columns="feature", values="value").sort_index()
    assert np.allclose(got, want)


def test_similarity_blocks(spark, monkeypatch):
    x, y = matrix(30, 9)
    x = np.where(x < 2.5, 0.0, x)
    monkeypatch.setattr(ft, "BLOCK_SAMPLES", 7)
    monkeypatch.setattr(ft, "SLAB_FEATURES", 4)
    for method, want in (("cosine", (lambda u: u @ u.T)(x / np.linalg.norm(x, axis=1, keepdims=True))), ("pearson", np.corrcoef(x))):
        got = ft.similarity_matrix(tables(spark, x, y)[0], method).toPandas()
        assert len(got) == 30 * 29 // 2
        assert np.allclose(got["similarity"], [want[int(a[1:]), int(b[1:])] for a, b in zip(got["a"], got["b"])])


def test_similarity_pairs_are_not_shuffled(spark):
    """Pairs come from the task that multiplies their blocks: nothing is exchanged behind the blocks."""
    x, y = matrix(40, 5)
    df = ft.similarity_matrix(tables(spark, x, y)[0], "pearson")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert df.count() == df.select("a", "b").distinct().count() == 40 * 39 // 2 and df.where("a >= b").isEmpty()


@pytest.mark.parametrize("method", ["auto", "pareto", "center"])
def test_scaling_of_absent_cells(spark, method):
    """Cells present and one value per feature for the others give the scaled matrix, cell by cell and as rows."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random((9, 5)) < 0.4, 0.0, rng.normal(3, 2, (9, 5)))
    x[:, 4] = 0.0
    x[0], x[:, 0] = 1.5, np.arange(1, 10)      # no sample is empty
    cells = [(f"s{i}", f"f{j}", float(x[i, j])) for i in range(9) for j in range(5) if x[i, j] != 0.0]
    long = spark.createDataFrame(cells + [("s1", "f4", None)], "sample string, feature string, value double")
    want = scaled(x, method)
    got = ft.scale_features(long, method).toPandas().pivot(index="sample", columns="feature", values="value").sort_index().to_numpy()
    assert got.shape == want.shape and np.allclose(got, want)
    assert ft.scaled_cells(long, method)[0].count() == len(cells) + 1
    rows = {r["sample"]: r["x"] for r in md.scaled_rows(long, [f"f{j}" for j in range(5)], method).collect()}
    assert np.allclose([rows[f"s{i}"] for i in range(9)], want)


def test_two_values_of_a_cell_are_refused(spark):
    long = spark.createDataFrame([("a", "f", 1.0), ("a", "f", 2.0)], "sample string, feature string, value double")
    with pytest.raises(Exception, match="two values"):
        md.wide_rows(long, ["f"]).collect()
