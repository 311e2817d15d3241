"""Signal kernels against direct formulas, and blocks against the whole signal."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayloom.operators import signals as sg


def study(n=1200, samples=4, seed=0):
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    rows = []
    for s in range(samples):
        y = 5.0 + 3.0 * i / n + rng.normal(0, 0.2, n)
        for centre, height, width in ((200, 40, 6), (500, 25, 8), (523, 18, 7), (900, 60, 5)):
            y += height * np.exp(-0.5 * ((i - centre - 3 * s) / width) ** 2)
        rows.append(pd.DataFrame({"sample": f"s{s}", "i": i, "rt": 5 + i * 0.01, "y": y}))
    return pd.concat(rows)


@pytest.fixture(scope="module")
def signal(spark):
    pdf = study()
    return pdf, spark.createDataFrame(pdf).repartition(5)


def dense_als(y, lam, p, iterations):
    n = len(y)
    d = np.diff(np.eye(n), 2, axis=0)
    w, z = np.ones(n), y
    for _ in range(iterations):
        z = np.linalg.solve(np.diag(w) + lam * d.T @ d, w * y)
        w = p * (y > z) + (1 - p) * (y < z)
    return z


def test_baseline_solver_matches_dense():
    y = study(333, 1)["y"].to_numpy()
    assert np.allclose(sg.baseline_als(y, 1e4, 0.01), dense_als(y, 1e4, 0.01, 10), rtol=1e-7)
    assert (sg.baseline_als(np.ones(4)) == 0).all()


def test_baseline_blocks_match_whole(spark):
    pdf = study(6000, 1)
    df = spark.createDataFrame(pdf)
    lam, p = 10.0, 0.1                                                       # short reach, so that a block is far shorter than the signal
    whole = sg.baseline_als(pdf["y"].to_numpy(), lam, p, 3)
    got = sg.baseline(df, lam, p, 3, block=1500).toPandas().sort_values("i")
    assert len(got) == 6000 and np.allclose(got["base"], whole, rtol=1e-9)


@pytest.mark.parametrize("n", [5, 6, 7, 64, 65, 301])
def test_solver_of_any_length(n):
    rng = np.random.default_rng(n)
    y, w = rng.random(n) * 10, rng.random(n)
    d = np.diff(np.eye(n), 2, axis=0)
    assert np.allclose(sg._penalised(w, w * y, 50.0), np.linalg.solve(np.diag(w) + 50.0 * d.T @ d, w * y), rtol=1e-8)


def counted(spark, pdf):
    """The signal, and how often its rows have been made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(y):
        made.add(1)
        return y
    return spark.createDataFrame(pdf).withColumn("y", seen.asNondeterministic()("y")), made


def test_baseline_is_solved_once(spark):
    pdf = study(300, 2)
    df, made = counted(spark, pdf)
    assert sg.correct_baseline(df, 0.01, 0.07, 10.0).count() == len(pdf)
    assert made.value < 2 * len(pdf)


def savgol(y, w, order):
    h, out = w // 2, np.empty(len(y))
    for k in range(len(y)):
        a = min(max(k - h, 0), len(y) - w)
        fit = np.polyfit(np.arange(w) - h, y[a:a + w], order)
        out[k] = np.polyval(fit, k - a - h)
    return out


@pytest.mark.parametrize("block", [64, 1 << 17])
def test_smooth(signal, block):
    pdf, df = signal
    got = sg.smooth(df, 9, 3, block).toPandas()
    for s, part in got.groupby("sample"):
        want = savgol(pdf[pdf["sample"] == s]["y"].to_numpy(), 9, 3)
        assert np.allclose(part.sort_values("i")["y"], want, atol=1e-8)


def test_smooth_caps_window_and_keeps_short(spark):
    pdf = pd.concat([study(8, 1), study(4, 1).assign(sample="tiny")])
    got = sg.smooth(spark.createDataFrame(pdf), 11, 3).toPandas()
    want = savgol(pdf[pdf["sample"] == "s0"]["y"].to_numpy(), 7, 3)
    assert np.allclose(got[got["sample"] == "s0"].sort_values("i")["y"], want, atol=1e-8)
    assert np.allclose(got[got["sample"] == "tiny"].sort_values("i")["y"], pdf[pdf["sample"] == "tiny"]["y"])


def test_noise(signal):
    pdf, df = signal
    got = sg.noise(df, blocks=500).toPandas().set_index("sample")["noise"]
    for s, part in pdf.groupby("sample"):
        y = part["y"].to_numpy()
        r = y - savgol(y, 11, 2)
        assert got[s] == pytest.approx(1.4826 * np.median(np.abs(r - np.median(r))))


def brute_peaks(y, threshold, width):
    """Prominence and widths by scanning outwards point by point."""
    out = []
    k = 1
    while k < len(y) - 1:
        j = k
        while j < len(y) - 1 and y[j + 1] == y[k]:
            j += 1
        if y[k - 1] < y[k] and j < len(y) - 1 and y[j + 1] < y[k]:
            at = (k + j) // 2
            bases, lows = [], []
            for step in (-1, 1):
                low, base, q = y[at], at, at
                while 0 <= q < len(y) and y[q] <= y[at]:
                    if y[q] < low:
                        low, base = y[q], q
                    q += step
                bases.append(base); lows.append(low)
            prom = y[at] - max(lows)

            def cross(step, base, level):
                q = at
                while q != base and y[q] > level:
                    q += step
                if y[q] < level:
                    return q - step * (level - y[q]) / (y[q - step] - y[q])
                return q
            half, foot = y[at] - prom / 2, y[at] - 0.95 * prom
            if prom >= threshold and cross(1, bases[1], half) - cross(-1, bases[0], half) >= width:
                out.append((at, max(int(np.floor(cross(-1, bases[0], foot))), bases[0]), min(int(np.ceil(cross(1, bases[1], foot))), bases[1])))
        k = j + 1
    return out


@pytest.mark.parametrize("seed", range(5))
def test_find_peaks_matches_scan(seed):
    rng = np.random.default_rng(seed)
    y = np.clip(np.convolve(rng.normal(size=800), np.ones(7) / 7, "same"), 0, None)
    y = np.round(y, 2)                                                       # plateaus and ties
    assert sg.find_peaks(y, 0.2, 1.0) == brute_peaks(y, 0.2, 1.0)


@pytest.mark.parametrize("block", [100, 1 << 17])
def test_detect_peaks_blocks(spark, signal, block):
    pdf, _ = signal
    flat = pdf.assign(y=np.clip(pdf["y"] - 9.0, 0, None))
    df = spark.createDataFrame(flat)
    levels = sg.noise(df).toPandas().set_index("sample")["noise"]
    got = sg.detect_peaks(df, 0.01, block=block, blocks=300).toPandas()
    for s, part in flat.groupby("sample"):
        y, rt = part["y"].to_numpy(), part["rt"].to_numpy()
        want = brute_peaks(y, max(5 * levels[s], 0.005 * y.max()), 1.0)
        mine = got[got["sample"] == s].sort_values("rt")
        assert np.allclose(mine["rt"], [rt[a] for a, _, _ in want])
        assert np.allclose(mine["area"], [np.trapezoid(y[a:b + 1], rt[a:b + 1]) for _, a, b in want])
        assert mine["area_pct"].sum() == pytest.approx(100.0)


def test_peak_area_is_gaussian_integral(spark):
    i = np.arange(2000)
    y = 100 * np.exp(-0.5 * ((i - 1000) / 12) ** 2)
    y[y < 1e-6] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"sample": "a", "i": i, "rt": i * 0.005, "y": y}))
    peak = sg.detect_peaks(df, 0.005).toPandas()
    assert len(peak) == 1 and peak["rt"][0] == pytest.approx(5.0)
    assert peak["area"][0] == pytest.approx(100 * 12 * 0.005 * np.sqrt(2 * np.pi), rel=0.06)


def test_alignment_recovers_shift(spark, signal):
    pdf, _ = signal
    df = spark.createDataFrame(pdf.assign(y=np.clip(pdf["y"] - 9.0, 0, None)))
    grid = sg.Grid(5.0, 0.01, 1200)
    aligned, lags = sg.align_signals(df, grid, max_shift=0.2)
    lag = lags.toPandas().set_index("sample")["lag"]
    assert [lag[f"s{s}"] - lag["s0"] for s in range(4)] == [0, -3, -6, -9]
    assert aligned.count() == 4800 and aligned.select("sample", "i").distinct().count() == 4800


def test_best_lag_blocks(spark, signal):
    pdf, df = signal
    ref = df.where("sample = 's0'").select("i", "y")
    a = sg._best_lags(df, ref, 15).toPandas().set_index("sample")["lag"].sort_index()
    b = sg._best_lags(df, ref, 15, block=100).toPandas().set_index("sample")["lag"].sort_index()
    assert a.equals(b) and a["s0"] == 0


def plain_clusters(rows, tol):
    """Sweep by time, one peak after the other."""
    out, current, members = [], [], set()
    for rt, sample, ord_ in sorted(rows, key=lambda r: (r[0], r[2])):
        if current and (rt - current[-1][0] > tol or rt - current[0][0] > 2 * tol or sample in members):
            out.append(frozenset(r[2] for r in current)); current, members = [], set()
        current.append((rt, sample, ord_)); members.add(sample)
    return set(out + [frozenset(r[2] for r in current)])


@pytest.mark.parametrize("block,spread", [(200_000, 40.0), (24, 40.0), (24, 4.0)])
def test_cluster_peaks_matches_sweep(spark, block, spread):
    rng = np.random.default_rng(3)
    rows = [(float(np.round(rng.uniform(0, spread), 3)), f"s{rng.integers(0, 6)}", k) for k in range(500)]
    df = spark.createDataFrame(rows, "rt double, sample string, ord long").repartition(4)
    got = sg.cluster_peaks(df, 0.05, block=block, blocks=100).toPandas()
    assert {frozenset(p["ord"]) for _, p in got.groupby("cluster")} == plain_clusters(rows, 0.05)


def test_resample_and_grid(spark):
    rng = np.random.default_rng(5)
    pdf = pd.concat([pd.DataFrame({"sample": s, "rt": np.sort(rng.uniform(0, 50, 400)), "y": rng.normal(size=400)}) for s in "ab"])
    pdf["ord"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf)
    grid = sg.common_grid(df, blocks=100)
    got = sg.resample(df, grid, blocks=100).toPandas()
    at = grid.low + np.arange(grid.n) * grid.step
    steps = [np.median(np.diff(p["rt"])) for _, p in pdf.groupby("sample")]
    assert grid.step == pytest.approx(np.median(steps))
    for s, p in pdf.groupby("sample"):
        mine = got[got["sample"] == s].sort_values("i")
        assert mine["i"].tolist() == list(range(grid.n))
        assert np.allclose(mine["y"], np.interp(at, p["rt"], p["y"]))


def test_grid_without_overlap_is_an_error(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 0), ("a", 1.0, 1.0, 1), ("b", 5.0, 1.0, 2), ("b", 6.0, 1.0, 3)], "sample string, rt double, y double, ord long")
    with pytest.raises(ValueError):
        sg.common_grid(df)


def test_bins_keep_mass(signal):
    _, df = signal
    grid = sg.Grid(5.0, 0.01, 1200)
    mass = df.groupBy("sample").agg(F.sum("y").alias("m")).toPandas().set_index("sample")["m"] * 0.01
    bins = sg.bin_signal(df, grid, 0.25).groupBy("sample").agg(F.sum("value").alias("m")).toPandas().set_index("sample")["m"]
    assert np.allclose(mass.sort_index(), bins.sort_index())


def test_gaps_against_loops(spark):
    """Cells that stand out, and the same with all other empty cells as zeros; bucket ends, no noise and null points included."""
    rng = np.random.default_rng(3)
    noise = {"a": 1.0, "b": 2.0, "c": 0.0}
    features = [(k, float(t), 2.0 + k) for k, t in enumerate([0.5, 1.0, 1.05, 3.0, 7.25])]
    points = [(s, round(float(t), 2), float(y)) for s in noise for t, y in zip(rng.uniform(0, 8, 40), rng.uniform(0, 12, 40))]
    points += [("a", 1.2, 11.0), ("a", 2.8, 5.0), ("b", None, 50.0), ("b", 3.0, None)]
    have = [("a", 0), ("b", 3), ("b", 3), ("c", 1)]
    want = {}
    for s, level in noise.items():
        for c, t, ratio in features:
            if (s, c) not in have:
                top = max((y for p, r, y in points if p == s and r is not None and y is not None and t - 0.2 <= r <= t + 0.2), default=0.0)
                height = top if level > 0 and top >= 5 * level else 0.0
                want[s, c] = (height, height * ratio)
    tables = (spark.createDataFrame(have, "sample string, cluster long"), spark.createDataFrame(features, "cluster long, rt double, ratio double"),
              spark.createDataFrame(points, "sample string, rt double, y double"), spark.createDataFrame(list(noise.items()), "sample string, noise double"))
    read = lambda df: {(r["sample"], r["cluster"]): (r["height"], r["area"]) for r in df.collect()}
    assert read(sg.fill_gaps(*tables, 0.2)) == want
    found = sg.found_gaps(*tables, 0.2)
    assert read(found) == {k: v for k, v in want.items() if v[0] > 0} and len(read(found)) > 2
    assert sg.found_gaps(tables[0], tables[1], tables[2].limit(0), tables[3], 0.2).count() == 0
