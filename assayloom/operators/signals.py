"""Chromatogram signals: clean-up, common grid, baseline, smoothing, alignment, peaks and their clusters.

Points are rows (sample, rt, y); on the common grid they are (sample, i, rt, y) with ``i`` counting from 0. Work on a grid runs in
blocks of neighbouring points. A block carries a rim of points from its neighbours wide enough that its own points come out as they
would on the whole signal, so no task ever holds a whole long run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayloom.functions.text import finite_or_null
from assayloom.ordered import matrix_cells, numbered, quantiles, running, with_blocks, without_blocks
from assayloom.session import cut

GRID_BLOCK = 1 << 17
FEW_SAMPLES = 4_096     # tables of one row per sample up to here are sent to all tasks

# Unit factors to minutes and plausibility limits of a run.
UNIT_FACTORS = {"min": 1.0, "sec": 1.0 / 60.0, "msec": 1.0 / 60000.0, "min_x1000": 1.0 / 1000.0}
CANDIDATE_FACTORS = (1.0, 1.0 / 60.0, 1.0 / 1000.0, 1.0 / 60000.0)
MIN_STEP, MAX_STEP, MIN_RUN, MAX_RUN, DENSE_POINTS = 1e-4, 0.5, 0.5, 400.0, 50


# ---- raw points --------------------------------------------------------------------------------------------

def clean_signal(points: DataFrame) -> DataFrame:
    """Finite times only, missing intensity 0, the first of equal times."""
    rows = points.withColumn("rt", finite_or_null("rt")).where("rt is not null").withColumn("y", F.coalesce(F.nanvl("y", F.lit(0.0)), F.lit(0.0)))
    return rows.groupBy("sample", "rt").agg(F.min_by("y", "ord").alias("y"))


def _steps(points: DataFrame, order: list[str], blocks: int | None) -> DataFrame:
    return running(points, ["sample"], order, {"_before": ("prev", "rt")}, blocks=blocks).withColumn("step", F.col("rt") - F.col("_before"))


def _per_sample(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join a table of one row per sample; a short one travels to the rows, so a few long samples are not dealt by their name."""
    return rows.join(F.broadcast(table) if table.count() <= FEW_SAMPLES else table, "sample")


def scan_interval(points: DataFrame, blocks: int | None = None) -> DataFrame:
    """Median distance of neighbouring times per sample; 0 for a single point."""
    # a median reads its rows several times
    steps = cut(_steps(points, ["rt"], blocks).select("sample", "step"))
    med = quantiles(steps, ["sample"], "step", {"scan_interval": 0.5}, blocks)
    return points.select("sample").distinct().join(med, "sample", "left").fillna(0.0, ["scan_interval"])


def rt_factor(points: DataFrame, unit: str = "auto", hints: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """Factor to minutes per sample.

    ``hints`` may give ``hint`` (unit word of the header), ``event_msec`` (recorded scan interval) and ``prefer`` (a factor).
    """
    if unit != "auto":
        return points.select("sample").distinct().withColumn("factor", F.lit(UNIT_FACTORS[unit]))
    ok = points.withColumn("rt", finite_or_null("rt")).where("rt is not null")
    med = quantiles(_steps(ok, ["rt", "ord"], blocks), ["sample"], "step", {"step": 0.5}, blocks)
    shape = ok.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.min("rt").alias("lo"), F.max("rt").alias("hi")).join(med, "sample", "left")
    given = hints.columns if hints is not None else []
    shape = shape.join(hints, "sample", "left") if hints is not None else shape
    for c, kind in (("hint", "string"), ("event_msec", "double"), ("prefer", "double")):
        if c not in given:
            shape = shape.withColumn(c, F.lit(None).cast(kind))
    step = F.when(F.col("n") > 2, F.col("step")).otherwise(0.0)
    hinted = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNIT_FACTORS.items() for x in kv]), F.coalesce("hint", F.lit("")))
    options = F.array_distinct(F.filter(F.array(F.col("prefer"), hinted, *[F.lit(f) for f in CANDIDATE_FACTORS]), lambda f: f.isNotNull()))
    off = lambda f: F.abs(F.log(step * f / (F.col("event_msec") / 60000.0)))
    nearest = F.array_min(F.transform(options, lambda f, k: F.struct(off(f).alias("d"), k.alias("k"), f.alias("f"))))
    timed = F.when((F.col("event_msec") > 0) & (step > 0) & (nearest["d"] < math.log(2.0)), nearest["f"])

    def plausible(f: Column) -> Column:
        dense = (step * f).between(MIN_STEP, MAX_STEP) & ((F.col("hi") - F.col("lo")) * f).between(MIN_RUN, MAX_RUN)
        return F.when(F.col("n") >= DENSE_POINTS, dense).otherwise((F.col("hi") * f).between(0.2, MAX_RUN))
    first = F.try_element_at(F.filter(options, plausible), F.lit(1))
    return shape.select("sample", F.coalesce(timed, first, F.lit(1.0)).alias("factor"))


def normalize_rt(points: DataFrame, unit: str = "auto", hints: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """Times in minutes."""
    if unit != "auto":
        return points.withColumn("rt", F.col("rt") * F.lit(UNIT_FACTORS[unit]))
    return points.join(rt_factor(points, unit, hints, blocks), "sample").withColumn("rt", F.col("rt") * F.col("factor")).drop("factor")


# ---- common grid -------------------------------------------------------------------------------------------

@dataclass
class Grid:
    low: float
    step: float
    n: int

    def points(self, spark) -> DataFrame:
        """Grid points (i, rt), made block by block."""
        blocks = -(-self.n // GRID_BLOCK)
        i = F.explode(F.sequence(F.col("id") * GRID_BLOCK, F.least(F.col("id") * GRID_BLOCK + GRID_BLOCK - 1, F.lit(self.n - 1))))
        return spark.range(blocks).select(i.alias("i")).withColumn("rt", self.at(F.col("i")))

    def at(self, i: Column) -> Column:
        return F.lit(self.low) + i * F.lit(self.step)


def common_grid(points: DataFrame, rt_range: tuple[float, float] | None = None, blocks: int | None = None) -> Grid:
    """Shared part of all runs, spaced by the median scan interval; three numbers reach the driver."""
    several = points.groupBy("sample").agg(F.min("rt").alias("lo"), F.max("rt").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ends = several.agg(F.max("lo").alias("low"), F.min("hi").alias("high")).first()
    if ends["low"] is None:
        raise ValueError("no sample holds a signal")
    low, high = ends["low"], ends["high"]
    if rt_range is not None:
        low, high = max(low, rt_range[0]), min(high, rt_range[1])
    if high <= low:
        raise ValueError("the time ranges of the samples do not overlap")
    gaps = cut(scan_interval(points, blocks).join(several, "sample", "left_semi"))
    step = quantiles(gaps, [], "scan_interval", {"step": 0.5}).first()["step"]
    return Grid(low, step, math.ceil((high + step * 0.5 - low) / step))


def resample(points: DataFrame, grid: Grid, blocks: int | None = None) -> DataFrame:
    """Linear interpolation on the grid, ends held; every segment between two points fills its own grid points."""
    order = running(points, ["sample"], ["rt"], {"_rt2": ("prev", "rt"), "_y2": ("prev", "y")}, reverse=True, blocks=blocks)
    ends = points.groupBy("sample").agg(F.min("rt").alias("_lo"))
    seg = _per_sample(order, cut(ends))
    index = lambda x: (x - F.lit(grid.low)) / F.lit(grid.step)
    first = F.col("rt") == F.col("_lo")
    lo = F.when(first, 0).otherwise(F.greatest(F.floor(index(F.col("rt"))) - 1, F.lit(0)))
    hi = F.when(F.col("_rt2").isNull(), grid.n - 1).otherwise(F.least(F.ceil(index(F.col("_rt2"))) + 1, F.lit(grid.n - 1)))
    seg = seg.withColumns({"_a": lo.cast("long"), "_b": hi.cast("long"), "_first": first}).where("_a <= _b")
    # long segments are cut into chunks before they are spread out
    chunk = F.explode(F.sequence(F.expr(f"_a div {GRID_BLOCK}"), F.expr(f"_b div {GRID_BLOCK}")))
    seg = seg.withColumn("_k", chunk).withColumn("i", F.explode(F.sequence(F.greatest("_a", F.col("_k") * GRID_BLOCK), F.least("_b", F.col("_k") * GRID_BLOCK + GRID_BLOCK - 1))))
    x = grid.at(F.col("i"))
    inside = ((x >= F.col("rt")) | F.col("_first")) & (F.col("_rt2").isNull() | (x < F.col("_rt2")))
    value = F.when((x <= F.col("rt")) | F.col("_rt2").isNull(), F.col("y")).otherwise(
        (F.col("_y2") - F.col("y")) / (F.col("_rt2") - F.col("rt")) * (x - F.col("rt")) + F.col("y"))
    return seg.where(inside).select("sample", "i", x.alias("rt"), value.alias("y"))


# ---- blocks with a rim -------------------------------------------------------------------------------------

def _rimmed(signal: DataFrame, rim: int, block: int) -> DataFrame:
    """Copy each row into its block and into the neighbours whose rim it lies in."""
    lo, hi = F.expr(f"greatest(i - {rim}, 0) div {block}"), F.expr(f"(i + {rim}) div {block}")
    return signal.withColumn("_blk", F.explode(F.sequence(lo, hi))).withColumn("_own", F.expr(f"i div {block}") == F.col("_blk"))


def _sg_rows(window: int, order: int) -> np.ndarray:
    """Least-squares polynomial smoothing weights: row r smooths position r of a window."""
    x = np.arange(window) - window // 2
    a = np.vander(x, order + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def smooth(signal: DataFrame, window_points: int, order: int = 3, block: int = GRID_BLOCK) -> DataFrame:
    """Savitzky-Golay smoothing; the window is odd and capped by the length, too short a signal stays as it is."""
    return _smoothed(signal, window_points, order, block).select("sample", "i", "rt", F.col("_s").alias("y"))


def _smoothed(signal: DataFrame, window_points: int, order: int, block: int = GRID_BLOCK) -> DataFrame:
    """The signal with its smoothed form ``_s``. It is read several times, so callers cut what is dear to make."""
    size = signal.groupBy("sample").agg((F.max("i") + 1).alias("n"))
    size = cut(size.withColumn("w", F.least(F.lit(int(window_points) | 1), F.expr("(n div 2) * 2 - 1")).cast("int")))
    rows = _per_sample(signal, size)
    windows = sorted(r["w"] for r in size.select("w").distinct().collect())
    parts = []
    for w in windows:
        mine = rows.where(F.col("w") == w)
        if w <= order + 1:
            parts.append(mine.select("sample", "i", "rt", "y", F.col("y").alias("_s")))
            continue
        h, weight = w // 2, _sg_rows(w, order)
        rim = _rimmed(mine, w, max(block, 4 * w))
        near = Window.partitionBy("sample", "_blk").orderBy("i")
        at = lambda k: F.col("y") if k == 0 else (F.lead("y", k) if k > 0 else F.lag("y", -k)).over(near)
        shifted = rim.withColumns({f"_y{k + h}": at(k) for k in range(-h, h + 1)})
        total = sum((F.col(f"_y{j}") * float(weight[h, j]) for j in range(1, w)), F.col("_y0") * float(weight[h, 0]))
        inner = shifted.where("_own").where((F.col("i") >= h) & (F.col("i") < F.col("n") - h)).select("sample", "i", "rt", "y", total.alias("_s"))
        parts.append(inner.unionByName(_smooth_ends(mine, weight, w, h)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _smooth_ends(mine: DataFrame, weight: np.ndarray, w: int, h: int) -> DataFrame:
    """The first and last half window, from the polynomial of the end windows."""
    def end(offset: Column, targets: list[int]) -> DataFrame:
        j = (F.col("i") - offset).cast("int")
        inside = mine.where((F.col("i") >= offset) & (F.col("i") < offset + w)).withColumn("_j", j)
        table = F.array(*[F.array(*[F.lit(float(weight[r, k])) for r in targets]) for k in range(w)])
        rows = inside.select("sample", offset.alias("_o"), "rt", "i", "y", F.posexplode(F.element_at(table, F.col("_j") + 1)).alias("_r", "_c"))
        first = F.lit(targets[0])
        target = F.col("_o") + first + F.col("_r")
        return rows.groupBy("sample", target.cast("long").alias("i")).agg(
            F.sum(F.col("_c") * F.col("y")).alias("_s"), *[F.max(F.when(F.col("i") == target, F.col(c))).alias(c) for c in ("rt", "y")]).select("sample", "i", "rt", "y", "_s")
    return end(F.lit(0), list(range(h))).unionByName(end(F.col("n") - w, list(range(h + 1, w))))


def noise(signal: DataFrame, blocks: int | None = None) -> DataFrame:
    """Robust deviation of the signal around its smoothed form; 0 under 15 points."""
    # read by two medians in a row, so the residual is kept rather than recomputed
    rest = cut(_smoothed(signal, 11, 2).select("sample", (F.col("y") - F.col("_s")).alias("r")))
    mid = cut(quantiles(rest, ["sample"], "r", {"m": 0.5}, blocks))
    dev = _per_sample(rest, mid).withColumn("d", F.abs(F.col("r") - F.col("m")))
    mad = quantiles(dev, ["sample"], "d", {"mad": 0.5}, blocks)
    size = signal.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return size.join(mad, "sample", "left").select("sample", F.when(F.col("n") < 15, 0.0).otherwise(1.4826 * F.col("mad")).alias("noise"))


# ---- baseline ----------------------------------------------------------------------------------------------

def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 blocks with blocks of two rows; the last axis counts the blocks."""
    return a[:, 0, None] * b[None, 0] + a[:, 1, None] * b[None, 1]


def _inverse(a: np.ndarray) -> np.ndarray:
    return np.array([[a[1, 1], -a[0, 1]], [-a[1, 0], a[0, 0]]]) / (a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0])


def _penalised(w: np.ndarray, rhs: np.ndarray, lam: float) -> np.ndarray:
    """Solve (diag(w) + lam * D'D) z = rhs for the second-difference penalty.

    Pairs of points are blocks of a block-tridiagonal system; every second block is eliminated at once until one is left.
    """
    n = len(w)
    size = n + n % 2
    d0, d1, d2 = np.zeros(size), np.zeros(size), np.zeros(size)
    d0[:n], d1[:n - 1], d2[:n - 2] = 6.0, -4.0, 1.0
    d0[[0, n - 1]], d0[[1, n - 2]] = 1.0, 5.0
    d1[[0, n - 2]] = -2.0
    d0, d1, d2 = lam * d0, lam * d1, lam * d2
    d0[:n] += w
    d0[n:] = 1.0
    r = np.pad(rhs, (0, size - n)).reshape(-1, 2).T[:, None]
    a = np.array([[d0[::2], d1[::2]], [d1[::2], d0[1::2]]])
    c = np.array([[d2[::2], np.zeros(size // 2)], [d1[1::2], d2[1::2]]])[:, :, :-1]      # from each block to the next
    levels = []
    while a.shape[2] > 1:
        kept, gone = (a.shape[2] + 1) // 2, a.shape[2] // 2
        inv, left, right = _inverse(a[:, :, 1::2]), c[:, :, ::2], c[:, :, 1::2]
        here, before, after = _times(inv, r[:, :, 1::2]), _times(inv, left.swapaxes(0, 1)), _times(inv[:, :, :kept - 1], right)
        levels.append((here, before, after))
        a, r = a[:, :, ::2].copy(), r[:, :, ::2].copy()
        a[:, :, :gone] -= _times(left, before)
        r[:, :, :gone] -= _times(left, here)
        a[:, :, 1:] -= _times(right.swapaxes(0, 1), after)
        r[:, :, 1:] -= _times(right.swapaxes(0, 1), here[:, :, :kept - 1])
        c = -_times(left[:, :, :kept - 1], after)
    z = _times(_inverse(a), r)
    while levels:
        here, before, after = levels.pop()
        here -= _times(before, z[:, :, :here.shape[2]])
        here[:, :, :after.shape[2]] -= _times(after, z[:, :, 1:])
        both = np.empty((2, 1, z.shape[2] + here.shape[2]))
        both[:, :, ::2], both[:, :, 1::2] = z, here
        z = both
    return z[:, 0].T.reshape(-1)[:n]


def baseline_als(y: np.ndarray, lam: float = 1e7, p: float = 0.001, iterations: int = 10) -> np.ndarray:
    """Asymmetric least-squares baseline of one stretch of signal."""
    if len(y) < 5:
        return np.zeros(len(y))
    w, z = np.ones(len(y)), y
    for _ in range(iterations):
        z = _penalised(w, w * y, lam)
        w = p * (y > z) + (1 - p) * (y < z)
    return z


def baseline(signal: DataFrame, lam: float = 1e7, p: float = 0.001, iterations: int = 10, block: int | None = None) -> DataFrame:
    """Baseline per grid point (sample, i, rt, y, base).

    A disturbance of the solution dies out over ``(lam / p) ** 0.25`` points. The rim spans that distance down to rounding for every
    iteration, so the blocks of a long signal agree with the whole-signal solution.
    """
    reach = math.ceil(37.0 * math.sqrt(2.0) * (lam / p) ** 0.25) * iterations
    block = block or max(1 << 20, 4 * reach)
    kind = dict(signal.dtypes)["sample"]

    def solve(rows: pa.Table) -> pa.Table:
        # columns as they come, without a frame and its copies
        order = np.argsort(rows["i"].to_numpy())
        base = baseline_als(rows["y"].to_numpy()[order], lam, p, iterations)
        own = rows["_own"].to_numpy()[order]
        mine = rows.select(["sample", "i", "rt", "y"]).take(order[own])
        return mine.append_column("base", pa.array(base[own]))
    return _rimmed(signal, reach, block).groupBy("sample", "_blk").applyInArrow(solve, f"sample {kind}, i long, rt double, y double, base double")


def correct_baseline(signal: DataFrame, step: float, smooth_minutes: float = 0.02, lam: float = 1e7, use_baseline: bool = True) -> DataFrame:
    """Baseline removed, smoothed, negative values cut to 0."""
    # smoothing reads its rows several times; the baseline is solved once
    rows = cut(baseline(signal, lam).select("sample", "i", "rt", (F.col("y") - F.col("base")).alias("y"))) if use_baseline else signal
    if smooth_minutes > 0:
        rows = smooth(rows, max(5, round(smooth_minutes / step)))
    return rows.withColumn("y", F.greatest("y", F.lit(0.0)))


# ---- alignment ---------------------------------------------------------------------------------------------

def shift_signal(signal: DataFrame, lags: DataFrame, grid: Grid) -> DataFrame:
    """Move each sample by its lag; places without a source are zero."""
    rows = signal.join(lags.select("sample", "lag"), "sample")
    moved = rows.withColumn("i", F.col("i") + F.col("lag")).where((F.col("i") >= 0) & (F.col("i") < grid.n)).select("sample", "i", "y")
    gap = F.when(F.col("lag") > 0, F.sequence(F.lit(0).cast("long"), F.col("lag").cast("long") - 1)).when(
        F.col("lag") < 0, F.sequence(F.lit(grid.n) + F.col("lag").cast("long"), F.lit(grid.n - 1).cast("long")))
    empty = lags.where("lag <> 0").select("sample", F.explode(gap).alias("i")).withColumn("y", F.lit(0.0))
    return moved.unionByName(empty).select("sample", "i", grid.at(F.col("i")).alias("rt"), "y")


def _best_lags(signal: DataFrame, reference: DataFrame, max_lag: int, block: int = GRID_BLOCK) -> DataFrame:
    """Lag with the largest product sum against the reference per sample, the smallest lag on ties."""
    block = max(block, 4 * max_lag)
    rows = _rimmed(signal.join(reference.select("i", F.col("y").alias("ref")), "i"), max_lag, block)
    kind = dict(signal.dtypes)["sample"]
    lags = np.arange(-max_lag, max_lag + 1)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        first = int(pdf["i"].iloc[0])
        own = pdf[pdf["_own"].to_numpy()]
        at, y = own["i"].to_numpy() - first + max_lag, own["y"].to_numpy()
        ref = np.zeros(len(pdf) + 2 * max_lag)
        ref[max_lag:max_lag + len(pdf)] = pdf["ref"].to_numpy()
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "lag": lags, "score": [float(y @ ref[at + k]) for k in lags]})
    part = rows.groupBy("sample", "_blk").applyInPandas(products, f"sample {kind}, lag int, score double")
    total = part.groupBy("sample", "lag").agg(F.sum("score").alias("score"))
    return total.groupBy("sample").agg(F.min_by("lag", F.struct((-F.col("score")).alias("s"), F.col("lag"))).alias("lag"))


def align_signals(signal: DataFrame, grid: Grid, max_shift: float = 0.3, iterations: int = 2) -> tuple[DataFrame, DataFrame]:
    """Aligned signal and the shift in minutes per sample.

    The first reference is the sample closest to all others: its product with the sum of all unit signals is the row sum of the
    similarity matrix, which needs no pairs. Later references are the mean of the aligned signals.
    """
    max_lag = round(max_shift / grid.step)
    root = signal.select("sample", "i", F.sqrt(F.greatest("y", F.lit(0.0))).alias("y"))
    norm = root.groupBy("sample").agg(F.greatest(F.sqrt(F.sum(F.col("y") ** 2)), F.lit(1e-12)).alias("_n"))
    unit = cut(root.join(norm, "sample").select("sample", "i", (F.col("y") / F.col("_n")).alias("y")))
    together = unit.groupBy("i").agg(F.sum("y").alias("t"))
    closeness = unit.join(together, "i").groupBy("sample").agg(F.sum(F.col("y") * F.col("t")).alias("c"))
    medoid = closeness.orderBy(F.round("c", 9).desc(), "sample").limit(1).select("sample")
    reference = unit.join(medoid, "sample", "left_semi").select("i", "y")
    lags = None
    for _ in range(max(1, iterations)):
        found = cut(_best_lags(unit, reference, max_lag))
        centre = round(found.agg(F.percentile("lag", 0.5).alias("m")).first()["m"])
        lags = found.withColumn("lag", F.col("lag") - int(centre))
        mean = shift_signal(unit, lags, grid).groupBy("i").agg(F.sum("y").alias("y"))
        size = mean.agg(F.greatest(F.sqrt(F.sum(F.col("y") ** 2)), F.lit(1e-12)).alias("s")).scalar()
        reference = cut(mean.withColumn("_s", size).select("i", (F.col("y") / F.col("_s")).alias("y")))
    return shift_signal(signal, lags, grid), lags.select("sample", "lag", (F.col("lag") * F.lit(grid.step)).alias("shift"))


# ---- bins and peaks ----------------------------------------------------------------------------------------

def bin_signal(signal: DataFrame, grid: Grid, width: float) -> DataFrame:
    """Sum of intensity times step per time bin; the last edge belongs to the last bin."""
    end = grid.low + (grid.n - 1) * grid.step
    bins = max(1, math.ceil((end + width - grid.low) / width) - 1)
    guess = F.floor((F.col("rt") - F.lit(grid.low)) / F.lit(width))
    edge = lambda k: F.lit(grid.low) + k * F.lit(width)
    k = F.when(F.col("rt") < edge(guess), guess - 1).when(F.col("rt") >= edge(guess + 1), guess + 1).otherwise(guess)
    k = F.least(F.greatest(k, F.lit(0)), F.lit(bins - 1)).cast("long")
    first_step = (grid.low + grid.step) - grid.low
    out = signal.groupBy("sample", k.alias("bin")).agg((F.sum("y") * F.lit(first_step)).alias("value"))
    return out.withColumn("center", (edge(F.col("bin")) + edge(F.col("bin") + 1)) / 2)


def _local_maxima(y: np.ndarray) -> np.ndarray:
    """Tops of the signal; a flat top counts once, at its middle."""
    change = np.flatnonzero(np.diff(y) != 0)
    starts, stops = np.r_[0, change + 1], np.r_[change, len(y) - 1]
    level = y[starts]
    top = np.zeros(len(starts), dtype=bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[top] + stops[top]) // 2


def _walk(y: np.ndarray, at: int, step: int, stop: int) -> tuple[float, int]:
    """Lowest value and its place between a top and the next higher point (or the stop)."""
    seg = y[at:stop + 1] if step > 0 else y[stop:at + 1][::-1]
    higher = np.flatnonzero(seg > y[at])
    seg = seg[:higher[0]] if len(higher) else seg
    k = int(seg.argmin())
    return float(seg[k]), at + step * k


def _crossing(y: np.ndarray, at: int, step: int, base: int, height: float) -> float:
    """Interpolated place where the flank falls to ``height``, not beyond the base."""
    seg = y[at:base + 1] if step > 0 else y[base:at + 1][::-1]
    below = np.flatnonzero(seg[1:] <= height)
    k = int(below[0]) + 1 if len(below) else len(seg) - 1
    frac = (height - seg[k]) / (seg[k - 1] - seg[k]) if k > 0 and seg[k] < height else 0.0
    return at + step * (k - frac)


def find_peaks(y: np.ndarray, threshold: float, min_width: float) -> list[tuple[int, int, int]]:
    """Apex, left and right bound of every peak with enough prominence and half-height width."""
    low = y.min()
    stops = np.flatnonzero(y == low)
    out = []
    for at in _local_maxima(y):
        if y[at] - low < threshold:
            continue
        k = np.searchsorted(stops, at)
        lo, hi = (int(stops[k - 1]) if k > 0 else 0), (int(stops[k]) if k < len(stops) else len(y) - 1)
        left, left_base = _walk(y, at, -1, lo)
        right, right_base = _walk(y, at, 1, hi)
        prominence = y[at] - max(left, right)
        if prominence < threshold:
            continue
        half = y[at] - prominence * 0.5
        if _crossing(y, at, 1, right_base, half) - _crossing(y, at, -1, left_base, half) < min_width:
            continue
        foot = y[at] - prominence * 0.95
        a = max(math.floor(_crossing(y, at, -1, left_base, foot)), left_base)
        b = min(math.ceil(_crossing(y, at, 1, right_base, foot)), right_base)
        out.append((int(at), a, b))
    return out


def detect_peaks(signal: DataFrame, step: float, min_snr: float = 5.0, min_prominence: float = 0.005, min_width: float = 0.01,
                 block: int = GRID_BLOCK, blocks: int | None = None) -> DataFrame:
    """Peaks of corrected signals: rt, height, area, bounds, signal-to-noise and area percent.

    A point at the sample's lowest value ends every search for a peak's foot. The signal is cut there into independent stretches,
    which are packed into groups of about one block.
    """
    kind = dict(signal.dtypes)["sample"]
    limits = (signal.groupBy("sample").agg(F.max("y").alias("top"), F.min("y").alias("low"), F.count(F.lit(1)).alias("n")).join(noise(signal, blocks), "sample")
              .where("n >= 5 and top > 0").withColumn("threshold", F.greatest(min_snr * F.col("noise"), min_prominence * F.col("top"), F.lit(1e-12))))
    rows = _per_sample(signal, cut(limits.select("sample", "low", "noise", "threshold"))).withColumn("_zero", F.when(F.col("y") == F.col("low"), F.col("i")))
    rows = running(with_blocks(rows, ["i"], blocks), ["sample"], ["i"], {"_start": ("fill", "_zero")}).withColumn("_g", F.expr(f"coalesce(_start, 0) div {block}"))
    rows = without_blocks(running(rows, ["sample"], ["i"], {"_gp": ("prev", "_g")}))
    both = F.when((F.col("_gp") != F.col("_g")), F.array("_gp", "_g")).otherwise(F.array("_g"))
    rows = rows.withColumn("_grp", F.explode(both)).select("sample", "_grp", "i", "rt", "y", "noise", "threshold")
    wide = max(1.0, min_width / step)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        y, rt, level = pdf["y"].to_numpy(), pdf["rt"].to_numpy(), float(pdf["noise"].iloc[0])
        found = find_peaks(y, float(pdf["threshold"].iloc[0]), wide)
        return pd.DataFrame([(pdf["sample"].iloc[0], rt[k], y[k], float(np.trapezoid(y[a:b + 1], rt[a:b + 1])), rt[a], rt[b],
                              y[k] / level if level > 0 else np.inf) for k, a, b in found],
                            columns=["sample", "rt", "height", "area", "start", "end", "snr"])
    peaks = rows.groupBy("sample", "_grp").applyInPandas(
        run, f"sample {kind}, rt double, height double, area double, `start` double, `end` double, snr double")
    return area_percent(cut(peaks))


def area_percent(peaks: DataFrame) -> DataFrame:
    """Share of each peak in the total area of its sample."""
    total = peaks.groupBy("sample").agg(F.sum("area").alias("_t"))
    return peaks.join(total, "sample").withColumn("area_pct", F.when(F.col("_t") > 0, 100.0 * F.col("area") / F.col("_t"))).drop("_t")


def peak_summary(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("sample").agg(F.count(F.lit(1)).alias("n_peaks"), F.sum("area").alias("total_area"))


def number_peaks(peaks: DataFrame, blocks: int | None = None) -> DataFrame:
    """1-based peak number by time per sample."""
    return numbered(peaks, ["sample"], ["rt", "ord"], "peak", blocks)


# ---- clusters across samples -------------------------------------------------------------------------------

def _next_starts(rt: np.ndarray, sample: np.ndarray, tol: float) -> np.ndarray:
    """For a cluster that starts at each peak: the peak that starts the next one."""
    n = len(rt)
    idx = np.arange(n)
    gap = np.r_[np.where(np.diff(rt) > tol, idx[1:], n), n]              # break between k and k + 1
    order = np.lexsort((idx, sample))
    same = np.full(n, n)
    again = sample[order][1:] == sample[order][:-1]
    same[order[:-1][again]] = order[1:][again]                          # next peak of the same sample
    first = np.minimum.accumulate(np.minimum(gap, same)[::-1])[::-1]
    span = np.searchsorted(rt, rt + 2 * tol, side="right")
    return np.minimum(np.minimum(first, span), n)


def cluster_peaks(peaks: DataFrame, tol: float, block: int = 200_000, blocks: int | None = None) -> DataFrame:
    """Add ``cluster``: the sweep by time that starts anew at a gap, a too wide span or a repeated sample.

    Where a cluster ends depends only on where it starts, and it holds at most one peak per sample. So each block of the sorted
    peaks tabulates, for every place a cluster may start near its beginning, where the chain leaves it. Chaining these small
    tables gives every block its true entry; the blocks then mark their cluster starts independently. ``ord`` breaks time ties.
    """
    spark = peaks.sparkSession
    codes = numbered(peaks.groupBy("sample").agg(F.min("ord").alias("_o")), [], ["_o"], "_code").select("sample", "_code")
    rows = cut(numbered(peaks.join(codes, "sample"), [], ["rt", "ord"], "_g", blocks).withColumn("_g", F.col("_g") - 1))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample").alias("s")).first()
    n, width = shape["n"], shape["s"]
    block = max(block, 4 * width)
    lo = F.expr(f"greatest(_g - {width}, 0) div {block}")
    copies = rows.select("_g", "rt", "_code").withColumn("_blk", F.explode(F.sequence(lo, F.expr(f"_g div {block}"))))

    def prepared(pdf: pd.DataFrame) -> tuple[int, int, np.ndarray]:
        pdf = pdf.sort_values("_g")
        first = int(pdf["_g"].iloc[0])
        return first, min(int(pdf["_blk"].iloc[0] + 1) * block, n) - first, _next_starts(pdf["rt"].to_numpy(), pdf["_code"].to_numpy(), tol)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        first, size, nxt = prepared(pdf)
        out = np.arange(len(nxt) + 1)
        for k in range(size - 1, -1, -1):
            out[k] = out[nxt[k]] if nxt[k] < size else nxt[k]
        entries = np.arange(1 if first == 0 else min(width + 1, size))
        return pd.DataFrame({"blk": pdf["_blk"].iloc[0], "entry": first + entries, "leave": first + out[entries]})

    if n <= block:
        entry = spark.createDataFrame([(0, 0)], "blk long, entry long")
    else:
        # tables of one block, two, four and so on: where a sweep that enters a block stands that many blocks later
        parts = -(-n // block)
        tables = [cut(copies.groupBy("_blk").applyInPandas(exits, "blk long, entry long, leave long"))]
        while 1 << len(tables) < parts:
            reach, last = 1 << (len(tables) - 1), tables[-1]
            after = last.select((F.col("blk") - reach).alias("blk"), F.col("entry").alias("leave"), F.col("leave").alias("then"))
            tables.append(cut(last.join(after, ["blk", "leave"]).select("blk", "entry", F.col("then").alias("leave"))))
        # every block number is a sum of such reaches, so the entries of all blocks are known after as many joins
        entry = spark.createDataFrame([(0, 0)], "blk long, entry long")
        for k in reversed(range(len(tables))):
            step = entry.join(tables[k], ["blk", "entry"]).select((F.col("blk") + (1 << k)).alias("blk"), F.col("leave").alias("entry")).where(F.col("blk") < parts)
            entry = cut(entry.unionByName(step))

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        first, size, nxt = prepared(pdf)
        at, found = int(pdf["entry"].iloc[0]) - first, []
        while at < size:
            found.append(first + at)
            at = int(nxt[at])
        return pd.DataFrame({"_g": found}, dtype="int64")
    marks = copies.join(entry.withColumnRenamed("blk", "_blk"), "_blk").groupBy("_blk").applyInPandas(starts, "_g long").withColumn("_s", F.col("_g"))
    out = running(rows.join(marks, "_g", "left"), [], ["_g"], {"cluster": ("fill", "_s")}, blocks=blocks)
    return out.drop("_g", "_s", "_code")


def min_presence(clusters: DataFrame, n_samples: int, fraction: float) -> DataFrame:
    """Clusters found in at least this share of the samples."""
    keep = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") / n_samples >= fraction)
    return clusters.join(keep.select("cluster"), "cluster", "left_semi")


def peak_features(clusters: DataFrame) -> DataFrame:
    """Per cluster: median time, majority name (first by alphabet on ties), mean area to height ratio and member count."""
    rt = quantiles(clusters, ["cluster"], "rt", {"rt": 0.5})
    counts = clusters.where("name is not null and name <> ''").groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("c"))
    names = counts.groupBy("cluster").agg(F.min_by("name", F.struct((-F.col("c")).alias("c"), F.col("name"))).alias("name"))
    ratio = clusters.groupBy("cluster").agg(F.coalesce(F.avg(F.when(F.col("height") > 0, F.col("area") / F.col("height"))), F.lit(0.0)).alias("ratio"),
                                            F.count(F.lit(1)).alias("n_samples"))
    return rt.join(ratio, "cluster").join(names, "cluster", "left").select("cluster", "rt", F.coalesce("name", F.lit("")).alias("name"), "ratio", "n_samples")


def peak_feature_matrix(clusters: DataFrame) -> DataFrame:
    """Area (else height) and height per sample and cluster."""
    return clusters.select("sample", "cluster", F.when(F.col("area") > 0, F.col("area")).otherwise(F.col("height")).alias("area"), "height")


GAP_SLICES = 16     # tasks a time bucket's points are dealt over, at most; features are repeated as often


def found_gaps(clusters: DataFrame, features: DataFrame, signal: DataFrame, noise_levels: DataFrame, tol: float, snr: float = 5.0,
               slices: int = GAP_SLICES) -> DataFrame:
    """Cells without a peak whose largest signal near the feature time stands out of the noise; every other such cell is 0 and has no row.

    Only points that reach their sample's limit meet the features, by time bucket, so rows grow with what stands out and not with samples times
    features. Samples without a positive noise level have no such cells; null times and intensities are skipped.
    """
    width = 2 * tol
    points = signal.select("sample", "rt", "y").join(noise_levels.where("noise > 0").select("sample", "noise"), "sample").where(F.col("y") >= snr * F.col("noise"))
    points = points.select("sample", "rt", "y", F.floor(F.col("rt") / width).alias("_k"), F.pmod(F.xxhash64("sample"), F.lit(slices)).alias("_slice"))
    times = features.select("cluster", F.col("rt").alias("f_rt"), "ratio", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("_slice"))
    times = times.withColumn("_k", F.explode(F.sequence(F.floor((F.col("f_rt") - tol) / width), F.floor((F.col("f_rt") + tol) / width))))
    hits = points.join(times, ["_k", "_slice"]).where((F.col("rt") >= F.col("f_rt") - tol) & (F.col("rt") <= F.col("f_rt") + tol))
    top = hits.groupBy("sample", "cluster").agg(F.max("y").alias("height"), F.first("ratio").alias("ratio"))
    top = top.join(clusters.select("sample", "cluster").distinct(), ["sample", "cluster"], "left_anti")
    return top.select("sample", "cluster", "height", (F.col("height") * F.col("ratio")).alias("area"))


def fill_gaps(clusters: DataFrame, features: DataFrame, signal: DataFrame, noise_levels: DataFrame, tol: float, snr: float = 5.0) -> DataFrame:
    """``found_gaps`` with a row for every cell without a peak; 0 where the signal stays in the noise."""
    cells = matrix_cells(noise_levels.select("sample"), features.select("cluster"), "sample")
    missing = cells.join(clusters.select("sample", "cluster").distinct(), ["sample", "cluster"], "left_anti")
    found = found_gaps(clusters, features, signal, noise_levels, tol, snr)
    return missing.join(found, ["sample", "cluster"], "left").select("sample", "cluster", F.coalesce("height", F.lit(0.0)).alias("height"),
                                                                     F.coalesce("area", F.lit(0.0)).alias("area"))
