"""Queries over chromatogram-like signals from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.operators import features as ft, signals as op
from assayloom.plans import bindings as b
from assayloom.plans.registry import query
from assayloom.plans.screening import r6
from assayloom.session import cut

POINTS = "pts AS (SELECT 'S' || (user_id % 12) AS sample, (epoch_us(ts) % 86400000000) / 60000000 AS rt, value AS y, event_id AS ord FROM events)"
CLEAN = POINTS + ", clean AS (SELECT sample, rt, arg_min(y, ord) AS y FROM pts GROUP BY 1, 2)"
STEPS = CLEAN + """, iv AS (SELECT sample, median(d) AS scan_interval FROM (SELECT sample, rt - lag(rt) OVER (PARTITION BY sample ORDER BY rt) AS d FROM clean) GROUP BY 1)"""
GRID = STEPS + """, gp AS (SELECT (SELECT max(lo) FROM e) AS low, (SELECT min(hi) FROM e) AS high, (SELECT median(scan_interval) FROM iv) AS step FROM (SELECT 1)),
 gn AS (SELECT low, step, CAST(ceil((high + step * 0.5 - low) / step) AS BIGINT) AS n FROM gp),
 grid AS (SELECT i, low + i * step AS rt FROM gn, LATERAL (SELECT unnest(range(n)) AS i))"""
GRID = GRID.replace(", gp AS", ", e AS (SELECT sample, min(rt) AS lo, max(rt) AS hi FROM clean GROUP BY 1), gp AS")
SIGNAL = GRID + """, seg AS (SELECT sample, rt, y, lead(rt) OVER w AS rt2, lead(y) OVER w AS y2 FROM clean WINDOW w AS (PARTITION BY sample ORDER BY rt)),
 sig AS (SELECT q.sample, q.i, q.rt, CASE WHEN rt2 IS NULL THEN y ELSE (y2 - y) / (rt2 - s.rt) * (q.rt - s.rt) + y END AS y
  FROM (SELECT sample, i, grid.rt FROM (SELECT DISTINCT sample FROM clean), grid) q ASOF JOIN seg s ON q.sample = s.sample AND q.rt >= s.rt)"""


def points(spark, sf):
    micros = b.day_micros("ts")
    return b.table(spark, sf, "events").select(F.concat(F.lit("S"), F.col("user_id") % 12).alias("sample"), (micros / 60000000).alias("rt"),
                                               F.col("value").alias("y"), F.col("event_id").alias("ord"))


def clean(spark, sf):
    return op.clean_signal(points(spark, sf))


def gridded(spark, sf):
    """Grid and signal; both the cleaned points and the signal are read several times by what follows."""
    rows = cut(clean(spark, sf))
    grid = op.common_grid(rows)
    return grid, cut(op.resample(rows, grid))


def corrected(spark, sf):
    grid, signal = gridded(spark, sf)
    return grid, cut(op.correct_baseline(signal, grid.step, smooth_minutes=7 * grid.step))


@query("P23_clean_signal", f"WITH {CLEAN} SELECT * FROM clean")
def _(spark, sf):
    return clean(spark, sf)


@query("W8_scan_interval", f"WITH {STEPS} SELECT sample, round(scan_interval, 9) AS scan_interval FROM iv")
def _(spark, sf):
    return op.scan_interval(clean(spark, sf)).select("sample", F.round("scan_interval", 9).alias("scan_interval"))


UNITS = """raw AS (SELECT 'U' || (user_id % 30) AS sample, event_id AS ord, ((epoch_us(ts) % 86400000000) / 60000000) / 4 * CASE user_id % 5 WHEN 1 THEN 60 WHEN 2 THEN 1000 WHEN 3 THEN 60000 WHEN 4 THEN 60 ELSE 1 END AS rt, user_id % 5 AS u FROM events),
 d AS (SELECT sample, median(step) AS step FROM (SELECT sample, rt - lag(rt) OVER (PARTITION BY sample ORDER BY rt, ord) AS step FROM raw) GROUP BY 1),
 sh AS (SELECT sample, count(*) AS n, min(rt) AS lo, max(rt) AS hi, min(u) AS u, any_value(step) AS step FROM raw JOIN d USING (sample) GROUP BY 1),
 opt AS (SELECT sample, k, f, step, lo, hi, n, u, CASE WHEN n >= 50 THEN step * f BETWEEN 1e-4 AND 0.5 AND (hi - lo) * f BETWEEN 0.5 AND 400 ELSE hi * f BETWEEN 0.2 AND 400 END AS ok
  FROM sh, LATERAL (VALUES (0, CASE WHEN u = 4 THEN 1.0::DOUBLE / 60 WHEN u = 2 THEN 1.0::DOUBLE / 60000 END), (1, 1.0::DOUBLE), (2, 1.0::DOUBLE / 60), (3, 1.0::DOUBLE / 1000), (4, 1.0::DOUBLE / 60000)) o(k, f) WHERE f IS NOT NULL),
 ev AS (SELECT DISTINCT ON (sample) sample, f FROM opt WHERE u = 3 AND abs(ln(step * f / (6000.0::DOUBLE / 60000))) < ln(2) ORDER BY sample, abs(ln(step * f / (6000.0::DOUBLE / 60000))), k),
 pl AS (SELECT DISTINCT ON (sample) sample, f FROM opt WHERE ok ORDER BY sample, k)"""


def raw_units(spark, sf):
    micros, u = b.day_micros("ts"), F.col("user_id") % 5
    scale = F.when(u == 1, 60).when(u == 2, 1000).when(u == 3, 60000).when(u == 4, 60).otherwise(1)
    rows = b.table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id") % 30).alias("sample"), F.col("event_id").alias("ord"),
                                               (micros / 60000000 / 4 * scale).alias("rt"), F.col("value").alias("y"), u.alias("u"))
    hints = rows.groupBy("sample").agg(F.min("u").alias("u")).select(
        "sample", F.when(F.col("u") == 4, "sec").when(F.col("u") == 2, "msec").alias("hint"), F.when(F.col("u") == 3, 6000.0).alias("event_msec"))
    return rows, hints


@query("P24_rt_factor", f"WITH {UNITS} SELECT sample, round(coalesce(ev.f, pl.f, 1), 12) AS factor FROM sh LEFT JOIN ev USING (sample) LEFT JOIN pl USING (sample)")
def _(spark, sf):
    rows, hints = raw_units(spark, sf)
    return op.rt_factor(rows, "auto", hints).select("sample", F.round("factor", 12).alias("factor"))


@query("P24_normalize_rt", f"WITH {UNITS} SELECT ord, sample, round(rt * coalesce(ev.f, pl.f, 1), 6) AS rt FROM raw LEFT JOIN ev USING (sample) LEFT JOIN pl USING (sample)")
def _(spark, sf):
    rows, hints = raw_units(spark, sf)
    return op.normalize_rt(rows, "auto", hints).select("ord", "sample", *r6("rt"))


@query("P12_common_grid", f"WITH {GRID} SELECT i, round(rt, 6) AS rt FROM grid")
def _(spark, sf):
    return op.common_grid(clean(spark, sf)).points(spark).select("i", *r6("rt"))


@query("J17_resample", f"WITH {SIGNAL} SELECT sample, i, round(rt, 6) AS rt, round(y, 6) AS y FROM sig")
def _(spark, sf):
    return gridded(spark, sf)[1].select("sample", "i", *r6("rt", "y"))


def _smooth_sql(window: int, order: int) -> str:
    w = op._sg_rows(window, order)
    rows = ", ".join("[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in r) + "]" for r in w)
    h = window // 2
    return f"""wt AS (SELECT [{rows}] AS w), arr AS (SELECT sample, list(y ORDER BY i) AS ys, count(*) AS n FROM sig GROUP BY 1),
 pos AS (SELECT sample, ys, n, i, least(greatest(i - {h}, 0), n - {window}) AS s FROM arr, LATERAL (SELECT unnest(range(n)) AS i)),
 smo AS (SELECT sample, i, ys[i + 1] AS y0, list_inner_product(ys[s + 1:s + {window}], w[i - s + 1]) AS y FROM pos, wt)"""


@query("W10_smooth", f"WITH {SIGNAL}, {_smooth_sql(9, 3)} SELECT sample, i, round(y, 6) AS y FROM smo")
def _(spark, sf):
    return op.smooth(gridded(spark, sf)[1], 9).select("sample", "i", *r6("y"))


@query("A21_noise", f"""WITH {SIGNAL}, {_smooth_sql(11, 2)}, r AS (SELECT sample, y0 - y AS r FROM smo), m AS (SELECT sample, median(r) AS m FROM r GROUP BY 1)
 SELECT sample, round(1.4826 * median(abs(r - m)), 6) AS noise FROM r JOIN m USING (sample) GROUP BY 1""")
def _(spark, sf):
    return op.noise(gridded(spark, sf)[1]).select("sample", *r6("noise"))


@query("W11_shift_signal", f"""WITH {SIGNAL}, lg AS (SELECT DISTINCT sample, CAST(CAST(substr(sample, 2) AS INT) % 7 - 3 AS INT) AS lag FROM sig)
 SELECT a.sample, a.i, round(coalesce(s.y, 0), 6) AS y FROM (SELECT sample, lag, i FROM lg, grid) a LEFT JOIN sig s ON s.sample = a.sample AND s.i = a.i - a.lag""")
def _(spark, sf):
    grid, signal = gridded(spark, sf)
    lags = signal.select("sample").distinct().withColumn("lag", F.substr("sample", F.lit(2)).cast("int") % 7 - 3)
    return op.shift_signal(signal, lags, grid).select("sample", "i", *r6("y"))


@query("A20_bin_signal", f"""WITH {SIGNAL}, bx AS (SELECT greatest(1, CAST(ceil(((low + (n - 1) * step) + 7.5 - low) / 7.5) AS BIGINT) - 1) AS bins FROM gn)
 SELECT sample, least(CAST(floor((rt - low) / 7.5) AS BIGINT), bins - 1) AS bin, round(sum(y) * ((low + step) - low), 4) AS value FROM sig, gn, bx GROUP BY 1, 2, low, step""")
def _(spark, sf):
    grid, signal = gridded(spark, sf)
    return op.bin_signal(signal, grid, 7.5).select("sample", "bin", F.round("value", 4).alias("value"))


@query("A36_class_mean_signal", f"""WITH {SIGNAL}, lab AS (SELECT DISTINCT sample, 'K' || (CAST(substr(sample, 2) AS INT) % 3) AS label FROM sig)
 SELECT label, i, round(avg(y), 6) AS y FROM sig JOIN lab USING (sample) GROUP BY 1, 2""")
def _(spark, sf):
    _, signal = gridded(spark, sf)
    return ft.class_mean_signal(signal, sample_labels(signal)).select("label", "i", *r6("y"))


def sample_labels(signal):
    k = F.substr("sample", F.lit(2)).cast("int")
    return signal.select("sample").distinct().select("sample", F.concat(F.lit("K"), k % 3).alias("label"), k.alias("ord"))


@query("J21_mirror_pairs", f"""WITH {SIGNAL}, m AS (SELECT 'K' || (CAST(substr(sample, 2) AS INT) % 3) AS label, i, avg(y) AS y FROM sig GROUP BY 1, 2)
 SELECT p.label AS a, q.label AS b, round(sum(p.y * q.y) / sqrt(sum(p.y * p.y) * sum(q.y * q.y)), 6) AS cosine, round(greatest(max(p.y), max(q.y)), 6) AS scale FROM m p JOIN m q ON p.i = q.i AND p.label < q.label GROUP BY 1, 2""")
def _(spark, sf):
    _, signal = gridded(spark, sf)
    return ft.mirror_pairs(signal, sample_labels(signal)).select("a", "b", *r6("cosine", "scale"))


# ---- whole-signal kernels: tested against brute force --------------------------------------------------------

@query("W14_correct_baseline")
def _(spark, sf):
    return corrected(spark, sf)[1]


@query("W13_align_signals")
def _(spark, sf):
    grid, signal = corrected(spark, sf)
    return op.align_signals(signal, grid, max_shift=10 * grid.step)[1]


@query("W12_detect_peaks")
def _(spark, sf):
    grid, signal = corrected(spark, sf)
    return op.detect_peaks(signal, grid.step, min_snr=1.0)


# ---- reported peaks --------------------------------------------------------------------------------------------

PEAKS = "peaks AS (SELECT 'P' || (user_id % 10) AS sample, (epoch_us(ts) % 86400000000) / 60000000 AS rt, value AS area, value / 2 AS height, event_type AS name, event_id AS ord FROM events)"


def peaks(spark, sf):
    micros = b.day_micros("ts")
    return b.table(spark, sf, "events").select(F.concat(F.lit("P"), F.col("user_id") % 10).alias("sample"), (micros / 60000000).alias("rt"), F.col("value").alias("area"),
                                               (F.col("value") / 2).alias("height"), F.col("event_type").alias("name"), F.col("event_id").alias("ord"))


@query("A34_peak_summary", f"WITH {PEAKS} SELECT sample, count(*) AS n_peaks, round(sum(area), 4) AS total_area FROM peaks GROUP BY 1")
def _(spark, sf):
    return op.peak_summary(peaks(spark, sf)).withColumn("total_area", F.round("total_area", 4))


@query("A34_area_percent", f"WITH {PEAKS} SELECT ord, sample, round(100 * area / sum(area) OVER (PARTITION BY sample), 6) AS area_pct FROM peaks")
def _(spark, sf):
    return op.area_percent(peaks(spark, sf)).select("ord", "sample", *r6("area_pct"))


@query("W7_number_peaks", f"WITH {PEAKS} SELECT ord, sample, row_number() OVER (PARTITION BY sample ORDER BY rt, ord) AS peak FROM peaks")
def _(spark, sf):
    return op.number_peaks(peaks(spark, sf)).select("ord", "sample", "peak")


@query("A18_cluster_peaks")
def clustered(spark, sf):
    """The sweep is sequential; it is tested against a plain loop."""
    return op.cluster_peaks(peaks(spark, sf), 0.25).select("sample", "rt", "area", "height", "name", "ord", "cluster")


BINNED = PEAKS + ", cl AS (SELECT *, CAST(floor(rt / 2) AS BIGINT) AS cluster FROM peaks)"


def binned_peaks(spark, sf):
    """Peaks with a cluster taken from two-minute bins, which SQL can repeat."""
    return peaks(spark, sf).withColumn("cluster", F.floor(F.col("rt") / 2))


@query("A19_peak_features", f"""WITH {BINNED}, nm AS (SELECT DISTINCT ON (cluster) cluster, name FROM (SELECT cluster, name, count(*) AS c FROM cl GROUP BY 1, 2) ORDER BY cluster, c DESC, name)
 SELECT cluster, round(median(rt), 6) AS rt, any_value(nm.name) AS name, round(avg(area / height) FILTER (height > 0), 6) AS ratio, count(*) AS n_samples FROM cl JOIN nm USING (cluster) GROUP BY 1""")
def _(spark, sf):
    return op.peak_features(binned_peaks(spark, sf)).select("cluster", *r6("rt"), "name", *r6("ratio"), "n_samples")


@query("A19_peak_feature_matrix", f"WITH {BINNED} SELECT sample, cluster, CASE WHEN area > 0 THEN area ELSE height END AS area, height FROM cl")
def _(spark, sf):
    return op.peak_feature_matrix(binned_peaks(spark, sf))


@query("P13_min_presence", f"WITH {BINNED} SELECT ord, cluster FROM cl WHERE cluster IN (SELECT cluster FROM cl GROUP BY 1 HAVING count(*) / 10 >= 1.2)")
def _(spark, sf):
    return op.min_presence(binned_peaks(spark, sf), 10, 1.2).select("ord", "cluster")


@query("J18_fill_gaps", f"""WITH {BINNED}, f AS (SELECT cluster, median(rt) AS f_rt, avg(area / height) FILTER (height > 0) AS ratio FROM cl GROUP BY 1), nz AS (SELECT sample, avg(height) / 20 AS noise FROM cl GROUP BY 1),
 ms AS (SELECT * FROM nz, f WHERE (sample, cluster) NOT IN (SELECT (sample, cluster) FROM cl)),
 tp AS (SELECT ms.sample, ms.cluster, max(p.height) AS top FROM ms JOIN peaks p ON p.sample = ms.sample AND p.rt >= f_rt - 1.5 AND p.rt <= f_rt + 1.5 GROUP BY 1, 2)
 SELECT sample, cluster, round(CASE WHEN noise > 0 AND coalesce(top, 0) >= 5 * noise THEN top ELSE 0 END, 6) AS height, round(CASE WHEN noise > 0 AND coalesce(top, 0) >= 5 * noise THEN top ELSE 0 END * ratio, 6) AS area FROM ms LEFT JOIN tp USING (sample, cluster)""")
def _(spark, sf):
    rows = binned_peaks(spark, sf)
    level = rows.groupBy("sample").agg((F.avg("height") / 20).alias("noise"))
    signal = rows.select("sample", "rt", F.col("height").alias("y"))
    return op.fill_gaps(rows, op.peak_features(rows), signal, level, 1.5).select("sample", "cluster", *r6("height", "area"))


@query("J18_found_gaps", f"""WITH {BINNED}, f AS (SELECT cluster, median(rt) AS f_rt, avg(area / height) FILTER (height > 0) AS ratio FROM cl GROUP BY 1), nz AS (SELECT sample, avg(height) / 20 AS noise FROM cl GROUP BY 1)
 SELECT p.sample, cluster, round(max(p.height), 6) AS height, round(max(p.height * ratio), 6) AS area FROM peaks p JOIN nz USING (sample) JOIN f ON p.rt >= f_rt - 1.5 AND p.rt <= f_rt + 1.5
 WHERE noise > 0 AND p.height >= 5 * noise AND (p.sample, cluster) NOT IN (SELECT (sample, cluster) FROM cl) GROUP BY p.sample, cluster""")
def _(spark, sf):
    rows = binned_peaks(spark, sf)
    level = rows.groupBy("sample").agg((F.avg("height") / 20).alias("noise"))
    signal = rows.select("sample", "rt", F.col("height").alias("y"))
    return op.found_gaps(rows, op.peak_features(rows), signal, level, 1.5).select("sample", "cluster", *r6("height", "area"))
