"""Balanced windows against pandas, with one key holding most rows and blocks far smaller than that key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayloom.ordered import average_rank, matrix_cells, numbered, quantiles, running


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 5, n).astype(str)), "v": np.round(rng.normal(size=n), 2), "id": np.arange(n)})
    pdf.loc[rng.random(n) < 0.3, "v"] = 1.25                                 # one value repeated in a third of the rows
    pdf["x"] = np.where(rng.random(n) < 0.7, None, rng.integers(0, 100, n).astype(float))
    pdf["x"] = pdf["x"].astype(float)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(7)
    return pdf, df


@pytest.mark.parametrize("blocks", [None, 30, 80, 1])
def test_row_number_and_sum(skewed, blocks):
    pdf, df = skewed
    want = pdf.sort_values(["v", "id"])
    want = want.assign(rn=want.groupby("k").cumcount() + 1).set_index("id")["rn"]
    got = numbered(df, ["k"], ["v", "id"], "rn", blocks).toPandas().set_index("id")["rn"]
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("blocks", [None, 30])
def test_fill_prev_min(skewed, reverse, blocks):
    pdf, df = skewed
    s = pdf.sort_values(["v", "id"], ascending=not reverse)
    g = s.groupby("k")
    want = pd.DataFrame({"id": s["id"], "f": g["x"].ffill(), "p": g["x"].shift(), "m": g["v"].cummin()}).set_index("id").sort_index()
    got = running(df, ["k"], ["v", "id"], {"f": ("fill", "x"), "p": ("prev", "x"), "m": ("min", "v")}, reverse, blocks).toPandas().set_index("id").sort_index()
    for c in "fpm":
        pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_names=False)


@pytest.mark.parametrize("blocks", [None, 30])
def test_quantiles(skewed, blocks):
    pdf, df = skewed
    got = quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}, blocks).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["v"].quantile([0.25, 0.5, 0.9]).unstack()
    assert np.allclose(got[["a", "b", "c"]], want.sort_index())
    whole = quantiles(df, [], "v", {"m": 0.5}, blocks).first()["m"]
    assert whole == pytest.approx(pdf["v"].median())


@pytest.mark.parametrize("blocks", [None, 30])
def test_weighted_quantiles(spark, blocks):
    rows = [("a", float(v), w) for v, w in zip(range(300), np.random.default_rng(0).integers(1, 5, 300).tolist())]
    df = spark.createDataFrame(rows, "k string, v double, w long")
    flat = np.repeat([r[1] for r in rows], [r[2] for r in rows])
    assert quantiles(df, ["k"], "v", {"m": 0.5}, blocks, weight="w").first()["m"] == pytest.approx(np.median(flat))


@pytest.mark.parametrize("blocks", [None, 30])
def test_average_rank(skewed, blocks):
    pdf, df = skewed
    got = average_rank(df, ["k"], "v", blocks).toPandas()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).groupby(["k", "v"])["r"].first()
    assert np.allclose(got.set_index(["k", "v"])["avg_rank"].sort_index(), want.sort_index())


def test_matrix_cells(spark):
    cells = matrix_cells(spark.range(30).toDF("a"), spark.range(7).toDF("b"), "a")
    assert cells.distinct().count() == cells.count() == 210
