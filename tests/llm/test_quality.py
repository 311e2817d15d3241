"""Quality model: held-out accuracy, features against plain Python, additive scoring, edges."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayloom.llm.common import utf8
from assayloom.llm.quality import FEATURES, features, fit, quality_scores


def test_held_out(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = quality_scores(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    assert len(rows) > 50 and right >= 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


@pytest.mark.parametrize("text", ["", "Hello, World! one two two\nline\nline\n", "ÄÖ é", "A!! B$$ | c\t\tD 12\n\n", "x"])
def test_features_against_plain_python(text):
    other = "padding Text 1\nso that limits matter!"
    got = dict(zip(FEATURES, features(*utf8(pa.array([other, text, None, other])))[1]))
    raw, words = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    low = [w.lower() for w in words]
    size, n = max(len(raw), 1), max(len(words), 1)
    lines = raw.split(b"\n")[:-1] if raw.endswith(b"\n") else raw.split(b"\n") if raw else []
    pairs = list(zip(low, low[1:]))
    want = {"log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "word_length": sum(map(len, words)) / n, "upper": len(re.findall(rb"[A-Z]", raw)) / size,
            "digits": len(re.findall(rb"[0-9]", raw)) / size, "lines": raw.count(b"\n") / size, "wide": sum(c > 127 for c in raw) / size, "exclaims": raw.count(b"!") / size,
            "distinct_words": len(set(low)) / n, "distinct_pairs": len(set(pairs)) / max(len(pairs), 1), "top_word": max([low.count(w) for w in low], default=0) / n,
            "short_words": sum(len(w) <= 3 for w in words) / n, "capital_words": sum(w[:1].isupper() for w in words) / n,
            "symbol_words": sum(bool(re.search(rb"[#$%&*+/<=>@\\^_`{}~\[\]!|]", w)) for w in words) / n}
    for name, value in want.items():
        assert got[name] == pytest.approx(value), name
    if lines:
        # a line is told apart with its end
        ends = [x + b"\n" for x in lines[:-1]] + [lines[-1] + b"\n" * raw.endswith(b"\n")]
        assert got["distinct_lines"] == pytest.approx(len(set(ends)) / len(ends))


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert {(a, b) for a, b, _ in model.pairs} >= {(0, 1)}
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    by_hand = model.intercept + sum(t[np.searchsorted(model.limits[j], x[7, j], side="right")] for j, t in enumerate(model.tables)) + sum(
        t[np.searchsorted(model.pair_limits[a], x[7, a], side="right"), np.searchsorted(model.pair_limits[b], x[7, b], side="right")] for a, b, t in model.pairs)
    assert model.score(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(-by_hand)))


def test_edges(spark):
    docs = spark.createDataFrame([(k, t, "z") for k, t in [(1, None), (2, ""), (None, "a b"), (3, "w " * 50_000), (4, "x"), (4, "x")]], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_scores(docs, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    same = spark.createDataFrame([(4, 1), (4, 0), (4, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert len({r.score for r in quality_scores(docs, same).collect()}) == 1
    assert quality_scores(docs.limit(0), same).collect() == []


def test_repeat_runs_agree(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    run = lambda n: sorted((r.doc_id, r.score) for r in quality_scores(docs.repartition(n), labels.repartition(n), fit_rows=50).collect())
    assert run(2) == run(5)
    assert docs.select(F.max("doc_id")).first()[0] is not None
