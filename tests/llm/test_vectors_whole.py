"""Vector search over components of any size and over rows that share an id."""

import duckdb
import numpy as np
import pytest

from assayloom.llm.hashing import nearest_neighbours
from assayloom.llm.queries import ORACLES, QUERIES
from assayloom.llm.topk import exact_top_k, limbs

SCHEMA = "vec_id long, embedding array<double>, label int"


def long_vectors(n=160, width=6, seed=4):
    """Whole numbers, so that sums are exact in the SQL too."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 10, (n, width)).astype(float)
    x[3, 0], x[7, 2], x[50, 1], x[60, 0], x[61, 0], x[100] = 4096, -1e6, 1e6, -4096, 4095, 1e6
    x[110:130] = x[7]
    return [(k, row.tolist(), 0) for k, row in enumerate(x)] + [(7, [1.0] * width, 0), (50, [2.0] * width, 0), (9, x[9].tolist(), 0)]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    return sorted(con.execute(ORACLES["op1_exact_top_k"]).fetchall())


def test_registered_query_keeps_long_vectors_and_rows_of_one_id_as_the_sql(spark, tmp_path):
    rows = long_vectors()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op1_exact_top_k"](spark, str(tmp_path)).collect())
    assert got == by_sql(rows)


@pytest.mark.parametrize("more", [{}, {"cell_vectors": 40, "cell_queries": 2}])
def test_ranks_are_exact_at_any_size(spark, more):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 5)) * 10.0 ** rng.choice([-3, 0, 4, 9, 40, 300], (200, 1))
    x[20:40] = x[5]
    x[50], x[51] = [2.0 ** 45, 1, 0, 0, 0], [2.0 ** 45, 2, 0, 0, 0]      # scores differ by less than doubles tell
    rows = [(k, row.tolist(), 0) for k, row in enumerate(x)]
    whole = [[int(v) * 256 if abs(v) >= 2 ** 52 else int(np.floor(v * 256)) for v in r[1]] for r in rows]
    want = []
    for q in range(0, 200, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[k])), k) for k in range(200) if k != q)[:5]
        want += [(q, n + 1, k, -s if limbs(-s) is None else None) for n, (s, k) in enumerate(best)]
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), **more).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want


def test_limbs_sort_like_scores():
    scores = [-10 ** 80, -10 ** 40, -(1 << 63) - 1, -(1 << 63), -5, 0, (1 << 63) - 1, 1 << 63, 10 ** 40, 10 ** 80]
    keys = [(limbs(s) or [0], s if limbs(s) is None else 0) for s in scores]
    assert keys == sorted(keys) and [limbs(s) is None for s in scores] == [False] * 3 + [True] * 4 + [False] * 3


def test_neighbours_of_long_vectors_and_of_each_row(spark):
    rows = [(0, [1e160, 0.0], 0), (1, [1e160, 3e159], 0), (2, [1.0, 0.0], 0), (3, [-1e308, -1e308], 0), (100, [1.0, 1.0], 0), (100, [5.0, 5.0], 0), (2, [5.0, 5.0], 0)]
    run = lambda **more: [tuple(r) for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), best=3, **more).orderBy("query_id", "rank").collect()]
    got = run(each_row=True)
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (100, 1, 2), (100, 2, 2), (100, 3, 2)]
    assert [r[3] for r in got] == pytest.approx([3e159, 1e160, 1e160, 0.0, 1.0, np.sqrt(32)], rel=1e-12)
    assert [r[2] for r in run()] == [1, 2, 100, 2, 0, 1]
