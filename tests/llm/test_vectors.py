"""Exact and approximate vector search against brute force."""

import numpy as np
import pytest

from assayloom.llm.hashing import Index, codes, learn_rotation, nearest_neighbours
from assayloom.llm.topk import branch_and_bound, exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(seed=0, n=400, width=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n // 2:] = x[rng.integers(0, n // 2, n - n // 2)] + (rng.normal(size=(n - n // 2, width)) * 0.05).astype(np.float32)
    x[50:130] = x[50]       # a large group of equal vectors
    rows = [(int(k), [float(v) for v in row], 0) for k, row in enumerate(x)]
    return rows


def usable(rows, zero):
    out = {}
    for i, v, _ in rows:
        if i is None or v is None or not v or any(c is None or not np.isfinite(c) for c in v) or not zero and not any(v):
            continue
        v = [float(np.float32(c)) for c in v]
        out[i] = min(out.get(i, v), v)
    width = max(map(len, out.values()), default=0)
    return {i: np.array(v + [0.0] * (width - len(v))) for i, v in out.items()}


def brute_top(rows, every=50, best=5):
    x = {i: np.floor(256 * v).astype(np.int64) for i, v in usable(rows, True).items()}
    out = []
    for q in sorted(i for i in x if i % every == 0):
        scored = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:best]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    return out


ODD = [(1000, None, 0), (1050, [], 0), (1100, [1.0, None] + [0.0] * 14, 0), (1150, [float("nan")] * 16, 0), (1200, [float("inf")] * 16, 0), (None, [1.0] * 16, 0),
       (1250, [0.5] * 4, 0), (1300, [0.0] * 16, 0), (0, [9.0] * 16, 0), (7, [0.25] * 16, 1), (7, [0.25] * 16, 1)]


@pytest.mark.parametrize("more", [{}, {"cell_vectors": 60, "cell_queries": 3}])
def test_exact_top_k(spark, more):
    rows = table() + ODD
    got = [tuple(r) for r in exact_top_k(spark.createDataFrame(rows, SCHEMA), **more).orderBy("query_id", "rank").collect()]
    assert got == brute_top(rows)


def test_exact_top_k_edges(spark):
    run = lambda rows: [tuple(r) for r in exact_top_k(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect()]
    assert run([]) == [] and run([(0, [1.0], 0)]) == [] and run([(1, [1.0], 0), (2, [1.0], 0)]) == []
    assert run([(0, [-1.0], 0), (3, [2.0], 0), (50, [1.0], 0)]) == [(0, 1, 50, -65536), (0, 2, 3, -131072), (50, 1, 3, 131072), (50, 2, 0, -65536)]


def test_branch_and_bound_drops_pairs_but_no_answers():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-50, 50, (20, 32)).astype(float), rng.integers(-50, 50, (3000, 32)).astype(float)
    qi, ci, s = branch_and_bound(q, c, np.full(20, -1), np.arange(3000), 5, dims=4, chunk=200)
    for k in range(20):
        want = sorted(zip(-(c @ q[k]), range(3000)))[:5]
        assert sorted(zip(-s[qi == k], ci[qi == k])) == want


def brute_near(rows, every=100, best=10):
    x = usable(rows, False)
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((m - m[k]) ** 2).sum(1))
        near = [(d[j], int(ids[j])) for j in np.lexsort((ids, d)) if j != k][:best]
        out[int(ids[k])] = near
    return out


@pytest.mark.parametrize("more", [{"enough": 10_000}, {"enough": 10_000, "cell_vectors": 70, "cell_queries": 2}])
def test_neighbours_are_exact_with_a_wide_radius(spark, more):
    rows = table(1) + ODD
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), **more).orderBy("query_id", "rank").collect()
    want = brute_near(rows)
    assert {r.query_id for r in got} == set(want)
    for q, near in want.items():
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in mine] == list(range(1, len(near) + 1))
        assert [r.vec_id for r in mine] == [i for _, i in near]
        assert [r.score for r in mine] == pytest.approx([d for d, _ in near], rel=1e-12)


def test_recall(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(path)
    rows = [tuple(r) for r in df.collect()]
    got = nearest_neighbours(df).collect()
    want = brute_near(rows)
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert len(got) == sum(map(len, want.values())) and hits >= 0.9 * len(got)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 64))
    code = codes(x, *learn_rotation(x))
    index = Index(code)
    distance = np.unpackbits(code ^ code[3], axis=1).sum(1)
    for enough in (1, 20, 100, 501):
        near = set(index.within(code[3], enough).tolist())
        radius = distance[sorted(near)].max()
        assert {k for k in range(500) if distance[k] <= radius} == near


def test_neighbour_edges(spark):
    run = lambda rows: [tuple(r) for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect()]
    assert run([]) == [] and run([(0, [1.0, 2.0], 0)]) == [] and run([(0, [0.0], 0), (100, [1.0], 0)]) == []
    assert run([(0, [1.0], 0), (1, [4.0], 0), (2, [-2.0], 0)]) == [(0, 1, 1, 3.0), (0, 2, 2, 3.0)]
