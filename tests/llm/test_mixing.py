"""Source mix against plain Python."""

import hashlib
import re

import pytest

from assayloom.llm.mixing import mixed_documents, mixture


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights, cap):
    """Shares by weight; what is above the cap is shared again until nothing is."""
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        want = {s: float(cap * sizes[s]) if s in capped else rest * weights[s] / w for s in sizes}
        more = {s for s in sizes if s not in capped and want[s] > cap * sizes[s]}
        if not more:
            return want
        capped |= more


def brute(rows, cycle=(1, 2, 3), cap=3, seed="mix"):
    """(id, size, source size, target, taken) per row of (id, text, source)."""
    sized = [(i, size_of(t), s) for i, t, s in rows]
    sizes = {}
    for _, n, s in sized:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    want = targets(sizes, {s: cycle[k % len(cycle)] for k, s in enumerate(names)}, cap) if rows else {}
    key = {k: hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest() for k, (i, _, _) in enumerate(sized)}
    copies = []
    for number, s in enumerate(names):
        cum = 0
        for k in sorted((k for k, x in enumerate(sized) if x[2] == s), key=lambda k: (key[k], sized[k][0] is not None, sized[k][0] or 0, sized[k][1])):
            cum += sized[k][1]
            if sized[k][1] and want[s] > 0:
                copies += [((e * sizes[s] + cum) / want[s], number, e, key[k], k) for e in range(cap)]
    taken, used = {}, 0
    for t, *_, k in sorted(copies):
        used += sized[k][1]
        if t > 2 or used > sum(sizes.values()):
            break
        taken[k] = taken.get(k, 0) + 1
    return [(i, n, sizes[s], want[s], n * taken.get(k, 0)) for k, (i, n, s) in enumerate(sized)]


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3], rel=1e-12)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return [tuple(r) for r in mixture(df, **more).select("doc_id", "size", "source_size", "target", "taken").collect()]


def rows_of(n, hot=0.0):
    out = []
    for k in range(n):
        source = "hot" if k < hot * n else ["a", "b", "é", "😀", "z", None, "tiny"][k % 7 if k % 50 else 6]
        out.append((k, "w " * ((k * 7919) % 40 + (k % 13 == 0) * 50), source))
    return out


@pytest.mark.parametrize("per_block", [10_000, 20, 3])
def test_against_plain_python(spark, per_block):
    rows = rows_of(400, 0.4)
    same(run(spark, rows, per_block=per_block), brute(rows))


def test_targets_are_met(spark):
    got = mixture(spark.createDataFrame(rows_of(3000, 0.3), "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-9
    assert all(abs(taken[s] - target[s]) <= 120 for s in target)
    assert sum(taken.values()) <= sum(r.size for r in got)


def test_edges(spark):
    assert run(spark, []) == []
    same(run(spark, [(1, None, None), (2, "", "a")]), [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])
    same(run(spark, [(1, "a b", None)]), [(1, 2, 2, 2.0, 2)])
    rows = [(7, "x y z", "s")] * 5 + [(None, "q", "s"), (None, None, "t"), (8, "w " * 50_000, "t")]
    got = run(spark, rows)
    assert sorted(r[4] for r in got) == sorted(r[4] for r in brute(rows))


def test_documents_come_in_order_and_as_often_as_taken(spark):
    rows = rows_of(300, 0.3)
    df = spark.createDataFrame([(i, t, s, "x", float(i)) for i, t, s in rows], "doc_id long, text string, source string, _size string, target double")
    out = mixed_documents(df, per_block=30)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    times = {i: n // size_of(dict((r[0], r[1]) for r in rows)[i]) for i, _, _, _, n in brute(rows) if n}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == times
