"""Exact top-k inner products by columnar branch and bound.

Inside a cell the candidates stand in vertical layout, one row per dimension, the dimensions with most mass first. Scores grow block by
block of dimensions. After each block the pairs go whose score so far plus the largest possible rest (product of the lengths of what
is left of both vectors) is below the query's k-th best score; the others are compacted for the next block.

Scores of long vectors pass the whole numbers a double holds. Pairs with one of those are sifted by scores in doubles with a bound of
their error, and what may be among the best is scored and ranked in whole numbers of any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayloom.llm import vectors

DIMS = 8            # dimensions per block
CHUNK = 4_096       # candidates at a time
QUERIES = 256       # queries at a time
SIFTED = 64         # queries at a time where pairs are sifted
SHORT = float(1 << 25)      # vectors below this length: all sums of their products are exact in doubles
LIMB = 63           # bits of a limb of a score beyond a long


def branch_and_bound(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, best: int, dims: int = DIMS, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and candidates and the scores of the best pairs; whole numbers in, whole numbers out."""
    order = np.argsort(-(c ** 2).sum(0), kind="stable")
    q, c = q[:, order], np.ascontiguousarray(c[:, order].T)
    cuts = [*range(0, len(c), dims), len(c)]
    rest = lambda m, axis, k: np.sqrt((m.take(range(cuts[k], len(c)), axis) ** 2).sum(axis))
    q_rest = [rest(q, 1, k) for k in range(len(cuts))]
    c_rest = [rest(c, 0, k) for k in range(len(cuts))]
    top_q, top_c, top_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(q), -np.inf)
    step = min(256, chunk)      # a short first chunk sets the limits
    at = 0
    while at < c.shape[1]:
        end = min(at + step, c.shape[1])
        step = chunk
        partial = q[:, :cuts[1]] @ c[:cuts[1], at:end]
        alive = partial + q_rest[1][:, None] * c_rest[1][None, at:end] * (1 + 1e-9) + 0.5 >= floor[:, None]
        alive &= q_ids[:, None] != c_ids[None, at:end]
        qi, ci = np.nonzero(alive)
        score = partial[qi, ci]
        ci = ci + at
        for k in range(1, len(cuts) - 1):
            block = slice(cuts[k], cuts[k + 1])
            score = score + np.einsum("ij,ji->i", q[qi, block], c[block][:, ci])
            keep = score + q_rest[k + 1][qi] * c_rest[k + 1][ci] * (1 + 1e-9) + 0.5 >= floor[qi]
            qi, ci, score = qi[keep], ci[keep], score[keep]
        top_q, top_c, top_s = np.concatenate([top_q, qi]), np.concatenate([top_c, ci]), np.concatenate([top_s, score])
        keep = vectors.first_per_query(top_q, top_c, top_s, best)
        top_q, top_c, top_s = top_q[keep], top_c[keep], top_s[keep]
        count = np.bincount(top_q, minlength=len(q))
        last = np.cumsum(count) - 1
        floor[count == best] = top_s[last[count == best]]
        at = end
    return top_q, top_c, top_s


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's whole numbers."""
    return np.array([[int(v) * scale if abs(v) >= 1 << 52 else math.floor(v * scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def sift_and_rank(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, best: int, scale: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The same as ``branch_and_bound`` for floor(scale * x) of finite vectors of any length."""
    def over_power(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """floor(scale * x) / (scale * 2**e), of at most about one, and e."""
        e = np.frexp(np.abs(x).max(1))[1]
        small = np.abs(x) < 1 << 52
        return np.ldexp(np.where(small, np.floor(np.where(small, x, 0) * scale) / scale, x), -e[:, None]), e
    (y, _), (z, e) = over_power(q), over_power(c)
    lift = np.ldexp(1.0, e - e.max())
    length = lambda m: np.sqrt((m ** 2).sum(1))
    error = (q.shape[1] + 8) * 2.0 ** -52
    kinds, kind = np.unique(c, axis=0, return_inverse=True)     # equal vectors are scored once
    kind = kind.reshape(-1)
    exact: dict[int, np.ndarray] = {}
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(q), SIFTED):
        rows = y[at:at + SIFTED]
        score = (rows @ z.T) * lift
        margin = length(rows)[:, None] * (length(z) * lift * error) + 1e-300
        own = q_ids[at:at + SIFTED, None] == c_ids
        low = np.where(own, -np.inf, score - margin)
        floor = np.partition(low, -best, 1)[:, -best] if low.shape[1] > best else np.full(len(rows), -np.inf)
        maybe = (score + margin >= floor[:, None]) & ~own
        for k in range(len(rows)):
            near = np.flatnonzero(maybe[k])
            if not len(near):
                continue
            some = np.unique(kind[near])
            for j in some.tolist():
                if j not in exact:
                    exact[j] = whole_numbers(kinds[j:j + 1], scale)[0]
            mine = whole_numbers(q[at + k:at + k + 1], scale)[0].tolist()
            value = {j: sum(a * b for a, b in zip(mine, exact[j].tolist())) for j in some.tolist()}
            first = sorted((-value[j], i) for i, j in zip(near.tolist(), kind[near].tolist()))[:best]
            out_q += [at + k] * len(first)
            out_c += [i for _, i in first]
            out_s += [-s for s, _ in first]
    return np.array(out_q, np.int64), np.array(out_c, np.int64), out_s


def limbs(score: int) -> list[int] | None:
    """None for a score that a long holds, else signed limbs after their signed number, which sort like the scores."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    sign, left, out = (1 if score > 0 else -1), abs(score), []
    while left:
        out.append(sign * (left & ((1 << LIMB) - 1)))
        left >>= LIMB
    return [sign * len(out), *out[::-1]]


def exact_top_k(embeddings: DataFrame, every: int = 50, best: int = 5, scale: int = 256, cell_vectors: int = vectors.CELL_VECTORS,
                cell_queries: int = vectors.CELL_QUERIES, each_row: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of the ``best`` highest inner products of floor(scale * x), ties to the smaller vec_id.

    Queries: rows whose id is divisible by ``every``; candidates: every row but those of the query's own id. Vectors that are null or hold
    null or non-finite components take no part; shorter vectors count as filled with zeros; rows that repeat an id are one vector, or
    with ``each_row`` a vector each. A score that a long cannot hold is null; its pair is ranked by the score all the same. An empty
    table gives an empty result.
    """
    rows = vectors.usable(embeddings, True, each_row)

    def search(q_ids, q, c_ids, c):
        with np.errstate(over="ignore"):
            whole_q, whole_c = np.floor(q * scale), np.floor(c * scale)
            short_q, short_c = (np.flatnonzero((m ** 2).sum(1) < SHORT ** 2) for m in (whole_q, whole_c))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(short_c):
            few = whole_c[short_c]
            for at in range(0, len(short_q), QUERIES):
                some = short_q[at:at + QUERIES]
                qi, ci, s = branch_and_bound(whole_q[some], few, q_ids[some], c_ids[short_c], best)
                out.append((some[qi], short_c[ci], s.astype(np.int64)))
        qi, ci, score = (np.concatenate(x) for x in zip(*out))
        more_q, more_c, more_s = [qi], [ci], []
        everything = np.arange(len(c))
        for some, others in ((short_q, np.setdiff1d(everything, short_c)), (np.setdiff1d(np.arange(len(q)), short_q), everything)):
            if len(some) and len(others):
                qi, ci, s = sift_and_rank(q[some], c[others], q_ids[some], c_ids[others], best, scale)
                more_q.append(some[qi])
                more_c.append(others[ci])
                more_s += s
        over = [limbs(s) for s in more_s]
        held = pa.array([s if o is None else None for s, o in zip(more_s, over)], pa.int64())
        kind = pa.list_(pa.int64())
        return (np.concatenate(more_q), np.concatenate(more_c), pa.concat_arrays([pa.array(score, pa.int64()), held]),
                pa.concat_arrays([pa.nulls(len(score), kind), pa.array(over, kind)]))

    order = [F.coalesce("over", F.array(F.lit(0).cast("long"))).desc(), F.col("score").desc()]
    return vectors.grid(rows, every, best, search, {"score": "long", "over": "array<long>"}, order, cell_vectors, cell_queries).drop("over")
