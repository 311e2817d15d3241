"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (iterative quantisation: alternate signs and the best rotation onto them) gives binary codes of
all vectors. In a cell, codes are split into substrings with one index each. A code within Hamming radius ``m * (a + 1) - 1`` of the
query differs by at most ``a`` bits in one of its ``m`` substrings, so probing all substrings within ``a`` bits finds every such code. The
radius grows until enough codes lie within it; all of these are ranked by distance on the original vectors.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from assayloom.llm import vectors

SAMPLE = 20_000     # rows the rotation is learned on, at most
BITS = 64
SUBSTRING = 8
ENOUGH = 600        # codes within the radius, per query and cell
LONG = 1e100        # components above it are scaled before they are squared


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of iterative quantisation. Fewer dimensions than bits are filled by random directions."""
    power = np.abs(sample).max(initial=0.0)
    power = power if power > LONG else 1.0      # directions don't depend on it
    mean = (sample / power).mean(0) if len(sample) else np.zeros(sample.shape[1])
    rng = np.random.default_rng(seed)
    x = sample / power - mean
    width = x.shape[1]
    if width >= bits and len(x):
        values, axes = np.linalg.eigh(x.T @ x)
        base = axes[:, np.argsort(-values)[:bits]]
    else:
        base = rng.standard_normal((width, bits)) / np.sqrt(max(1, width))
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    y = x @ base
    for _ in range(rounds if len(x) else 0):
        u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = (u @ v).T
    return mean * power, base @ turn


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Packed codes, one byte per substring of eight bits."""
    part = 2.0 ** -20       # sums of the largest doubles stay finite
    return np.packbits((x * part - mean * part) @ projection >= 0, axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``x`` to ``y``; infinite where it passes the largest double."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = x - y
        top = np.abs(gap).max(1, initial=0.0)
        out = np.sqrt((gap ** 2).sum(1))
        far = top > LONG
        out[far] = np.sqrt(((gap[far] / top[far, None]) ** 2).sum(1)) * top[far]
    return np.where(np.isfinite(top), out, np.inf)


_BITS = np.array([bin(v).count("1") for v in range(256)], np.uint8)
_FLIPS = [np.array([sum(1 << b for b in c) for c in combinations(range(SUBSTRING), k)], np.int64) for k in range(SUBSTRING + 1)]


class Index:
    """One table per substring: positions of codes, grouped by the substring's value."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.at = [np.argsort(code[:, s], kind="stable") for s in range(code.shape[1])]
        self.begin = [np.searchsorted(code[a, s], np.arange(257)) for s, a in enumerate(self.at)]

    def within(self, query: np.ndarray, enough: int) -> np.ndarray:
        """Positions of every code within the smallest radius tried that holds ``enough`` codes, or all."""
        m = self.code.shape[1]
        seen = np.zeros(len(self.code), bool)
        for a in range(SUBSTRING + 1):
            for s in range(m):
                for value in int(query[s]) ^ _FLIPS[a]:
                    seen[self.at[s][self.begin[s][value]:self.begin[s][value + 1]]] = True
            found = np.flatnonzero(seen)
            near = found[_BITS[self.code[found] ^ query].sum(1, dtype=np.int64) <= m * (a + 1) - 1]
            if len(near) >= enough or a == SUBSTRING:
                return near
        return found


def nearest_neighbours(embeddings: DataFrame, every: int = 100, best: int = 10, enough: int = ENOUGH, sample: int = SAMPLE,
                       cell_vectors: int = vectors.CELL_VECTORS, cell_queries: int = vectors.CELL_QUERIES,
                       each_row: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: nearest found by Euclidean distance, ties to the smaller vec_id.

    Queries: rows whose id is divisible by ``every``; candidates: every row but those of the query's own id. Vectors that are null, zero or
    hold null or non-finite components take no part; shorter vectors count as filled with zeros; rows that repeat an id are one vector,
    or with ``each_row`` a vector each. Only the rotation is learned on a sample, of ``sample`` rows at most, the first by a hash of the id.
    """
    usable = vectors.usable(embeddings, False, each_row)
    rows = [r[0] for r in usable.select("x", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).select("x").collect()]
    width = max(map(len, rows), default=1)
    if rows:
        width = usable.agg(F.max(F.size("x"))).first()[0]
    matrix = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        matrix[k, :len(r)] = r
    mean, projection = learn_rotation(matrix)

    def search(q_ids, q, c_ids, c):
        index, own = Index(codes(c, mean, projection)), codes(q, mean, projection)
        same = np.searchsorted(c_ids, q_ids, "right") - np.searchsorted(c_ids, q_ids)
        out = []
        for k in range(len(q)):
            near = index.within(own[k], enough + max(1, int(same[k])))
            near = near[c_ids[near] != q_ids[k]]
            dist = distances(c[near], q[k])
            if len(near) > best:        # the k-th distance and all ties with it, then the first by id
                keep = np.flatnonzero(dist <= np.partition(dist, best - 1)[best - 1])
                keep = keep[np.lexsort((near[keep], dist[keep]))[:best]]
                near, dist = near[keep], dist[keep]
            out.append((np.full(len(near), k), near, dist))
        return tuple(np.concatenate(x) for x in zip(*out))

    return vectors.grid(usable, every, best, search, {"score": "double"}, [F.col("score").asc()], cell_vectors, cell_queries)
