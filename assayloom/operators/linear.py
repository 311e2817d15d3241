"""Products of a samples-by-features matrix with a few vectors, and its leading components.

The matrix stays in Spark as one array per sample. A pass multiplies it, and its transpose, with a handful of vectors; the driver holds vectors
as long as there are features, never a features-by-features table. Rows may belong to folds; a training set is all folds but one, and
one pass serves all training sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame

BASIS = 256             # directions a search for components keeps, at most
EXTRA = 10              # directions beside those wanted
PASSES = 60
EVERY = -1              # the training set of all folds


@dataclass
class Moments:
    """Additive moments of a set of samples: count, sum and squares of every feature, class counts and class sums."""

    n: float
    s: np.ndarray
    q: np.ndarray
    cn: np.ndarray
    cs: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.s - other.s, self.q - other.q, self.cn - other.cn, self.cs - other.cs)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.q + other.q, self.cn + other.cn, self.cs + other.cs)

    def scaled(self, method: str) -> tuple[np.ndarray, np.ndarray, float]:
        """Mean, divisor and the sum of squares of the scaled, centred matrix."""
        mean = self.s / self.n
        var = np.maximum(self.q / self.n - mean ** 2, 0.0)
        std = np.sqrt(var)
        flat = std <= 1e-7 * np.maximum(np.abs(mean), 1e-300)
        std = np.where(flat, 1.0, std)
        div = {"auto": std, "pareto": np.sqrt(std), "center": np.ones_like(std)}[method]
        return mean, div, float((np.where(flat, 0.0, var) / div ** 2).sum() * self.n)


def vector_sum(df: DataFrame, keys: list[str], col: str = "v") -> dict[tuple, np.ndarray]:
    summed = df.groupBy(*keys).agg(Summarizer.sum(array_to_vector(col)).alias("v"))
    return {tuple(r[k] for k in keys): r["v"].toArray() for r in summed.collect()}


def _blocks(it: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, pd.DataFrame]]:
    for pdf in it:
        for fold, part in pdf.groupby("fold"):
            yield int(fold), np.vstack(part["x"].to_numpy()), part


def fold_moments(rows: DataFrame, folds: int, classes: int, p: int) -> list[Moments]:
    """Moments per fold in one pass; ``rows`` has x (array), y (class index) and fold."""
    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for fold, x, part in _blocks(it):
            hot = np.eye(classes)[part["y"].to_numpy()]
            sums = np.hstack([np.concatenate([[len(x)], [0], hot.sum(0)])[:, None], np.vstack([x.sum(0), (x * x).sum(0), hot.T @ x])])
            acc[fold] = acc.get(fold, 0.0) + sums
        for fold, m in acc.items():
            yield pd.DataFrame({"fold": fold, "row": np.arange(len(m)), "v": list(m)})

    sums = vector_sum(rows.select("fold", "y", "x").mapInPandas(partial, "fold int, row int, v array<double>"), ["fold", "row"])
    out = []
    for f in range(folds):
        m = np.vstack([sums.get((f, r), np.zeros(p + 1)) for r in range(2 + classes)])
        out.append(Moments(m[0, 0], m[0, 1:], m[1, 1:], m[2:, 0], m[2:, 1:]))
    return out


def total(parts: list[Moments]) -> Moments:
    out = parts[0]
    for m in parts[1:]:
        out = out + m
    return out


def products(rows: DataFrame, vectors: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """X'X v per training set in one pass: set f leaves fold f out. Vectors are features-by-few arrays, and so are the results."""
    shared = rows.sparkSession.sparkContext.broadcast(vectors)      # sets x features x a few numbers

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for fold, x, _ in _blocks(it):
            for f, v in shared.value.items():
                if f != fold:
                    acc[f] = acc.get(f, 0.0) + x.T @ (x @ v)
        for f, m in acc.items():
            yield pd.DataFrame({"set": f, "col": np.arange(m.shape[1]), "v": list(np.ascontiguousarray(m.T))})

    found = vector_sum(rows.select("fold", "x").mapInPandas(partial, "set int, col int, v array<double>"), ["set", "col"])
    shared.destroy()
    return {f: np.column_stack([found.get((f, c), np.zeros(len(v))) for c in range(v.shape[1])]) for f, v in vectors.items()}


def scaled_products(rows: DataFrame, sets: dict[int, tuple[float, np.ndarray, np.ndarray]], vectors: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The same for the centred, scaled matrix of each training set, given as count, mean and divisor."""
    raw = products(rows, {f: v / sets[f][2][:, None] for f, v in vectors.items()})
    out = {}
    for f, v in vectors.items():
        n, mean, div = sets[f]
        out[f] = (raw[f] - n * np.outer(mean, (mean / div) @ v)) / div[:, None]
    return out


class _Search:
    """One matrix's search for its leading components in a growing basis."""

    def __init__(self, p: int, k: int, basis: int):
        self.p, self.k, self.most = p, min(k, p), max(basis, 2 * (k + EXTRA))
        width = p if p <= basis else min(p, k + EXTRA)
        self.next = np.eye(p) if width == p else np.linalg.qr(np.random.default_rng(0).normal(size=(p, width)))[0]
        self.s, self.a = np.zeros((p, 0)), np.zeros((p, 0))
        self.values, self.vectors, self.done = np.zeros(0), np.zeros((p, 0)), False

    def add(self, product: np.ndarray, tolerance: float) -> None:
        self.s, self.a = np.hstack([self.s, self.next]), np.hstack([self.a, product])
        h = self.s.T @ self.a
        value, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-value, kind="stable")
        value, y = value[order], y[:, order]
        k = self.k
        self.values, self.vectors = value[:k], self.s @ y[:, :k]
        apart = np.linalg.norm(self.a @ y[:, :k] - self.vectors * self.values, axis=0)
        if self.s.shape[1] >= self.p or apart.max(initial=0.0) <= tolerance * max(value[0], 1e-300):
            self.done = True
            return
        # go on along what the best directions still lack
        m = min(k + EXTRA, self.s.shape[1])
        new = self.a @ y[:, :m] - (self.s @ y[:, :m]) * value[:m]
        if self.s.shape[1] + m > self.most:     # keep the best directions only
            keep = min(len(value), 2 * k + EXTRA)
            self.s, self.a = self.s @ y[:, :keep], self.a @ y[:, :keep]
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 1e-13 * max(value[0], 1e-300)]
        new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
        for _ in range(2):
            new = new - self.s @ (self.s.T @ new)
            u, sv, _ = np.linalg.svd(new, full_matrices=False)
            new = u[:, sv > 1e-10]
        self.next = new[:, :self.p - self.s.shape[1]]
        self.done = not self.next.shape[1]


def leading(multiply: Callable[[dict[int, np.ndarray]], dict[int, np.ndarray]], sets: list[int], p: int, k: int, tolerance: float = 1e-9,
            basis: int = BASIS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ``k`` largest eigenvalues and their vectors (features by k) of each set's cross products, found by block Krylov steps.

    ``multiply`` does one pass for all sets. A table of no more than ``basis`` features is settled in the first pass; others go on until the
    residual is below ``tolerance`` times the largest eigenvalue. The largest entry of a vector is positive.
    """
    search = {f: _Search(p, k, basis) for f in sets}
    for _ in range(PASSES):
        open_ = {f: s.next for f, s in search.items() if not s.done}
        if not open_:
            break
        for f, product in multiply(open_).items():
            search[f].add(product, tolerance)
    out = {}
    for f, s in search.items():
        v = s.vectors
        sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        out[f] = np.maximum(s.values, 0.0), v * np.where(sign == 0, 1.0, sign)
    return out
