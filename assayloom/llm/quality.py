"""Quality classifier: generalised additive model with pairwise interactions.

Features of whole texts are cut into bins. Cyclic boosting visits one feature after another and adds a small step of a shallow tree over
its bins to the feature's lookup table; then the pairs of features that explain most of what is left get tables of their own. A
score is the logistic function of a sum of looked-up values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayloom.llm.common import Rolling, Words, fold, runs, slices, utf8
from assayloom.session import cut

FIT_ROWS = 20_000       # labelled rows the model is fitted on, at most
BINS, PAIR_BINS, PAIRS = 32, 8, 6
THRESHOLD = 0.3

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "bars", "exclaims", "stops", "commas", "lines", "wide",
            "distinct_words", "distinct_lines", "distinct_pairs", "top_word", "short_words", "long_words", "capital_words", "symbol_words")

_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#$%&*+/<=>@\\^_`{}~[]", "bars": b"|", "exclaims": b"!",
         "stops": b".?", "commas": b",;:", "lines": b"\n", "wide": bytes(range(128, 256))}


def _count(flags: np.ndarray, limits: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[limits[1:]] - total[limits[:-1]]).astype(float)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per text, and how often the most frequent one stands there."""
    keys, counts = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)), return_counts=True)
    owner = (keys >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    at = runs(owner)
    if len(at):
        most[owner[at]] = np.maximum.reduceat(counts, at)
    return np.bincount(owner, minlength=n).astype(float), most


def features(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text has zeros."""
    n = len(limits) - 1
    size = np.diff(limits).astype(float)
    per = lambda a, b: a / np.maximum(b, 1)
    out = {"log_bytes": np.log1p(size)}
    for name, members in _SETS.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[name] = per(_count(table[data], limits), size)
    words = Words(data, limits)
    count = words.counts().astype(float)
    length = (words.end - words.start).astype(float)
    by = lambda values: np.bincount(words.doc, values, n)
    odd = np.zeros(256, bool)
    odd[list(_SETS["symbols"] + b"!|")] = True
    wide = np.concatenate([[0], np.cumsum(odd[words.data])])
    first = words.start - words.doc - 1
    capital = (data[first] >= 65) & (data[first] <= 90) if len(first) else np.zeros(0, bool)
    distinct, top = _distinct(words.doc, words.hash, n)
    pair = words.doc[1:] == words.doc[:-1]
    pairs = (words.hash[:-1] * np.uint64(3) + words.hash[1:])[pair]
    pair_count = np.bincount(words.doc[1:][pair], minlength=n).astype(float)
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([limits[:-1][size > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    finish = np.concatenate([begin[1:], [len(data)]])[:len(begin)]
    line_doc = np.searchsorted(limits, begin, side="right") - 1
    line_count = np.bincount(line_doc, minlength=n).astype(float)
    out |= {"log_words": np.log1p(count), "word_length": per(by(length), count), "distinct_words": per(distinct, count), "top_word": per(top, count),
            "distinct_pairs": per(_distinct(words.doc[1:][pair], pairs, n)[0], pair_count),
            "distinct_lines": per(_distinct(line_doc, Rolling(data).span(begin, finish), n)[0], line_count),
            "short_words": per(by(length <= 3), count), "long_words": per(by(length > 12), count), "capital_words": per(by(capital), count),
            "symbol_words": per(by(wide[words.end] > wide[words.start]), count)}
    return np.column_stack([out[f] for f in FEATURES])


@dataclass
class AdditiveModel:
    """Intercept, bin limits and lookup tables; pairs look up by the coarser limits."""
    intercept: float = 0.0
    limits: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pair_limits: list = field(default_factory=list)
    pairs: list = field(default_factory=list)       # (feature, feature, table)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.limits[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.pair_limits[a], x[:, a], side="right"), np.searchsorted(self.pair_limits[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _limits(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 2.0) -> np.ndarray:
    """Newton step per bin of a tree of the given depth over ordered bins."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least / 4) & (hr >= least / 4), gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1), -1.0)
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return value
    return np.concatenate([_tree(g[:k + 1], h[:k + 1], depth - 1, least), _tree(g[k + 1:], h[k + 1:], depth - 1, least)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Step per cell of a tree that cuts the first feature once and each half along the second; and its gain."""
    best, out = -1.0, np.zeros_like(g)
    side = lambda gs, hs: (np.cumsum(gs)[:-1], np.cumsum(hs)[:-1], gs.sum(), hs.sum())
    for k in range(1, g.shape[0]):
        step, total = np.zeros_like(g), 0.0
        for rows in (slice(0, k), slice(k, None)):
            gl, hl, gt, ht = side(g[rows].sum(0), h[rows].sum(0))
            if not len(gl):
                step[rows] = gt / (ht + 1)
                total += gt ** 2 / (ht + 1)
                continue
            gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
            c = int(gain.argmax())
            total += gain[c]
            step[rows, :c + 1], step[rows, c + 1:] = gl[c] / (hl[c] + 1), (gt - gl[c]) / (ht - hl[c] + 1)
        if total > best:
            best, out = total, step
    return out, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting of the features, then of the pairs with the largest gain on what is left.

    Without rows of both classes the model is a constant: the class's share, drawn towards a half by one row of each.
    """
    base = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(base / (1 - base))))
    if not 0 < y.sum() < len(y):
        return model
    width = x.shape[1]
    model.limits = [_limits(x[:, j], BINS) for j in range(width)]
    model.pair_limits = [_limits(x[:, j], PAIR_BINS) for j in range(width)]
    at = [np.searchsorted(model.limits[j], x[:, j], side="right") for j in range(width)]
    model.tables = [np.zeros(len(model.limits[j]) + 1) for j in range(width)]
    logit = np.full(len(y), model.intercept)

    def gradient():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = gradient()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), 2)
            model.tables[j] += step
            logit += step[at[j]]
    coarse = [np.searchsorted(model.pair_limits[j], x[:, j], side="right") for j in range(width)]
    sizes = [len(model.pair_limits[j]) + 1 for j in range(width)]

    def sums(a, b):
        g, h = gradient()
        cell = coarse[a] * sizes[b] + coarse[b]
        fold2 = lambda v: np.bincount(cell, v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])
        return fold2(g), fold2(h)

    ranked = sorted(((_pair_tree(*sums(a, b))[1], a, b) for a in range(width) for b in range(a + 1, width) if sizes[a] > 1 and sizes[b] > 1), reverse=True)
    chosen = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in ranked[:pairs]]
    for _ in range(rounds // 2):
        for a, b, table in chosen:
            step = rate * _pair_tree(*sums(a, b))[0]
            table += step
            logit += step[coarse[a], coarse[b]]
    model.pairs = chosen
    return model


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and ``features``, from one pass over whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            x = features(*utf8(batch.column("text")))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "features"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, features array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The model is fitted on at most ``fit_rows`` labelled rows outside the held-out fold, the first by a hash of the id. Several labels of
    one document count by majority, a tie as 1; null labels do not count. Null text is empty; empty texts get the score of their
    bins. Without labels every score is one half.
    """
    rows = cut(document_features(docs))
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("y"))
    train = rows.where(fold("doc_id", parts) != held).join(marks, "doc_id").select("features", "y", F.xxhash64("doc_id").alias("h"))
    sample = train.orderBy("h", "y").limit(fit_rows).select("features", "y").toArrow()
    n = sample.num_rows
    x = sample["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, len(FEATURES)) if n else np.zeros((0, len(FEATURES)))
    model = fit(x, sample["y"].to_numpy().astype(float) if n else np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(got))], ["doc_id", "score"])

    scored = rows.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


