"""Whitening of embeddings by the covariance of their distinct integer vectors.

Vectors become whole numbers, equal ones are grouped, and each group counts in the fit with weight one or with its size. Sums are exact
whole numbers; the covariance is a product of centred blocks, one per task, added up by Spark. Every distinct vector is
whitened once, and the result is joined back to the rows.

The driver sees tables as wide as a vector (sums, covariance, components), never rows. Vectors that hold more than ``HOT_SHARE`` of all rows
are split over several tasks in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from assayloom.llm.common import quoted, release
from assayloom.llm.vectors import matrix
from assayloom.session import cut

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LIMIT = 1 << 53             # entries beyond it stay there: doubles hold whole numbers up to it
HOT_SHARE = 1 / 200
LEAST_SHARE = 1e-12         # components with less of the variance have no scale of their own
SLICE_ROWS = 8_192
_LOW = 26                   # sums are kept as high and low parts, so that no sum leaves 64 bits


def whole(rows: DataFrame, width: int) -> DataFrame:
    """The column ``x`` (array of double) as bytes of 64-bit floor(64 * entry) + 1000000; entries that a shorter vector lacks count as 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            at = part.schema.get_field_index("x")
            x = np.clip(matrix(pa.chunked_array([part.column(at)]), width), -float(LIMIT), float(LIMIT))      # keeps the product finite
            x = np.clip(np.floor(x * SCALE), -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT
            yield part.set_column(at, "x", _as_bytes(x))

    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "x" else f.dataType) for f in rows.schema])
    return rows.mapInArrow(run, schema)


def _as_bytes(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x, "<i8")
    limits = np.arange(len(x) + 1, dtype=np.int32) * (data.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(limits.tobytes()), pa.py_buffer(data.tobytes())])


def _from_bytes(column: pa.Array, width: int) -> np.ndarray:
    limits = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[limits[0]:limits[-1]].view("<i8").reshape(-1, width)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some thousand rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(lo, SLICE_ROWS)
    release()


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole vectors and weights."""
    for part in _parts(batches):
        yield _from_bytes(part.column("x").cast(pa.binary()), width), part.column("w").to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Total weight and exact weighted sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * width, [0] * width
        for x, w in _slices(batches, width):
            n += int(w.sum())
            for total, part in ((high, x >> _LOW), (low, x & ((1 << _LOW) - 1))):
                # a slice's sum stays far inside 64 bits for weights up to 2**23; larger ones are added as Python integers
                add = (part * w[:, None]).sum(0).tolist() if w.max(initial=0) < 1 << 23 else [sum(a * b for a, b in zip(c.tolist(), w.tolist())) for c in part.T]
                for k in range(width):
                    total[k] += add[k]
        if n:
            at = list(range(-1, width))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([str(n), *map(str, high)]), pa.array(["0", *map(str, low)])], ["at", "high", "low"])

    parts = fit.mapInArrow(run, "at int, high string, low string")
    rows = parts.groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    total = {r["at"]: (int(r["high"]) << (_LOW if r["at"] >= 0 else 0)) + int(r["low"]) for r in rows}
    return total.get(-1, 0), [total.get(k, 0) for k in range(width)]


class Centre:
    """The mean as whole part and fraction, so that centring loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n*x - S)**2; null where it passes a long."""
        if not len(x):
            return []
        left = (x - self.floor).astype(np.int64)        # n*x - S = n*left - r
        r = np.array([s % self.n for s in self.sums], object)
        most = self.n * (int(np.abs(left).max(initial=0)) + 1)
        if most ** 2 * x.shape[1] < 1 << 63:
            d = left * self.n - r.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = left.astype(object) * self.n - r
        return [v if v < 1 << 63 else None for v in (d * d).sum(1)]


def _product(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sum over tasks of v' w v of the slices ``of`` gives; the upper triangle travels, one number per row, added per place by Spark."""
    upper = np.triu_indices(width)
    place = pa.array(np.arange(len(upper[0]), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for v, w in of(batches):
            total += (v * w[:, None]).T @ v
        yield pa.RecordBatch.from_arrays([place, pa.array(total[upper])], ["at", "value"])
        release()

    out = np.zeros((width, width))
    for at, value in rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toLocalIterator():
        out[upper[0][at], upper[1][at]] = out[upper[1][at], upper[0][at]] = value
    return out


def _components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by size, eigenvectors as rows, shares of the trace; a vector's largest entry is positive."""
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value, kind="stable")[:most]
    value, vector = value[order], vector[:, order].T
    sign = np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(1)]) if len(vector) else np.zeros(0)
    trace = float(np.trace(covariance))
    return value, vector * sign[:, None], value / trace if trace > 0 else np.zeros(len(value))


def _salted(rows: DataFrame, groups: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``salt``: rows of a vector that holds a large share of all rows are dealt over several values, its group is repeated for each.

    At most ``1 / HOT_SHARE`` vectors can be hot, so their hashes (one number each) are a bounded list.
    """
    parts = F.ceil(F.col("count") / (total * HOT_SHARE)).cast("int")
    hot = [(r["h"], r["parts"]) for r in groups.where(F.col("count") > total * HOT_SHARE).select(F.xxhash64("x").alias("h"), parts.alias("parts")).collect()]
    of = F.lit(1)
    for h, p in hot:
        of = F.when(F.col("_h") == h, F.lit(p)).otherwise(of)
    rows = rows.withColumn("_h", F.xxhash64("x")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), of).cast("int")).drop("_h")
    groups = groups.withColumn("_h", F.xxhash64("x")).withColumn("salt", F.explode(F.sequence(F.lit(0), of - 1))).drop("_h")
    return rows, groups


def whiten(vectors: DataFrame, keep: list[str] = ["vec_id"], embedding: str = "embedding", components: int = COMPONENTS, weights: str = "one") -> DataFrame:  # noqa: B006
    """Per remaining row and component: ``keep``, component, n, deviation, whitened, explained, identity_error.

    ``weights`` is "one" (each distinct vector once) or "count" (as often as it occurs); n and every covariance follow it. Rows whose vector is null or
    holds null or non-finite entries take no part, nor do empty vectors; rows that repeat and null ids are kept. Shorter vectors count as
    filled with zeros; entries beyond 2**53 / 64 stand there. Components without variance (constant data, fewer vectors than
    dimensions) have a null ``whitened`` and take no part in ``identity_error``. A deviation beyond a long is null. An empty table
    gives an empty result.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is 'one' or 'count'")
    spark = vectors.sparkSession
    e = quoted(embedding)
    good = F.forall(e, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf"))) & (F.size(e) > 0)
    good_rows = vectors.where(e.isNotNull() & good)
    width, total = good_rows.agg(F.coalesce(F.max(F.size(e)), F.lit(0)), F.count(F.lit(1))).first()
    doubles = F.transform(e, lambda v: v.cast("double"))
    rows = whole(good_rows.select(*[quoted(c).alias(f"k{j}") for j, c in enumerate(keep)], doubles.alias("x")), max(width, 1))
    groups = cut(rows.groupBy("x").agg(F.count(F.lit(1)).alias("count")))
    weight = F.lit(1).cast("long") if weights == "one" else F.col("count")
    fit = groups.select("x", weight.alias("w"))
    n, sums = _sums(fit, width) if width else (0, [])
    kept = [F.col(f"k{j}").alias(c) for j, c in enumerate(keep)]
    if not n:
        empty = rows.where(F.lit(False)).select(*kept, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                                                F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
        return spark.createDataFrame([], empty.schema)
    centre = Centre(n, sums)

    def centred(batches):
        for x, w in _slices(batches, width):
            yield centre.of(x), w

    value, vector, share = _components(_product(fit, centred, width) / n, min(components, width))
    scaled = vector / np.sqrt(np.where(share > LEAST_SHARE, value, 1.0))[:, None]
    live = share > LEAST_SHARE
    schema = pa.schema([("x", pa.binary()), ("count", pa.int64()), ("w", pa.int64()), ("deviation", pa.int64()), ("z", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            packed = part.column("x").cast(pa.binary())
            x = _from_bytes(packed, width)
            z = centre.of(x) @ scaled.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([packed, part.column("count"), part.column("w"), pa.array(centre.deviation(x), pa.int64()), lists], schema=schema)

    done = cut(groups.withColumn("w", weight).mapInArrow(run, "x binary, count long, w long, deviation long, z array<double>"))

    def whitened(batches):
        for batch in batches:
            yield matrix(pa.chunked_array([batch.column("z")]), len(share)), batch.column("w").to_numpy(zero_copy_only=False)

    error = np.abs(_product(done, whitened, len(share)) / n - np.eye(len(share)))[live][:, live].max(initial=0.0)
    left, right = _salted(rows, done, total)
    joined = left.join(right.hint("shuffle_merge"), ["x", "salt"])
    table = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(float(share[k])).alias("explained"),
                               (F.get("z", F.lit(k)) if live[k] else F.lit(None).cast("double")).alias("whitened")) for k in range(len(share))])
    out = joined.select(*[f"k{j}" for j in range(len(keep))], "deviation", F.explode(table).alias("c"))
    return out.select(*kept, "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))
