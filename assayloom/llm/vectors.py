"""Search of a set of query vectors against all vectors, in a grid of bounded cells.

Vectors are dealt into groups and queries into blocks, both by a hash of the id. A cell is one group and one block; its task sees at
most about ``CELL_VECTORS`` vectors and ``CELL_QUERIES`` queries, whatever the size of the table. Cells return the best of each
query, which are ranked once more per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

CELL_VECTORS = 16_384
CELL_QUERIES = 4_096


def usable(vectors: DataFrame, zero: bool, each_row: bool = False) -> DataFrame:
    """vec_id and ``x`` (array of double): vectors without null or non-finite components.

    Rows of one id are one vector, the smallest array, unless ``each_row``. Null ids, empty arrays and, unless ``zero``, vectors of zeros
    take no part.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < math.inf)) & (F.size("x") > 0)     # NaN is above every number
    if not zero:
        good = good & F.exists("x", lambda v: v != 0)
    rows = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good)
    return rows if each_row else rows.groupBy("vec_id").agg(F.min("x").alias("x"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists as one matrix; short rows are filled with zeros."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def grid(vectors: DataFrame, every: int, best: int, search: Callable[..., tuple], scores: dict[str, str], order: list[Column], cell_vectors: int = CELL_VECTORS,
         cell_queries: int = CELL_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and the columns ``scores`` (name to type): the ``best`` of every row whose id is divisible by ``every``.

    ``search(query ids, query matrix, ids, matrix)`` returns positions of queries, positions of vectors and the score columns of one cell.
    """
    is_query = F.col("vec_id") % every == 0
    n, nq, width = vectors.agg(F.count(F.lit(1)), F.count_if(is_query), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    groups, blocks = max(1, math.ceil(n / cell_vectors)), max(1, math.ceil(nq / cell_queries))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    everywhere = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = vectors.select("vec_id", "x", F.lit(False).alias("q"), deal(groups).alias("g"), everywhere(blocks).alias("b"))
    rows = rows.unionByName(vectors.where(is_query).select("vec_id", "x", F.lit(True).alias("q"), deal(blocks).alias("b"), everywhere(groups).alias("g")))
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), *[(c, kinds[t]) for c, t in scores.items()]])

    def cell(table: pa.Table) -> pa.Table:
        is_q = table["q"].to_numpy()
        table = table.take(pa.array(np.argsort(table["vec_id"].to_numpy(), kind="stable")))     # ties go to the smaller id
        is_q = table["q"].to_numpy()
        ids, x = table["vec_id"].to_numpy(), matrix(table["x"], width)
        if is_q.all() or not is_q.any():
            return schema.empty_table()
        q_ids, c_ids = ids[is_q], ids[~is_q]
        qi, ci, *score = search(q_ids, x[is_q], c_ids, x[~is_q])
        return pa.table([q_ids[qi], c_ids[ci], *score], schema=schema)

    found = rows.groupBy("g", "b").applyInArrow(cell, ", ".join(["query_id long, vec_id long", *[f"{c} {t}" for c, t in scores.items()]]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= best).select("query_id", "rank", "vec_id", *scores)


def first_per_query(qi: np.ndarray, ci: np.ndarray, score: np.ndarray, best: int) -> np.ndarray:
    """Positions of the ``best`` highest scores per query, ties to the smaller candidate position."""
    at = np.lexsort((ci, -score, qi))
    q = qi[at]
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], q[1:] != q[:-1]]), np.arange(len(q)), 0)) if len(q) else at
    return at[np.arange(len(at)) - begin < best]
