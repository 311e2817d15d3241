"""Windows, ranks and exact quantiles that stay balanced when one key holds most of the rows.

A plain window sends a whole key to one task. Here the order columns are first cut into value blocks, a few per shuffle partition, by
approximate quantiles from one pass. A value that fills a block by itself is cut again by the next order column, with limits taken from
its own rows, and so on through all order columns. A block is a pure function of the row's values, so recomputing a lost
partition gives the same block. Per-block totals are one small table whose running total is carried back to the rows of each block.

All inputs take this one path, whatever their size. ``with_blocks`` can be called once for several windows along the same order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCKS_PER_PARTITION = 2

_BLK = "_order_block"


def _limits(quantiles: Sequence[float]) -> list[float]:
    """Inner bucket limits; every quantile value also gets a bucket of its own."""
    out = set()
    for q in quantiles:
        out.update((q, math.nextafter(q, math.inf)))
    return sorted(x for x in out if math.isfinite(x))


def _probs(blocks: int) -> list[float]:
    return [k / blocks for k in range(1, blocks)]


def _approx(col: str, blocks: int) -> Column:
    """Limits of about equal blocks; nulls do not count."""
    return F.percentile_approx(F.col(col).cast("double"), _probs(blocks), 4 * blocks)


def _bucket(df: DataFrame, col: str, limits: list[float], out: str) -> DataFrame:
    """Number of the value's bucket: nulls sort first, NaN sorts last."""
    tmp = df.withColumn("_bucket_in", F.col(col).cast("double") + 0.0)        # -0.0 and 0.0 are one value
    cut_up = Bucketizer(splits=[-math.inf, *limits, math.inf], inputCol="_bucket_in", outputCol=out, handleInvalid="keep").transform(tmp)
    return cut_up.withColumn(out, F.when(F.col("_bucket_in").isNull(), -1).otherwise(F.col(out).cast("int"))).drop("_bucket_in")


def with_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Add a block column that follows the numeric order columns; ``blocks`` is about how many there are.

    One small job finds the limits, and one more for each further order column, where a value before it fills a block by itself.
    """
    blocks = blocks or max(2, BLOCKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    quantiles = df.select(_approx(order[0], blocks)).first()[0] or []
    out = _bucket(df, order[0], _limits(quantiles) or [0.0], "_b0")
    # values that stand at several limits, and for how many blocks
    hot = {(q,): n for q, n in Counter(quantiles).items() if n > 1}
    level = 1
    while hot and level < len(order):
        most = max(hot.values()) + 1
        names = [f"_h{k}" for k in range(level)]
        table = df.sparkSession.createDataFrame([(*v, n + 1) for v, n in hot.items()], ", ".join(f"{n} double" for n in names) + ", _n int")
        match = [F.col(c).cast("double").eqNullSafe(F.col(n)) for c, n in zip(order, names)]
        found = df.join(F.broadcast(table), match).groupBy(*names, "_n").agg(_approx(order[level], most).alias("_q")).collect()
        rows, deeper = [], {}
        for r in found:
            # every value was cut into as many parts as the largest: take as many limits as its share
            values = [r["_q"][round(k * most / r["_n"]) - 1] for k in range(1, r["_n"])] if r["_q"] else []
            prefix = tuple(r[n] for n in names)
            rows.append((*prefix, _limits(values)))
            deeper |= {(*prefix, q): n for q, n in Counter(values).items() if n > 1}
        limits = df.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", _l array<double>")
        out = out.join(F.broadcast(limits), match, "left")
        value = F.col(order[level]).cast("double")
        inner = F.when(value.isNull(), -1).otherwise(F.size(F.filter("_l", lambda x: x <= value)))
        out = out.withColumn(f"_b{level}", F.when(F.col("_l").isNotNull(), inner).otherwise(0)).drop("_l", *names)
        hot, level = deeper, level + 1
    parts = [f"_b{k}" for k in range(level)]
    return out.withColumn(_BLK, F.struct(*parts)).drop(*parts)


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    right = right.select(*[F.col(c).alias(f"_r_{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & left[c].eqNullSafe(right[f"_r_{i}"])
    return left.join(right, cond, how).drop(*[f"_r_{i}" for i in range(len(on))])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, str]],
            reverse: bool = False, blocks: int | None = None) -> DataFrame:
    """Add running values along ``order`` inside ``keys``.

    ``specs`` maps an output name to ``(kind, column)``; kinds: ``sum`` and ``min`` (including the current row), ``fill`` (last
    non-null so far), ``prev`` (value of the row before). ``reverse`` walks from the end. Rows that come from ``with_blocks`` along
    the same order keep its blocks.
    """
    keys, order = list(keys), list(order)
    given = _BLK in df.columns
    blocked = df if given else with_blocks(df, order, blocks)
    part = keys + [_BLK]
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    w = Window.partitionBy(*[F.col(c) for c in part]).orderBy(*direction)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    out = blocked
    local: dict[str, Column] = {}
    for name, (kind, col) in specs.items():
        c = F.col(col)
        local[f"_w_{name}"] = {
            "sum": lambda: F.sum(c).over(upto),
            "min": lambda: F.min(c).over(upto),
            "fill": lambda: F.last(c, ignorenulls=True).over(upto),
            "prev": lambda: F.lag(c).over(w),
        }[kind]()
    out = out.withColumns(local)
    extreme = F.min_by if reverse else F.max_by
    ord_key = F.struct(*[F.col(c) for c in order])
    aggs = []
    for name, (kind, col) in specs.items():
        c = F.col(col)
        aggs.append({
            "sum": lambda: F.sum(c),
            "min": lambda: F.min(c),
            "fill": lambda: extreme(c, F.when(c.isNotNull(), ord_key)),
            "prev": lambda: extreme(F.struct(c.alias("v")), ord_key),
        }[kind]().alias(f"_t_{name}"))
    totals = blocked.groupBy(*part).agg(*aggs)
    blk = F.col(_BLK).desc() if reverse else F.col(_BLK).asc()
    before = Window.partitionBy(*[F.col(c) for c in keys]).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for name, (kind, _) in specs.items():
        t = F.col(f"_t_{name}")
        fn = {"sum": lambda: F.sum(t), "min": lambda: F.min(t)}.get(kind, lambda: F.last(t, ignorenulls=True))()
        carries.append(fn.over(before).alias(f"_c_{name}"))
    out = _null_safe(out, totals.select(*part, *carries), part)
    final = {}
    for name, (kind, _) in specs.items():
        here, carry = F.col(f"_w_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            final[name] = F.when(carry.isNull(), here).otherwise(carry + F.coalesce(here, F.lit(0)))
        elif kind == "min":
            final[name] = F.least(here, carry)
        elif kind == "fill":
            final[name] = F.coalesce(here, carry)
        else:
            first = F.row_number().over(w) == 1
            final[name] = F.when(first, carry["v"]).otherwise(here)
    out = out.withColumns(final)
    return out.drop(*[f"_{p}_{n}" for p in "wc" for n in specs], *([] if given else [_BLK]))


def given_blocks(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Take leading order columns, or expressions that follow the order, as blocks where they are known to be small units, as a few lines of a file are."""
    return df.withColumn(_BLK, F.struct(*[F.expr(c).alias(f"_b{k}") for k, c in enumerate(first)]))


def without_blocks(df: DataFrame) -> DataFrame:
    return df.drop(_BLK)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn",
             blocks: int | None = None) -> DataFrame:
    """``row_number`` along numeric order columns."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running(one, keys, order, {out: ("sum", "_one")}, blocks=blocks).drop("_one")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              blocks: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key; equal values are counted before any ordering.

    ``weight`` names a count column: the row stands for that many equal values.
    """
    keys = list(keys)
    data = df.where(F.col(value).isNotNull())
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    counts = data.groupBy(*keys, value).agg(F.sum(w).alias("_n"))
    cum = running(counts, keys, [value], {"_cum": ("sum", "_n")}, blocks=blocks)
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = _null_safe(cum, total, keys) if keys else cum.withColumn("_total", total.scalar())
    pos = {n: F.lit(p) * (F.col("_total") - 1) for n, p in probs.items()}
    picks = []
    for n in probs:
        for tag, at in (("lo", F.floor(pos[n])), ("hi", F.ceil(pos[n]))):
            picks.append(F.min(F.when(F.col("_cum") > at, F.col(value))).alias(f"_{tag}_{n}"))
        picks.append(F.max(pos[n] - F.floor(pos[n])).alias(f"_f_{n}"))
    picked = joined.groupBy(*keys).agg(*picks)
    return picked.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs])


def average_rank(df: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """One row per key and distinct value: its count ``ties`` and mean rank ``avg_rank``."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    cum = running(counts, keys, [value], {"_cum": ("sum", "ties")}, blocks=blocks)
    return cum.withColumn("avg_rank", F.col("_cum") - (F.col("ties") - 1) / 2.0).drop("_cum")


def matrix_cells(rows: DataFrame, cols: DataFrame, row_key: str, slices: int | None = None) -> DataFrame:
    """All cells of a rows-by-columns matrix, for results that are such a matrix.

    Rows are spread over slices (a few per shuffle partition) and every slice meets the whole column list by an equal-key join.
    """
    slices = slices or max(16, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = rows.withColumn("_slice", F.pmod(F.xxhash64(row_key), F.lit(slices)).cast("int"))
    right = cols.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return left.join(right, "_slice").drop("_slice")
