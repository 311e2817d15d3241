"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents are shuffled by a hash of their id. Each copy of a document gets a virtual finish time: the words its source has given by
then, divided by the source's target. All copies are ordered by that time and cut off where the total budget is used up.

Running sums go through blocks, which are prefixes of the hash (inside a source) or ranges of virtual time (over all), so one source
with a third of all rows is spread over many tasks. Only tables with one row per source or per block are summed in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayloom.llm.common import WORD, quoted
from assayloom.session import cut

ROWS_PER_BLOCK = 10_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: number ``_src``, weight, size, rows and target.

    Sources stand in code point order, null last, and take the weights in turn. Targets share the sum of all sizes by weight; none is
    above ``cap`` times its source's size, and what that leaves over goes to the others by weight. The level all others reach is the
    largest of those found by setting aside the sources with the smallest size per weight one after another.
    """
    totals = sized.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("_src", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("_w", F.element_at(cycle, (F.col("_src") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_full", (F.col("source_size") * cap).cast("double"))
    before = Window.orderBy(F.col("_full") / F.col("_w"), "_src").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("_full").over(before), F.lit(0.0)))
             / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("_level", level).withColumn("_budget", F.sum("source_size").over(whole)).withColumn("_all", F.sum("_rows").over(whole))
    return ranked.withColumn("target", F.least(F.col("_full"), F.max("_level").over(whole) * F.col("_w"))).drop("_level", "_full")


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return docs.withColumns({"_size": word_count("text"), "_key": key})


def _placed(rows: DataFrame, targets: DataFrame, per_block: int) -> DataFrame:
    """Add source number, target and block: as many leading hex digits of the hash as keep a block at about ``per_block`` rows."""
    t = targets.withColumnRenamed("source", "_source")
    out = rows.join(t, rows["source"].eqNullSafe(t["_source"]), "inner").drop("_source")
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("_rows") / per_block))).cast("int")
    return out.withColumn("_blk", F.substr(F.col("_key"), F.lit(1), digits))


def _finish(copy: Column) -> Column:
    return (copy * F.col("source_size") + F.col("_cum")) / F.when(F.col("target") > 0, F.col("target"))


def _mark(copy: Column) -> Column:
    """Place of a copy in the global order."""
    return F.struct(_finish(copy).alias("t"), F.col("_src").alias("s"), copy.alias("c"), F.col("_key").alias("k"), F.col("doc_id").alias("d"), F.col("_size").alias("n"))


def _schedule(docs: DataFrame, keep: Sequence[str], weights, cap, seed, per_block) -> DataFrame:
    """``keep`` and the columns of the schedule, one row per document, with ``copies``: how often the mix takes it."""
    light = cut(_keyed(docs, seed).select("doc_id", "source", "_size", "_key"))
    targets = cut(source_targets(light, weights, cap))
    inside = Window.partitionBy("_src", "_blk").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = _placed(light, targets, per_block)
    ahead = Window.partitionBy("_src").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = placed.groupBy("_src", "_blk").agg(F.sum("_size").alias("_sum"))
    carry = cut(carry.select(F.col("_src").alias("_cs"), F.col("_blk").alias("_cb"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_carry")))

    def summed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_in", F.sum("_size").over(inside))
        rows = rows.join(carry, (rows["_src"] == carry["_cs"]) & (rows["_blk"] == carry["_cb"]), "inner").drop("_cs", "_cb")
        return rows.withColumn("_cum", F.col("_in") + F.col("_carry"))

    # where the budget ends: running sums over ranges of virtual time
    copies = summed(placed).where("_size > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    copies = copies.withColumn("_m", _mark(F.col("_copy"))).where(F.col("_m.t") <= 2.0)     # the budget ends near time 1
    copies = copies.withColumn("_vb", F.floor(F.col("_m.t") * F.ceil(F.col("_all") * cap / per_block)).cast("long"))
    copies = copies.select("_m", "_vb", "_size", "_budget")
    vb = copies.groupBy("_vb").agg(F.sum("_size").alias("_sum"))
    vb = vb.select(F.col("_vb").alias("_v"), F.coalesce(F.sum("_sum").over(Window.orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_vcarry"))
    run = F.sum("_size").over(Window.partitionBy("_vb").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    taken = copies.withColumn("_run", run).join(vb, F.col("_vb") == F.col("_v")).where(F.col("_run") + F.col("_vcarry") <= F.col("_budget"))
    last = cut(taken.agg(F.max("_m").alias("_last")))
    full = summed(placed) if set(keep) <= {"doc_id", "source"} else summed(_placed(_keyed(docs, seed).select(*keep, "_size", "_key"), targets, per_block))
    full = full.withColumn("_last", last.scalar())
    took = [F.when((F.col("_size") > 0) & (_mark(F.lit(c)) <= F.col("_last")), 1).otherwise(0) for c in range(cap)]
    return full.withColumn("copies", sum(took[1:], took[0]))


def mixture(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: str = "mix", per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    Null text has size 0 and is never taken; a null source is a source of its own. Rows that agree in doc_id, source and size are
    interchangeable. Reruns agree, as the order follows from a hash of the id. An empty table gives an empty result.
    """
    out = _schedule(docs.select("doc_id", "source", "text"), ["doc_id", "source"], weights, cap, seed, per_block)
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: str = "mix", per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The mix itself: all columns of the documents taken, one row per copy, sorted over all partitions by virtual finish time."""
    rows = docs.select("doc_id", "source", "text", F.struct(*[quoted(c) for c in docs.columns]).alias("_row"))
    out = _schedule(rows, ["doc_id", "source", "_row"], weights, cap, seed, per_block).where("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.withColumn("_t", _finish(F.col("_copy"))).sort("_t", "_src", "_key").select("_row.*")
