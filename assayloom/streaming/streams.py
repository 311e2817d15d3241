"""The incremental operators as Structured Streaming plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayloom.functions.text import day_micros
from assayloom.operators.screening import best_affinity, succeeded
from assayloom.session import scratch_path


def stream_replicate_stats(runs: DataFrame, time: str = "ts", delay: str = "7 days") -> DataFrame:
    """Replicate statistics as runs arrive (update mode); a run sent again within the delay counts once."""
    a = best_affinity()
    return (runs.where(succeeded()).withWatermark(time, delay).dropDuplicatesWithinWatermark(["ligand", "receptor", "replicate"])
            .groupBy("ligand", "receptor").agg(F.count(F.lit(1)).alias("n_replicates_success"), F.round(F.avg(a), 3).alias("affinity_mean"),
                                               F.round(F.stddev_pop(a), 3).alias("affinity_std"), F.round(F.min(a), 3).alias("affinity_best")))


def stream_pending_keys(keys: DataFrame, cache: DataFrame, time: str = "ts", delay: str = "7 days") -> DataFrame:
    """Each key once, unless the static result cache already holds it (append mode)."""
    return keys.join(cache.select("key").distinct(), "key", "left_anti").withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])


def stream_binned_signal(points: DataFrame, width: str, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Tumbling sums per sample in event time. Points behind the watermark are dropped and counted in the query progress."""
    return points.withWatermark(time, delay).groupBy("sample", F.window(time, width).alias("w")).agg(F.sum("y").alias("value"), F.count(F.lit(1)).alias("n")).select(
        "sample", F.col("w.start").alias("start"), "value", "n")


def run_available(stream: DataFrame, mode: str, keys: list[str] | None = None, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Process what is there and return the written rows.

    Every batch goes to a folder of its own, so a repeated batch overwrites itself. In update mode the latest row of each key counts.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("batch long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)).option("basePath", out).parquet(out)
    if keys is None:
        return rows.drop("batch")
    values = [c for c in rows.columns if c not in ("batch", *keys)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def event_time(ts: str) -> Column:
    """Wall-clock time as an instant, whatever the session time zone."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return F.timestamp_micros(days * 86400000000 + day_micros(ts))
