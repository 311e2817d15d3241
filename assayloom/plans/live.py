"""Queries over streams, SQL function names and user hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions.register import register_functions
from assayloom.functions.text import compound_key
from assayloom.functions.udfs import set_canonicalizer
from assayloom.plans import bindings as b
from assayloom.plans.registry import query
from assayloom.rules import DEFAULT_RULES, Rule, classify_rules
from assayloom.session import scratch_path
from assayloom.streaming import streams as st


def table_stream(spark, sf, name):
    """The given table as a file stream."""
    schema = b.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


RESENT = """r AS (SELECT DISTINCT 'L' || l_partkey AS ligand, 'R' || (l_suppkey % 10) AS receptor, l_orderkey, l_linenumber, l_extendedprice, -l_extendedprice / 7919 AS affinity FROM lineitem WHERE l_returnflag <> 'R')"""


@query("ST1_stream_replicate_stats", f"""WITH {RESENT} SELECT ligand, receptor, count(*) AS n_replicates_success, round(avg(affinity), 3) AS affinity_mean, round(stddev_pop(affinity), 3) AS affinity_std, round(min(affinity), 3) AS affinity_best FROM r GROUP BY 1, 2""")
def _(spark, sf):
    li = table_stream(spark, sf, "lineitem").withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))      # every run is sent twice
    failed = F.col("l_returnflag") == "R"
    pose = F.struct(F.lit(1).alias("mode"), (-F.col("l_extendedprice") / 7919).alias("affinity"))
    runs = li.select(F.concat(F.lit("L"), "l_partkey").alias("ligand"), F.concat(F.lit("R"), F.col("l_suppkey") % 10).alias("receptor"),
                     F.concat_ws("/", "l_orderkey", "l_linenumber", "l_extendedprice").alias("replicate"), F.array(pose).alias("poses"), F.when(failed, "run failed").alias("error"), st.event_time("l_shipdate").alias("ts"))
    return st.run_available(st.stream_replicate_stats(runs, delay="20000 days"), "update", ["ligand", "receptor"])


@query("ST2_stream_pending_keys", "SELECT DISTINCT 'raw:C' || (l_partkey % 1500) AS key FROM lineitem WHERE l_partkey % 1500 NOT IN (SELECT c_custkey % 200 FROM customer)")
def _(spark, sf):
    keys = table_stream(spark, sf, "lineitem").select(F.concat(F.lit("raw:C"), F.col("l_partkey") % 1500).alias("key"), st.event_time("l_shipdate").alias("ts"))
    cache = b.table(spark, sf, "customer").select(F.concat(F.lit("raw:C"), F.col("c_custkey") % 200).alias("key"))
    return st.run_available(st.stream_pending_keys(keys, cache, delay="20000 days"), "append").select("key")


@query("ST3_stream_binned_signal", "SELECT 'U' || user_id AS sample, epoch_us(ts) // 600000000 * 10 AS start_minute, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    pts = table_stream(spark, sf, "events").select(F.concat(F.lit("U"), "user_id").alias("sample"), st.event_time("ts").alias("ts"), F.col("value").alias("y"))
    got = st.run_available(st.stream_binned_signal(pts, "10 minutes", delay="20000 days"), "update", ["sample", "start"])
    return got.select("sample", F.expr("unix_micros(start) div 60000000").alias("start_minute"), F.round("value", 4).alias("value"), "n")


LATE = """e AS (SELECT 'U' || user_id AS sample, ts, value, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 4 // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) AS turn FROM events),
 kept AS (SELECT * FROM e WHERE NOT (turn = 0 AND event_id % 10 = 0)),
 closed AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 AS mark FROM e)"""


@query("ST3_stream_late_points", f"""WITH {LATE} SELECT sample, epoch_us(ts) // 600000000 * 10 AS start_minute, round(sum(value), 4) AS value, count(*) AS n
 FROM kept, closed WHERE (epoch_us(ts) // 600000000 + 1) * 600000000 <= mark GROUP BY 1, 2""")
def _(spark, sf):
    """Points in four deliveries by time; a tenth of the first quarter comes last and is late by then. Closed bins are written once."""
    ev = b.table(spark, sf, "events")
    ends = ev.agg(F.min(st.event_time("ts")).alias("lo"), F.max(st.event_time("ts")).alias("hi"))
    pts = ev.select(F.concat(F.lit("U"), "user_id").alias("sample"), st.event_time("ts").alias("ts"), F.col("value").alias("y"), "event_id").crossJoin(F.broadcast(ends))
    turn = F.expr("(unix_micros(ts) - unix_micros(lo)) * 4 div (unix_micros(hi) - unix_micros(lo) + 1)")
    pts = pts.withColumn("turn", F.when((turn == 0) & (F.col("event_id") % 10 == 0), 3).otherwise(turn)).select("sample", "ts", "y", "turn")
    path, files = scratch_path(spark, "points"), 4
    for k in range(4):
        pts.where(F.col("turn") == k).select("sample", "ts", "y").repartition(files).write.mode("append").parquet(path)
    stream = spark.readStream.schema("sample string, ts timestamp, y double").option("maxFilesPerTrigger", files).parquet(path)
    got = st.run_available(st.stream_binned_signal(stream, "10 minutes", delay="10 minutes"), "append")
    return got.select("sample", F.expr("unix_micros(start) div 60000000").alias("start_minute"), F.round("value", 4).alias("value"), "n")


@query("X1_register_functions", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey / 10 END AS number, CASE WHEN p_partkey % 3 = 1 THEN 'Tanpa Grup' ELSE p_brand END AS label, replace(p_name, ' ', '') AS key, p_name AS series,
 CASE WHEN p_partkey % 7 < 2 THEN 'good' WHEN p_partkey % 7 < 3 THEN 'acceptable' ELSE 'poor' END AS status, p_partkey % 50 AS resnum, replace(p_name, ' ', '_') AS file FROM part""")
def _(spark, sf):
    register_functions(spark)
    b.table(spark, sf, "part").createOrReplaceTempView("assayloom_part")
    return spark.sql(r"""SELECT p_partkey, to_float(CASE WHEN p_partkey % 3 = 0 THEN replace(concat(' ', p_partkey / 10, '%'), '.', ',') ELSE 'n/a' END) AS number,
      group_label(CASE WHEN p_partkey % 3 = 1 THEN ' ' ELSE p_brand END) AS label, name_key(concat('(E)-', upper(p_name))) AS key, infer_series(concat(p_name, ' rep 2')) AS series, rmsd_status(p_partkey % 7) AS status,
      cast(parse_atom_spec(concat('A:SER', p_partkey % 50, ':OG')).resnum AS BIGINT) AS resnum, sanitize_filename(concat(p_name, ' ')) AS file FROM assayloom_part""")


@query("X3_set_canonicalizer", "SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN 'name:' || p_name ELSE 'smi:' || upper(p_brand) END AS key FROM part")
def _(spark, sf):
    set_canonicalizer(lambda c: F.upper(c))
    try:
        key = compound_key(F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")), F.col("p_name"))
    finally:
        set_canonicalizer(None)
    return b.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), key.alias("key"))


@query("X4_user_rules", """SELECT 'L' || p_partkey AS ligand, CASE WHEN p_size <= 10 THEN 'green' ELSE 'red' END AS size_flag, CASE WHEN p_retailprice < 1000 THEN 'cheap' ELSE 'dear' END AS price_label FROM part""")
def _(spark, sf):
    own = (*DEFAULT_RULES, Rule("own_size", "Toksisitas", "Size", "threshold_lte", hi=10), Rule("own_price", "Toksisitas", "Price", label_sql="case when value < 1000 then 'cheap' else 'dear' end"))
    wide = b.table(spark, sf, "part").select(F.concat(F.lit("L"), "p_partkey").alias("ligand"), F.col("p_size").alias("own_size"), F.col("p_retailprice").alias("own_price"))
    got = classify_rules(wide, own)
    return got.groupBy("ligand").agg(F.max(F.when(F.col("column") == "own_size", F.col("flag"))).alias("size_flag"), F.max(F.when(F.col("column") == "own_price", F.col("flag_label"))).alias("price_label"))
