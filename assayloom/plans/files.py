"""Queries over sources and sinks: the given tables are written in each file format and read back."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F
from pyspark.sql.types import StringType

from assayloom.functions import text as tx
from assayloom.functions.udfs import nfkd, safe_name
from assayloom.operators.features import densify
from assayloom.plans import bindings as b
from assayloom.plans.contacts import RAW_SPECS, raw_interactions
from assayloom.plans.features import LONG, feature_long
from assayloom.plans.registry import query
from assayloom.plans.screening import r6, stats
from assayloom.plans.signals import CLEAN, PEAKS, points
from assayloom.plans.structures import ATOMS, MERGED, atoms, merged
from assayloom.session import cut, scratch_path
from assayloom.sources import chromatograms as ch, records as rc, sinks, tables as tb


def _csv(spark, df, order, name):
    path = scratch_path(spark, name)
    df.orderBy(order).drop(order).write.option("header", True).option("quoteAll", True).csv(path)
    return path


# ---- tables ------------------------------------------------------------------------------------------------

@query("S1_read_ligands", """SELECT trim(p_name) AS name, CASE p_partkey % 4 WHEN 0 THEN '' ELSE 'C' || p_partkey END AS smiles, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS "group", p_partkey + 1 AS ord FROM part WHERE p_partkey % 9 <> 0""")
def _(spark, sf):
    k = F.col("p_partkey")
    df = b.table(spark, sf, "part").select(k.alias("o"), F.when(k % 9 == 0, "nan").otherwise(F.concat("p_name", F.lit(" "))).alias("Compound Name"), F.when(k % 4 == 0, "None").otherwise(F.concat(F.lit("C"), k)).alias("SMILES"),
                                           F.when(k % 6 != 0, F.col("p_brand")).alias("Source Group"))
    return tb.read_ligands(spark, _csv(spark, df, "o", "ligands"))


@query("S2_melt_wide_ligands", """SELECT p_name || ' a' AS name, '' AS smiles, 'Asli' AS "group", p_partkey + 1 AS ord FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT p_name, '', 'Tiruan', (SELECT count(*) FROM part) + p_partkey + 1 FROM part WHERE p_partkey % 3 = 0""")
def _(spark, sf):
    k = F.col("p_partkey")
    df = b.table(spark, sf, "part").select(k.alias("o"), F.when(k % 2 == 0, F.concat("p_name", F.lit(" a"))).alias("Asli"), F.when(k % 3 == 0, F.col("p_name")).alias(" Tiruan"))
    return tb.read_ligands(spark, _csv(spark, df, "o", "wide"))


@query("S3_read_receptors", """SELECT upper('1ab' || (s_suppkey % 7)) AS pdb_code, s_suppkey + 1 AS row_index, s_acctbal AS center_x, CAST(s_nationkey AS DOUBLE) AS center_y, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey AS DOUBLE) END AS center_z,
 CAST(20 AS DOUBLE) AS uniform_size, s_name AS label, upper('1ab' || (s_suppkey % 7)) || '_R' || lpad(CAST(s_suppkey + 1 AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey + 1 AS VARCHAR))) AS INT), '0') AS receptor FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    df = b.table(spark, sf, "supplier").select(k.alias("o"), F.concat(F.lit(" 1ab"), k % 7).alias("PDB Code"), F.col("s_acctbal").alias("Center_X"), F.col("s_nationkey").alias("center_y"), F.when(k % 3 != 0, k.cast("string")).otherwise("n/a").alias("center_z"),
                                               F.lit("20").alias("gridbox (A)"), F.col("s_name").alias("site"))
    return tb.read_receptors(spark, _csv(spark, df, "o", "receptors")).drop("size_x", "size_y", "size_z")


@query("S4_read_admet", """SELECT 'C' || p_partkey AS raw_smiles, CAST(p_partkey % 101 AS VARCHAR) AS "hERG", CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 7 AS VARCHAR) END AS "MW", p_partkey + 1 AS ord FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    df = b.table(spark, sf, "part").select(k.alias("o"), F.concat(F.lit("C"), k).alias("raw_smiles"), (k % 101).cast("string").alias("hERG"), F.when(k % 5 == 0, "NaN").otherwise((k % 7).cast("string")).alias("MW"))
    return tb.read_admet(spark, _csv(spark, df, "o", "admet"))


@query("S5_read_sample_groups", """SELECT c_name AS sample, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS series, 'K' || (c_custkey % 3) AS class, c_custkey + 1 AS ord FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    df = b.table(spark, sf, "customer").select(k.alias("o"), F.col("c_name").alias("Nama"), F.when(k % 4 == 0, "nan").otherwise(F.col("c_mktsegment")).alias("Produk"), F.concat(F.lit("K"), k % 3, F.lit(" ")).alias("KELAS"))
    return tb.read_sample_groups(spark, _csv(spark, df, "o", "groups"))


@query("S6_read_compound_library", """SELECT p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS rt, CAST(p_partkey AS DOUBLE) AS ri, '' AS cas, 'C' || p_partkey AS smiles, p_partkey + 1 AS ord FROM part WHERE p_partkey % 8 <> 0""")
def _(spark, sf):
    k = F.col("p_partkey")
    df = b.table(spark, sf, "part").select(k.alias("o"), F.when(k % 8 != 0, F.col("p_name")).alias("Senyawa"), F.when(k % 3 == 0, "bad").otherwise(F.col("p_retailprice").cast("string")).alias("Ret.Time"), k.alias("Kovats RI"), F.concat(F.lit("C"), k).alias("SMILES"))
    return tb.read_compound_library(spark, _csv(spark, df, "o", "library")).drop("aliases")


@query("S7_read_alkane_ladder", "SELECT CAST(c_custkey % 40 + 5 AS DOUBLE) AS carbon, c_acctbal AS rt FROM customer WHERE c_custkey % 7 <> 0")
def _(spark, sf):
    k = F.col("c_custkey")
    df = b.table(spark, sf, "customer").select(k.alias("o"), F.when(k % 7 != 0, (k % 40 + 5).cast("string")).alias("Karbon"), F.col("c_acctbal").alias("RT (min)"))
    return tb.read_alkane_ladder(spark, _csv(spark, df, "o", "ladder"))


@query("S8_list_inputs", "SELECT DISTINCT 'g=' || event_type AS label FROM events WHERE event_type <> 'error'")
def _(spark, sf):
    path = scratch_path(spark, "inputs")
    b.table(spark, sf, "events").select(F.col("event_type").alias("g"), F.col("event_id").cast("string").alias("line")).write.partitionBy("g").text(path)
    return tb.list_inputs(spark, path, exclude=("g=error",)).select("label").distinct()


@query("W4_unique_safe_names")
def _(spark, sf):
    """Numbering follows the input order; tested against a plain loop."""
    k = F.col("p_partkey")
    names = b.table(spark, sf, "part").select(k.alias("ord"), F.when(k % 3 == 0, F.upper("p_name")).when(k % 50 == 1, F.concat("p_name", F.lit("_2"))).otherwise(F.concat(F.lit("β-"), "p_name")).alias("name"))
    return tb.unique_safe_names(names).select("ord", "name", "safe_name")


@query("W4_native_names", """WITH n AS (SELECT s_suppkey AS ord, 'NATIVE_LIG_A' || (s_suppkey % 9) AS base, 'R' || s_suppkey AS receptor FROM supplier)
 SELECT ord, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY ord) > 1 OR base = 'NATIVE_LIG_A4' THEN base || '_' || receptor ELSE base END AS safe_name FROM n""")
def _(spark, sf):
    k = F.col("s_suppkey")
    rows = b.table(spark, sf, "supplier").select(k.alias("ord"), F.concat(F.lit("LIG_A"), k % 9).alias("label"), F.concat(F.lit("R"), k).alias("receptor"))
    used = b.table(spark, sf, "region").select(F.concat(F.lit("native_lig_a"), F.col("r_regionkey")).alias("safe_name")).where("safe_name = 'native_lig_a4'")
    return tb.native_names(rows, used).select("ord", "safe_name")


@query("W5_unique_sample_names", """WITH f AS (SELECT c_custkey AS ord, 'run' || (c_custkey % 700) AS name, 'd' || (c_custkey % 4) AS folder FROM customer), n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || folder || ')' ELSE name END AS nn FROM f)
 SELECT ord, name AS original, folder, CASE WHEN row_number() OVER (PARTITION BY nn ORDER BY ord) > 1 THEN nn || '_' || row_number() OVER (PARTITION BY nn ORDER BY ord) ELSE nn END AS name FROM n""")
def _(spark, sf):
    k = F.col("c_custkey")
    return tb.unique_sample_names(b.table(spark, sf, "customer").select(k.alias("ord"), F.concat(F.lit("run"), k % 700).alias("name"), F.concat(F.lit("d"), k % 4).alias("folder")))


# ---- chromatogram files --------------------------------------------------------------------------------------

def _documents(spark, lines, key, order, name):
    path = scratch_path(spark, name)
    sinks.write_documents(lines, path, key, order)
    return path


XML_CHUNK = 100_000


def _xml_files(spark, lines, name, root):
    """Well-formed files, one per sample and chunk of scans. The chunks are numbered in order and name the part files, so the files of a sample continue one another."""
    path = scratch_path(spark, name)
    body = lines.withColumn("_c", F.expr(f"seq div {XML_CHUNK}"))
    numbers = cut(body.select("_c").distinct().withColumn("chunk", F.row_number().over(Window.orderBy("_c")) - 1))     # one row per chunk
    body = body.join(F.broadcast(numbers), "_c").drop("_c")
    ends = body.select("sample", "chunk").distinct()
    edge = lambda seq, line: ends.select("sample", F.lit(seq).cast("long").alias("seq"), F.lit(line).alias("line"), "chunk")
    rows = body.unionByName(edge(-2 ** 62, f"<{root}>")).unionByName(edge(2 ** 62, f"</{root}>"))
    rows.repartitionById(max(1, numbers.count()), "chunk").sortWithinPartitions("sample", "seq").select("sample", "line").write.partitionBy("sample").text(path)
    return path


def _comma(c):
    """Decimal comma, as some exports write it."""
    t = c.cast("string")
    return F.when(t.contains("E"), t).otherwise(F.replace(t, F.lit("."), F.lit(",")))


@query("S9_read_delimited_signals", f"WITH {CLEAN} SELECT * FROM clean")
def _(spark, sf):
    pts = points(spark, sf)
    lines = pts.select("sample", F.col("ord").alias("seq"), F.concat_ws(";", _comma(F.col("rt")), _comma(F.col("y"))).alias("line"))
    head = pts.select("sample").distinct().select("sample", F.lit(-1).cast("long").alias("seq"), F.lit("Ret.Time;Absolute Intensity").alias("line"))
    return ch.read_delimited_signals(spark, _documents(spark, lines.unionByName(head), "sample", ["seq"], "delimited"), "min", "sample")


def _sections(spark, sf):
    """One document per sample: header facts, a signal section and a peak section."""
    pts = points(spark, sf)
    docs = pts.select("sample").distinct()
    fixed = [(0, "[Header]"), (1, "Data File\tx.qgd"), (2, "Sample Name\tEau"), (10, "[MS Chromatogram]"), (11, "m/z\tTIC"), (12, "Event Time(sec)\t0.3"), (13, "Ret.Time\tAbsolute Intensity\tRelative Intensity"),
             (29, ""), (30, "[MS Peak Table]"), (31, "# of Peaks\t9"), (32, "Peak#\tRet.Time\tProc.From\tProc.To\tArea\tHeight\tName\tCAS#")]
    heads = docs.select("sample", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("part"), F.lit(t).alias("line")) for k, t in fixed])).alias("h")).select("sample", "h.part", F.lit(0).cast("long").alias("seq"), "h.line")
    rt, y = F.col("rt").cast("string"), F.col("y").cast("string")
    body = pts.select("sample", F.lit(20).cast("long").alias("part"), F.col("ord").alias("seq"), F.concat_ws("\t", rt, y, F.lit("1.0")).alias("line"))
    found = pts.select("sample", F.lit(40).cast("long").alias("part"), F.col("ord").alias("seq"), F.concat_ws("\t", F.col("ord").cast("string"), rt, (F.col("rt") - 1).cast("string"), (F.col("rt") + 1).cast("string"),
                                            y, F.lit("5.0"), F.concat(F.lit("N"), F.col("ord")), F.lit("91-64-5")).alias("line"))
    return _documents(spark, heads.unionByName(body).unionByName(found), "sample", ["part", "seq"], "sections")


@query("S10_sectioned_signal", f"WITH {CLEAN} SELECT * FROM clean")
def _(spark, sf):
    return ch.read_sectioned_text(spark, _sections(spark, sf), "min", "sample")[0]


@query("S10_sectioned_peaks", f"WITH {CLEAN} SELECT sample, rt, y AS area, 5.0::DOUBLE AS height, rt - 1 AS \"start\", rt + 1 AS \"end\", 'N' || ord AS name, '91-64-5' AS cas FROM pts")
def _(spark, sf):
    return ch.read_sectioned_text(spark, _sections(spark, sf), "min", "sample")[1].select("sample", "rt", "area", "height", "start", "end", "name", "cas")


@query("S10_sectioned_meta", "WITH s AS (SELECT DISTINCT 'S' || (user_id % 12) AS document FROM events) SELECT document, k AS key, v AS value FROM s, (VALUES ('data file', 'x.qgd'), ('sample name', 'Eau'), ('m/z', 'TIC'), ('event time(sec)', '0.3'), ('# of peaks', '9'), ('ret.time', 'Absolute Intensity'), ('peak#', 'Ret.Time')) t(k, v)")
def _(spark, sf):
    return ch.read_sectioned_text(spark, _sections(spark, sf), "min", "sample")[2]


@query("S11_read_multi_signal", f"WITH {PEAKS}, c AS (SELECT rt, arg_min(area, ord) AS y FROM peaks GROUP BY 1) SELECT 'run1' AS sample, rt, y FROM c UNION ALL SELECT 'run2', rt, y * 2 FROM c")
def _(spark, sf):
    pts = points(spark, sf)
    lines = pts.select(F.lit("all").alias("doc"), F.col("ord").alias("seq"), F.concat_ws(",", F.col("rt").cast("string"), F.col("y").cast("string"), (F.col("y") * 2).cast("string"),
                       F.when(F.col("ord") % 3 == 0, "4").otherwise("x")).alias("line"))
    head = spark.range(1).select(F.lit("all").alias("doc"), F.lit(-1).cast("long").alias("seq"), F.lit("Time (min),run1,run2,notes").alias("line"))
    return ch.read_multi_signal(spark, _documents(spark, lines.unionByName(head), "doc", ["seq"], "multi"), "min", "doc")


@query("S12_read_peak_tables", f"WITH {PEAKS} SELECT sample, rt, area, 0.0::DOUBLE AS height, name FROM peaks")
def _(spark, sf):
    from assayloom.plans.signals import peaks
    rows = peaks(spark, sf)
    lines = rows.select("sample", F.col("ord").alias("seq"), F.concat_ws("\t", F.col("rt").cast("string"), F.col("area").cast("string"), "name").alias("line"))
    head = rows.select("sample").distinct().select("sample", F.lit(-1).cast("long").alias("seq"), F.lit("Retention Time (min)\tArea\tCompound").alias("line"))
    return ch.read_peak_tables(spark, _documents(spark, lines.unionByName(head), "sample", ["seq"], "peaks"), "min", "sample").select("sample", "rt", "area", "height", "name")


@query("S13_read_feature_matrix", f"""WITH {LONG} SELECT 'V' || sample AS sample, 'F' || feature AS feature, CASE WHEN (sample + feature) % 5 = 0 THEN 0 ELSE value END AS value FROM dense""")
def _(spark, sf):
    """Every cell is written as a number but every fifth one of a line, which is a dash and reads as zero."""
    cells = densify(feature_long(spark, sf))
    names = sorted(r["feature"] for r in cells.select("feature").distinct().collect())
    text = F.when((F.col("sample") + F.col("feature")) % 5 == 0, "-").otherwise(F.col("value").cast("string"))
    rows = cells.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("feature", text.alias("t")))).alias("cells"))
    line = F.concat_ws(",", F.concat(F.lit("V"), "sample"), F.array_join(F.transform("cells", lambda c: c["t"]), ","))
    lines = rows.select(F.lit("m").alias("doc"), F.col("sample").alias("seq"), line.alias("line"))
    head = spark.range(1).select(F.lit("m").alias("doc"), F.lit(-1).cast("long").alias("seq"), F.lit(",".join(["Sample"] + [f"F{n}" for n in names])).alias("line"))
    return ch.read_feature_matrix(spark, _documents(spark, lines.unionByName(head), "doc", ["seq"], "matrix"), "doc").drop("document")


@F.pandas_udf(StringType())
def _packed(y: pd.Series, little: pd.Series) -> pd.Series:
    """Intensities y and 2y as a packed binary array; the big-endian form interleaves positions."""
    return pd.Series([base64.b64encode(zlib.compress((np.array([v, 2 * v], "<f8") if le else np.array([1, v, 2, 2 * v], ">f8")).tobytes())).decode() for v, le in zip(y, little)])


@query("S14_read_mzml_tic", f"WITH {CLEAN}, w AS (SELECT sample, rt, CASE WHEN ord % 3 = 0 THEN y + 2 * y ELSE y END AS y, ord FROM pts WHERE ord % 5 <> 0) SELECT sample, rt, arg_min(y, ord) AS y FROM w GROUP BY 1, 2")
def _(spark, sf):
    pts = points(spark, sf)
    level = F.when(F.col("ord") % 5 == 0, "2").otherwise("1")
    cv = lambda acc, value, unit="": F.concat(F.lit(f'<cvParam accession="{acc}" value="'), value, F.lit(f'" unitName="{unit}"/>'))
    binary = F.concat(F.lit('<binaryDataArrayList><binaryDataArray><cvParam accession="MS:1000523" value=""/><cvParam accession="MS:1000574" value=""/><cvParam accession="MS:1000515" value=""/><binary>'),
                      _packed(F.col("y"), F.lit(True)), F.lit("</binary></binaryDataArray></binaryDataArrayList>"))
    total = F.when(F.col("ord") % 3 == 0, binary).otherwise(cv("MS:1000285", F.col("y").cast("string")))
    start = F.concat(F.lit("<scanList><scan>"), cv("MS:1000016", F.col("rt").cast("string"), "minute"), F.lit("</scan></scanList>"))
    body = F.when(F.col("ord") % 3 == 0, F.concat(start, total)).otherwise(F.concat(total, start))
    lines = pts.select("sample", F.col("ord").alias("seq"), F.concat(F.lit("<spectrum>"), cv("MS:1000511", level), body, F.lit("</spectrum>")).alias("line"))
    return ch.read_mzml_tic(spark, _xml_files(spark, lines, "mzml", "mzML"), "sample")


@query("S15_read_mzxml_tic", f"WITH {CLEAN}, w AS (SELECT sample, CASE WHEN ord % 2 = 0 THEN rt ELSE rt * 60 / 60 END AS rt, CASE WHEN ord % 3 = 0 THEN y + 2 * y ELSE y END AS y, ord FROM pts WHERE ord % 5 <> 0) SELECT sample, round(rt, 9) AS rt, round(arg_min(y, ord), 9) AS y FROM w GROUP BY sample, w.rt")
def _(spark, sf):
    pts, o = points(spark, sf), F.col("ord")
    time = F.when(o % 2 == 0, F.concat(F.lit("PT"), F.col("rt").cast("string"), F.lit("M"))).otherwise(F.concat(F.lit("PT"), (F.col("rt") * 60).cast("string"), F.lit("S")))
    total = F.when(o % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(' totIonCurrent="'), F.col("y").cast("string"), F.lit('"')))
    peaks_ = F.concat(F.lit('<peaks precision="64" compressionType="zlib">'), _packed(F.col("y"), F.lit(False)), F.lit("</peaks>"))
    lines = pts.select("sample", o.alias("seq"), F.concat(F.lit('<scan msLevel="'), F.when(o % 5 == 0, "2").otherwise("1"), F.lit('" retentionTime="'), time, F.lit('"'), total, F.lit(">"), peaks_, F.lit("</scan>")).alias("line"))
    return ch.read_mzxml_tic(spark, _xml_files(spark, lines, "mzxml", "mzXML"), "sample").select("sample", F.round("rt", 9).alias("rt"), F.round("y", 9).alias("y"))


@query("S16_read_all", """WITH p AS (SELECT user_id, (epoch_us(ts) % 86400000000) / 60000000 AS rt, value AS y, event_id AS ord FROM events), c AS (SELECT user_id, rt, arg_min(y, ord) AS y FROM p GROUP BY 1, 2)
 SELECT count(DISTINCT user_id) AS n_samples, count(*) AS n_points, round(sum(y), 4) AS total, 1::BIGINT AS n_skipped FROM c""")
def _(spark, sf):
    path = scratch_path(spark, "all")
    rows = b.table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.concat_ws("\t", (b.day_micros("ts") / 60000000).cast("string"), F.col("value").cast("string")).alias("line"))
    # a file per user, in folders of so many files that one can be listed at a time
    shards = max(1, -(-2 * rows.select("user_id").distinct().count() // tb.BATCH_FILES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("user_id"), F.lit(shards)))
    rows.repartition("user_id").sortWithinPartitions("shard", "user_id", "seq").select("shard", "user_id", "line").write.partitionBy("shard", "user_id").text(path + "/signals")
    b.table(spark, sf, "region").select(F.col("r_name").alias("value")).coalesce(1).write.text(path + "/junk")
    got = ch.read_all(spark, path, "min")
    bad = got.skipped.agg(F.count(F.lit(1)).alias("n")).scalar()
    return got.signals.agg(F.count_distinct("sample").alias("n_samples"), F.count(F.lit(1)).alias("n_points"), F.round(F.sum("y"), 4).alias("total")).withColumn("n_skipped", bad)


# ---- records ------------------------------------------------------------------------------------------------

RECORDS_A_FILE = 200_000     # packed files are not split, so they are kept small


def _packed_texts(df, path):
    """Text that is only read back: indented JSON is many times its table, so it is packed."""
    df.write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


@query("S17_read_interactions", f"""WITH {RAW_SPECS} SELECT receptor || complex AS document, type AS type_subtype, CASE WHEN ts.chain <> '' AND fs.chain <> '' THEN NULL ELSE 'atom not understood' END AS error,
 nullif(fs.chain, '') AS from_chain, try_cast(fs.resnum AS INT) AS from_resnum, nullif(ts.chain, '') AS to_chain, try_cast(ts.resnum AS INT) AS to_resnum FROM spec""")
def _(spark, sf):
    raw = raw_interactions(spark, sf).withColumn("document", F.concat("receptor", "complex"))
    named = F.xxhash64("document") % 2 == 0
    cells = lambda *c: F.concat_ws("\t", *c)
    lines = raw.select("document", F.lit(1).cast("long").alias("seq"), F.when(named, cells(F.lit("Hydrogen Bond"), F.lit("f"), "type_subtype", "f", "t")).otherwise(
        cells(*[F.lit(x) for x in ("n", "Yes", "g", "p", "3.1", "Hydrogen Bond")], "type_subtype", "f", F.lit("H-Donor"), "t", F.lit("H-Acceptor"))).alias("line"))
    head = raw.select("document").distinct().withColumn("_n", named).select("document", F.lit(0).cast("long").alias("seq"), F.when(F.col("_n"), cells(*[F.lit(x) for x in ("Category", "From Chemistry", "Types", "From", "To")])).otherwise(
        cells(*[F.lit(f"column {k}") for k in range(11)])).alias("line"))
    df = rc.read_interactions(spark, _documents(spark, lines.unionByName(head), "document", ["seq"], "contacts"), "document")
    return df.select("document", "type_subtype", "error", F.col("from_spec.chain").alias("from_chain"), F.col("from_spec.resnum").alias("from_resnum"), F.col("to_spec.chain").alias("to_chain"), F.col("to_spec.resnum").alias("to_resnum"))


@query("S18_read_pdb_atoms", f"WITH {ATOMS} SELECT structure, record, CAST(ord % 100000 AS INT) AS serial, atom, resname, chain, resnum, x, y, z, element FROM atoms")
def _(spark, sf):
    path = scratch_path(spark, "pdb")
    sinks.write_complex_text(atoms(spark, sf).select("*", F.col("structure").alias("complex"), F.lit(0).alias("part")), path)
    return rc.read_pdb_atoms(spark, path, "complex").select("structure", "record", "serial", "atom", "resname", "chain", "resnum", "x", "y", "z", "element")


@query("K5_write_complex_text", f"""WITH {MERGED}, n AS (SELECT complex, (SELECT count(*) FROM rec WHERE rec.structure = hd.structure) AS r, (SELECT count(*) FROM lg WHERE lg.complex = hd.complex) AS l FROM hd)
 SELECT complex AS document, r + l AS n_atoms, CAST((CASE WHEN r > 0 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS n_ter, 'END' AS last FROM n""")
def _(spark, sf):
    from assayloom.sources.lines import ORDER, read_lines
    path = scratch_path(spark, "complexes")
    sinks.write_complex_text(merged(spark, sf), path)
    lines = read_lines(spark, path, "complex")
    return lines.groupBy("document").agg(F.count_if(F.col("line").rlike("^(ATOM|HETATM)")).alias("n_atoms"), F.count_if(F.col("line") == "TER").alias("n_ter"), F.max_by("line", F.struct(*ORDER)).alias("last"))


@query("S19_read_pose_atoms", """WITH p AS (SELECT 'D' || (l_orderkey % 50) AS document, l_linenumber AS model, l_quantity AS x, l_orderkey AS o, l_partkey AS k FROM lineitem)
 SELECT document, model, x, CASE k % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'Cl' ELSE 'N' END AS element, count(*) AS n FROM p GROUP BY ALL""")
def _(spark, sf):
    li = b.table(spark, sf, "lineitem").select(F.concat(F.lit("D"), F.col("l_orderkey") % 50).alias("doc"), F.col("l_linenumber").alias("model"), F.col("l_quantity").alias("x"), F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("k"))
    atom = F.when(F.col("k") % 3 == 0, "O1").when(F.col("k") % 3 == 1, "Cl1").otherwise("N1")
    kind = F.when(F.col("k") % 3 == 0, "OA").when(F.col("k") % 3 == 1, "").otherwise("NA")
    line = F.format_string("ATOM  %5d  %-3s LIG A   1    %8.3f%8.3f%8.3f  1.00  0.00    +0.000 %-2s", F.pmod("seq", F.lit(100000)).cast("int"), atom, F.col("x"), F.lit(0.0), F.lit(0.0), kind)
    body = li.select("doc", F.col("model").alias("part"), F.lit(1).alias("sub"), "seq", line.alias("line"))
    per = li.select("doc", "model").distinct()
    head = per.select("doc", F.col("model").alias("part"), F.lit(0).alias("sub"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("MODEL "), F.col("model")).alias("line"))
    tail = per.select("doc", F.col("model").alias("part"), F.lit(2).alias("sub"), F.lit(0).cast("long").alias("seq"), F.lit("ENDMDL").alias("line"))
    stray = li.select("doc").distinct().select("doc", F.lit(99).alias("part"), F.lit(0).alias("sub"), F.lit(0).cast("long").alias("seq"), F.lit("ATOM      1  C1  LIG A   1       1.000   1.000   1.000").alias("line"))
    path = _documents(spark, body.unionByName(head).unionByName(tail).unionByName(stray), "doc", ["part", "sub", "seq"], "poses")
    return rc.read_pose_atoms(spark, path, "doc").groupBy("document", "model", "x", "element").agg(F.count(F.lit(1)).alias("n"))


@query("S20_read_score_logs", """SELECT 'D' || (l_orderkey % 80) AS document, CAST(l_orderkey % 1000 AS INT) AS mode, -l_extendedprice AS affinity, l_discount AS rmsd_lb, l_tax AS rmsd_ub FROM lineitem WHERE l_linenumber <> 2
 UNION ALL SELECT 'D' || (l_orderkey % 80), CAST(l_orderkey % 1000 AS INT), -l_extendedprice, NULL, NULL FROM lineitem WHERE l_linenumber = 2""")
def _(spark, sf):
    li = b.table(spark, sf, "lineitem").withColumn("doc", F.concat(F.lit("D"), F.col("l_orderkey") % 80))
    mode, score = (F.col("l_orderkey") % 1000).cast("string"), (-F.col("l_extendedprice")).cast("string")
    text = F.when(F.col("l_linenumber") == 2, F.concat_ws("  ", mode, score)).otherwise(F.concat_ws("   ", mode, score, F.col("l_discount").cast("string"), F.col("l_tax").cast("string")))
    body = li.select("doc", F.lit(2).alias("part"), F.concat(F.lit("   "), text).alias("line"))
    fixed = [(0, "Performing docking (random seed: 42) ... done."), (0, "1 2.0 not yet a score"), (1, "-----+------------+----------+----------"), (3, "Writing output ... done.")]
    head = li.select("doc").distinct().select("doc", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(t).alias("line")) for k, t in fixed])).alias("h")).select("doc", "h.part", "h.line")
    return rc.read_score_logs(spark, _documents(spark, body.unionByName(head), "doc", ["part"], "logs"), "doc").select("document", "mode", "affinity", "rmsd_lb", "rmsd_ub")


@query("S21_read_run_checkpoints", f"WITH {b.RUNS} SELECT ligand, receptor, CAST(ord % 1000 AS INT) AS replicate, affinity, n_poses FROM runs WHERE NOT failed")
def _(spark, sf):
    path = scratch_path(spark, "runs")
    runs = b.docking_runs(spark, sf)
    _packed_texts(runs.select(F.col("ligand").alias("ligand_name"), F.col("receptor").alias("receptor_key"), (F.col("replicate") % 1000).cast("int").alias("replicate"), "seed", "poses", "error").select(
        F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")), path)
    df = rc.read_run_checkpoints(spark, path, glob="*")
    return df.select("ligand", "receptor", "replicate", F.col("poses")[0]["affinity"].alias("affinity"), F.size("poses").alias("n_poses"))


@query("S22_read_complex_sidecars", "SELECT 'R' || (l_suppkey % 10) AS receptor, l_orderkey || '_' || l_linenumber AS complex, l_linenumber = 1 AS is_native FROM lineitem WHERE l_partkey % 6 <> 0")
def _(spark, sf):
    path = scratch_path(spark, "sidecars")
    li = b.table(spark, sf, "lineitem")
    rec = F.to_json(F.struct(F.concat(F.lit("R"), F.col("l_suppkey") % 10).alias("receptor"), F.concat("l_orderkey", F.lit("_"), "l_linenumber").alias("complex"), F.lit("X").alias("ligand_chain"), (F.col("l_linenumber") == 1).alias("is_native")), {"pretty": "true"})
    _packed_texts(li.select(F.when(F.col("l_partkey") % 6 == 0, F.lit('{"receptor": "R1", broken')).otherwise(rec).alias("value")), path)
    return rc.read_complex_sidecars(spark, path, glob="*").select("receptor", "complex", "is_native")


@query("K1_write_report", f"WITH {b.STATS} SELECT * FROM stats")
def _(spark, sf):
    path = scratch_path(spark, "report")
    s = stats(spark, sf)
    written = sinks.write_report({"ligands": b.compounds(spark, sf), "docking": s, "empty": s.where("ligand is null")}, path, notes=["one"], parameters={"replicates": 3})
    if written != ["ligands", "docking", "notes", "parameters"]:
        raise ValueError(f"unexpected report tables {written}")
    return spark.read.parquet(f"{path}/docking")


@query("K2_order_report_columns", f"WITH {b.WIDE} SELECT ligand, \"MW\", \"hERG\", unknown_property FROM wide")
def _(spark, sf):
    df = sinks.order_report_columns(b.properties(spark, sf).select("unknown_property", "hERG", "ligand", "MW"))
    if df.columns != ["ligand", "MW", "hERG", "unknown_property"]:
        raise ValueError(f"unexpected column order {df.columns}")
    return df


@query("K6_run_manifest", "SELECT DISTINCT 'c' || (l_partkey % 900) AS path FROM lineitem WHERE l_partkey % 900 NOT IN (SELECT o_orderkey % 700 FROM orders)")
def _(spark, sf):
    active = b.table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey") % 700).alias("path"))
    previous = b.table(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_partkey") % 900).alias("path"))
    return sinks.run_manifest(active, previous)[1]


# ---- text functions ----------------------------------------------------------------------------------------

@query("F1_to_float", """WITH t AS (SELECT CASE l_linenumber % 7 WHEN 0 THEN ' ' || replace(CAST(l_quantity AS VARCHAR), '.', ',') WHEN 1 THEN l_discount || '%' WHEN 2 THEN 'n/a' WHEN 3 THEN '1e3' WHEN 4 THEN '1,234,5' WHEN 5 THEN '--' ELSE CAST(l_tax AS VARCHAR) END AS raw,
  CASE l_linenumber % 7 WHEN 0 THEN l_quantity WHEN 1 THEN l_discount WHEN 3 THEN 1000 WHEN 6 THEN l_tax END AS value FROM lineitem) SELECT raw, value, count(*) AS n FROM t GROUP BY ALL""")
def _(spark, sf):
    m = F.col("l_linenumber") % 7
    raw = (F.when(m == 0, F.concat(F.lit(" "), F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")))).when(m == 1, F.concat(F.col("l_discount").cast("string"), F.lit("%"))).when(m == 2, "n/a")
           .when(m == 3, "1e3").when(m == 4, "1,234,5").when(m == 5, "--").otherwise(F.col("l_tax").cast("string")))
    rows = b.table(spark, sf, "lineitem").select(raw.alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("raw", tx.to_float("raw").alias("value"), "n")


@query("P2_group_label", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Tanpa Grup' WHEN 1 THEN 'Tanpa Grup' ELSE p_brand END AS label FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    return b.table(spark, sf, "part").select(k, tx.group_label(F.when(k % 4 == 1, "  ").when(k % 4 > 1, F.concat(F.lit(" "), "p_brand"))).alias("label"))


@query("F3_sanitize_filename")
def _(spark, sf):
    """Unicode folding has no SQL twin; tested on literal cases."""
    rows = b.table(spark, sf, "documents").select("doc_id", "text")
    return rows.select("doc_id", safe_name("text").alias("safe_name"))


@query("F4_pdb_resname", "SELECT p_partkey, upper(substr(regexp_replace(p_name, '[^a-z0-9]', '', 'g') || 'XXX', 1, 3)) AS resname FROM part")
def _(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", tx.residue_name(nfkd(F.concat(F.lit("7"), "p_name")), nfkd("p_brand")).alias("resname"))


@query("F7_rt_from_label", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey / 10 WHEN 1 THEN CAST(o_custkey AS DOUBLE) WHEN 2 THEN o_custkey / 4 END AS rt FROM orders")
def _(spark, sf):
    m, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    label = F.when(m == 0, F.concat(F.lit("RT "), F.replace((c / 10).cast("string"), F.lit("."), F.lit(",")), F.lit(" min"))).when(m == 1, c.cast("string")).when(m == 2, F.concat(F.lit("rt"), (c / 4).cast("string"))).otherwise(F.concat(F.lit("linalool "), c))
    return b.table(spark, sf, "orders").select("o_orderkey", tx.rt_from_label(label).alias("rt"))


@query("F8_unit_hint", "SELECT c_custkey, ['msec', 'sec', 'sec', 'min', 'min', NULL][CAST(c_custkey % 6 AS INT) + 1] AS hint FROM customer")
def _(spark, sf):
    heads = F.array(*[F.lit(x) for x in ("Time (ms)", "RT (s)", "Waktu detik", "Ret.Time min", "Retention minutes", "Ret.Time")])
    return b.table(spark, sf, "customer").select("c_custkey", tx.unit_hint(F.element_at(heads, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("hint"))


@query("F9_parse_box_size", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 20.0 WHEN 1 THEN s_suppkey + 0.5 WHEN 2 THEN 3.0 ELSE NULL END::DOUBLE AS x, CASE s_suppkey % 5 WHEN 0 THEN 20.0 WHEN 1 THEN s_suppkey + 0.5 WHEN 2 THEN CAST(s_suppkey AS DOUBLE) ELSE NULL END::DOUBLE AS z FROM supplier")
def _(spark, sf):
    m, k = F.col("s_suppkey") % 5, F.col("s_suppkey")
    text = F.when(m == 0, "").when(m == 1, F.concat((k.cast("string")), F.lit(",5"))).when(m == 2, F.concat(F.lit("3 4.5 "), k)).when(m == 3, "1 -2 3").otherwise("4 x")
    box = tx.parse_box_size(text)
    return b.table(spark, sf, "supplier").select("s_suppkey", box[0].alias("x"), box[2].alias("z"))


@query("F9_parse_pdb_codes", "SELECT n_nationkey, '1AB' || (n_nationkey % 10) || ',2XYZ' AS valid, 'bad;toolong' AS invalid FROM nation")
def _(spark, sf):
    text = F.concat(F.lit(" 1ab"), F.col("n_nationkey") % 10, F.lit("; 2xyz,bad 1AB"), F.col("n_nationkey") % 10, F.lit(" toolong"))
    codes = tx.parse_pdb_codes(text)
    return b.table(spark, sf, "nation").select("n_nationkey", F.array_join(codes["valid"], ",").alias("valid"), F.array_join(codes["invalid"], ";").alias("invalid"))


@query("F10_guess_element", "SELECT s_suppkey, ['O', 'N', 'Cl', 'C', 'C', 'Zn'][CAST(s_suppkey % 6 AS INT) + 1] AS element FROM supplier")
def _(spark, sf):
    k = (F.col("s_suppkey") % 6 + 1).cast("int")
    names, kinds = ("O1", "XX", "Cl2", "C7", "", "Q1"), ("OA", "NA", "", "??", "", "Zn+")
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), k)
    return b.table(spark, sf, "supplier").select("s_suppkey", tx.guess_element(at(names), at(kinds)).alias("element"))


@query("F11_compound_key", f"WITH {b.COMPOUNDS} SELECT ord, key FROM keyed")
def _(spark, sf):
    return b.compounds(spark, sf).select("ord", tx.compound_key("smiles", "name").alias("key"))


@query("F12_format_cell", "SELECT l_extendedprice AS v, CASE WHEN l_extendedprice >= 100 THEN printf('%.0f', round_even(l_extendedprice, 0)) ELSE CAST(l_extendedprice AS VARCHAR) END AS cell, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    rows = b.table(spark, sf, "lineitem").groupBy(F.col("l_extendedprice").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("v", tx.format_cell("v").alias("cell"), "n")


@query("F12_feature_label", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || ' (' END || CASE WHEN p_partkey % 4 = 0 THEN 'F' || p_partkey ELSE printf('%.2f', p_retailprice) END || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ')' END AS label FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    return b.table(spark, sf, "part").select("p_partkey", tx.feature_label(F.when(k % 3 != 0, F.col("p_name")), F.when(k % 4 != 0, F.col("p_retailprice")), F.concat(F.lit("F"), k)).alias("label"))


@query("F15_column_role", "SELECT c_custkey, ['rt', 'area', 'height', 'intensity_abs', 'relative', 'name', 'cas', 'similarity', 'start', 'end', 'area_pct', NULL][CAST(c_custkey % 12 AS INT) + 1] AS role FROM customer")
def _(spark, sf):
    heads = ("Ret.Time (min)", "Luas", "Height", "Absolute Intensity", "Rel. Abundance", "Nama", "CAS#", "SI", "Proc.From", "Proc.To", "Area %", "Mark")
    at = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("c_custkey") % 12 + 1).cast("int"))
    return b.table(spark, sf, "customer").select("c_custkey", tx.column_role(at).alias("role"))


@query("F18_finite_or_null", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS value FROM customer")
def _(spark, sf):
    k = F.col("c_custkey") % 3
    return b.table(spark, sf, "customer").select("c_custkey", tx.finite_or_null(F.when(k == 0, F.col("c_acctbal")).when(k == 1, float("nan")).otherwise(float("inf"))).alias("value"))
