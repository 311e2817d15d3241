"""Queries over docking runs, groups, property flags and compound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayloom import rules
from assayloom.operators import screening as op
from assayloom.plans import bindings as b
from assayloom.plans.registry import query


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return op.replicate_stats(b.docking_runs(spark, sf))


@query("A1_replicate_stats", f"WITH {b.STATS} SELECT * FROM stats")
def _(spark, sf):
    return stats(spark, sf)


@query("A10_summarize_docking_by_group", f"""WITH {b.GROUPED} SELECT receptor, grp AS "group", count(*) AS n_ligands, {b.half_up('avg(affinity_best)')} AS affinity_mean,
 {b.half_up('stddev_pop(affinity_best)')} AS affinity_std, {b.half_up('min(affinity_best)')} AS affinity_best, min(native_affinity) AS native_affinity,
 CASE WHEN grp <> 'Native' THEN round(100.0 * sum(CASE WHEN affinity_best <= native_affinity THEN 1.0 WHEN native_affinity IS NOT NULL THEN 0.0 END)
   / count(native_affinity), 1) END AS percent_better
 FROM g LEFT JOIN natives USING (receptor) GROUP BY receptor, grp""")
def summarize_docking(spark, sf):
    return op.summarize_docking_by_group(stats(spark, sf), b.ligand_groups(spark, sf))


@query("A2_affinities_by_group", f"WITH {b.GROUPED} SELECT receptor, grp AS \"group\", ligand, affinity_best FROM g WHERE grp <> 'Native'")
def _(spark, sf):
    return op.affinities_by_group(stats(spark, sf), b.ligand_groups(spark, sf))


@query("A3_native_affinity", f"WITH {b.STATS}, {b.GROUPS}, {b.NATIVE} SELECT * FROM natives")
def _(spark, sf):
    return op.native_affinity(stats(spark, sf), b.ligand_groups(spark, sf))


@query("A4_fraction_better_than_native", f"""WITH {b.GROUPED} SELECT receptor, grp AS "group",
 round(CAST(100.0 * sum(CASE WHEN affinity_best <= native_affinity THEN 1 ELSE 0 END) / count(*) AS DOUBLE), 6) AS percent_better
 FROM g JOIN natives USING (receptor) WHERE grp <> 'Native' GROUP BY 1, 2""")
def _(spark, sf):
    df = op.fraction_better_than_native(stats(spark, sf), b.ligand_groups(spark, sf))
    return df.select("receptor", "group", *r6("percent_better"))


@query("A5_flag_scores_by_group", f"""WITH {b.FLAGS}, {b.GROUPS} SELECT grp AS "group", category, label, rule_ord, round(CAST(avg(s) AS DOUBLE), 6) AS score
 FROM scored JOIN grps USING (ligand) WHERE category = 'Toksisitas' GROUP BY ALL""")
def _(spark, sf):
    df = op.flag_scores_by_group(b.properties(spark, sf), b.ligand_groups(spark, sf), "Toksisitas")
    return df.withColumn("score", F.round("score", 6))


def flags(spark, sf):
    return rules.classify_rules(b.properties(spark, sf))


SHARES = ", ".join(f"round(CAST(100.0 * sum(CASE WHEN flag = '{c}' THEN 1 ELSE 0 END) / count(*) AS DOUBLE), 6) AS {c}" for c in ("green", "yellow", "red"))


@query("A6_flag_shares_by_group", f"""WITH {b.FLAGS}, {b.GROUPS} SELECT grp AS "group", category, label, rule_ord, {SHARES}
 FROM scored JOIN grps USING (ligand) GROUP BY grp, category, label, rule_ord""")
def _(spark, sf):
    df = op.flag_shares_by_group(b.properties(spark, sf), b.ligand_groups(spark, sf))
    return df.select("group", "category", "label", "rule_ord", *r6("green", "yellow", "red"))


@query("A7_category_scores", f"WITH {b.CATEGORY_SCORES} SELECT ligand, category, round(score, 6) AS score FROM cs")
def _(spark, sf):
    return op.category_scores(b.properties(spark, sf)).select("ligand", "category", *r6("score"))


@query("A7_category_scores_by_group", f"""WITH {b.CATEGORY_SCORES}, {b.GROUPS} SELECT grp AS "group", category, round(avg(score), 6) AS score
 FROM cs JOIN grps USING (ligand) GROUP BY 1, 2""")
def _(spark, sf):
    return op.category_scores_by_group(b.properties(spark, sf), b.ligand_groups(spark, sf)).select("group", "category", *r6("score"))


@query("A8_property_distribution", f"""WITH {b.DESCRIPTORS}, {b.GROUPS}, long AS (SELECT grp, p.property, p.value FROM descriptors JOIN grps USING (ligand),
   LATERAL (VALUES ('MW', MW), ('LogP', LogP), ('HBA', HBA)) p(property, value)),
 q AS (SELECT grp, property, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2)
 SELECT grp AS "group", property, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
 FROM long JOIN q USING (grp, property) GROUP BY ALL""")
def _(spark, sf):
    df = op.property_distribution(b.descriptors(spark, sf), b.ligand_groups(spark, sf), ["MW", "LogP", "HBA"])
    return df.select("group", "property", "n", *r6("q1", "median", "q3", "whisker_low", "whisker_high"))


SCORED_CATEGORIES = ("Absorpsi", "Distribusi", "Metabolisme", "Ekskresi", "Toksisitas")
GROUP_SCORES = f"""gs AS (SELECT grp, {", ".join(f"avg(score) FILTER (category = '{c}') AS {c}" for c in SCORED_CATEGORIES)}
  FROM cs JOIN grps USING (ligand) GROUP BY 1)"""


@query("A9_summarize_groups", f"""WITH {b.DESCRIPTORS}, {b.CATEGORY_SCORES}, {b.GROUPS}, {GROUP_SCORES},
 props AS (SELECT grp, count(*) AS n_ligands, round(CAST(100.0 * avg(CAST(violations <= 1 AS INT)) AS DOUBLE), 1) AS ro5_percent,
   {", ".join(f"round(avg({c}), 2) AS {c}_mean" for c in ("MW", "LogP", "HBD", "HBA"))} FROM ro5 JOIN grps USING (ligand) GROUP BY 1)
 SELECT grp AS "group", props.* EXCLUDE (grp), {", ".join(f"round({c}, 3) AS score_{c}" for c in SCORED_CATEGORIES)} FROM props JOIN gs USING (grp)""")
def _(spark, sf):
    return op.summarize_groups(op.lipinski_ro5(b.descriptors(spark, sf)), b.properties(spark, sf), b.ligand_groups(spark, sf))


@query("A11_best_run_per_pair", f"""WITH {b.RUNS} SELECT ligand, receptor, replicate, affinity_best FROM (SELECT ligand, receptor, ord AS replicate, affinity AS affinity_best,
 row_number() OVER (PARTITION BY ligand, receptor ORDER BY affinity, ord) AS rn FROM runs WHERE NOT failed) WHERE rn = 1""")
def _(spark, sf):
    df = op.best_run_per_pair(b.docking_runs(spark, sf))
    return df.select("ligand", "receptor", "replicate", op.best_affinity().alias("affinity_best"))


@query("A16_multi_group_compounds", f"""WITH {b.COMPOUNDS}, p AS (SELECT DISTINCT lower(trim(name)) AS compound, grp AS "group" FROM compounds)
 SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY compound) AS n_groups FROM p) WHERE n_groups > 1""")
def _(spark, sf):
    return op.multi_group_compounds(b.compounds(spark, sf))


GROUP_BY_KEY = """firsts AS (SELECT key, min(ord) AS first_ord, arg_min(name, ord) AS name, arg_min(smiles, ord) AS smiles, count(*) AS n_members FROM keyed GROUP BY 1),
 slots AS (SELECT *, row_number() OVER (ORDER BY first_ord) AS slot, n_members - 1 AS n_duplicates FROM firsts)"""


@query("A17_group_by_key", f"WITH {b.COMPOUNDS}, {GROUP_BY_KEY} SELECT * FROM slots")
def _(spark, sf):
    return op.group_by_key(b.compounds(spark, sf))


@query("A17_describe_duplicates", f"""WITH {b.COMPOUNDS}, {GROUP_BY_KEY}, f AS (SELECT * FROM slots WHERE n_members > 1 ORDER BY first_ord LIMIT 5)
 SELECT f.first_ord, f.name, k.grp AS "group", count(*) AS n_members, (SELECT greatest(count(*) - 5, 0) FROM slots WHERE n_members > 1) AS n_more
 FROM f JOIN keyed k USING (key) GROUP BY f.first_ord, f.name, k.grp""")
def _(spark, sf):
    return op.describe_duplicates(b.compounds(spark, sf))


@query("A37_flag_shares", f"WITH {b.FLAGS} SELECT category, label, rule_ord, {SHARES} FROM scored GROUP BY category, label, rule_ord")
def _(spark, sf):
    return op.flag_shares(b.properties(spark, sf)).select("category", "label", "rule_ord", *r6("green", "yellow", "red"))


@query("A38_affinity_matrix", f"""WITH {b.GROUPED} SELECT receptor, ligand AS "column", affinity_best AS value FROM g WHERE grp <> 'Native'
 UNION ALL SELECT receptor, 'Native (ref)', native_affinity FROM natives""")
def _(spark, sf):
    return op.affinity_matrix(stats(spark, sf), b.ligand_groups(spark, sf))


@query("A38_affinity_group_matrix", f"""WITH {b.GROUPED} SELECT receptor, grp AS "column", round(avg(affinity_best), 9) AS value FROM g WHERE grp <> 'Native' GROUP BY 1, 2
 UNION ALL SELECT receptor, 'Native (ref)', native_affinity FROM natives""")
def _(spark, sf):
    return op.affinity_group_matrix(stats(spark, sf), b.ligand_groups(spark, sf)).withColumn("value", F.round("value", 9))


@query("A42_group_flag_matrix", f"""WITH {b.CATEGORY_SCORES}, {b.GROUPS}, {GROUP_SCORES} SELECT grp AS "group", {", ".join(f"round({c}, 6) AS {c}" for c in SCORED_CATEGORIES)} FROM gs""")
def _(spark, sf):
    return op.group_flag_matrix(b.properties(spark, sf), b.ligand_groups(spark, sf)).select("group", *r6(*SCORED_CATEGORIES))


PARAMETERS = [r.label for r in rules.DEFAULT_RULES if r.category == "Toksisitas" and r.rule_type != "descriptive"]


@query("A42_group_parameter_matrix", f"""WITH {b.FLAGS}, {b.GROUPS} SELECT grp AS "group", {", ".join(f"""round(CAST(avg(s) FILTER (label = '{x.replace("'", "''")}') AS DOUBLE), 6) AS "{x}" """ for x in PARAMETERS)}
 FROM scored JOIN grps USING (ligand) WHERE category = 'Toksisitas' GROUP BY grp""")
def _(spark, sf):
    got = op.group_parameter_matrix(flags(spark, sf), b.ligand_groups(spark, sf), "Toksisitas")
    return got.select("group", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in PARAMETERS])


@query("P1_with_group", f"""WITH {b.STATS}, {b.GROUPS} SELECT ligand, coalesce(grp, 'Tanpa Grup') AS "group", receptor, affinity_best FROM stats LEFT JOIN grps USING (ligand)""")
def _(spark, sf):
    return op.with_group(stats(spark, sf).select("ligand", "receptor", "affinity_best"), b.ligand_groups(spark, sf))


@query("P3_lipinski_ro5", f'WITH {b.DESCRIPTORS} SELECT ligand, violations, violations <= 1 AS "Lolos_Ro5" FROM ro5')
def _(spark, sf):
    return op.lipinski_ro5(b.descriptors(spark, sf)).select("ligand", "violations", "Lolos_Ro5")


@query("P4_classify_rules", f"""WITH {b.FLAGS} SELECT ligand, col AS "column", raw, v AS value, flag, category, label, CASE
 WHEN flag = 'na' THEN 'N/A' WHEN rule_type = 'alert_count' THEN CASE flag WHEN 'green' THEN 'Tanpa peringatan' ELSE 'Ada peringatan' END
 WHEN rule_type = 'descriptive' THEN CASE WHEN v IS NULL THEN raw WHEN col = 'mp' THEN CASE WHEN v < 25 THEN 'Cair (<25 C)' ELSE 'Padat (>=25 C)' END
   WHEN col = 'bp' THEN CASE WHEN v < 25 THEN 'Gas (<25 C)' ELSE 'Cair/padat pada suhu ruang (>=25 C)' END ELSE printf('%g', v) END
 WHEN rule_type = 'range' THEN CASE flag WHEN 'green' THEN 'Optimal' ELSE 'Di luar rentang' END
 WHEN rule_type IN ('binary', 'threshold_gte', 'threshold_lte') THEN CASE flag WHEN 'green' THEN 'Baik' ELSE 'Buruk' END
 ELSE CASE flag WHEN 'green' THEN 'Sangat baik' WHEN 'yellow' THEN 'Sedang' ELSE 'Buruk' END END AS flag_label FROM flags""")
def _(spark, sf):
    return flags(spark, sf).select("ligand", "column", "raw", "value", "flag", "category", "label", "flag_label")


@query("P7_docking_rows", f"""WITH {b.RUNS} SELECT ligand, receptor, ord AS replicate, seed, CASE WHEN NOT failed THEN affinity END AS affinity_best,
 CASE WHEN failed THEN 0 ELSE n_poses END AS n_poses, CASE WHEN failed THEN 'gagal' ELSE 'sukses' END AS status FROM runs""")
def _(spark, sf):
    return op.docking_rows(b.docking_runs(spark, sf))


@query("P8_ligand_summary", f"""WITH {b.COMPOUNDS}, {b.RUNS}, done AS (SELECT DISTINCT ligand AS safe_name FROM runs WHERE NOT failed)
 SELECT name, safe_name, smiles, grp AS "group", 'uji' AS type, CASE WHEN done.safe_name IS NULL THEN 'gagal' ELSE 'siap' END AS status
 FROM compounds LEFT JOIN done USING (safe_name)
 UNION ALL SELECT s_name, 'N' || s_suppkey, '', 'Native', 'native', 'siap' FROM supplier""")
def _(spark, sf):
    prepared = b.docking_runs(spark, sf).where(op.succeeded()).select(F.col("ligand").alias("safe_name"))
    natives = b.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("N"), "s_suppkey").alias("safe_name"), F.lit("").alias("smiles"))
    return op.ligand_summary(b.compounds(spark, sf), prepared, natives)


@query("J2_add_delta_vs_native", f"""WITH {b.GROUPED} SELECT ligand, receptor, grp AS "group", affinity_best,
 CASE WHEN grp <> 'Native' THEN round(affinity_best - native_affinity, 3) END AS delta_vs_native FROM g LEFT JOIN natives USING (receptor)""")
def _(spark, sf):
    df = op.add_delta_vs_native(stats(spark, sf), b.ligand_groups(spark, sf))
    return df.select("ligand", "receptor", "group", "affinity_best", "delta_vs_native")


@query("J3_fan_out", f"""WITH {b.COMPOUNDS}, {GROUP_BY_KEY} SELECT k.name AS ligand, k.grp AS "group", k.ord, CAST(slots.first_ord * 0.5 AS DOUBLE) AS score
 FROM keyed k JOIN slots USING (key) WHERE slots.slot % 7 <> 0""")
def _(spark, sf):
    unique = op.group_by_key(b.compounds(spark, sf)).where("slot % 7 <> 0").select("key", (F.col("first_ord") * F.lit(0.5)).alias("score"))
    return op.fan_out(unique, b.compounds(spark, sf)).withColumn("score", F.col("score").cast("double"))


def _returned(spark, sf):
    k = F.col("p_partkey")
    return b.table(spark, sf, "part").select(k.alias("ord"), F.concat(F.lit("C"), k % 301).alias("raw_smiles"), (k * 3 % 97).alias("score"))


@query("J4_join_by_position", f"""WITH {b.COMPOUNDS} SELECT c.ord, name, smiles, 'C' || (p_partkey % 301) AS raw_smiles, p_partkey * 3 % 97 AS score FROM compounds c JOIN part ON p_partkey = ord""")
def _(spark, sf):
    return op.join_by_position(b.compounds(spark, sf), _returned(spark, sf)).select("ord", "name", "smiles", "raw_smiles", "score")


@query("J4_join_by_unique_position", f"""WITH {b.COMPOUNDS}, {GROUP_BY_KEY} SELECT k.ord, k.name, slots.slot * 2 AS score FROM keyed k JOIN slots USING (key)""")
def _(spark, sf):
    results = op.group_by_key(b.compounds(spark, sf)).select(F.col("slot").alias("ord"), (F.col("slot") * 2).alias("score"))
    return op.join_by_position(b.compounds(spark, sf), results).select("ord", "name", "score")


@query("J4_structure_mismatches", f"""WITH {b.COMPOUNDS} SELECT c.ord, name, smiles, 'C' || (p_partkey % 301) AS raw_smiles FROM compounds c JOIN part ON p_partkey = ord
 WHERE smiles <> '' AND smiles <> 'C' || (p_partkey % 301)""")
def _(spark, sf):
    return op.structure_mismatches(op.join_by_position(b.compounds(spark, sf), _returned(spark, sf)))


SENT = "sent AS (SELECT p_partkey // 50 AS batch, p_partkey % 50 AS pos, 'C' || (p_partkey * 7 % 1000) AS key FROM part)"


@query("J5_map_batches", f"""WITH {SENT}, returned AS (SELECT batch, pos, key AS raw_smiles, batch * 100 + pos AS score FROM sent WHERE NOT (batch % 3 = 2 AND pos = 3)
   UNION ALL SELECT batch, 50, key, -1 FROM sent WHERE batch % 3 = 1 AND pos = 0)
 SELECT batch, pos, key, CASE batch % 3 WHEN 0 THEN 'position' ELSE 'structure' END AS how, key AS raw_smiles, batch * 100 + pos AS score FROM sent WHERE batch % 3 < 2""")
def _(spark, sf):
    k = F.col("p_partkey")
    sent = b.table(spark, sf, "part").select(F.expr("p_partkey div 50").alias("batch"), (k % 50).alias("pos"), F.concat(F.lit("C"), k * 7 % 1000).alias("key"))
    rows = sent.select("batch", "pos", F.col("key").alias("raw_smiles"), (F.col("batch") * 100 + F.col("pos")).alias("score"))
    returned = rows.where("not (batch % 3 = 2 and pos = 3)").unionByName(
        rows.where("batch % 3 = 1 and pos = 0").withColumns({"pos": F.lit(50).cast("long"), "score": F.lit(-1).cast("long")}))
    return op.map_batches(sent, returned)


@query("J6_docking_tasks", """SELECT 'L' || p_partkey AS ligand, 'R' || n_nationkey AS receptor, CAST(r AS INT) AS replicate, CAST(41 + r AS BIGINT) AS seed
 FROM part, nation, range(1, 4) t(r)""")
def _(spark, sf):
    ligands = b.table(spark, sf, "part").select(F.concat(F.lit("L"), "p_partkey").alias("ligand"))
    targets = b.table(spark, sf, "nation").select(F.concat(F.lit("R"), "n_nationkey").alias("receptor"))
    return op.docking_tasks(ligands, targets, 3, 42)


@query("J15_pending_keys", f"""WITH {b.COMPOUNDS}, d AS (SELECT 'raw:C' || (c_custkey % 200) AS key FROM customer) SELECT DISTINCT key FROM keyed WHERE key NOT IN (SELECT key FROM d)""")
def _(spark, sf):
    done = b.table(spark, sf, "customer").select(F.concat(F.lit("raw:C"), F.col("c_custkey") % 200).alias("key"))
    return op.pending_keys(op.group_by_key(b.compounds(spark, sf)).select("key"), done, ["key"])


@query("J15_pending_complexes", f"""WITH {b.GROUPED} SELECT DISTINCT g.receptor, g.ligand AS complex, grp = 'Native' AS is_native FROM g
 WHERE (receptor, ligand) NOT IN (SELECT (receptor, ligand) FROM runs WHERE failed)""")
def _(spark, sf):
    done = b.docking_runs(spark, sf).where(~op.succeeded()).select("receptor", F.col("ligand").alias("complex"))
    rows = op.with_group(stats(spark, sf), b.ligand_groups(spark, sf)).select("receptor", F.col("ligand").alias("complex"), (F.col("group") == "Native").alias("is_native"))
    return op.pending_complexes(rows, done)


COMBINED = f"""lip AS (SELECT ligand, MW, LogP, HBD, HBA FROM descriptors),
 cw AS (SELECT ligand, {", ".join(f"min(score) FILTER (category = '{c}') AS {c}" for c in SCORED_CATEGORIES)} FROM cs GROUP BY 1)"""


@query("U3_report_union", f"""WITH {b.GROUPED} SELECT ligand, receptor, affinity_best, CAST(NULL AS DOUBLE) AS native_affinity FROM g WHERE grp <> 'Native'
 UNION ALL SELECT NULL, receptor, NULL, native_affinity FROM natives""")
def _(spark, sf):
    s, g = stats(spark, sf), b.ligand_groups(spark, sf)
    return op.report_union(op.affinities_by_group(s, g).select("ligand", "receptor", "affinity_best"), op.native_affinity(s, g))


@query("U5_missing_keys", f"""WITH {b.STATS}, {b.GROUPS} SELECT DISTINCT 'L' || l_partkey || ' R' || l_suppkey % 10 AS pair FROM lineitem
 EXCEPT SELECT ligand || ' ' || receptor FROM stats""")
def _(spark, sf):
    pair = F.concat_ws(" ", "ligand", "receptor").alias("pair")
    return op.missing_keys(b.docking_runs(spark, sf).select(pair), stats(spark, sf).select(pair), "pair")


@query("W3_group_order", f"""WITH {b.GROUPS} SELECT grp AS "group", CAST(row_number() OVER (ORDER BY grp <> 'Native', min(ord)) AS BIGINT) AS position FROM grps GROUP BY grp""")
def _(spark, sf):
    return op.group_order(b.ligand_groups(spark, sf))


@query("W6_paginate", f"""WITH {b.GROUPED}, n AS (SELECT CAST(greatest(1, ceil(count(*) / 30)) AS BIGINT) AS n_pages FROM g),
 o AS (SELECT CAST(substr(ligand, 2) AS BIGINT) AS lnum, CAST(substr(receptor, 2) AS BIGINT) AS rnum, affinity_best FROM g)
 SELECT lnum, rnum, position, n_pages, page FROM (SELECT *, row_number() OVER (ORDER BY affinity_best, lnum, rnum) AS position FROM o), n,
  LATERAL (SELECT (SELECT count(*) FROM g) // n_pages AS small, (SELECT count(*) FROM g) % n_pages AS extra),
  LATERAL (SELECT CAST(CASE WHEN position - 1 < extra * (small + 1) THEN (position - 1) // (small + 1) ELSE extra + (position - 1 - extra * (small + 1)) // small END + 1 AS BIGINT) AS page)""")
def _(spark, sf):
    s = stats(spark, sf).select(F.substr("ligand", F.lit(2)).cast("long").alias("lnum"), F.substr("receptor", F.lit(2)).cast("long").alias("rnum"), "affinity_best")
    return op.paginate(s, ["affinity_best", "lnum", "rnum"], 30).drop("affinity_best")


@query("W6_paginate_grid", f"""WITH {b.STATS}, c AS (SELECT CAST(substr(ligand, 2) AS BIGINT) AS "row", CAST(substr(receptor, 2) AS BIGINT) AS "col" FROM stats),
 p AS (SELECT count(*) AS n, CAST(ceil(count(*) / 30) AS BIGINT) AS pages FROM part)
 SELECT "row", "col", CAST((CASE WHEN "row" < (n % pages) * (n // pages + 1) THEN "row" // (n // pages + 1)
   ELSE n % pages + ("row" - (n % pages) * (n // pages + 1)) // (n // pages) END) * 2 + "col" // 5 + 1 AS BIGINT) AS tile FROM c, p""")
def _(spark, sf):
    cells = stats(spark, sf).select(F.substr("ligand", F.lit(2)).cast("long").alias("row"), F.substr("receptor", F.lit(2)).cast("long").alias("col"))
    return op.paginate_grid(cells, 30, 5, b.table(spark, sf, "part").count(), 10)


@query("T1_rank_affinity", f"""WITH {b.GROUPED} SELECT ligand || ' (' || receptor || ')' AS label, affinity_best, grp = 'Native' AS is_native FROM g ORDER BY affinity_best, 1 LIMIT 40""")
def _(spark, sf):
    return op.rank_affinity(stats(spark, sf), b.ligand_groups(spark, sf), 40)


RMSD_POSES = """rp AS (SELECT receptor, ord AS replicate, CAST(m AS INT) AS mode, CASE WHEN ord % 4 = 0 THEN NULL ELSE (ord * 37 % 1009) / 100 END AS rmsd, affinity + (m - 1) * 0.25 AS affinity
  FROM (SELECT 'R' || l_partkey AS receptor, ord, affinity, n_poses, failed FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS ord, -l_extendedprice / 7919 AS affinity,
   1 + l_linenumber % 3 AS n_poses, l_returnflag = 'R' AS failed FROM lineitem)), range(1, 4) t(m) WHERE m <= n_poses AND NOT failed)"""


@query("A12_rmsd_summary", f"""WITH {RMSD_POSES} SELECT receptor, b.replicate, b.mode, b.rmsd, b.affinity,
 CASE WHEN b.rmsd IS NULL THEN 'gagal' WHEN b.rmsd < 2 THEN 'good' WHEN b.rmsd < 3 THEN 'acceptable' ELSE 'poor' END AS status,
 CASE WHEN b.rmsd IS NOT NULL THEN a.rmsd END AS rmsd_affinity_best, CASE WHEN b.rmsd IS NOT NULL THEN a.replicate END AS affinity_best_replicate, CASE WHEN b.rmsd IS NOT NULL THEN a.mode END AS affinity_best_mode
 FROM (SELECT DISTINCT receptor FROM rp) r
 LEFT JOIN (SELECT DISTINCT ON (receptor) * FROM rp WHERE rmsd IS NOT NULL ORDER BY receptor, rmsd, replicate, mode, affinity) b USING (receptor)
 LEFT JOIN (SELECT DISTINCT ON (receptor) * FROM rp ORDER BY receptor, affinity, replicate, mode) a USING (receptor)""")
def _(spark, sf):
    from assayloom.functions.text import rmsd_status
    li = b.table(spark, sf, "lineitem").withColumn("receptor", F.concat(F.lit("R"), "l_partkey"))
    runs = b.docking_runs(spark, sf)
    o = F.col("replicate")
    poses = (li.select("receptor", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("replicate"), (-F.col("l_extendedprice") / 7919).alias("aff"),
                       (1 + F.col("l_linenumber") % 3).alias("n"), "l_returnflag").where("l_returnflag <> 'R'")
             .withColumn("mode", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
             .select("receptor", "replicate", "mode", F.when(o % 4 != 0, (o * 37 % 1009) / 100).alias("rmsd"), (F.col("aff") + (F.col("mode") - 1) * F.lit(0.25)).alias("affinity"))
             .withColumn("status", rmsd_status("rmsd")))
    return op.rmsd_summary(poses)


@query("P6_rmsd_status", f"""WITH {RMSD_POSES} SELECT receptor, replicate, mode, CASE WHEN rmsd IS NULL THEN 'gagal' WHEN rmsd < 2 THEN 'good' WHEN rmsd < 3 THEN 'acceptable' ELSE 'poor' END AS status FROM rp""")
def _(spark, sf):
    from assayloom.functions.text import rmsd_status
    o = F.col("replicate")
    li = b.table(spark, sf, "lineitem").where("l_returnflag <> 'R'")
    return (li.select(F.concat(F.lit("R"), "l_partkey").alias("receptor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("replicate"),
                      F.explode(F.sequence(F.lit(1), (1 + F.col("l_linenumber") % 3).cast("int"))).alias("mode"))
            .withColumn("status", rmsd_status(F.when(o % 4 != 0, (o * 37 % 1009) / 100))))


@query("K3_rules_legend", f"""WITH rules(col, category, category_ord, label, rule_type, lo, hi, ascending_bad, inverted, rule_ord) AS (VALUES {b._rule_values()}),
 u AS (SELECT l_returnflag || l_linestatus AS x, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT category, col AS "column", label, rule_ord, CASE rule_type
  WHEN 'range' THEN printf('%g', lo) || ' sampai ' || printf('%g', hi) || ' hijau, di luar rentang merah'
  WHEN 'threshold_gte' THEN CASE WHEN lo <> round(lo, 6) THEN '> ' ELSE '>= ' END || printf('%g', round(lo, 6)) || ' hijau, selain itu merah'
  WHEN 'threshold_lte' THEN CASE WHEN hi <> round(hi, 6) THEN '< ' ELSE '<= ' END || printf('%g', round(hi, 6)) || ' hijau, selain itu merah'
  WHEN 'tiered' THEN '0-0,3 hijau / 0,3-0,7 kuning / 0,7-1,0 merah' WHEN 'tiered_reversed' THEN '0-0,3 merah / 0,3-0,7 kuning / 0,7-1,0 hijau'
  WHEN 'tiered_range' THEN CASE WHEN ascending_bad THEN printf('<= %g hijau / %g-%g kuning / > %g merah', lo, lo, hi, hi) ELSE printf('> %g hijau / %g-%g kuning / < %g merah', hi, lo, hi, lo) END
  WHEN 'alert_count' THEN 'tanpa peringatan hijau, ada peringatan merah' WHEN 'binary' THEN CASE WHEN inverted THEN '0 hijau, 1 merah' ELSE '1 hijau, 0 merah' END
  ELSE 'informasi saja (tanpa ambang)' END AS threshold, p.n_cells FROM rules JOIN (SELECT col, count(*) AS n_cells FROM (SELECT ligand, col FROM ({"WITH " + b.WIDE} SELECT * FROM wide) UNPIVOT (raw FOR col IN ({", ".join(f'"{c}"' for c in b.PROPERTY_COLUMNS)}))) GROUP BY 1) p USING (col)""")
def _(spark, sf):
    filled = flags(spark, sf).where("raw is not null").groupBy("column").agg(F.count(F.lit(1)).alias("n_cells"))
    return rules.rules_legend(spark).join(filled, "column").select("category", "column", "label", "rule_ord", "threshold", "n_cells")
