"""Queries over contact tables and profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions.text import parse_atom_spec, residue_label
from assayloom.operators import contacts as op, profile as pr, screening as sc
from assayloom.plans import bindings as b
from assayloom.plans.registry import query
from assayloom.plans.screening import COMBINED, SCORED_CATEGORIES, flags, r6, stats
from assayloom.session import cut

RESIDUE = "substr('ALAGLYSERHISLEU', (l_partkey % 5) * 3 + 1, 3)"
CONTACTS = f"""contacts AS (SELECT DISTINCT 'R' || (l_suppkey % 10) AS receptor, 'K' || (l_orderkey % 200) AS complex, l_partkey % 60 AS resnum,
  substr('ALAGLYSERHISLEU', CAST(l_partkey % 5 AS INT) * 3 + 1, 3) AS resname, l_returnflag || l_linestatus AS type FROM lineitem),
 ref AS (SELECT * FROM contacts WHERE complex = 'K0'),
 refsize AS (SELECT receptor, count(DISTINCT resnum || resname) AS n_aa_ref, count(*) AS int_aa_ref FROM ref GROUP BY 1),
 sim AS (SELECT c.receptor, c.complex, coalesce(a.n, 0) AS n_aa_test, n_aa_ref, coalesce(t.n, 0) AS int_aa_test, int_aa_ref
  FROM (SELECT DISTINCT receptor, complex FROM contacts WHERE complex <> 'K0') c JOIN refsize USING (receptor)
  LEFT JOIN (SELECT receptor, complex, count(*) AS n FROM (SELECT DISTINCT receptor, complex, resnum, resname FROM contacts) x
    JOIN (SELECT DISTINCT receptor, resnum, resname FROM ref) y USING (receptor, resnum, resname) GROUP BY 1, 2) a USING (receptor, complex)
  LEFT JOIN (SELECT x.receptor, x.complex, count(*) AS n FROM contacts x JOIN ref USING (receptor, resnum, resname, type) GROUP BY 1, 2) t USING (receptor, complex)),
 simp AS (SELECT *, round(n_aa_test / n_aa_ref * 100.0, 2) AS aa_similarity, round(int_aa_test / int_aa_ref * 100.0, 2) AS type_similarity,
   round(0.5 * (n_aa_test / n_aa_ref * 100.0) + 0.5 * (int_aa_test / int_aa_ref * 100.0), 2) AS overall_similarity FROM sim)"""


def contacts(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("R"), F.col("l_suppkey") % 10).alias("receptor"), F.concat(F.lit("K"), F.col("l_orderkey") % 200).alias("complex"),
        (F.col("l_partkey") % 60).alias("resnum"), F.expr("substr('ALAGLYSERHISLEU', cast(l_partkey % 5 as int) * 3 + 1, 3)").alias("resname"),
        F.concat("l_returnflag", "l_linestatus").alias("type"))


def sidecars(spark, sf):
    return contacts(spark, sf).select("receptor", "complex").distinct().select(
        "receptor", "complex", F.concat(F.lit("L"), F.substr("complex", F.lit(2))).alias("ligand_name"), F.lit("X").alias("ligand_chain"),
        (F.col("complex") == "K0").alias("is_native"))


@query("J13_interaction_similarity", f"""WITH {CONTACTS} SELECT receptor, complex, 'L' || substr(complex, 2) AS ligand_name, 'L0' AS reference_name, n_aa_test, n_aa_ref,
 aa_similarity, int_aa_test, int_aa_ref, type_similarity, overall_similarity FROM simp""")
def similarity(spark, sf):
    return op.interaction_similarity(contacts(spark, sf), sidecars(spark, sf))


@query("J14_similarity_affinities", f"""WITH {CONTACTS}, {b.GROUPED}, t AS (SELECT receptor, 'K' || substr(ligand, 2) AS complex, affinity_best AS affinity_test FROM stats),
 rd AS (SELECT 'R' || s_suppkey AS receptor, -s_suppkey * 0.75 AS redock FROM supplier WHERE s_suppkey < 4 ORDER BY 1)
 SELECT receptor, complex, overall_similarity, affinity_test, CAST(coalesce(redock, native_affinity) AS DOUBLE) AS affinity_ref,
  round(affinity_test - CAST(coalesce(redock, native_affinity) AS DOUBLE), 3) AS delta_g
 FROM simp LEFT JOIN t USING (receptor, complex) LEFT JOIN natives USING (receptor) LEFT JOIN rd USING (receptor)""")
def _(spark, sf):
    redock = b.table(spark, sf, "supplier").select(F.concat(F.lit("R"), "s_suppkey").alias("receptor"),
                                                   F.when(F.col("s_suppkey") < 4, -F.col("s_suppkey") * 0.75).alias("affinity"))
    df = op.similarity_affinities(similarity(spark, sf), stats(spark, sf), b.ligand_groups(spark, sf), redock)
    return df.select("receptor", "complex", "overall_similarity", "affinity_test", "affinity_ref", "delta_g")


@query("U1_matched_contacts", f"""WITH {CONTACTS}, c AS (SELECT *, resnum || '-' || resname[1] || lower(resname[2:]) AS label FROM contacts WHERE complex <> 'K0')
 SELECT receptor, complex, array_to_string(list(label ORDER BY resnum, label), ',') AS matched_residues, min(mi) AS matched_interactions
 FROM (SELECT DISTINCT receptor, complex, resnum, resname, label FROM c) JOIN (SELECT DISTINCT receptor, resnum, resname FROM ref) USING (receptor, resnum, resname)
 LEFT JOIN (SELECT c.receptor, c.complex, array_to_string(list(label || ' (' || type || ')' ORDER BY label || ' (' || type || ')'), ',') AS mi FROM c JOIN ref USING (receptor, resnum, resname, type) GROUP BY ALL) USING (receptor, complex)
 GROUP BY receptor, complex""")
def _(spark, sf):
    df = op.matched_contacts(contacts(spark, sf), sidecars(spark, sf))
    return df.select("receptor", "complex", F.array_join("matched_residues", ",").alias("matched_residues"), F.array_join("matched_interactions", ",").alias("matched_interactions"))


@query("U2_residue_union", f"WITH {CONTACTS} SELECT DISTINCT receptor, resnum, resname FROM contacts")
def _(spark, sf):
    return op.residue_union(contacts(spark, sf))


@query("A39_contact_footprint", f"""WITH {CONTACTS}, k AS (SELECT DISTINCT receptor, complex FROM contacts), r AS (SELECT DISTINCT receptor, resnum, resname FROM contacts)
 SELECT k.receptor, k.complex, r.resnum, r.resname, k.complex = 'K0' AS is_reference, CASE WHEN EXISTS (SELECT 1 FROM contacts c WHERE c.receptor = k.receptor AND c.complex = k.complex
  AND c.resnum = r.resnum AND c.resname = r.resname) THEN 1 ELSE 0 END AS contact FROM k JOIN r USING (receptor)""")
def _(spark, sf):
    return op.contact_footprint(contacts(spark, sf), sidecars(spark, sf))


@query("T7_rank_similarity", f"WITH {CONTACTS} SELECT receptor, 'L' || substr(complex, 2) AS ligand_name, overall_similarity FROM simp")
def _(spark, sf):
    return op.rank_similarity(similarity(spark, sf)).select("receptor", "ligand_name", "overall_similarity")


RAW_SPECS = """raw AS (SELECT 'R' || (l_suppkey % 10) AS receptor, 'K' || (l_orderkey % 200) AS complex, l_returnflag || l_linestatus AS type,
  CASE l_linenumber % 3 WHEN 0 THEN 'X:LIG1:C' || l_linenumber WHEN 1 THEN 'A:ser' || (l_partkey % 60 - 10) ELSE 'B:PHE' || (l_partkey % 60) || ':CZ ' END AS f,
  CASE l_linenumber % 4 WHEN 0 THEN 'X:LIG1:N1' WHEN 1 THEN 'A:HIS' || (l_partkey % 40) || ':ND1' WHEN 2 THEN 'C:GLY' || (l_partkey % 40) ELSE 'bad' END AS t FROM lineitem),
 spec AS (SELECT *, regexp_matches(f, '^\\s*[A-Za-z0-9]{1,2}:') AND regexp_matches(t, ':') AS ok, regexp_extract(f, '^\\s*([A-Za-z0-9]{1,2}):([A-Za-z0-9]{1,4}?)(-?\\d+)(?::(.+?))?\\s*$', ['chain', 'resname', 'resnum', 'atom']) AS fs,
   regexp_extract(t, '^\\s*([A-Za-z0-9]{1,2}):([A-Za-z0-9]{1,4}?)(-?\\d+)(?::(.+?))?\\s*$', ['chain', 'resname', 'resnum', 'atom']) AS ts FROM raw)"""


def raw_interactions(spark, sf):
    f = "CASE l_linenumber % 3 WHEN 0 THEN 'X:LIG1:C' || l_linenumber WHEN 1 THEN 'A:ser' || (l_partkey % 60 - 10) ELSE 'B:PHE' || (l_partkey % 60) || ':CZ ' END"
    t = "CASE l_linenumber % 4 WHEN 0 THEN 'X:LIG1:N1' WHEN 1 THEN 'A:HIS' || (l_partkey % 40) || ':ND1' WHEN 2 THEN 'C:GLY' || (l_partkey % 40) ELSE 'bad' END"
    return b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("R"), F.col("l_suppkey") % 10).alias("receptor"), F.concat(F.lit("K"), F.col("l_orderkey") % 200).alias("complex"),
        F.concat("l_returnflag", "l_linestatus").alias("type_subtype"), F.expr(f).alias("f"), F.expr(t).alias("t"))


@query("F6_parse_atom_spec", f"""WITH {RAW_SPECS}, u AS (SELECT f AS s, fs AS p FROM spec UNION ALL SELECT t, ts FROM spec)
 SELECT s AS spec, nullif(p.chain, '') AS chain, CASE WHEN p.chain <> '' THEN upper(p.resname) END AS resname, try_cast(p.resnum AS INT) AS resnum,
  CASE WHEN p.chain <> '' THEN p.atom END AS atom_name, CASE WHEN p.chain <> '' THEN p.resnum || '-' || upper(p.resname[1]) || lower(p.resname[2:]) END AS label, count(*) AS n FROM u GROUP BY ALL""")
def _(spark, sf):
    raw = raw_interactions(spark, sf)
    rows = raw.select(F.explode(F.array("f", "t")).alias("spec")).groupBy("spec").agg(F.count(F.lit(1)).alias("n")).withColumn("p", parse_atom_spec("spec"))
    return rows.select("spec", "p.chain", "p.resname", "p.resnum", "p.atom_name", residue_label("p.resnum", "p.resname").alias("label"), "n")


@query("P9_filter_protein_ligand", f"""WITH {RAW_SPECS} SELECT receptor, complex, CAST(CASE WHEN fs.chain = 'X' THEN ts.resnum ELSE fs.resnum END AS INT) AS resnum,
 upper(CASE WHEN fs.chain = 'X' THEN ts.resname ELSE fs.resname END) AS resname, type FROM spec WHERE ts.chain <> '' AND (fs.chain = 'X') <> (ts.chain = 'X')""")
def _(spark, sf):
    raw = raw_interactions(spark, sf).withColumns({"from_spec": parse_atom_spec("f"), "to_spec": parse_atom_spec("t")}).where("to_spec is not null and from_spec is not null")
    return op.filter_protein_ligand(raw, sidecars(spark, sf))


# ---- profiles --------------------------------------------------------------------------------------------

CRITERIA = ["affinity_best", "MW", "LogP", "HBD", "HBA", *SCORED_CATEGORIES]
PROFILE = f"""{b.STATS}, {b.DESCRIPTORS}, {b.CATEGORY_SCORES}, {COMBINED},
 comb AS (SELECT DISTINCT ON (ligand) ligand, receptor, {", ".join(CRITERIA)} FROM stats JOIN lip USING (ligand) JOIN cw USING (ligand)
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in CRITERIA)} ORDER BY ligand, affinity_best, receptor)"""


def combined(spark, sf):
    return pr.combined_profile(stats(spark, sf), b.descriptors(spark, sf), b.properties(spark, sf))


@query("J16_combined_profile", f"WITH {PROFILE} SELECT ligand, receptor, {', '.join(f'round({c}, 6) AS {c}' for c in CRITERIA)} FROM comb")
def _(spark, sf):
    return combined(spark, sf).select("ligand", "receptor", *r6(*CRITERIA))


@query("A41_group_profile", f"""WITH {b.GROUPS}, {PROFILE}, best AS (SELECT ligand, min(affinity_best) AS affinity_best FROM stats GROUP BY 1),
 m AS (SELECT coalesce(grp, 'Tanpa Grup') AS "group", {", ".join(f"avg({c}) AS {c}" for c in CRITERIA)} FROM best LEFT JOIN grps USING (ligand) LEFT JOIN lip USING (ligand) LEFT JOIN cw USING (ligand) GROUP BY 1)
 SELECT "group", {", ".join(f"round({c}, 6) AS {c}" for c in CRITERIA)} FROM m WHERE {" AND ".join(f"{c} IS NOT NULL" for c in CRITERIA)}""")
def _(spark, sf):
    df = pr.group_profile(stats(spark, sf), b.descriptors(spark, sf), b.properties(spark, sf), b.ligand_groups(spark, sf))
    return df.select("group", *r6(*CRITERIA))


LOWER = {"affinity_best", "MW", "LogP", "HBD", "HBA"}
ABSOLUTE = set(SCORED_CATEGORIES)


def _minmax_sql() -> str:
    out = []
    for c in CRITERIA:
        if c in ABSOLUTE:
            out.append(f"greatest(least({c}, 1), 0) AS {c}")
        else:
            out.append(f"(max({c}) OVER () - {c}) / (max({c}) OVER () - min({c}) OVER ()) AS {c}")
    return "mm AS (SELECT ligand, CAST(substr(ligand, 2) AS BIGINT) AS ord, " + ", ".join(out) + " FROM comb)"


def minmax(spark, sf):
    # the profile table is read twice (ranges, rows) and is far smaller than the property table behind it
    rows = cut(combined(spark, sf).withColumn("ord", F.substr("ligand", F.lit(2)).cast("long")))
    return pr.profile_minmax(rows, CRITERIA, LOWER, ABSOLUTE)


@query("P22_profile_minmax", f"WITH {PROFILE}, {_minmax_sql()} SELECT ligand, {', '.join(f'round({c}, 6) AS {c}' for c in CRITERIA)} FROM mm")
def _(spark, sf):
    return minmax(spark, sf).select("ligand", *r6(*CRITERIA))


@query("T2_rank_profiles", f"""WITH {PROFILE}, {_minmax_sql()}, s AS (SELECT ligand, ord, ({" + ".join(CRITERIA)}) / {len(CRITERIA)} AS score FROM mm),
 pin AS (SELECT * FROM s WHERE ligand IN ('L1', 'L2', 'L3', 'L5') ),
 rest AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) - 1 AS k0, count(*) OVER () AS n FROM s WHERE ligand NOT IN (SELECT ligand FROM pin)),
 z AS (SELECT *, 8 - (SELECT count(*) FROM pin) AS size FROM rest), y AS (SELECT *, CAST(ceil(n / size) AS BIGINT) AS pages FROM z),
 p AS (SELECT ligand, score, CAST(CASE WHEN k0 < (n % pages) * (n // pages + 1) THEN k0 // (n // pages + 1) ELSE n % pages + (k0 - (n % pages) * (n // pages + 1)) // (n // pages) END + 1 AS BIGINT) AS page FROM y)
 SELECT ligand, round(score, 6) AS score, page, false AS pinned FROM p
 UNION ALL SELECT ligand, round(score, 6), page, true FROM pin, (SELECT DISTINCT page FROM p)""")
def _(spark, sf):
    return pr.rank_profiles(minmax(spark, sf), CRITERIA, None, 8, ["L1", "L2", "L3", "L5"]).withColumn("score", F.round("score", 6))


@query("T3_top_variance_axes", f"""WITH {b.FLAGS} SELECT label, rule_ord, round(var_pop(CASE flag WHEN 'green' THEN 1.0 WHEN 'yellow' THEN 0.5 WHEN 'red' THEN 0.0 ELSE 0.5 END), 6) AS variance
 FROM flags WHERE category = 'Toksisitas' AND rule_type <> 'descriptive' GROUP BY 1, 2 ORDER BY round(var_pop(CASE flag WHEN 'green' THEN 1.0 WHEN 'yellow' THEN 0.5 WHEN 'red' THEN 0.0 ELSE 0.5 END), 12) DESC, rule_ord LIMIT 12""")
def _(spark, sf):
    return pr.top_variance_axes(flags(spark, sf), "Toksisitas").withColumn("variance", F.round("variance", 6))


@query("T3_top_variance_group_axes", f"""WITH {b.FLAGS}, {b.GROUPS}, m AS (SELECT grp, label, rule_ord, CAST(avg(s) AS DOUBLE) AS score FROM scored JOIN grps USING (ligand) WHERE category = 'Toksisitas' GROUP BY 1, 2, 3)
 SELECT label, rule_ord, round(var_pop(score), 6) AS variance FROM m GROUP BY 1, 2 ORDER BY round(var_pop(score), 12) DESC, rule_ord LIMIT 12""")
def _(spark, sf):
    scores = sc.flag_scores_by_group(flags(spark, sf), b.ligand_groups(spark, sf), "Toksisitas")
    return pr.top_variance_group_axes(scores).withColumn("variance", F.round("variance", 6))


@query("A40_value_range", f"WITH {b.GROUPED} SELECT min(affinity_best) AS lo, max(affinity_best) AS hi FROM stats")
def _(spark, sf):
    return pr.value_range(stats(spark, sf), "affinity_best")


@query("P15_complete_cases", f"WITH {b.WIDE} SELECT ligand FROM wide WHERE \"MW\" IS NOT NULL AND \"logP\" IS NOT NULL AND \"TPSA\" IS NOT NULL")
def _(spark, sf):
    return pr.complete_cases(b.properties(spark, sf), ["MW", "logP", "TPSA"]).select("ligand")


@query("P21_zscore_properties", f"""WITH {b.DESCRIPTORS} SELECT ligand, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in ("MW", "LogP", "HBD", "HBA"))} FROM descriptors""")
def _(spark, sf):
    return pr.zscore_properties(b.descriptors(spark, sf), ["MW", "LogP", "HBD", "HBA"]).select("ligand", *r6("MW", "LogP", "HBD", "HBA"))


@query("T9_preview", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 200")
def _(spark, sf):
    return pr.preview(b.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), 200, 3, ["c_custkey"])[0]
