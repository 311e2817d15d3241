"""Queries over library matching and atom tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.operators import identify as idn, structures as op
from assayloom.plans import bindings as b
from assayloom.plans.features import LONG, feature_long
from assayloom.plans.registry import query
from assayloom.plans.screening import r6
from assayloom.plans.signals import PEAKS, peaks

# ---- identification ----------------------------------------------------------------------------------------

LADDER = "ladder AS (SELECT CAST(n_nationkey AS DOUBLE) AS carbon, n_nationkey * 55.0::DOUBLE + n_nationkey % 3 AS rt FROM nation)"


def ladder(spark, sf):
    k = F.col("n_nationkey")
    return b.table(spark, sf, "nation").select(k.cast("double").alias("carbon"), (k * F.lit(55.0) + k % 3).alias("rt"))


@query("J8_kovats_index", f"""WITH {PEAKS}, {LADDER}, seg AS (SELECT carbon, rt, lead(carbon) OVER (ORDER BY rt) AS c2, lead(rt) OVER (ORDER BY rt) AS rt2 FROM ladder)
 SELECT ord, round(100 * CASE WHEN peaks.rt = seg.rt THEN carbon ELSE (c2 - carbon) / (rt2 - seg.rt) * (peaks.rt - seg.rt) + carbon END, 9) AS ri FROM peaks ASOF LEFT JOIN seg ON peaks.rt >= seg.rt""")
def _(spark, sf):
    return idn.kovats_index(peaks(spark, sf).select("ord", "rt"), ladder(spark, sf)).select("ord", F.round("ri", 9).alias("ri"))


@query("J10_inherit_peak_names", f"""WITH {PEAKS}, rep AS (SELECT * FROM peaks WHERE name = 'purchase'), det AS (SELECT * FROM peaks WHERE name <> 'purchase'),
 near AS (SELECT DISTINCT ON (d.ord) d.ord, r.ord AS rord, abs(r.rt - d.rt) AS gap FROM det d JOIN rep r ON r.sample = d.sample AND r.rt BETWEEN d.rt - 1.5 AND d.rt + 1.5 ORDER BY d.ord, abs(r.rt - d.rt), r.ord)
 SELECT det.ord, CASE WHEN gap <= 1.25 THEN 'N' || rord END AS name FROM det LEFT JOIN near USING (ord)""")
def _(spark, sf):
    rows = peaks(spark, sf)
    rep = rows.where("name = 'purchase'").select("sample", "rt", "ord", F.concat(F.lit("N"), "ord").alias("name"), F.lit("").alias("cas"), F.lit(1.0).alias("similarity"))
    return idn.inherit_peak_names(rows.where("name <> 'purchase'"), rep, 1.25).select("ord", "name")


KEY = r"""regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '\((e|z|r|s|\+|-|±|rs)\)-?', '', 'g'), '^(d|l|dl|cis|trans|e|z)-', ''), '[^a-z0-9]', '', 'g')"""
LIB = f"""lib AS (SELECT min(p_partkey) AS ord, p_name AS name, min(p_partkey) % 1440 AS rt, CASE WHEN min(p_partkey) % 3 = 0 THEN (min(p_partkey) % 500 + 100) || '-11-1' ELSE '' END AS cas FROM part GROUP BY p_name),
 feats AS (SELECT p_partkey AS feature, CASE p_partkey % 4 WHEN 0 THEN 'D-' || upper(p_name) WHEN 1 THEN '(E)-' || p_name WHEN 2 THEN p_name || ' x' ELSE '' END AS name, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey % 500 + 100) || '-11-1' ELSE '' END AS cas FROM part)"""


def library(spark, sf):
    rows = b.table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return rows.select("ord", "name", (F.col("ord") % 1440).alias("rt"), F.when(F.col("ord") % 3 == 0, F.concat((F.col("ord") % 500 + 100).cast("string"), F.lit("-11-1"))).otherwise("").alias("cas"),
                       F.lit("C").alias("smiles"), F.array().cast("array<string>").alias("aliases"))


def named_features(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 4 == 0, F.concat(F.lit("D-"), F.upper(name))).when(k % 4 == 1, F.concat(F.lit("(E)-"), name)).when(k % 4 == 2, F.concat(name, F.lit(" x"))).otherwise("")
    return b.table(spark, sf, "part").select(k.alias("feature"), text.alias("name"), F.when(k % 5 == 0, F.concat((k % 500 + 100).cast("string"), F.lit("-11-1"))).otherwise("").alias("cas"),
                                             (k % 1440).cast("double").alias("rt"))


@query("F2_name_key", f"WITH {LIB} SELECT name, {KEY.format('name')} AS key, count(*) AS n FROM feats GROUP BY 1")
def _(spark, sf):
    from assayloom.functions.text import name_key
    rows = named_features(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("name", name_key("name").alias("key"), "n")


@query("J11_match_by_name", f"""WITH {LIB}, nk AS (SELECT {KEY.format('name')} AS key, min(ord) AS o FROM lib GROUP BY 1), ck AS (SELECT cas, min(ord) AS o FROM lib WHERE cas <> '' GROUP BY 1)
 SELECT feature, coalesce(ck.o, nk.o) AS compound FROM feats LEFT JOIN ck ON ck.cas = feats.cas LEFT JOIN nk ON feats.name <> '' AND nk.key = {KEY.format('feats.name')}""")
def _(spark, sf):
    return idn.match_by_name(named_features(spark, sf), library(spark, sf)).select("feature", "compound")


ALLERGEN_SQL = "al(ord, name, cas) AS (VALUES " + ", ".join(
    f"({k}, '{name}', '{cas}')" for k, (name, cas, *_) in enumerate(idn.ALLERGENS)) + ")"


def smelled(spark, sf):
    """Features whose names and CAS numbers come from the allergen list by position."""
    al = idn.allergens(spark).select("ord", F.col("name").alias("_n"), F.col("cas").alias("_c"))
    k = F.col("feature")
    feats = feature_long(spark, sf).select("feature").distinct().withColumn("ord", k % 30)
    rows = feats.join(F.broadcast(al), "ord", "left")
    return rows.select("feature", (k * 1.5).cast("double").alias("rt"), F.when(k % 2 == 0, F.lower("_n")).otherwise("").alias("name"), F.when(k % 3 == 0, F.col("_c")).otherwise("").alias("cas"))


@query("J12_screen_allergens", f"""WITH {LONG}, {ALLERGEN_SQL}, f AS (SELECT DISTINCT feature FROM long), s AS (SELECT feature, CAST(feature * 1.5 AS DOUBLE) AS rt, CASE WHEN feature % 2 = 0 THEN coalesce(lower(name), '') ELSE '' END AS nm,
   name AS allergen, al.cas, feature % 2 = 0 OR feature % 3 = 0 AS hit FROM f JOIN al ON al.ord = feature % 30)
 SELECT allergen, feature, rt, nm AS detected_name, cas, sample, round(100.0 * value / (sum(value) OVER (PARTITION BY sample)), 6) AS value FROM (SELECT * FROM long LEFT JOIN s USING (feature)) QUALIFY hit""")
def _(spark, sf):
    from assayloom.operators.features import normalize_samples
    values = normalize_samples(feature_long(spark, sf), "total")
    df = idn.screen_allergens(smelled(spark, sf).fillna("", ["name", "cas"]), values, idn.allergens(spark))
    return df.select("allergen", "feature", "rt", "detected_name", "cas", "sample", *r6("value"))


@query("J9_match_by_retention")
def _(spark, sf):
    """Greedy matching is sequential; it is tested against a plain loop."""
    k = F.col("p_partkey")
    feats = b.table(spark, sf, "part").select(k.alias("feature"), (k * 37 % 144000 / 100).alias("rt"), F.when(k % 2 == 0, (k * 53 % 20000 / 10)).alias("ri"))
    lib = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") * 41 % 144000 / 100).alias("rt"),
                                                F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") * 59 % 20000 / 10).alias("ri"))
    return idn.match_by_retention(feats, lib, 0.2, 2.0).select("feature", "compound", "score")


@query("K4_export_named_compounds", f"""WITH {LONG}, f AS (SELECT DISTINCT feature, CASE WHEN feature % 3 = 0 THEN '' ELSE 'N' || (feature % 20) END AS name, CASE WHEN feature % 4 = 0 THEN '' ELSE 'C' || feature END AS smiles FROM long),
 n AS (SELECT DISTINCT ON (name) name, smiles, feature FROM f WHERE name <> '' AND smiles <> '' ORDER BY name, feature),
 t AS (SELECT DISTINCT ON (feature) feature, 'S' || (sample % 7) AS g FROM long ORDER BY feature, value DESC, sample)
 SELECT name, smiles, g AS "group" FROM n JOIN t USING (feature)""")
def _(spark, sf):
    long, k = feature_long(spark, sf), F.col("feature")
    feats = long.select("feature").distinct().select("feature", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("N"), k % 20)).alias("name"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("C"), k)).alias("smiles"))
    samples = long.select("sample").distinct().select("sample", F.concat(F.lit("S"), F.col("sample") % 7).alias("series"), F.col("sample").alias("ord"))
    return idn.export_named_compounds(feats, long, samples)


# ---- atoms -------------------------------------------------------------------------------------------------

RESNAMES = "['HIS', 'CYS', 'SER', 'HOH', 'LIG', 'ZN', 'MSE', 'GOL', 'PRO', 'ALA']"
ATOMNAMES = "['N', 'CA', 'C', 'O', 'HD1', 'HE2', 'HG', 'H1', 'OXT', 'CB']"
ATOMS = f"""atoms AS (SELECT structure, CASE WHEN resname IN ('HOH', 'LIG', 'ZN', 'MSE', 'GOL') THEN 'HETATM' ELSE 'ATOM' END AS record, CASE WHEN resname = 'ZN' THEN 'ZN' ELSE atom END AS atom, resname, chain, resnum, x, y, z,
  CASE WHEN resname = 'ZN' THEN 'ZN' ELSE substr(atom, 1, 1) END AS element, ord FROM (SELECT 'S' || (l_orderkey % 500) AS structure, CASE WHEN l_suppkey % 40 >= 20 THEN 'B' ELSE 'A' END AS chain, CAST(l_suppkey % 20 AS INT) AS resnum,
  ({RESNAMES})[CAST((l_suppkey % 20 + l_orderkey % 500) % 10 AS INT) + 1] AS resname, ({ATOMNAMES})[CAST(l_partkey % 10 AS INT) + 1] AS atom,
  (l_partkey * 37 % 40000 - 20000) / 1000 AS x, (l_orderkey * 91 % 40000 - 20000) / 1000 AS y, (l_linenumber * 1000 + l_suppkey * 13 - 2000) / 1000 AS z, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)),
 res AS (SELECT structure, chain, resnum, any_value(resname) AS resname, bool_or(atom = 'N') AND bool_or(atom = 'CA') AND bool_or(atom = 'C') AS bb, bool_or(atom = 'HD1') AS hd1, bool_or(atom = 'HE2') AS he2, bool_or(atom = 'HG') AS hg FROM atoms GROUP BY 1, 2, 3),
 ends AS (SELECT structure, chain, min(resnum) AS a, max(resnum) AS b FROM atoms GROUP BY 1, 2),
 var AS (SELECT res.*, CASE resname WHEN 'HIS' THEN CASE WHEN hd1 AND he2 THEN 'HIP' WHEN hd1 THEN 'HID' ELSE 'HIE' END WHEN 'CYS' THEN CASE WHEN hg THEN 'CYS' ELSE 'CYX' END ELSE resname END AS variant, resnum = a AS is_first, resnum = b AS is_last FROM res JOIN ends USING (structure, chain))"""


def atoms(spark, sf):
    li = b.table(spark, sf, "lineitem")
    names = lambda text: F.array(*[F.lit(x) for x in text.strip("[]").replace("'", "").split(", ")])
    raw = li.select(
        F.concat(F.lit("S"), F.col("l_orderkey") % 500).alias("structure"), F.when(F.col("l_suppkey") % 40 >= 20, "B").otherwise("A").alias("chain"),
        (F.col("l_suppkey") % 20).cast("int").alias("resnum"), F.element_at(names(RESNAMES), ((F.col("l_suppkey") % 20 + F.col("l_orderkey") % 500) % 10).cast("int") + 1).alias("resname"),
        F.element_at(names(ATOMNAMES), (F.col("l_partkey") % 10).cast("int") + 1).alias("a"), ((F.col("l_partkey") * 37 % 40000 - 20000) / 1000).alias("x"),
        ((F.col("l_orderkey") * 91 % 40000 - 20000) / 1000).alias("y"), ((F.col("l_linenumber") * 1000 + F.col("l_suppkey") * 13 - 2000) / 1000).alias("z"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    zn = F.col("resname") == "ZN"
    return raw.select("structure", F.when(F.col("resname").isin("HOH", "LIG", "ZN", "MSE", "GOL"), "HETATM").otherwise("ATOM").alias("record"), F.when(zn, "ZN").otherwise(F.col("a")).alias("atom"),
                      "resname", "chain", "resnum", "x", "y", "z", F.when(zn, "ZN").otherwise(F.substring("a", 1, 1)).alias("element"), "ord")


@query("P16_ligand_candidates", f"WITH {ATOMS} SELECT ord, structure, resname, atom FROM atoms WHERE record = 'HETATM' AND resname NOT IN ('HOH', 'GOL')")
def _(spark, sf):
    return op.ligand_candidates(atoms(spark, sf)).select("ord", "structure", "resname", "atom")


NATIVES = ATOMS + f""", nat AS (SELECT structure, chain, resname, resnum, count(*) AS atom_count, {b.half_up('avg(x)')} AS center_x, {b.half_up('avg(y)')} AS center_y, {b.half_up('avg(z)')} AS center_z,
  greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent, resname || '_' || chain || resnum AS label FROM atoms JOIN res USING (structure, chain, resnum, resname) WHERE record = 'HETATM' AND resname NOT IN ('HOH', 'GOL') AND NOT bb GROUP BY 1, 2, 3, 4)"""


@query("A13_native_ligands", f"WITH {NATIVES} SELECT * FROM nat")
def natives(spark, sf):
    return op.native_ligands(atoms(spark, sf))


@query("A14_backbone_complete", f"WITH {ATOMS} SELECT structure, chain, resnum FROM res WHERE bb")
def _(spark, sf):
    return op.backbone_complete(atoms(spark, sf))


@query("A15_residue_variants", f"WITH {ATOMS} SELECT structure, chain, resnum, resname, variant, is_first, is_last FROM var")
def _(spark, sf):
    return op.residue_variants(atoms(spark, sf))


@query("P10_clean_receptor_atoms", f"WITH {ATOMS} SELECT a.ord, a.structure, a.resname, a.atom FROM atoms a JOIN res USING (structure, chain, resnum) WHERE a.resname <> 'HOH' AND (record = 'ATOM' OR element = 'ZN' OR bb)")
def _(spark, sf):
    return op.clean_receptor_atoms(atoms(spark, sf)).select("ord", "structure", "resname", "atom")


SIDE_SQL = "side(variant, atom, q) AS (VALUES " + ", ".join(
    f"('{variant}', '{a}', {q}::DOUBLE)" for variant, atoms in op.SIDE_CHAIN_CHARGES.items() for a, q in atoms.items()) + ")"
_CASE = lambda table, cond="": " ".join(f"WHEN v.atom = '{a}'{cond} THEN {q}::DOUBLE" for a, q in table.items())


@query("J19_assign_charges", f"""WITH {ATOMS}, {SIDE_SQL}, v AS (SELECT a.ord, a.structure, a.resname, a.atom, var.variant, is_first, is_last FROM atoms a JOIN var USING (structure, chain, resnum))
 SELECT ord, structure, v.atom, v.variant, coalesce(CASE WHEN v.variant = 'PRO' AND v.atom = 'H' THEN NULL {_CASE(op.BACKBONE_CHARGES)} END, q, CASE WHEN v.variant NOT IN ('HOH', 'WAT') THEN NULL {_CASE(op.WATER_CHARGES)} END,
  CASE WHEN NOT is_first THEN NULL {_CASE(op.N_TERMINUS_CHARGES)} END, CASE WHEN NOT is_last THEN NULL {_CASE(op.C_TERMINUS_CHARGES)} END, 0.0::DOUBLE) AS charge FROM v LEFT JOIN side ON side.variant = v.variant AND side.atom = v.atom""")
def _(spark, sf):
    return op.assign_charges(atoms(spark, sf)).select("ord", "structure", "atom", "variant", "charge")


ENTRIES = """ent AS (SELECT 'E' || o_orderkey AS receptor, 'S' || (o_orderkey % 520) AS structure, (o_orderkey * 73 % 30000 - 15000) / 1000 AS center_x, (o_custkey * 91 % 30000 - 15000) / 1000 AS center_y, (o_orderkey % 9) / 1 AS center_z,
  CASE WHEN o_orderkey % 4 = 0 THEN 22.5 WHEN o_orderkey % 4 = 1 THEN 0 END::DOUBLE AS size_x, CASE WHEN o_orderkey % 7 = 0 THEN 25 END::DOUBLE AS uniform_size FROM orders)"""


def entries(spark, sf):
    k = F.col("o_orderkey")
    return b.table(spark, sf, "orders").select(
        F.concat(F.lit("E"), k).alias("receptor"), F.concat(F.lit("S"), k % 520).alias("structure"), ((k * 73 % 30000 - 15000) / 1000).alias("center_x"), ((F.col("o_custkey") * 91 % 30000 - 15000) / 1000).alias("center_y"),
        ((k % 9) / 1).alias("center_z"), F.when(k % 4 == 0, 22.5).when(k % 4 == 1, 0.0).alias("size_x"), F.lit(None).cast("double").alias("size_y"), F.lit(None).cast("double").alias("size_z"), F.when(k % 7 == 0, 25.0).alias("uniform_size"))


NEAR = f"""{NATIVES}, {ENTRIES}, d AS (SELECT receptor, label, extent, atom_count, sqrt((e.center_x - n.center_x) ** 2 + (e.center_y - n.center_y) ** 2 + (e.center_z - n.center_z) ** 2) AS distance FROM ent e JOIN nat n USING (structure)),
 best AS (SELECT DISTINCT ON (receptor) receptor, label AS native, distance, extent AS native_extent FROM d WHERE distance <= 8 ORDER BY receptor, distance, atom_count DESC, label)"""


@query("J7_nearest_native", f"WITH {NEAR} SELECT ent.receptor, native, round(distance, 6) AS distance FROM ent LEFT JOIN best USING (receptor)")
def _(spark, sf):
    return op.nearest_native(entries(spark, sf), natives(spark, sf)).select("receptor", "native", *r6("distance"))


@query("P17_grid_box", f"""WITH {NEAR}, f AS (SELECT ent.*, CASE WHEN native IS NOT NULL THEN least(ceil(greatest(native_extent + 8, 18)), 30) ELSE 20 END AS fb FROM ent LEFT JOIN best USING (receptor))
 SELECT receptor, CAST(coalesce(nullif(size_x, 0), uniform_size, fb) AS DOUBLE) AS size_x, CAST(coalesce(uniform_size, fb) AS DOUBLE) AS size_y FROM f""")
def _(spark, sf):
    return op.grid_box(op.nearest_native(entries(spark, sf), natives(spark, sf))).select("receptor", "size_x", "size_y")


def ligand_atoms(spark, sf):
    rows = atoms(spark, sf).where("resname = 'LIG'")
    return rows.select(F.concat("structure", F.lit("_"), "chain", "resnum").alias("complex"), "structure", "element", "x", "y", "z", "ord")


MERGED = f"""{ATOMS}, lg AS (SELECT structure || '_' || chain || resnum AS complex, structure, element, x, y, z, ord FROM atoms WHERE resname = 'LIG'),
 rec AS (SELECT * FROM atoms WHERE record = 'ATOM'), hd AS (SELECT DISTINCT complex, structure, CASE WHEN length(regexp_replace(complex, '^S', '')) > 0 THEN 'SXX' END AS rn FROM lg)"""


def merged(spark, sf):
    lig = ligand_atoms(spark, sf)
    names = lig.select("complex").distinct().select("complex", F.concat(F.lit("1β-"), F.substr("complex", F.lit(2))).alias("name"), F.lit("").alias("code"))
    return op.merge_complex_atoms(atoms(spark, sf).where("record = 'ATOM'"), lig, names)


@query("U4_merge_complex_atoms", f"""WITH {MERGED} SELECT complex, 0 AS part, record, atom, resname, chain, resnum, x, y, z, ord FROM hd JOIN rec USING (structure)
 UNION ALL SELECT complex, 1, 'HETATM', element || ord, 'BET', 'X', 1, x, y, z, ord FROM lg""")
def _(spark, sf):
    return merged(spark, sf).select("complex", "part", "record", "atom", "resname", "chain", "resnum", "x", "y", "z", "ord")


POSES = """ps AS (SELECT 'T' || l_orderkey AS structure, l_suppkey AS pose, l_linenumber * 1000000 + l_partkey AS ord, 'CNOH'[CAST(l_linenumber % 4 AS INT) + 1] AS element, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem),
 nv AS (SELECT structure, ord AS native_ord, element, x + 1 AS x, y * 0.5 AS y, z AS z FROM ps)"""


def poses(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("T"), "l_orderkey").alias("structure"), F.col("l_suppkey").alias("pose"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"),
                     F.substr(F.lit("CNOH"), (F.col("l_linenumber") % 4).cast("int") + 1, F.lit(1)).alias("element"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


@query("J20_pose_rmsd", f"WITH {POSES} SELECT structure, pose, round(sqrt(avg((p.x - n.x) ** 2 + (p.y - n.y) ** 2 + (p.z - n.z) ** 2)), 6) AS rmsd FROM (SELECT * FROM ps WHERE element <> 'H') p JOIN (SELECT * FROM nv WHERE element <> 'H') n USING (structure) WHERE p.ord = n.native_ord GROUP BY 1, 2")
def _(spark, sf):
    p = poses(spark, sf)
    native = p.select("structure", "ord", "element", (F.col("x") + 1).alias("x"), (F.col("y") * 0.5).alias("y"), "z")
    mapping = p.select("structure", "ord", F.col("ord").alias("native_ord")).distinct()
    return op.pose_rmsd(p, native, mapping).select("structure", "pose", *r6("rmsd"))


@query("J20_pose_rmsd_greedy")
def _(spark, sf):
    """Sequential pairing inside one molecule; tested against a plain loop."""
    p = poses(spark, sf).withColumn("pose", F.lit(1).cast("long"))
    return op.pose_rmsd_greedy(p, p.select("structure", "ord", "element", (F.col("x") + 1).alias("x"), (F.col("y") * 0.5).alias("y"), "z"))
