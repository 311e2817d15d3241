"""Atom tables of structures: residues, native ligands, receptor clean-up, charges, complexes, pose deviation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from assayloom.functions.text import residue_name
from assayloom.functions.udfs import nfkd

# Residue and element sets, box limits.
WATERS = ("HOH", "WAT")
METALS = ("ZN", "MG", "FE", "MN", "CU", "CO", "NI", "CA", "NA", "K", "CD", "HG")
CHAIN_LETTERS = "XYZWVUTSRQPONMLKJIHGFEDCBA"
MIN_BOX, MAX_BOX = 18.0, 30.0
RESIDUE = ["structure", "chain", "resnum"]

# Backbone, terminal, water and side-chain partial charges.
BACKBONE_CHARGES = {"N": -0.4157, "H": 0.2719, "CA": 0.0337, "HA": 0.0823, "C": 0.5973, "O": -0.5679}
N_TERMINUS_CHARGES = {"H1": 0.1921, "H2": 0.1921, "H3": 0.1921}
C_TERMINUS_CHARGES = {"OXT": -0.5679}
WATER_CHARGES = {"O": -0.834, "OW": -0.834, "H1": 0.417, "H2": 0.417, "HW1": 0.417, "HW2": 0.417}
SIDE_CHAIN_CHARGES = {
    "ALA": {"CB": 0.0},
    "VAL": {"CB": 0.0, "CG1": 0.0, "CG2": 0.0},
    "LEU": {"CB": 0.0, "CG": 0.0, "CD1": 0.0, "CD2": 0.0},
    "ILE": {"CB": 0.0, "CG1": 0.0, "CG2": 0.0, "CD1": 0.0, "CD": 0.0},
    "PRO": {"CB": 0.0, "CG": 0.0, "CD": 0.0192},
    "PHE": {"CB": 0.0, "CG": 0.0, "CD1": 0.0, "CD2": 0.0, "CE1": 0.0, "CE2": 0.0, "CZ": 0.0},
    "MET": {"CB": 0.0, "CG": 0.044, "SD": -0.2737, "CE": 0.0536},
    "MSE": {"CB": 0.0, "CG": 0.044, "SE": -0.2737, "CE": 0.0536},
    "TRP": {"CB": 0.0, "CG": -0.026, "CD1": 0.0402, "CD2": 0.1243, "NE1": -0.3418, "HE1": 0.3412, "CE2": -0.0515, "CE3": 0.0, "CZ2": 0.0, "CZ3": 0.0, "CH2": 0.0},
    "SER": {"CB": 0.2117, "OG": -0.6546, "HG": 0.4275},
    "THR": {"CB": 0.3654, "OG1": -0.6761, "HG1": 0.4102, "CG2": 0.0},
    "ASN": {"CB": 0.0, "CG": 0.713, "OD1": -0.5931, "ND2": -0.9191, "HD21": 0.4196, "HD22": 0.4196},
    "GLN": {"CB": 0.0, "CG": 0.0, "CD": 0.6951, "OE1": -0.6086, "NE2": -0.9407, "HE21": 0.4251, "HE22": 0.4251},
    "TYR": {"CB": 0.0, "CG": 0.0, "CD1": 0.0, "CD2": 0.0, "CE1": 0.0, "CE2": 0.0, "CZ": 0.3226, "OH": -0.5579, "HH": 0.3992},
    "ASP": {"CB": -0.0303, "CG": 0.7994, "OD1": -0.8014, "OD2": -0.8014},
    "GLU": {"CB": 0.0, "CG": 0.0136, "CD": 0.8054, "OE1": -0.8188, "OE2": -0.8188},
    "LYS": {"CB": 0.0, "CG": 0.0187, "CD": 0.0482, "CE": 0.2175, "NZ": -0.3854, "HZ1": 0.34, "HZ2": 0.34, "HZ3": 0.34},
    "ARG": {"CB": 0.0, "CG": 0.039, "CD": 0.0486, "NE": -0.5295, "HE": 0.3456, "CZ": 0.8076, "NH1": -0.8627, "HH11": 0.4478, "HH12": 0.4478, "NH2": -0.8627, "HH21": 0.4478, "HH22": 0.4478},
    "CYS": {"CB": 0.119, "SG": -0.1996, "HG": 0.1933},
    "CYX": {"CB": 0.0984, "SG": -0.0984},
    "HID": {"CB": 0.0, "CG": -0.0266, "ND1": -0.3819, "CE1": 0.2057, "NE2": -0.5727, "CD2": 0.1292, "HD1": 0.3652},
    "HIE": {"CB": 0.0, "CG": 0.1868, "ND1": -0.5432, "CE1": 0.1868, "NE2": -0.2795, "CD2": -0.2207, "HE2": 0.3324},
    "HIP": {"CB": 0.0, "CG": -0.0012, "ND1": -0.1739, "CE1": -0.017, "NE2": -0.1717, "CD2": 0.1141, "HD1": 0.38, "HE2": 0.39},
}

# Residues that are solvent, buffer or additive rather than a ligand.
NOT_LIGANDS = ("HOH", "WAT", "DOD", "H2O", "EDO", "GOL", "DMS", "SO4", "PO4", "ACT", "ACE", "MES", "TRS", "EPE")


def side_chain_table(spark: SparkSession) -> DataFrame:
    rows = [(variant, atom, charge) for variant, atoms in SIDE_CHAIN_CHARGES.items() for atom, charge in atoms.items()]
    return spark.createDataFrame(rows, "variant string, atom string, charge double")


# ---- residues ----------------------------------------------------------------------------------------------

def ligand_candidates(atoms: DataFrame) -> DataFrame:
    """Hetero atoms of residues that may be ligands."""
    return atoms.where((F.col("record") == "HETATM") & ~F.col("resname").isin(*NOT_LIGANDS) & (F.length("resname") > 1))


def native_ligands(atoms: DataFrame, digits: int = 3) -> DataFrame:
    """Ligand residues with atom count, centre and longest bounding-box side; residues with a whole backbone belong to the chain.

    Ties of ``digits`` are decided on six digits more, so the order of summation does not show.
    """
    to = lambda c: F.round(F.round(c, digits + 6), digits)
    side = lambda c: F.max(c) - F.min(c)
    is_ = lambda atom, element: F.bool_or((F.upper("atom") == atom) & (F.upper("element") == element))
    out = ligand_candidates(atoms).groupBy("structure", "chain", "resname", "resnum").agg(
        F.count(F.lit(1)).alias("atom_count"), *[to(F.avg(c)).alias(f"center_{c}") for c in "xyz"],
        F.greatest(side("x"), side("y"), side("z")).alias("extent"), (is_("N", "N") & is_("CA", "C") & is_("C", "C")).alias("_chain"))
    label = F.concat("resname", F.lit("_"), "chain", F.col("resnum").cast("string"))
    return out.where(~F.col("_chain")).drop("_chain").withColumn("label", label)


def backbone_complete(atoms: DataFrame) -> DataFrame:
    """Residues with a whole backbone (N, CA and C of the right element)."""
    is_ = lambda atom, element: F.bool_or((F.upper("atom") == atom) & (F.upper("element") == element))
    return (atoms.groupBy(*RESIDUE).agg((is_("N", "N") & is_("CA", "C") & is_("C", "C")).alias("ok")).where("ok").select(*RESIDUE))


def clean_receptor_atoms(atoms: DataFrame, remove_waters: bool = True, remove_hetero: bool = True, keep_metals: bool = True) -> DataFrame:
    """Drop waters and hetero atoms, except metals and residues that belong to the chain."""
    out = atoms
    if remove_waters:
        out = out.where(~F.col("resname").isin(*WATERS))
    if remove_hetero:
        chain = backbone_complete(atoms).withColumn("_chain", F.lit(True))
        metal = F.upper("element").isin(*METALS) if keep_metals else F.lit(False)
        keep = (F.col("record") != "HETATM") | metal | F.coalesce("_chain", F.lit(False))
        out = out.join(chain, RESIDUE, "left").where(keep).drop("_chain")
    return out


def residue_variants(atoms: DataFrame) -> DataFrame:
    """Protonation variant of each residue and whether it is the first or last of its chain."""
    has = lambda a: F.bool_or(F.upper("atom") == a)
    res = atoms.groupBy(*RESIDUE).agg(F.min_by(F.upper("resname"), "ord").alias("resname"), has("HD1").alias("hd1"), has("HE2").alias("he2"), has("HG").alias("hg"))
    variant = (F.when(F.col("resname") == "HIS", F.when(F.col("hd1") & F.col("he2"), "HIP").when(F.col("hd1"), "HID").otherwise("HIE"))
               .when(F.col("resname") == "CYS", F.when(F.col("hg"), "CYS").otherwise("CYX")).otherwise(F.col("resname")))
    ends = atoms.groupBy("structure", "chain").agg(F.min("resnum").alias("_a"), F.max("resnum").alias("_b"))
    return res.join(ends, ["structure", "chain"]).select(*RESIDUE, "resname", variant.alias("variant"),
                                                        (F.col("resnum") == F.col("_a")).alias("is_first"), (F.col("resnum") == F.col("_b")).alias("is_last"))


def _lookup(table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("atom"))


def assign_charges(atoms: DataFrame) -> DataFrame:
    """Partial charge per atom: backbone, side chain of the variant, water, chain ends, else 0. The tables have fixed sizes."""
    rows = atoms.withColumn("atom", F.upper(F.trim("atom"))).join(residue_variants(atoms).drop("resname"), RESIDUE)
    rows = rows.join(F.broadcast(side_chain_table(atoms.sparkSession)), ["variant", "atom"], "left")
    backbone = F.when(~((F.col("variant") == "PRO") & (F.col("atom") == "H")), _lookup(BACKBONE_CHARGES))
    water = F.when(F.col("variant").isin(*WATERS), _lookup(WATER_CHARGES))
    value = F.coalesce(backbone, F.col("charge"), water, F.when(F.col("is_first"), _lookup(N_TERMINUS_CHARGES)),
                       F.when(F.col("is_last"), _lookup(C_TERMINUS_CHARGES)), F.lit(0.0))
    return rows.withColumn("charge", value).drop("is_first", "is_last")


# ---- docking boxes -----------------------------------------------------------------------------------------

def nearest_native(entries: DataFrame, natives: DataFrame, radius: float = 8.0) -> DataFrame:
    """Native ligand of the same structure nearest to the box centre, null beyond the radius.

    Space is cut into cells of one radius; an entry meets only the natives of the cells around it.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip("xyz", (a, b, c))]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    left = entries.select("receptor", "structure", "center_x", "center_y", "center_z", F.explode(around).alias("_d"))
    left = left.select("*", *[(cell(f"center_{n}") + F.col(f"_d.{n}")).alias(f"_{n}") for n in "xyz"])
    right = natives.select("structure", F.col("label").alias("native"), "extent", "atom_count", *[F.col(f"center_{n}").alias(f"n{n}") for n in "xyz"],
                           *[cell(f"center_{n}").alias(f"_{n}") for n in "xyz"])
    gap = F.sqrt(sum((F.col(f"center_{n}") - F.col(f"n{n}")) ** 2 for n in "xyz"))
    near = left.join(right, ["structure", "_x", "_y", "_z"]).withColumn("distance", gap).where(F.col("distance") <= radius)
    best = near.groupBy("receptor").agg(F.min(F.struct("distance", (-F.col("atom_count")).alias("o"), "native", "extent")).alias("b"))
    return entries.join(best.select("receptor", F.col("b.native").alias("native"), F.col("b.distance").alias("distance"), F.col("b.extent").alias("native_extent")), "receptor", "left")


def suggested_size(extent: Column, padding: float = 8.0) -> Column:
    return F.least(F.ceil(F.greatest(F.coalesce(extent, F.lit(0.0)) + padding, F.lit(MIN_BOX))).cast("double"), F.lit(MAX_BOX))


def grid_box(entries: DataFrame, padding: float = 8.0, default: float = 20.0) -> DataFrame:
    """Box per entry: its own size per axis, else the uniform size, else from the native ligand, else the default.

    ``entries`` carries ``native`` and ``native_extent`` from ``nearest_native``; a zero size counts as missing.
    """
    given = lambda c: F.when(F.col(c) != 0, F.col(c))
    fallback = F.when(F.col("native").isNotNull(), suggested_size(F.col("native_extent"), padding)).otherwise(F.lit(default))
    return entries.withColumns({f"size_{n}": F.coalesce(given(f"size_{n}"), given("uniform_size"), fallback) for n in "xyz"})


# ---- complexes ---------------------------------------------------------------------------------------------

def merge_complex_atoms(receptor: DataFrame, ligand: DataFrame, names: DataFrame) -> DataFrame:
    """Receptor atoms followed by the ligand, which gets a free chain letter, a residue name and its own atom names.

    ``receptor`` has structure; ``ligand`` has complex, structure, element, x, y, z, ord; ``names`` has complex, name and code.
    """
    used = receptor.where("trim(chain) <> ''").groupBy("structure").agg(F.collect_set(F.trim("chain")).alias("_used"))
    letters = F.array(*[F.lit(c) for c in CHAIN_LETTERS])
    free = F.coalesce(F.try_element_at(F.array_except(letters, F.coalesce("_used", F.array().cast("array<string>"))), F.lit(1)), F.lit("X"))
    heads = (ligand.select("complex", "structure").distinct().join(used, "structure", "left")
             .join(names.select("complex", residue_name(nfkd("name"), nfkd("code")).alias("resname")), "complex")
             .select("complex", "structure", free.alias("chain"), "resname"))
    rec = heads.select("complex", "structure").join(receptor.select("structure", "record", "atom", "resname", "chain", "resnum", "x", "y", "z", "element", "ord"), "structure")
    lig = ligand.select("complex", "structure", "element", "x", "y", "z", "ord").join(heads, ["complex", "structure"]).select(
        "complex", "structure", F.lit("HETATM").alias("record"), F.concat("element", F.col("ord").cast("string")).alias("atom"), "resname", "chain",
        F.lit(1).alias("resnum"), "x", "y", "z", "element", "ord")
    return rec.withColumn("part", F.lit(0)).unionByName(lig.withColumn("part", F.lit(1)))


# ---- pose deviation ----------------------------------------------------------------------------------------

def pose_rmsd(pose: DataFrame, native: DataFrame, mapping: DataFrame) -> DataFrame:
    """Deviation of heavy atoms without superposition, atoms paired by ``mapping`` (structure, ord, native_ord)."""
    heavy = F.upper("element") != "H"
    p = pose.where(heavy).select("structure", "pose", "ord", "x", "y", "z")
    n = native.where(heavy).select("structure", F.col("ord").alias("native_ord"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    both = p.join(mapping, ["structure", "ord"]).join(n, ["structure", "native_ord"])
    return both.groupBy("structure", "pose").agg(F.sqrt(F.avg(sum((F.col(c) - F.col(f"n{c}")) ** 2 for c in "xyz"))).alias("rmsd"))


def _greedy_pairs(element_a: np.ndarray, a: np.ndarray, element_b: np.ndarray, b: np.ndarray) -> float | None:
    if sorted(element_a) != sorted(element_b):
        return None
    free, total = np.ones(len(b), dtype=bool), 0.0
    for k in range(len(a)):
        d = ((b - a[k]) ** 2).sum(axis=1)
        d[~free | (element_b != element_a[k])] = np.inf
        j = int(d.argmin())
        free[j] = False
        total += d[j]
    return float(np.sqrt(total / len(a))) if len(a) else None


@F.pandas_udf(DoubleType())
def _greedy_rmsd(pose: pd.Series, native: pd.Series) -> pd.Series:
    out = []
    for left, right in zip(pose, native):
        a, b = (sorted(side, key=lambda r: r["ord"]) for side in (left, right))
        xyz = lambda rows: np.array([[r["x"], r["y"], r["z"]] for r in rows], dtype=float)
        out.append(_greedy_pairs(np.array([r["element"] for r in a]), xyz(a), np.array([r["element"] for r in b]), xyz(b)))
    return pd.Series(out, dtype=float)


def pose_rmsd_greedy(pose: DataFrame, native: DataFrame) -> DataFrame:
    """Deviation with each pose atom paired to the nearest unused native atom of its element, in pose order.

    The atoms of one pose of one ligand molecule travel as one array. Null when the element counts differ.
    """
    heavy = F.upper("element") != "H"
    packed = lambda df, keys, name: df.where(heavy).groupBy(*keys).agg(F.collect_list(F.struct("ord", "element", "x", "y", "z")).alias(name))
    both = packed(pose, ["structure", "pose"], "_p").join(packed(native, ["structure"], "_n"), "structure")
    return both.select("structure", "pose", _greedy_rmsd("_p", "_n").alias("rmsd"))
