"""Literal examples for screening, rules, contacts and profiles."""

import pytest
from pyspark.sql import functions as F

from assayloom import rules
from assayloom.operators import contacts as ct, profile as pr, screening as sc


@pytest.fixture(scope="module")
def stats(spark):
    rows = [("A1", "R1", -8.0), ("A2", "R1", -6.0), ("B1", "R1", -9.5), ("B2", "R1", -7.0), ("NATIVE_X", "R1", -9.0), ("A1", "R2", -5.0), ("B1", "R2", -7.5)]
    return spark.createDataFrame(rows, "ligand string, receptor string, affinity_best double")


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([("A1", "G1", 1), ("A2", "G1", 2), ("B1", "G2", 3), ("B2", "G2", 4), ("NATIVE_X", "Native", 5)], "ligand string, group string, ord long")


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_native_and_better(stats, groups):
    assert rows(sc.native_affinity(stats, groups), "receptor", "native_affinity") == {("R1", -9.0)}
    assert rows(sc.fraction_better_than_native(stats, groups), "receptor", "group", "percent_better") == {("R1", "G1", 0.0), ("R1", "G2", 50.0)}


def test_delta(stats, groups):
    got = {(r["ligand"], r["receptor"]): r["delta_vs_native"] for r in sc.add_delta_vs_native(stats, groups).collect()}
    assert got[("A1", "R1")] == 1.0 and got[("B1", "R1")] == -0.5 and got[("NATIVE_X", "R1")] is None and got[("A1", "R2")] is None


def test_docking_summary(stats, groups):
    got = {(r["receptor"], r["group"]): r for r in sc.summarize_docking_by_group(stats, groups).collect()}
    g2 = got[("R1", "G2")]
    assert (g2["n_ligands"], g2["affinity_mean"], g2["affinity_std"], g2["affinity_best"], g2["native_affinity"], g2["percent_better"]) == (2, -8.25, 1.25, -9.5, -9.0, 50.0)
    assert got[("R1", "Native")]["percent_better"] is None and got[("R2", "G1")]["percent_better"] is None


def test_group_order_and_label(spark, groups):
    assert [r["group"] for r in sc.group_order(groups).orderBy("position").collect()] == ["Native", "G1", "G2"]
    assert [r["group"] for r in sc.group_order(groups, native_last=True).orderBy("position").collect()] == ["G1", "G2", "Native"]
    got = sc.with_group(spark.createDataFrame([("ZZ", 1)], "ligand string, x int"), groups)
    assert got.columns == ["ligand", "group", "x"] and got.first()["group"] == "Tanpa Grup"


def test_replicates_ignore_failures(spark):
    pose = "array<struct<mode:int,affinity:double,rmsd_lb:double,rmsd_ub:double>>"
    data = [("LigA", "REC1", k, 42, [(1, a, 0.0, 0.0)], None, k) for k, a in enumerate((-6.0, -6.2, -5.8))] + [("LigA", "REC1", 3, 42, [], "boom", 3), ("LigA", "REC1", 4, 42, [(1, -99.0, 0.0, 0.0)], "boom", 4)]
    df = spark.createDataFrame(data, f"ligand string, receptor string, replicate int, seed long, poses {pose}, error string, ord long")
    r = sc.replicate_stats(df).first()
    assert (r["n_replicates_success"], r["affinity_mean"], r["affinity_best"]) == (3, -6.0, -6.2)
    assert sc.best_run_per_pair(df).first()["replicate"] == 1
    assert [r["status"] for r in sc.docking_rows(df).orderBy("replicate").collect()] == ["sukses"] * 3 + ["gagal"] * 2


@pytest.mark.parametrize("n,limit", [(5, 3), (31, 30), (7, 7), (1, 4), (100, 8)])
def test_pages_are_balanced(spark, n, limit):
    got = sc.paginate(spark.range(n), ["id"], limit, blocks=3).groupBy("page").count().orderBy("page").collect()
    sizes = [r["count"] for r in got]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True) and len(sizes) == -(-n // limit)


def test_property_count_mismatch(spark):
    lig = spark.createDataFrame([("a", "C", "g", 1), ("b", "CC", "g", 2), ("c", "C", "h", 3)], "name string, smiles string, group string, ord long")
    with pytest.raises(ValueError):
        sc.join_by_position(lig, spark.createDataFrame([(1, 0.5)], "ord long, v double"))
    got = sc.join_by_position(lig, spark.createDataFrame([(1, 0.5), (2, 0.7)], "ord long, v double")).orderBy("ord").collect()
    assert [r["v"] for r in got] == [0.5, 0.7, 0.5]


CELLS = [("hERG", "0.1", "green"), ("hERG", "0.3", "green"), ("hERG", "0.5", "yellow"), ("hERG", "0.9", "red"), ("BCRP", "0.1", "red"), ("BCRP", "0.9", "green"), ("PAINS", "['-']", "green"),
         ("PAINS", "0", "green"), ("PAINS", "3", "red"), ("PAINS", "CCO", "red"), ("PAINS", None, "na"), ("caco2", "-4", "green"), ("caco2", "-5.15", "red"), ("caco2", "-6", "red"), ("MW", "350", "green"),
         ("MW", "600", "green"), ("MW", "700", "red"), ("logVDss", "0", "green"), ("Synth", "6", "red"), ("Synth", "5.9", "green"), ("t0.5", "9", "green"), ("t0.5", "1", "yellow"), ("t0.5", "0.5", "red"),
         ("cl-plasma", "5", "green"), ("cl-plasma", "15", "yellow"), ("cl-plasma", "16", "red"), ("gasa", "0", "green"), ("gasa", "0.5", "green"), ("gasa", "1", "red"), ("mp", "20", "info"), ("Vol", "", "na"),
         ("Vol", "abc", "info"), ("hERG", "['-']", "na"), ("nothing", "1", "na")]


def test_rule_cells(spark):
    df = spark.createDataFrame([(k, c, r) for k, (c, r, _) in enumerate(CELLS)], "k int, column string, raw string")
    got = {r["k"]: r for r in rules.classify_cells(df).collect()}
    assert [(c, r, got[k]["flag"]) for k, (c, r, _) in enumerate(CELLS)] == CELLS
    label = {(c, r): got[k]["flag_label"] for k, (c, r, _) in enumerate(CELLS)}
    assert label[("mp", "20")] == "Cair (<25 C)" and label[("Vol", "abc")] == "abc" and label[("hERG", "0.5")] == "Sedang"


def test_legend(spark):
    text = {r["column"]: r["threshold"] for r in rules.rules_legend(spark).collect()}
    assert text["QED"] == "> 0.67 hijau, selain itu merah" and text["Synth"] == "< 6 hijau, selain itu merah" and text["MDCK"] == ">= -5.7 hijau, selain itu merah"
    assert text["logS"] == "-4 sampai 0.5 hijau, di luar rentang merah" and text["t0.5"] == "> 8 hijau / 1-8 kuning / < 1 merah" and len(text) == 120


def test_similarity_examples(spark):
    sides = spark.createDataFrame([("R", "n", "NAT", "X", True), ("R", "a", "A", "X", False), ("R", "b", "B", "X", False), ("R", "c", "C", "X", False)],
                                  "receptor string, complex string, ligand_name string, ligand_chain string, is_native boolean")
    ref = [("R", "n", k, "SER", t) for k, t in ((1, "H"), (2, "H"), (3, "H"), (4, "P"))]
    full = [("R", "a", *r[2:]) for r in ref]
    types = [("R", "b", k, "SER", "P" if k < 4 else "P") for k in (1, 2, 3, 4)]
    df = spark.createDataFrame(ref + full + types, "receptor string, complex string, resnum int, resname string, type string")
    got = {r["ligand_name"]: r for r in ct.interaction_similarity(df, sides, sides).collect()}
    assert got["A"]["overall_similarity"] == 100.0
    assert (got["B"]["aa_similarity"], got["B"]["type_similarity"], got["B"]["overall_similarity"]) == (100.0, 25.0, 62.5)
    assert got["C"]["overall_similarity"] == 0.0
    assert "C" not in {r["ligand_name"] for r in ct.interaction_similarity(df, sides).collect()}


def test_pages_of_profiles(spark):
    df = spark.createDataFrame([(f"L{k}", float(k), k) for k in range(30)], "ligand string, a double, ord long")
    got = pr.rank_profiles(df, ["a"], "a", 8, ["L3"], 2).collect()
    assert {r["page"] for r in got} == {1, 2} and sum(r["pinned"] for r in got) == 2
    assert sorted(r["ligand"] for r in got if r["page"] == 1 and not r["pinned"]) == ["L24", "L25", "L26", "L27", "L28", "L29"]


def test_top_per_group_with_hot_group(spark):
    df = spark.range(2000).selectExpr("case when id < 1500 then 'hot' else 'cold' end as g", "cast(id * 7919 % 2003 as double) as m", "id as feature")
    got = pr.top_per_group(df, "g", "m", 3, "feature")
    want = {g: sorted(((r["m"], r["feature"]) for r in df.where(F.col("g") == g).collect()), reverse=True)[:3] for g in ("hot", "cold")}
    assert {(r["g"], r["feature"]) for r in got.collect()} == {(g, f) for g, v in want.items() for _, f in v}


def test_preview_cuts(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "a int, b double")
    part, cut = pr.preview(df, 1, 5, ["a"])
    assert cut and part.count() == 1 and part.first()["b"] is None
