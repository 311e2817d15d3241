"""Interaction contacts: filtering to protein-ligand pairs and similarity against the native reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayloom.functions.text import NATIVE_GROUP, residue_label


def filter_protein_ligand(interactions: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Contacts between the ligand chain and the protein, reduced to the protein side."""
    rows = interactions.join(sidecars.select("receptor", "complex", "ligand_chain"), ["receptor", "complex"])
    from_lig = F.col("from_spec.chain") == F.col("ligand_chain")
    to_lig = F.col("to_spec.chain") == F.col("ligand_chain")
    protein = F.when(from_lig, F.col("to_spec")).otherwise(F.col("from_spec"))
    return rows.where(from_lig != to_lig).select(
        "receptor", "complex", protein["resnum"].alias("resnum"), protein["resname"].alias("resname"), F.col("type_subtype").alias("type"))


def native_reference(sidecars: DataFrame) -> DataFrame:
    """One native complex per receptor, the first by name."""
    return (sidecars.where("is_native").groupBy("receptor")
            .agg(F.min("complex").alias("complex"), F.min_by("ligand_name", "complex").alias("reference_name")))


def _distinct(contacts: DataFrame) -> DataFrame:
    return contacts.select("receptor", "complex", "resnum", "resname", "type").distinct()


def reference_pairs(contacts: DataFrame, sidecars: DataFrame) -> DataFrame:
    return _distinct(contacts).join(native_reference(sidecars).select("receptor", "complex"), ["receptor", "complex"]).drop("complex")


def interaction_similarity(contacts: DataFrame, sidecars: DataFrame, analysed: DataFrame | None = None) -> DataFrame:
    """Share of the reference residues and of its (residue, type) pairs that each complex keeps.

    ``analysed`` lists complexes that have a contact file; those without a contact stay at zero. By default they are the
    complexes that occur in ``contacts``.
    """
    pairs = _distinct(contacts)
    native = native_reference(sidecars)
    ref = reference_pairs(contacts, sidecars)
    size = ref.groupBy("receptor").agg(F.count_distinct("resnum", "resname").alias("n_aa_ref"), F.count(F.lit(1)).alias("int_aa_ref"))
    have = (contacts if analysed is None else analysed).select("receptor", "complex").distinct()
    tests = (sidecars.select("receptor", "complex", "ligand_name").join(have, ["receptor", "complex"])
             .join(native.select("receptor", F.col("complex").alias("_native"), "reference_name"), "receptor")
             .where(F.col("complex") != F.col("_native")).drop("_native"))
    ref_residues = ref.select("receptor", "resnum", "resname").distinct()
    residues = (pairs.select("receptor", "complex", "resnum", "resname").distinct()
                .join(ref_residues, ["receptor", "resnum", "resname"]).groupBy("receptor", "complex").agg(F.count(F.lit(1)).alias("aa")))
    typed = pairs.join(ref, ["receptor", "resnum", "resname", "type"]).groupBy("receptor", "complex").agg(F.count(F.lit(1)).alias("typed"))
    rows = (tests.join(size, "receptor").join(residues, ["receptor", "complex"], "left").join(typed, ["receptor", "complex"], "left")
            .fillna(0, ["aa", "typed"]))
    aa, ty = F.col("aa") / F.col("n_aa_ref") * 100.0, F.col("typed") / F.col("int_aa_ref") * 100.0
    return rows.select(
        "receptor", "complex", "ligand_name", "reference_name", F.col("aa").alias("n_aa_test"), "n_aa_ref",
        F.round(aa, 2).alias("aa_similarity"), F.col("typed").alias("int_aa_test"), "int_aa_ref", F.round(ty, 2).alias("type_similarity"),
        F.round(0.5 * aa + 0.5 * ty, 2).alias("overall_similarity"))


def similarity_affinities(similarity: DataFrame, stats: DataFrame, groups: DataFrame, rmsd: DataFrame | None = None) -> DataFrame:
    """Add the test and reference affinities and their difference; the redocked value goes before the native docking value."""
    test = stats.groupBy("receptor", F.col("ligand").alias("ligand_name")).agg(F.min("affinity_best").alias("affinity_test"))
    native = groups.where(F.col("group") == NATIVE_GROUP).select("ligand")
    ref = stats.join(native, "ligand", "left_semi").groupBy("receptor").agg(F.min("affinity_best").alias("_native"))
    out = similarity.join(test, ["receptor", "ligand_name"], "left").join(ref, "receptor", "left")
    if rmsd is not None:
        out = out.join(rmsd.where("affinity is not null").groupBy("receptor").agg(F.min("affinity").alias("_redock")), "receptor", "left")
    else:
        out = out.withColumn("_redock", F.lit(None).cast("double"))
    out = out.withColumn("affinity_ref", F.coalesce("_redock", "_native")).drop("_redock", "_native")
    return out.withColumn("delta_g", F.round(F.col("affinity_test") - F.col("affinity_ref"), 3))


def matched_contacts(contacts: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Residue and (residue, type) labels shared with the reference, sorted, per complex.

    A complex has at most one entry per residue and interaction type of its reference, so the lists stay short.
    """
    ref = reference_pairs(contacts, sidecars)
    native = native_reference(sidecars).select("receptor", F.col("complex").alias("_native"))
    pairs = _distinct(contacts).join(native, "receptor").where(F.col("complex") != F.col("_native")).drop("_native")
    label = residue_label("resnum", "resname")
    residues = (pairs.select("receptor", "complex", "resnum", "resname").distinct()
                .join(ref.select("receptor", "resnum", "resname").distinct(), ["receptor", "resnum", "resname"])
                .groupBy("receptor", "complex").agg(F.transform(F.array_sort(F.collect_set(F.struct("resnum", label.alias("label")))),
                                                                lambda s: s["label"]).alias("matched_residues")))
    typed = (pairs.join(ref, ["receptor", "resnum", "resname", "type"]).groupBy("receptor", "complex")
             .agg(F.array_sort(F.collect_set(F.concat(label, F.lit(" ("), F.col("type"), F.lit(")")))).alias("matched_interactions")))
    return residues.join(typed, ["receptor", "complex"], "left")


def residue_union(contacts: DataFrame) -> DataFrame:
    """Residues met by any complex of a receptor."""
    return contacts.select("receptor", "resnum", "resname").distinct()


def contact_footprint(contacts: DataFrame, sidecars: DataFrame) -> DataFrame:
    """0/1 matrix of residues and complexes per receptor as rows, the reference complex first."""
    seen = contacts.select("receptor", "complex", "resnum", "resname").distinct().withColumn("_hit", F.lit(1))
    complexes = contacts.select("receptor", "complex").distinct()
    native = native_reference(sidecars).select("receptor", F.col("complex").alias("_native"))
    grid = complexes.join(residue_union(contacts), "receptor").join(native, "receptor")
    return (grid.join(seen, ["receptor", "complex", "resnum", "resname"], "left")
            .select("receptor", "complex", "resnum", "resname", (F.col("complex") == F.col("_native")).alias("is_reference"),
                    F.coalesce("_hit", F.lit(0)).alias("contact")))


def rank_similarity(similarity: DataFrame) -> DataFrame:
    """Complexes from the most similar down within each receptor."""
    return similarity.orderBy("receptor", F.col("overall_similarity").desc(), "ligand_name")
