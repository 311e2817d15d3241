"""Property rules: the rule table, flag classification of wide property tables and its texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.functions.text import general_number, read_number
from assayloom.session import spread

# Category order, flag scores, aliases, columns that are never properties.
CATEGORIES = ("Fisikokimia", "Absorpsi", "Distribusi", "Metabolisme", "Ekskresi", "Toksisitas")
PHYSICOCHEMICAL = "Fisikokimia"
FLAG_SCORES = {"green": 1.0, "yellow": 0.5, "red": 0.0}
COLUMN_ALIASES = {"logVDss": "VDss"}
NO_ALERT = "['-']"
IDENTITY_COLUMNS = ("raw_smiles", "smiles", "molstr", "ligand", "ligand_name", "ligand_code", "group")


@dataclass(frozen=True)
class Rule:
    """One property rule. ``label_sql`` may hold a SQL expression over ``value`` for a descriptive rule."""

    column: str
    category: str
    label: str
    rule_type: str = "descriptive"
    lo: float | None = None
    hi: float | None = None
    ascending_bad: bool = True
    inverted: bool = False
    unit: str = ""
    citation: str = ""
    note: str = ""
    label_sql: str = ""


# A bound that is itself outside is the bound plus or minus this.
STRICT = 1e-9

# The property rules in report order. For tiered_range, the two numbers are the break points.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("MW", "Fisikokimia", "Molecular Weight", "range", 100, 600, unit="Da", citation="Drug-Like Soft rule"),
    Rule("Vol", "Fisikokimia", "Volume", "descriptive", unit="A^3", citation="Van der Waals volume"),
    Rule("Dense", "Fisikokimia", "Density", "descriptive", citation="MW / Volume"),
    Rule("nHA", "Fisikokimia", "H-Bond Acceptors", "range", 0, 12, citation="Drug-Like Soft rule"),
    Rule("nHD", "Fisikokimia", "H-Bond Donors", "range", 0, 7, citation="Drug-Like Soft rule"),
    Rule("TPSA", "Fisikokimia", "TPSA", "range", 0, 140, unit="A^2", citation="Veber et al. 2002"),
    Rule("nRot", "Fisikokimia", "Rotatable Bonds", "range", 0, 11, citation="Drug-Like Soft rule"),
    Rule("nRing", "Fisikokimia", "Ring Count", "range", 0, 6, citation="Drug-Like Soft rule"),
    Rule("MaxRing", "Fisikokimia", "Max Ring Size", "range", 0, 18, unit="atoms", citation="Drug-Like Soft rule"),
    Rule("nHet", "Fisikokimia", "Heteroatom Count", "range", 1, 15, citation="Drug-Like Soft rule"),
    Rule("fChar", "Fisikokimia", "Formal Charge", "range", -4, 4, citation="Drug-Like Soft rule"),
    Rule("nRig", "Fisikokimia", "Rigid Bonds", "range", 0, 30, citation="Drug-Like Soft rule"),
    Rule("Flex", "Fisikokimia", "Flexibility", "descriptive", citation="nRot / nRig"),
    Rule("nStereo", "Fisikokimia", "Stereo Centers", "threshold_lte", None, 2, citation="Lead-Like Soft rule"),
    Rule("logS", "Fisikokimia", "logS", "range", -4, 0.5, unit="log mol/L", citation="Rentang ADMETLab3"),
    Rule("logP", "Fisikokimia", "logP", "range", 0, 3, unit="log mol/L", citation="Rentang ADMETLab3"),
    Rule("logD", "Fisikokimia", "logD 7.4", "range", 1, 3, unit="log mol/L", citation="Rentang ADMETLab3"),
    Rule("mp", "Fisikokimia", "Melting Point", "descriptive", unit="C",
         label_sql="case when value < 25 then 'Cair (<25 C)' else 'Padat (>=25 C)' end"),
    Rule("bp", "Fisikokimia", "Boiling Point", "descriptive", unit="C",
         label_sql="case when value < 25 then 'Gas (<25 C)' else 'Cair/padat pada suhu ruang (>=25 C)' end"),
    Rule("pka_acidic", "Fisikokimia", "pKa (acidic)", "descriptive", citation="Makin kecil, asam makin kuat"),
    Rule("pka_basic", "Fisikokimia", "pKa (basic)", "descriptive", citation="Makin besar, basa makin kuat"),
    Rule("QED", "Fisikokimia", "QED", "threshold_gte", 0.67 + STRICT, None, citation="Bickerton et al. 2012"),
    Rule("Synth", "Fisikokimia", "SAscore", "threshold_lte", None, 6 - STRICT, unit="1-10", citation="Ertl & Schuffenhauer 2009"),
    Rule("gasa", "Fisikokimia", "GASA", "binary", inverted=True, unit="0/1", citation="Yu et al. 2022 (0 mudah, 1 sulit)"),
    Rule("Fsp3", "Fisikokimia", "Fsp3", "threshold_gte", 0.42, None, citation="Lovering et al. 2009"),
    Rule("MCE-18", "Fisikokimia", "MCE-18", "threshold_gte", 45, None, citation="Ivanenkov et al. 2019"),
    Rule("Natural Product-likeness", "Fisikokimia", "Natural Product-likeness", "descriptive", unit="-5 sampai 5", citation="Ertl et al. 2008"),
    Rule("Alarm_NMR", "Fisikokimia", "ALARM NMR Alerts", "alert_count", citation="Huth et al. 2005"),
    Rule("BMS", "Fisikokimia", "BMS Alerts", "alert_count", citation="Pearce et al. 2006"),
    Rule("Chelating", "Fisikokimia", "Chelator Alerts", "alert_count", citation="Agrawal et al. 2010"),
    Rule("PAINS", "Fisikokimia", "PAINS Alerts", "alert_count", citation="Baell & Holloway 2010"),
    Rule("Lipinski", "Fisikokimia", "Lipinski Rule", "threshold_lte", None, 1, unit="pelanggaran", citation="Lipinski et al. 1997"),
    Rule("Pfizer", "Fisikokimia", "Pfizer Rule", "threshold_lte", None, 1, unit="pelanggaran", citation="Hughes et al. 2008"),
    Rule("GSK", "Fisikokimia", "GSK Rule", "threshold_lte", None, 0, unit="pelanggaran", citation="Gleeson 2008"),
    Rule("GoldenTriangle", "Fisikokimia", "Golden Triangle", "threshold_lte", None, 0, unit="pelanggaran", citation="Johnson et al. 2009"),
    Rule("Aggregators", "Fisikokimia", "Colloidal Aggregators", "tiered"),
    Rule("Fluc", "Fisikokimia", "FLuc Inhibitors", "tiered"),
    Rule("Blue_fluorescence", "Fisikokimia", "Blue Fluorescence", "tiered"),
    Rule("Green_fluorescence", "Fisikokimia", "Green Fluorescence", "tiered"),
    Rule("Reactive", "Fisikokimia", "Reactive Compounds", "tiered"),
    Rule("Promiscuous", "Fisikokimia", "Promiscuous Compounds", "tiered"),
    Rule("Other_assay_interference", "Fisikokimia", "Other Assay Interference", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("caco2", "Absorpsi", "Caco-2 Permeability", "threshold_gte", -5.15 + STRICT, None, unit="log cm/s"),
    Rule("PAMPA", "Absorpsi", "PAMPA", "tiered"),
    Rule("MDCK", "Absorpsi", "MDCK Permeability", "threshold_gte", -5.7, None, unit="log cm/s",
         note="Ambang linear 2e-6 cm/s dikonversi ke log10 (-5,70) karena kolom CSV berisi log10(Papp)."),
    Rule("pgp_inh", "Absorpsi", "P-gp Inhibitor", "tiered"),
    Rule("pgp_sub", "Absorpsi", "P-gp Substrate", "tiered"),
    Rule("hia", "Absorpsi", "HIA", "tiered"),
    Rule("f20", "Absorpsi", "F20%", "tiered"),
    Rule("f30", "Absorpsi", "F30%", "tiered"),
    Rule("f50", "Absorpsi", "F50%", "tiered"),
    Rule("OATP1B1", "Distribusi", "OATP1B1 Inhibitor", "tiered"),
    Rule("OATP1B3", "Distribusi", "OATP1B3 Inhibitor", "tiered"),
    Rule("BCRP", "Distribusi", "BCRP Inhibitor", "tiered_reversed", note="Arah pita kebalikan dari transporter sejenis (OATP1B1/3, BSEP, MRP1)."),
    Rule("BSEP", "Distribusi", "BSEP Inhibitor", "tiered"),
    Rule("MRP1", "Distribusi", "MRP1 Inhibitor", "tiered"),
    Rule("PPB", "Distribusi", "Plasma Protein Binding", "threshold_lte", None, 90, unit="%"),
    Rule("VDss", "Distribusi", "VDss", "range", -1.4, 1.3, unit="log10(L/kg)",
         note="Rentang linear 0,04-20 L/kg dikonversi ke log10 karena kolom CSV berisi log10(VDss)."),
    Rule("BBB", "Distribusi", "BBB Penetration", "tiered"),
    Rule("Fu", "Distribusi", "Fraction Unbound", "threshold_gte", 5, None, unit="%", note="Nilai CSV sudah dalam skala persen (bukan pecahan 0-1)."),
    Rule("CYP1A2-inh", "Metabolisme", "CYP1A2 Inhibitor", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP1A2-sub", "Metabolisme", "CYP1A2 Substrate", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP2C19-inh", "Metabolisme", "CYP2C19 Inhibitor", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP2C19-sub", "Metabolisme", "CYP2C19 Substrate", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP2C9-inh", "Metabolisme", "CYP2C9 Inhibitor", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP2C9-sub", "Metabolisme", "CYP2C9 Substrate", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP2D6-inh", "Metabolisme", "CYP2D6 Inhibitor", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP2D6-sub", "Metabolisme", "CYP2D6 Substrate", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP3A4-inh", "Metabolisme", "CYP3A4 Inhibitor", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP3A4-sub", "Metabolisme", "CYP3A4 Substrate", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP2B6-inh", "Metabolisme", "CYP2B6 Inhibitor", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP2B6-sub", "Metabolisme", "CYP2B6 Substrate", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("CYP2C8-inh", "Metabolisme", "CYP2C8 Inhibitor", "tiered",
         note="Tidak ada skala keputusan khusus di dokumentasi, dipakai pita bertingkat 0,3/0,7."),
    Rule("LM-human", "Metabolisme", "HLM Stability", "tiered_reversed", note="Keluaran berupa probabilitas ketidakstabilan."),
    Rule("cl-plasma", "Ekskresi", "Plasma Clearance", "tiered_range", 5, 15, unit="mL/min/kg"),
    Rule("t0.5", "Ekskresi", "Half-life", "tiered_range", 1, 8, ascending_bad=False, unit="jam",
         note="Nilai keluaran sering berkumpul dekat batas merah/kuning; tafsirkan dengan hati-hati."),
    Rule("Neurotoxicity-DI", "Toksisitas", "Drug-induced Neurotoxicity", "tiered"),
    Rule("Ototoxicity", "Toksisitas", "Ototoxicity", "tiered"),
    Rule("Hematotoxicity", "Toksisitas", "Hematotoxicity", "tiered"),
    Rule("Nephrotoxicity-DI", "Toksisitas", "Drug-induced Nephrotoxicity", "tiered"),
    Rule("Genotoxicity", "Toksisitas", "Genotoxicity", "tiered"),
    Rule("RPMI-8226", "Toksisitas", "RPMI-8226 Immunotoxicity", "tiered"),
    Rule("A549", "Toksisitas", "A549 Cytotoxicity", "tiered"),
    Rule("HEK293", "Toksisitas", "HEK293 Cytotoxicity", "tiered"),
    Rule("hERG-10um", "Toksisitas", "hERG Blockers (10 uM)", "tiered"),
    Rule("hERG", "Toksisitas", "hERG Blockers", "tiered"),
    Rule("H-HT", "Toksisitas", "Human Hepatotoxicity", "tiered"),
    Rule("DILI", "Toksisitas", "DILI", "tiered"),
    Rule("Ames", "Toksisitas", "Ames Mutagenicity", "tiered"),
    Rule("ROA", "Toksisitas", "Rat Oral Acute Toxicity", "tiered"),
    Rule("FDAMDD", "Toksisitas", "FDAMDD", "tiered"),
    Rule("SkinSen", "Toksisitas", "Skin Sensitization", "tiered"),
    Rule("Carcinogenicity", "Toksisitas", "Carcinogenicity", "tiered"),
    Rule("EC", "Toksisitas", "Eye Corrosion", "tiered"),
    Rule("EI", "Toksisitas", "Eye Irritation", "tiered"),
    Rule("Respiratory", "Toksisitas", "Respiratory Toxicity", "tiered"),
    Rule("NR-AhR", "Toksisitas", "NR-AhR", "tiered"),
    Rule("NR-AR", "Toksisitas", "NR-AR", "tiered"),
    Rule("NR-AR-LBD", "Toksisitas", "NR-AR-LBD", "tiered"),
    Rule("NR-Aromatase", "Toksisitas", "NR-Aromatase", "tiered"),
    Rule("NR-ER", "Toksisitas", "NR-ER", "tiered"),
    Rule("NR-ER-LBD", "Toksisitas", "NR-ER-LBD", "tiered"),
    Rule("NR-PPAR-gamma", "Toksisitas", "NR-PPAR-gamma", "tiered"),
    Rule("SR-ARE", "Toksisitas", "SR-ARE", "tiered"),
    Rule("SR-ATAD5", "Toksisitas", "SR-ATAD5", "tiered"),
    Rule("SR-HSE", "Toksisitas", "SR-HSE", "tiered"),
    Rule("SR-MMP", "Toksisitas", "SR-MMP", "tiered"),
    Rule("SR-p53", "Toksisitas", "SR-p53", "tiered"),
    Rule("BCF", "Toksisitas", "Bioconcentration Factor", "descriptive", unit="log10(L/kg)"),
    Rule("IGC50", "Toksisitas", "T. pyriformis IGC50", "descriptive", unit="-log10[(mg/L)/(1000*MW)]"),
    Rule("LC50DM", "Toksisitas", "D. magna LC50", "descriptive", unit="-log10[(mg/L)/(1000*MW)]"),
    Rule("LC50FM", "Toksisitas", "Fathead Minnow LC50", "descriptive", unit="-log10[(mg/L)/(1000*MW)]"),
    Rule("LD50_oral", "Toksisitas", "Acute Toxicity Rule", "alert_count", citation="20 substruktur"),
    Rule("NonBiodegradable", "Toksisitas", "NonBiodegradable Rule", "alert_count", citation="19 substruktur"),
    Rule("NonGenotoxic_Carcinogenicity", "Toksisitas", "NonGenotoxic Carcinogenicity Rule", "alert_count", citation="23 substruktur"),
    Rule("SureChEMBL", "Toksisitas", "SureChEMBL Rule", "alert_count", citation="164 substruktur"),
    Rule("Skin_Sensitization", "Toksisitas", "Skin Sensitization Rule", "alert_count", citation="155 substruktur"),
    Rule("Acute_Aquatic_Toxicity", "Toksisitas", "Aquatic Toxicity Rule", "alert_count", citation="99 substruktur"),
    Rule("Genotoxic_Carcinogenicity_Mutagenicity", "Toksisitas", "Genotoxic Carcinogenicity Rule", "alert_count", citation="117 substruktur"),
    Rule("FAF-Drugs4 Rule", "Toksisitas", "FAF-Drugs4 Rule", "alert_count"),
)

RULE_SCHEMA = ("column string, category string, category_ord int, label string, rule_type string, lo double, hi double, "
               "ascending_bad boolean, inverted boolean, unit string, citation string, note string, rule_ord int")


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """The rules as a table; ``rule_ord`` keeps the report order."""
    order = {c: k for k, c in enumerate(CATEGORIES)}
    num = lambda v: None if v is None else float(v)
    rows = [(r.column, r.category, order.get(r.category, len(order)), r.label, r.rule_type, num(r.lo), num(r.hi), r.ascending_bad, r.inverted,
             r.unit, r.citation, r.note, k) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _number(raw: Column) -> Column:
    return read_number(raw)


def descriptive_label(column: Column, raw: Column, value: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Text of an informative property: its own label expression, else the short number, else the raw text."""
    custom = [r for r in rules if r.label_sql]
    out = F.when(value.isNull(), raw)
    for r in custom:
        out = out.when(column == r.column, F.expr(r.label_sql))
    return out.otherwise(general_number(value))


def _pair(ok: Column, good: str, bad: str) -> tuple[Column, Column]:
    return F.when(ok, "green").otherwise("red"), F.when(ok, good).otherwise(bad)


def classify_cells(cells: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Add category, label, value, ``flag`` and ``flag_label`` to rows holding ``column`` and ``raw``.

    The rules are a literal of fixed size, so they are broadcast.
    """
    spark = cells.sparkSession
    alias = F.create_map(*[F.lit(x) for kv in COLUMN_ALIASES.items() for x in kv])
    df = cells.withColumn("_rule", F.coalesce(F.try_element_at(alias, F.col("column")), F.col("column")))
    table = rules_table(spark, rules).withColumnRenamed("column", "_rule")
    df = df.join(F.broadcast(table), "_rule", "left").withColumn("value", _number(F.col("raw")))
    v, raw, lo, hi, kind = (F.col(c) for c in ("value", "raw", "lo", "hi", "rule_type"))
    text = F.trim(raw)

    alert_free = F.lower(text).isin("", "nan") | (text == NO_ALERT) | F.coalesce(v == 0, F.lit(False))
    rounded = F.rint(v)
    # The texts beside each flag
    cases: list[tuple[Column, Column, Column]] = [
        (kind.isNull() | raw.isNull(), F.lit("na"), F.lit("N/A")),
        (kind == "alert_count", *_pair(alert_free, "Tanpa peringatan", "Ada peringatan")),
        ((kind == "descriptive") & ((text == "") | (text == NO_ALERT)), F.lit("na"), F.lit("N/A")),
        (kind == "descriptive", F.lit("info"), descriptive_label(F.col("_rule"), raw, v, rules)),
        (v.isNull(), F.lit("na"), F.lit("N/A")),
        (kind == "binary", *_pair(rounded == F.when(F.col("inverted"), 0).otherwise(1), "Baik", "Buruk")),
        (kind == "range", *_pair(v.between(lo, hi), "Optimal", "Di luar rentang")),
        (kind == "threshold_gte", *_pair(v >= lo, "Baik", "Buruk")),
        (kind == "threshold_lte", *_pair(v <= hi, "Baik", "Buruk")),
    ]
    falling = (kind == "tiered_range") & ~F.col("ascending_bad")
    low = F.when(kind == "tiered_range", lo).otherwise(0.3)
    high = F.when(kind == "tiered_range", hi).otherwise(0.7)
    band = F.when(falling, F.when(v > high, 0).when(v >= low, 1).otherwise(2)).otherwise(
        F.when(v <= low, 0).when(v <= high, 1).otherwise(2))
    band = F.when(kind == "tiered_reversed", 2 - band).otherwise(band)
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), band + 1)
    flag = reduce(lambda acc, c: acc.when(c[0], c[1]), cases[1:], F.when(cases[0][0], cases[0][1]))
    label = reduce(lambda acc, c: acc.when(c[0], c[2]), cases[1:], F.when(cases[0][0], cases[0][2]))
    return (df.withColumn("flag", flag.otherwise(pick(("green", "yellow", "red"))))
            .withColumn("flag_label", label.otherwise(pick(("Sangat baik", "Sedang", "Buruk")))).drop("_rule"))


def classify_rules(wide: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, key: str = "ligand") -> DataFrame:
    """Classify every property cell of a wide table: one row per key and column."""
    skip = set(IDENTITY_COLUMNS) | {key}
    columns = [c for c in wide.columns if c not in skip]
    # exploding an array of cells compiles where an unpivot of over a hundred columns does not
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("raw"))
    cells = spread(wide.select(key, *[f"`{c}`" for c in columns])).select(key, F.inline(F.array(*[cell(c) for c in columns])))
    return classify_cells(cells, rules).select(
        key, "column", "raw", "value", "flag", "flag_label", "category", "category_ord", "label", "rule_type", "rule_ord")


def rule_score(rule: Rule, raw: Column) -> Column | None:
    """Score of one cell under a rule known when planning; null for a cell that does not count, None for a rule that never does."""
    v, text = read_number(raw), F.trim(raw)
    good = lambda ok: F.when(v.isNotNull(), F.when(ok, FLAG_SCORES["green"]).otherwise(FLAG_SCORES["red"]))
    kind = rule.rule_type
    if kind == "descriptive":
        return None
    if kind == "alert_count":
        free = F.lower(text).isin("", "nan") | (text == NO_ALERT) | F.coalesce(v == 0, F.lit(False))
        return F.when(raw.isNotNull(), F.when(free, FLAG_SCORES["green"]).otherwise(FLAG_SCORES["red"]))
    if kind == "binary":
        return good(F.rint(v) == (0 if rule.inverted else 1))
    if kind == "range":
        return good(v.between(rule.lo, rule.hi))
    if kind in ("threshold_gte", "threshold_lte"):
        return good(v >= rule.lo if kind == "threshold_gte" else v <= rule.hi)
    low, high = (rule.lo, rule.hi) if kind == "tiered_range" else (0.3, 0.7)
    first, last = (FLAG_SCORES[c] for c in (("red", "green") if kind == "tiered_reversed" else ("green", "red")))
    if kind == "tiered_range" and not rule.ascending_bad:
        band = F.when(v > high, first).when(v >= low, FLAG_SCORES["yellow"]).otherwise(last)
    else:
        band = F.when(v <= low, first).when(v <= high, FLAG_SCORES["yellow"]).otherwise(last)
    return F.when(v.isNotNull(), band)


def wide_category_scores(wide: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, key: str = "ligand") -> DataFrame:
    """Mean score per key and category, summed inside the wide row: no cell becomes a row of its own.

    The physicochemical category is left out; a category without a counted cell has no row.
    """
    by_column = {r.column: r for r in rules}
    scores: dict[str, list[Column]] = {}
    for c in wide.columns:
        rule = by_column.get(COLUMN_ALIASES.get(c, c))
        if c in IDENTITY_COLUMNS or c == key or rule is None or rule.category == PHYSICOCHEMICAL:
            continue
        score = rule_score(rule, F.col(f"`{c}`").cast("string"))
        if score is not None:
            scores.setdefault(rule.category, []).append(score)
    # the scores of a category as one array, so that each cell is read once
    means = [F.struct(F.lit(name).alias("category"), F.aggregate(
        F.filter(F.array(*cells), lambda x: x.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n")),
        lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"])).alias("score")) for name, cells in scores.items()]
    if not means:
        return wide.select(key, F.lit("").alias("category"), F.lit(0.0).alias("score")).limit(0)
    return spread(wide).select(key, F.inline(F.array(*means))).where("score is not null")


def wide_flag_counts(wide: DataFrame, by: list[str], category: str | None = None, rules: tuple[Rule, ...] = DEFAULT_RULES, key: str = "ligand") -> DataFrame:
    """Green, yellow and red cells per ``by`` and rule, counted by place in an array of the wide row's scores: no cell becomes a row of its own.

    Rules without a counted cell have no row.
    """
    order = {r.column: k for k, r in enumerate(rules)}
    scores, places = [], {}
    for c in wide.columns:
        at = order.get(COLUMN_ALIASES.get(c, c))
        if c in IDENTITY_COLUMNS or c == key or c in by or at is None or category not in (None, rules[at].category):
            continue
        score = rule_score(rules[at], F.col(f"`{c}`").cast("string"))
        if score is not None:
            places.setdefault(at, []).append(len(scores))
            scores.append(score)
    if not scores:
        nothing = [F.lit("").alias("category"), F.lit("").alias("label"), F.lit(0).alias("rule_ord"), *[F.lit(0).cast("long").alias(n) for n in FLAG_SCORES]]
        return wide.select(*by, *nothing).limit(0)
    rows = spread(wide).select(*by, F.array(*scores).alias("_s"))
    count = lambda j, value: F.count_if(F.get("_s", F.lit(j)) == value)
    counts = rows.groupBy(*by).agg(*[count(j, v).alias(f"_{n}{j}") for j in range(len(scores)) for n, v in FLAG_SCORES.items()])
    cell = lambda at, js: F.struct(F.lit(rules[at].category).alias("category"), F.lit(rules[at].label).alias("label"), F.lit(at).alias("rule_ord"),
                                   *[reduce(lambda a, b: a + b, [F.col(f"_{n}{j}") for j in js]).alias(n) for n in FLAG_SCORES])
    return counts.select(*by, F.inline(F.array(*[cell(at, js) for at, js in sorted(places.items())]))).where("green + yellow + red > 0")


def flag_score(flag: Column) -> Column:
    """Score of a counted flag; null for na and info."""
    return reduce(lambda acc, kv: acc.when(flag == kv[0], F.lit(kv[1])), list(FLAG_SCORES.items())[1:],
                  F.when(flag == "green", F.lit(1.0)))


def threshold_text(kind: Column, lo: Column, hi: Column, ascending_bad: Column, inverted: Column) -> Column:
    """Readable threshold of one rule; a bound shifted by a tiny epsilon reads as strict."""
    def bound(c: Column, strict: str, open_: str) -> Column:
        near = F.round(c, 6)
        is_strict = (c != near) & (F.abs(c - near) < 1e-6)
        return F.concat(F.when(is_strict, strict).otherwise(open_), F.lit(" "), general_number(near), F.lit(" hijau, selain itu merah"))
    g = general_number
    # Legend texts
    return (F.when(kind == "range", F.concat(g(lo), F.lit(" sampai "), g(hi), F.lit(" hijau, di luar rentang merah")))
            .when(kind == "threshold_gte", bound(lo, ">", ">=")).when(kind == "threshold_lte", bound(hi, "<", "<="))
            .when(kind == "tiered", "0-0,3 hijau / 0,3-0,7 kuning / 0,7-1,0 merah")
            .when(kind == "tiered_reversed", "0-0,3 merah / 0,3-0,7 kuning / 0,7-1,0 hijau")
            .when((kind == "tiered_range") & ascending_bad,
                  F.concat(F.lit("<= "), g(lo), F.lit(" hijau / "), g(lo), F.lit("-"), g(hi), F.lit(" kuning / > "), g(hi), F.lit(" merah")))
            .when(kind == "tiered_range",
                  F.concat(F.lit("> "), g(hi), F.lit(" hijau / "), g(lo), F.lit("-"), g(hi), F.lit(" kuning / < "), g(lo), F.lit(" merah")))
            .when(kind == "alert_count", "tanpa peringatan hijau, ada peringatan merah")
            .when((kind == "binary") & inverted, "0 hijau, 1 merah").when(kind == "binary", "1 hijau, 0 merah")
            .otherwise("informasi saja (tanpa ambang)"))


def rules_legend(spark: SparkSession, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Legend of the rules in report order."""
    t = rules_table(spark, rules)
    return t.select("category", "column", "label", "unit", threshold_text(
        F.col("rule_type"), F.col("lo"), F.col("hi"), F.col("ascending_bad"), F.col("inverted")).alias("threshold"),
        "citation", "note", "rule_ord")
