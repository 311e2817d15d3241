"""Engine tables derived from the given tables, as DataFrames and as SQL common table expressions.

Every binding covers its whole source table, so the work of a query grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.functions.text import day_micros
from assayloom.rules import DEFAULT_RULES
from assayloom.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def half_up(sql: str, digits: int = 3) -> str:
    """SQL for a half rounded up in decimals, ties decided on six digits more."""
    return f"CAST(round(CAST(round({sql}, {digits + 6}) AS DECIMAL(36, {digits + 6})), {digits}) AS DOUBLE)"


# ---- docking runs, groups, compounds ---------------------------------------------------------------------

def docking_runs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    affinity = -F.col("l_extendedprice") / 7919
    n = (F.lit(1) + F.col("l_linenumber") % 3).cast("int")
    pose = lambda k: F.struct(F.lit(k).alias("mode"), (affinity + (k - 1) * 0.25).alias("affinity"),
                              F.lit(k - 1.0).alias("rmsd_lb"), F.lit(2.0 * (k - 1)).alias("rmsd_ub"))
    failed = F.col("l_returnflag") == "R"
    return li.select(
        F.concat(F.lit("L"), "l_partkey").alias("ligand"), F.concat(F.lit("R"), F.col("l_suppkey") % 10).alias("receptor"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("replicate"), (F.col("l_orderkey") + 42).alias("seed"),
        F.when(failed, F.array().cast("array<struct<mode:int,affinity:double,rmsd_lb:double,rmsd_ub:double>>"))
        .otherwise(F.slice(F.array(pose(1), pose(2), pose(3)), F.lit(1), n)).alias("poses"),
        F.when(failed, "run failed").alias("error"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def ligand_groups(spark: SparkSession, sf: str) -> DataFrame:
    group = (F.when(F.col("p_partkey") % 50 == 7, "  ").when(F.col("p_brand") == "Brand#1", "Native").otherwise(F.col("p_brand")))
    return table(spark, sf, "part").select(F.concat(F.lit("L"), "p_partkey").alias("ligand"), group.alias("group"),
                                           F.col("p_partkey").alias("ord"))


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("C"), k % 300)).alias("smiles"),
        F.col("p_brand").alias("group"), F.concat(F.lit("L"), k).alias("safe_name"), k.alias("ord"))


def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("L"), k).alias("ligand"), (F.col("p_retailprice") / 3).alias("MW"), ((k * 13 % 120) / 10 - 3).alias("LogP"),
        (k % 9).cast("double").alias("HBD"), (k * 7 % 17).cast("double").alias("HBA"))


RUNS = """runs AS (SELECT 'L' || l_partkey AS ligand, 'R' || (l_suppkey % 10) AS receptor, l_orderkey * 10 + l_linenumber AS ord,
  -l_extendedprice / 7919 AS affinity, 1 + l_linenumber % 3 AS n_poses, l_returnflag = 'R' AS failed, l_orderkey + 42 AS seed FROM lineitem)"""
STATS = RUNS + """, stats AS (SELECT ligand, receptor, count(*) AS n_replicates_success, round(avg(affinity), 3) AS affinity_mean,
  round(stddev_pop(affinity), 3) AS affinity_std, round(min(affinity), 3) AS affinity_best FROM runs WHERE NOT failed GROUP BY 1, 2)"""
GROUPS = """grps AS (SELECT 'L' || p_partkey AS ligand, CASE WHEN p_partkey % 50 = 7 THEN 'Tanpa Grup' WHEN p_brand = 'Brand#1' THEN 'Native'
  ELSE p_brand END AS grp, p_partkey AS ord FROM part)"""
NATIVE = """natives AS (SELECT receptor, min(affinity_best) AS native_affinity FROM stats JOIN grps USING (ligand)
  WHERE grp = 'Native' GROUP BY 1)"""
GROUPED = f"{STATS}, {GROUPS}, {NATIVE}, g AS (SELECT stats.*, coalesce(grp, 'Tanpa Grup') AS grp FROM stats LEFT JOIN grps USING (ligand))"
COMPOUNDS = """compounds AS (SELECT p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'C' || (p_partkey % 300) END AS smiles,
  p_brand AS grp, 'L' || p_partkey AS safe_name, p_partkey AS ord FROM part),
  keyed AS (SELECT *, CASE WHEN smiles = '' THEN 'name:' || lower(trim(name)) ELSE 'raw:' || smiles END AS key FROM compounds)"""
DESCRIPTORS = """descriptors AS (SELECT 'L' || p_partkey AS ligand, p_retailprice / 3 AS MW, (p_partkey * 13 % 120) / 10 - 3 AS LogP,
  CAST(p_partkey % 9 AS DOUBLE) AS HBD, CAST(p_partkey * 7 % 17 AS DOUBLE) AS HBA FROM part),
  ro5 AS (SELECT *, CAST(MW > 500 AS INT) + CAST(LogP > 5 AS INT) + CAST(HBD > 5 AS INT) + CAST(HBA > 10 AS INT) AS violations FROM descriptors)"""


# ---- wide property table: every rule column from the part key -----------------------------------------------

def _cell(k: int) -> str:
    """Text of one property cell, the same expression in both SQL dialects."""
    r = DEFAULT_RULES[k]
    step = f"(p_partkey * {7 + 2 * k} % 101)"
    if r.rule_type == "alert_count":
        value = f"CASE p_partkey * {3 + k} % 4 WHEN 0 THEN '[''-'']' WHEN 1 THEN '0' WHEN 2 THEN '2' ELSE 'C=O' END"
    elif r.rule_type == "binary":
        value = f"cast({step} % 2 as string)"
    elif r.rule_type in ("tiered", "tiered_reversed"):
        value = f"cast({step} / 100 as string)"
    elif r.rule_type == "descriptive":
        value = f"cast({step} / 4 - 3 as string)"
    else:
        lo = r.lo if r.lo is not None else r.hi - 10
        hi = r.hi if r.hi is not None else r.lo + 10
        low, span = round(lo - (hi - lo) / 2), max(1, round((hi - lo) * 2))
        value = f"cast({step} * {span} / 100 + ({low}) as string)"
    return f"CASE WHEN (p_partkey + {k}) % 17 = 0 THEN NULL WHEN (p_partkey + {k}) % 29 = 0 THEN '[''-'']' ELSE {value} END"


PROPERTY_COLUMNS = [r.column for r in DEFAULT_RULES] + ["unknown_property"]


def properties(spark: SparkSession, sf: str) -> DataFrame:
    cells = [F.expr(_cell(k)).alias(r.column) for k, r in enumerate(DEFAULT_RULES)]
    # six columns become 121: computed on all cores
    return spread(table(spark, sf, "part").select("p_partkey")).select(F.concat(F.lit("L"), "p_partkey").alias("ligand"), *cells, F.lit("1").alias("unknown_property"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_values() -> str:
    rows = []
    order = {c: i for i, c in enumerate(("Fisikokimia", "Absorpsi", "Distribusi", "Metabolisme", "Ekskresi", "Toksisitas"))}
    for k, r in enumerate(DEFAULT_RULES):
        num = lambda x: "NULL" if x is None else f"CAST('{x!r}' AS DOUBLE)"
        rows.append(f"({_quoted(r.column)}, {_quoted(r.category)}, {order[r.category]}, {_quoted(r.label)}, {_quoted(r.rule_type)}, "
                    f"{num(r.lo)}, {num(r.hi)}, {str(r.ascending_bad).lower()}, {str(r.inverted).lower()}, {k})")
    return ", ".join(rows)


WIDE = "wide AS (SELECT 'L' || p_partkey AS ligand, " + ", ".join(
    f'{_cell(k)} AS "{r.column}"' for k, r in enumerate(DEFAULT_RULES)) + ", '1' AS unknown_property FROM part)"
FLAGS = WIDE + f""", rules(col, category, category_ord, label, rule_type, lo, hi, ascending_bad, inverted, rule_ord) AS (VALUES {_rule_values()}),
 cells AS (SELECT ligand, col, raw FROM wide UNPIVOT INCLUDE NULLS (raw FOR col IN ({", ".join(f'"{c}"' for c in PROPERTY_COLUMNS)}))),
 valued AS (SELECT cells.*, rules.* EXCLUDE (col), CASE WHEN trim(raw) IN ('', '[''-'']') THEN NULL ELSE try_cast(raw AS DOUBLE) END AS v
   FROM cells LEFT JOIN rules USING (col)),
 flags AS (SELECT *, CASE
   WHEN rule_type IS NULL OR raw IS NULL THEN 'na'
   WHEN rule_type = 'alert_count' THEN CASE WHEN trim(raw) IN ('', '[''-'']') OR v = 0 THEN 'green' ELSE 'red' END
   WHEN rule_type = 'descriptive' THEN CASE WHEN trim(raw) IN ('', '[''-'']') THEN 'na' ELSE 'info' END
   WHEN v IS NULL THEN 'na'
   WHEN rule_type = 'binary' THEN CASE WHEN (v = 0) = inverted THEN 'green' ELSE 'red' END
   WHEN rule_type = 'range' THEN CASE WHEN v >= lo AND v <= hi THEN 'green' ELSE 'red' END
   WHEN rule_type = 'threshold_gte' THEN CASE WHEN v >= lo THEN 'green' ELSE 'red' END
   WHEN rule_type = 'threshold_lte' THEN CASE WHEN v <= hi THEN 'green' ELSE 'red' END
   WHEN rule_type = 'tiered' THEN CASE WHEN v <= 0.3 THEN 'green' WHEN v <= 0.7 THEN 'yellow' ELSE 'red' END
   WHEN rule_type = 'tiered_reversed' THEN CASE WHEN v <= 0.3 THEN 'red' WHEN v <= 0.7 THEN 'yellow' ELSE 'green' END
   WHEN ascending_bad THEN CASE WHEN v <= lo THEN 'green' WHEN v <= hi THEN 'yellow' ELSE 'red' END
   ELSE CASE WHEN v > hi THEN 'green' WHEN v >= lo THEN 'yellow' ELSE 'red' END END AS flag FROM valued),
 scored AS (SELECT flags.*, CASE flag WHEN 'green' THEN 1.0 WHEN 'yellow' THEN 0.5 ELSE 0.0 END AS s FROM flags WHERE flag IN ('green', 'yellow', 'red'))"""
CATEGORY_SCORES = FLAGS + """, cs AS (SELECT ligand, category, CAST(avg(s) AS DOUBLE) AS score FROM scored WHERE category <> 'Fisikokimia' GROUP BY 1, 2)"""
