"""Report tables, column order, complex files and the manifest of written complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayloom.rules import COLUMN_ALIASES, DEFAULT_RULES, Rule

# Identity columns of the property sheet.
IDENTITY = ("ligand", "group", "raw_smiles", "smiles")


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", notes: list[str] = (), parameters: dict[str, object] | None = None) -> list[str]:
    """One folder per table. The first two are always written, the others when they hold rows; returns what was written."""
    spark = next(iter(tables.values())).sparkSession
    extra = dict(tables)
    if notes:
        extra["notes"] = spark.createDataFrame([(k, n) for k, n in enumerate(notes, 1)], "number int, note string")
    if parameters:
        extra["parameters"] = spark.createDataFrame([(k, str(v)) for k, v in parameters.items()], "parameter string, value string")
    written = []
    for k, (name, df) in enumerate(extra.items()):
        if k >= 2 and df.isEmpty():
            continue
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{path}/{name}")
        written.append(name)
    return written


def report_column_order(columns: list[str], rules: tuple[Rule, ...] = DEFAULT_RULES) -> list[str]:
    """Identity columns, then the rule columns in report order, then the rest; an alias of a present column is left out."""
    known = [r.column for r in rules]
    first = [c for c in IDENTITY if c in columns] + [c for c in known if c in columns]
    return first + [c for c in columns if c not in first and COLUMN_ALIASES.get(c) not in first]


def order_report_columns(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    return df.select(*[f"`{c}`" for c in report_column_order(df.columns, rules)])


def complex_lines(atoms: DataFrame) -> DataFrame:
    """Fixed-width lines of merged complexes: receptor, TER, ligand, TER, END. ``part`` is 0 for the receptor and 1 for the ligand."""
    name = F.when(F.length("atom") < 4, F.concat(F.lit(" "), F.rpad("atom", 3, " "))).otherwise(F.substring("atom", 1, 4))
    serial = F.col("serial") if "serial" in atoms.columns else F.pmod(F.col("ord"), F.lit(100000)).cast("int")
    line = F.format_string("%-6s%5d %s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.col("record"), serial, name, F.col("resname"), F.col("chain"), F.col("resnum"),
                           F.col("x"), F.col("y"), F.col("z"), F.lit(1.0), F.lit(0.0), F.col("element"))
    rows = atoms.select("complex", F.col("part").cast("int").alias("part"), F.col("ord").cast("long").alias("seq"), line.alias("line"))
    ends = atoms.select("complex", F.col("part").cast("int").alias("part")).distinct()
    last = F.lit(2 ** 62).cast("long")
    ter = ends.select("complex", "part", last.alias("seq"), F.lit("TER").alias("line"))
    end = ends.select("complex").distinct().select("complex", F.lit(2).alias("part"), last.alias("seq"), F.lit("END").alias("line"))
    return rows.unionByName(ter).unionByName(end)


def write_documents(lines: DataFrame, path: str, key: str, order: list[str], partitions: int | None = None) -> None:
    """Write ``line`` to one folder per key. A large document spans several part files that continue one another in name order."""
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).select(key, "line")
     .write.mode("overwrite").partitionBy(key).text(path))


def write_complex_text(atoms: DataFrame, path: str, partitions: int | None = None) -> None:
    write_documents(complex_lines(atoms), path, "complex", ["part", "seq"], partitions)


def run_manifest(active: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths written now, and earlier paths that are no longer active."""
    now = active.select("path").distinct()
    return now, previous.select("path").distinct().join(now, "path", "left_anti")
