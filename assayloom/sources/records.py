"""Structure, pose, log, contact and JSON record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.functions.text import clean_text, guess_element, parse_atom_spec
from assayloom.session import cut
from assayloom.sources.chromatograms import _cells, sniff_delimiter
from assayloom.sources.lines import ORDER, along_lines, line_order, read_lines

# Contact table header words and the positions used without a header.
CONTACT_HEADERS = {"category": ("category",), "type_subtype": ("types", "type", "type/subtype"), "from": ("from",), "from_chemistry": ("from chemistry",),
                   "to": ("to",), "to_chemistry": ("to chemistry",)}
CONTACT_POSITIONS = {"category": 5, "type_subtype": 6, "from": 7, "from_chemistry": 8, "to": 9, "to_chemistry": 10}
CONTACT_WIDTH = 11
REQUIRED = ("category", "type_subtype", "from", "to")


def read_interactions(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Contact rows per document; a row whose atoms cannot be read carries an ``error`` instead."""
    lines = read_lines(spark, path, folder)
    return contact_rows(lines)


def contact_rows(lines: DataFrame) -> DataFrame:
    rows = lines.join(sniff_delimiter(lines), "document").withColumn("cells", _cells(F.col("line"), F.col("delimiter")))
    rows = cut(rows.where(F.exists("cells", lambda c: c != "")).select("document", F.struct(*ORDER).alias("at"), "cells"))
    head = rows.groupBy("document").agg(F.min(F.struct("at", "cells")).alias("h"), F.count(F.lit(1)).alias("_rows"))
    names = F.transform(F.col("h.cells"), lambda c: F.lower(F.trim(c)))
    found = lambda key: F.coalesce(*[F.nullif(F.array_position(names, a), F.lit(0).cast("long")) for a in CONTACT_HEADERS[key]])
    head = head.select("document", "_rows", F.col("h.at").alias("_first"), F.col("h.cells").alias("_head"), *[found(k).alias(f"_h_{k}") for k in CONTACT_HEADERS])
    named = F.lit(True)
    for k in REQUIRED:
        named = named & F.col(f"_h_{k}").isNotNull()
    spec = lambda i: parse_atom_spec(F.try_element_at("_head", F.lit(i + 1)))
    looks_data = (F.size("_head") >= CONTACT_WIDTH) & spec(7).isNotNull() & spec(9).isNotNull()
    head = head.withColumn("_named", named).withColumn("_skip", named | ((F.col("_rows") > 1) & ~looks_data))
    rows = rows.join(head, "document").where(~(F.col("_skip") & (F.col("at") == F.col("_first"))))
    cell = lambda k: F.coalesce(F.try_element_at("cells", F.when(F.col("_named"), F.col(f"_h_{k}")).otherwise(CONTACT_POSITIONS[k] + 1).cast("int")), F.lit(""))
    need = F.when(F.col("_named"), F.greatest(*[F.col(f"_h_{k}") for k in REQUIRED])).otherwise(CONTACT_WIDTH)
    out = rows.select("document", cell("category").alias("category"), cell("type_subtype").alias("type_subtype"), cell("from").alias("from"), cell("from_chemistry").alias("from_chemistry"),
                      cell("to").alias("to"), cell("to_chemistry").alias("to_chemistry"), (F.size("cells") < need).alias("_short"))
    out = out.withColumns({"from_spec": parse_atom_spec("from"), "to_spec": parse_atom_spec("to")})
    error = F.when(F.col("_short"), "too few columns").when(F.col("from_spec").isNull() | F.col("to_spec").isNull(), "atom not understood")
    return out.withColumn("error", error).drop("_short")


def _field(line: str, start: int, end: int) -> Column:
    return F.trim(F.substring(line, start, end - start + 1))


def _atom_columns(line: str) -> list[Column]:
    name, chain = F.upper(_field(line, 13, 16)), _field(line, 22, 22)
    element = F.upper(_field(line, 77, 78))
    return [_field(line, 1, 6).alias("record"), _field(line, 7, 11).try_cast("int").alias("serial"), name.alias("atom"), F.upper(_field(line, 18, 20)).alias("resname"),
            F.when(chain == "", "A").otherwise(chain).alias("chain"), _field(line, 23, 26).try_cast("int").alias("resnum"),
            *[_field(line, a, a + 7).try_cast("double").alias(c) for c, a in zip("xyz", (31, 39, 47))],
            F.when(element == "", F.substring(name, 1, 1)).otherwise(element).alias("element")]


def read_pdb_atoms(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Atom records of fixed-width structure files with the place of each line."""
    lines = read_lines(spark, path, folder).where(F.col("line").startswith("ATOM  ") | F.col("line").startswith("HETATM"))
    return lines.select(F.col("document").alias("structure"), *_atom_columns("line"), *ORDER).where("resnum is not null")


def read_pose_atoms(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Atoms of every MODEL block with the model number; atoms outside a model are ignored."""
    start, end = F.col("line").startswith("MODEL"), F.col("line").startswith("ENDMDL")
    atom_line = F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM")
    lines = read_lines(spark, path, folder).where(start | end | atom_line)
    marked = lines.withColumns({"_m": start.cast("long"), "_e": end.cast("long"),
                                "_no": F.when(start, F.struct(F.regexp_extract("line", r"^MODEL\S*\s+(\d+)", 1).try_cast("int").alias("no")))})
    rows = along_lines(marked, ["document"], {"_ms": ("sum", "_m"), "_es": ("sum", "_e"), "_id": ("fill", "_no")})
    rows = rows.where(atom_line & (F.col("_ms") > F.col("_es")))
    kind = F.regexp_extract(F.substring("line", 78, 20), r"(\S+)\s*$", 1)
    atom = F.trim(F.substring("line", 13, 4))
    return rows.select("document", F.coalesce("_id.no", F.col("_ms").cast("int")).alias("model"), *[c for c in _atom_columns("line")][:-1], guess_element(atom, kind).alias("element"), *ORDER)


def read_score_logs(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Score rows below the table rule of docking logs."""
    lines = read_lines(spark, path, folder)
    marked = lines.withColumn("_rule", (F.col("line").contains("-----+") & F.col("line").contains("----------")).cast("long"))
    rows = along_lines(marked, ["document"], {"_seen": ("sum", "_rule")}).where("_seen > 0 and _rule = 0")
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda c: c != "")
    rows = rows.withColumn("p", parts).where((F.size("p") >= 2) & F.col("p")[0].rlike(r"^\d+$"))
    number = lambda k: F.try_element_at("p", F.lit(k)).try_cast("double")
    wide = F.size("p") >= 4
    rows = rows.select("document", F.col("p")[0].try_cast("int").alias("mode"), number(2).alias("affinity"), F.when(wide, number(3)).alias("rmsd_lb"), F.when(wide, number(4)).alias("rmsd_ub"), wide.alias("_wide"), *ORDER)
    return rows.where("affinity is not null and (not _wide or (rmsd_lb is not null and rmsd_ub is not null))").drop("_wide")


RUN_SCHEMA = ("ligand_name string, receptor_key string, replicate int, seed long, "
              "poses array<struct<mode:int,affinity:double,rmsd_lb:double,rmsd_ub:double>>, output_pdbqt string, log_path string, error string")


def _plain_records(spark: SparkSession, path: str, glob: str) -> bool:
    """Whether all files are UTF-8, begin with a brace and have no line that begins with two: then a newline and a brace cut them into records."""
    df = line_order(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, lineSep="\n"))
    line, first = F.col("value"), F.when(F.col("block") == 0, F.col("pos"))
    other = line.contains("\0") | ~F.is_valid_utf8(line) | line.rlike("^\\{\ufeff?\\{")
    files = df.groupBy(F.col("_metadata.file_path")).agg(F.bool_or(other).alias("other"), F.min_by(line.rlike("^\ufeff?\\{"), first).alias("begins"))
    return files.where("other or not begins").isEmpty()


def _json_records(spark: SparkSession, path: str, schema: str, lines: bool, glob: str) -> DataFrame:
    """Records of JSON files with the file's path, broken ones as null.

    A file holds one record or several, indented or not, each beginning with a brace at the start of a line. That is the record separator of the
    text reader, so Spark splits a file at any byte, no task holds more than a record and nothing is shuffled. Files in other encodings or with
    other beginnings are read as lines; records are numbered along the lines, and the lines of each are put together again. With ``lines`` every
    line is a record.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if lines:
        text = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    elif _plain_records(spark, path, glob):
        # the separator takes the brace of every record but the first of a file
        value = F.when(F.col("value").rlike("^\ufeff?\\{"), F.col("value")).otherwise(F.concat(F.lit("{"), "value"))
        text = reader.text(path, lineSep="\n{").select(value.alias("value"), F.col("_metadata.file_path").alias("file"))
    else:
        rows = read_lines(spark, path, glob=glob, full_path=True)
        rows = rows.withColumn("_begins", F.col("line").startswith("{").cast("long"))
        rows = along_lines(rows, ["document"], {"_record": ("sum", "_begins")})
        text = rows.groupBy(F.col("document").alias("file"), "_record").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "line"))).alias("l"))
        text = text.select("file", F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("value"))
    return text.select("file", F.from_json(F.regexp_replace("value", "^\ufeff", ""), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("file", "r.*")


def read_run_checkpoints(spark: SparkSession, path: str, lines: bool = False, glob: str = "*.json") -> DataFrame:
    """Finished runs: no error and at least one pose."""
    df = _json_records(spark, path, RUN_SCHEMA + ", _corrupt_record string", lines, glob)
    good = df.where("_corrupt_record is null and ligand_name is not null and receptor_key is not null and replicate is not null and error is null")
    return good.where(F.size("poses") > 0).select(F.col("ligand_name").alias("ligand"), F.col("receptor_key").alias("receptor"), "replicate", "seed", "poses", "error")


SIDECAR_SCHEMA = "receptor string, complex string, ligand_name string, ligand_code string, ligand_chain string, ligand_resname string, is_native boolean"


def read_complex_sidecars(spark: SparkSession, path: str, lines: bool = False, glob: str = "*.json") -> DataFrame:
    """Identity records of merged complexes; corrupt ones are left out.

    A record without receptor or complex takes them from its place: the folder's name and the file's name without ending.
    """
    df = _json_records(spark, path, SIDECAR_SCHEMA + ", _corrupt_record string", lines, glob)
    place = lambda pattern: F.url_decode(F.regexp_extract("file", pattern, 1))
    df = df.where("_corrupt_record is null and ligand_chain is not null").withColumns({
        "receptor": F.coalesce("receptor", place(r"([^/]+)/[^/]+$")), "complex": F.coalesce("complex", place(r"([^/]+?)(?:\.[^./]*)?$"))})
    return df.drop("_corrupt_record", "file").fillna(False, ["is_native"])
