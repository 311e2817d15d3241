"""Text files as ordered lines, without ever holding a whole file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.functions.text import once
from assayloom.ordered import given_blocks, numbered, running, without_blocks

ORDER = ["part", "block", "pos"]
BLOCK_LINES = 1 << 13
# where Windows-1252 differs from Latin-1: the code points that Latin-1 gives, and the characters meant
_OTHER = [b for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore")]
WINDOWS = "".join(map(chr, _OTHER)), bytes(_OTHER).decode("cp1252")


def file_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)


def decoded(value: Column) -> Column:
    """A line's text: UTF-8; UTF-16 where it holds zero bytes; else Windows-1252.

    The line reader cuts at the newline byte, so a UTF-16 line carries half of a neighbouring newline at one end: little-endian lines
    begin with a zero byte, big-endian lines (told by their mark on the first line) end with one.
    """
    raw = value.cast("binary")
    text = F.hex(raw)
    big = text.startswith("FEFF")
    body = F.when(text.startswith("FFFE") | big, F.substr(text, F.lit(5))).when(text.startswith("00") & (F.length(text) % 4 == 2), F.substr(text, F.lit(3))).otherwise(text)
    even = F.left(body, F.length(body) - F.length(body) % 4)
    wide = F.when(big, F.decode(F.unhex(even), "UTF-16BE")).otherwise(F.decode(F.unhex(even), "UTF-16LE"))
    return F.when(value.contains("\0"), F.rtrim(wide, F.lit("\0"))).when(F.is_valid_utf8(value), value).otherwise(
        F.translate(F.decode(raw, "iso-8859-1"), *WINDOWS))


def line_order(df: DataFrame) -> DataFrame:
    """Add the place of each row: number of a part file, start of the file split, and running number inside the split.

    A split is read front to back by one task, so the running number orders its rows; the split starts order the splits.
    """
    part = F.coalesce(F.regexp_extract(file_name(), r"^part-(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    return df.select("*", part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))


def read_lines(spark: SparkSession, path: str | list[str], folder: str | None = None, glob: str | None = None, full_path: bool = False) -> DataFrame:
    """Lines as (document, part, block, pos, line).

    A document is a file, named by its file name or its full path; with ``folder`` it is a partition folder ``folder=value`` whose
    part files follow one another. Lines end with LF or CRLF.
    """
    reader = spark.read.option("recursiveFileLookup", folder is None)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = line_order(reader.text(path, lineSep="\n"))
    stem = F.col("_metadata.file_path") if full_path else F.regexp_replace(file_name(), r"(?<=.)\.[^.]*$", "")
    document = F.col(folder).cast("string") if folder else stem
    return df.select(document.alias("document"), *ORDER, _text_of(F.col("value")).alias("line"))


def _text_of(value: Column) -> Column:
    """The decoded line without byte order mark and carriage return.

    Almost every line is itself; the long way stays out of generated code, which filters repeat until it is too large to be compiled.
    """
    edge = value.startswith("\ufeff") | F.right(value, F.lit(1)).isin("\r", "\x85", "\u2028", "\u2029")
    plain = ~value.contains("\0") & F.is_valid_utf8(value) & ~edge
    return F.when(plain, value).otherwise(once(value, lambda v: F.regexp_replace(decoded(v), "^\ufeff|\r$", "")))


_BLOCK = [*ORDER[:2], f"pos div {BLOCK_LINES}"]


def along_lines(lines: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, str]], reverse: bool = False) -> DataFrame:
    """Running values along the lines of each key; a few thousand neighbouring lines of a split are a block, so a split is dealt over many tasks."""
    return without_blocks(running(given_blocks(lines, _BLOCK), keys, ORDER, specs, reverse))


def numbered_lines(lines: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Running number of the lines of each key."""
    return without_blocks(numbered(given_blocks(lines, _BLOCK), keys, ORDER, out))


def with_section(lines: DataFrame) -> DataFrame:
    """Number the ``[Name]`` sections of each document; the heading lines themselves are dropped."""
    heading = F.trim("line").rlike(r"^\[.+\][\s,;|\t]*$")
    marked = lines.withColumns({"_head": heading.cast("long"), "_name": F.when(heading, F.regexp_extract(F.trim("line"), r"^\[(.+)\]", 1))})
    out = along_lines(marked, ["document"], {"section": ("sum", "_head"), "section_name": ("fill", "_name")})
    return out.where("_head = 0").drop("_head", "_name").withColumn("section_name", F.trim(F.coalesce("section_name", F.lit(""))))
