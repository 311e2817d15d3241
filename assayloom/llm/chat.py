"""Chat formatting in Spark expressions only.

A conversation is written as ``<s>``, its turns, ``</s>``. Every turn is a new line, a mark, a new line and the text. The mark names the
role; a turn that follows one of the same role has the mark ``[NEXT]`` and so belongs to the same block. Marks inside texts get one
more backslash in front, which reading takes away again; marks of the template always follow a new line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

MARKS = {"user": "[INST]", "assistant": "[/INST]", "system": "<<SYS>>"}
NEXT, OTHER, NONE = "[NEXT]", "[ROLE]", "[NULL]"
START, END = "<s>", "</s>"
TURN_MARKS = [*MARKS.values(), NEXT, OTHER, NONE]
CONTROL = "|".join(re.escape(x) for x in (START, END, *TURN_MARKS))
_SPLIT = "\n(?=" + "|".join(re.escape(x) for x in TURN_MARKS) + ")"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*(?:{CONTROL}))", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*(?:{CONTROL}))", "$1")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _mark(role: Column) -> Column:
    out = F.concat(F.lit(OTHER), _role_out(role))
    for name, mark in MARKS.items():
        out = F.when(role == name, mark).otherwise(out)
    return F.when(role.isNull(), NONE).otherwise(out)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, ``formatted``, and ``pieces``: its parts in order, each with ``loss`` true or false.

    Rows are ordered by turn, null first, then role and text. Null text is empty; a null role has a mark of its own; a null conv_id is
    one conversation. Repeated rows are repeated turns. An empty table gives an empty result.
    """
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn"), F.col("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")))).alias("_t"))
    same = lambda t, i: (i > 0) & F.get(F.col("_t"), i - 1)["role"].eqNullSafe(t["role"])
    # blocks of adjacent turns of one role: where they begin, then the turns between two beginnings
    begins = F.filter(F.transform(F.col("_t"), lambda t, i: F.when(~same(t, i), i)), lambda i: i.isNotNull())
    ordered = ordered.withColumn("_b", F.concat(begins, F.array(F.size("_t"))))
    spans = F.zip_with(F.slice("_b", F.lit(1), F.size("_b") - 1), F.slice("_b", F.lit(2), F.size("_b") - 1), lambda a, b: F.slice(F.col("_t"), a + 1, b - a))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    blocks = F.transform(spans, lambda block: F.flatten(F.transform(block, lambda t, i: F.array(
        piece(F.concat(F.lit("\n"), F.when(i == 0, _mark(t["role"])).otherwise(NEXT), F.lit("\n")), no),
        piece(escape(t["text"]), F.coalesce(t["role"] == loss_role, no))))))
    pieces = F.concat(F.array(piece(F.lit(START), no)), F.flatten(blocks), F.array(piece(F.lit("\n" + END), no)))
    return ordered.select("conv_id", pieces.alias("pieces")).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    body = F.substr(formatted, F.lit(len(START) + 1), F.length(formatted) - len(START) - len(END) - 1)
    # the part before the first turn is empty
    parts = F.slice(F.split(body, _SPLIT), 2, 1 << 30)
    split = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("mark"), p.alias("all")))
    text = lambda x: unescape(F.substr(x["all"], F.length(x["mark"]) + 2))
    role = F.when(F.lit(False), F.lit(None).cast("string"))

    def named(mark: Column) -> Column:
        out = role
        for name, m in MARKS.items():
            out = out.when(mark == m, name)
        return out.when(mark.startswith(OTHER), _role_in(F.substr(mark, F.lit(len(OTHER) + 1))))

    def in_blocks(turns: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, 1 << 30), F.array(F.size(turns)))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: _let(named(F.get(turns, a)["mark"]), lambda r: F.transform(
            F.slice(turns, a + 1, b - a), lambda x: F.struct(r.alias("role"), text(x).alias("text"))))))

    begins = lambda turns: F.filter(F.transform(turns, lambda x, i: F.when(x["mark"] != NEXT, i)), lambda i: i.isNotNull())
    return _let(split, lambda turns: _let(begins(turns), lambda starts: in_blocks(turns, starts)))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
