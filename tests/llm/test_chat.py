"""Chat formatting: exact round trip and SQL twin on hard texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assayloom.llm import chat

HARD = ["", "\n", "\\", "\\\\", "</s>", "\\</s>", "\n</s>", "a\n[INST]\nb", "[/INST] [NEXT][ROLE]<s><<SYS>>", "x\\\n", "[NULL]", "\n\n[NEXT]\n", "$1 \\1", "é😀\r\n", "[INST", "\\\\[INST]\\"]
SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows):
    done = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("pieces")).alias("loss"), "pieces").collect()
    return {r.conv_id: r for r in got}


def test_round_trip(spark):
    roles = ["user", "assistant", "system", None, "tool\n\\n\\", "", "[INST]", "assistant"]
    rows = []
    for c in range(40):
        for t in range(c):
            rows.append((c, t, roles[(c * 7 + t * t // 3) % len(roles)], HARD[(c * 5 + t * 3) % len(HARD)]))
    got = back(spark, rows)
    for c in range(1, 40):
        want = [(r, x) for i, _, r, x in rows if i == c]
        assert [(t.role, t.text) for t in got[c].t] == want
        assert got[c].loss == "".join(x for r, x in want if r == "assistant")
        assert "".join(p.text for p in got[c].pieces) == got[c].formatted
        assert got[c].formatted.startswith("<s>\n") and got[c].formatted.endswith("\n</s>")


def test_edges(spark):
    got = back(spark, [(None, 2, "user", "b"), (None, None, "user", None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (2, 5, "user", "w " * 100_000)])
    assert [(t.role, t.text) for t in got[None].t] == [("user", ""), ("user", "b")]
    assert got[1].loss == "xx" and got[1].formatted == "<s>\n[/INST]\nx\n[NEXT]\nx\n</s>"
    assert got[2].t[0].text == "w " * 100_000 and got[2].loss == ""
    assert back(spark, []) == {}


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "z", 3)], SCHEMA + ", formatted string, _t long")
    assert chat.format_conversations(df).columns == ["conv_id", "formatted", "pieces"]


def test_long_conversation_is_linear(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"turn {t} " + "x" * 50) for t in range(6000)]
    got = back(spark, rows)[1]
    assert len(got.t) == 6000
    text = lambda ts: hashlib.sha256("".join(f"{a}{b}" for a, b in ts).encode()).hexdigest()
    assert text([(t.role, t.text) for t in got.t]) == text([(r, x) for _, _, r, x in rows])


@pytest.mark.parametrize("text", HARD)
def test_escape(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"))
    assert df.select(chat.unescape(F.col("e"))).first()[0] == text
