"""Collocations against plain counting: lengths, cuts, covered phrases, edges; few bits and many shards change nothing."""

import random
import re
from collections import Counter

import pytest

from assayloom.llm import collocations as op

SCHEMA = "doc_id long, text string, lang string, rank int, h long"       # extra columns with clashing names


def plain(rows, least, longest, best, covered=100):
    count, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i:i + k])] += 1
    wanted = {p: a for p, a in count.items() if a >= least and len(p[1]) > 1}
    gone = set()
    for (lang, w), a in wanted.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= covered * count[lang, w[i:i + k]]:
                    gone.add((lang, w[i:i + k]))
    out = []
    for (lang, w), a in wanted.items():
        if (lang, w) not in gone:
            score, cut = min((1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, count[lang, w[:cut]], count[lang, w[cut:]], total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        rows = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], k + 1, *r[1:]) for k, r in enumerate(rows[:best])]
    return sorted(ranked)


def texts(n=240, seed=3):
    rng = random.Random(seed)
    words = ["The", "of", "ähre", "new", "york", "x y", "a", "b", "c", "d'e", " "] + [f"w{k}" for k in range(30)]
    out = []
    for k in range(n):
        t = []
        for _ in range(rng.randrange(0, 60)):
            t.append(rng.choice(words))
            if rng.random() < .1:
                t.append(rng.choice(["New York City hall tower", "of the of the of", "a a a a a a a"]))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\v"]) for w in t)
        out.append((rng.choice([k, 7, None]), text, rng.choice(["en", "en", "de", None, "und"]), k, k))
    return out + [(1, None, "en", 1, 1), (2, "", "de", 1, 1), (3, ",.;", None, 1, 1), (4, "solo", "xx", 1, 1), (5, "New York City hall tower " * 3000, "en", 1, 1)] + out[:20]


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(tuple(r) for r in op.collocations(df, **more).collect())


@pytest.mark.parametrize("more", [{}, {"shards": 7, "bucket_bytes": 30_000}, {"filter_bits": 64}, {"shards": 1, "covered": 60}])
def test_against_plain_counting(spark, monkeypatch, more):
    monkeypatch.setattr(op, "PACK_BYTES", 4_000)
    monkeypatch.setattr(op, "SLICE_BYTES", 1_500)
    monkeypatch.setattr(op, "HELD", 5_000)
    rows = texts()
    want = plain(rows, 12, 5, 25, more.get("covered", 100))
    assert len(want) >= 15 and {r[0] for r in want} >= {"en", "de", "und"}
    assert got(spark, rows, least=12, best=25, **more) == want


def test_score_ties_and_all_phrases(spark):
    rows = [(k, "b a. b a; d c", "en", 0, 0) for k in range(4)]
    want = plain(rows, 3, 3, 100)
    assert got(spark, rows, least=3, longest=3, best=None) == want
    assert [r[2] for r in sorted(want, key=lambda r: r[1])] == ["d c", "b a"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "one two", "en", 1, 1)] * 3])
def test_nothing_to_find(spark, rows):
    df = op.collocations(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and df.collect() == []


def test_products_beyond_64_bits(spark):
    """The score is a quotient of whole numbers of 38 digits."""
    row = spark.sql("select 3000000001 as a, 9000000000001 as n, 3000000007 as l, 3000000011 as r")
    score = "cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    assert row.selectExpr(score).first()[0] == 1000 * 3000000001 * 9000000000001 // (3000000007 * 3000000011)


def test_each_phrase_is_counted_over_one_cycle(spark, monkeypatch):
    """Later scans count longer phrases only, and the scan ends by itself."""
    steps = []
    scan = op._scan
    monkeypatch.setattr(op, "_scan", lambda shard, step, *rest: steps.append(step) or scan(shard, step, *rest))
    rows = texts()
    got(spark, rows, least=12, shards=3)
    assert steps == list(range(len(steps))) and 3 < len(steps) <= 3 * 5
