"""Repeat removal against plain sets of windows."""

import hashlib
import random

import numpy as np
import pytest

from assayloom.llm import suffixes
from assayloom.llm.suffixes import equal_windows, remove_repeats, suffix_order


def brute(rows, window=50):
    """(id, n_bytes, n_removed, n_spans, sha256) per row."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        i = i if i is not None else 1 << 63
        for k in range(len(b) - window + 1):
            w = b[k:k + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k:k + window]] < (i if i is not None else 1 << 63):
                gone[k:k + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def corpus(seed, docs=60, alphabet="ab é\n"):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    rows = []
    for i in range(docs):
        t = text(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) - 1)
            k = rnd.randint(0, len(t))
            t = t[:k] + s[a:a + rnd.randint(20, 200)] + t[k:]
        if rnd.random() < 0.2 and rows:
            t = rnd.choice(rows)[1] or ""
            if rnd.random() < 0.5:
                k = rnd.randint(0, len(t))
                t = t[:k] + "X" + t[k:]
        rows.append((rnd.randint(0, 2 * docs), t))
    return rows


def test_suffix_order_is_the_suffix_array():
    rnd = random.Random(1)
    for n in [*range(0, 12), 50, 301]:
        s = np.array([rnd.randint(1, 3) for _ in range(n)], np.int64)
        assert suffix_order(s, 20).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_equal_windows():
    rnd = random.Random(2)
    text = np.frombuffer(("ab" * 40 + "".join(rnd.choice("ab") for _ in range(300)) * 3).encode(), np.uint8)
    starts = np.arange(0, len(text) - 50 + 1)
    order, new = equal_windows(text, starts, 50)
    groups = np.split(order, new[1:])
    want = {}
    for i in starts:
        want.setdefault(text[i:i + 50].tobytes(), []).append(int(i))
    assert sorted(sorted(g.tolist()) for g in groups) == sorted(want.values())


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"pack_bytes": 700, "bucket_bytes": 3000}), (3, {"pack_bytes": 2000, "bucket_bytes": 900})])
def test_against_brute_force(spark, seed, more):
    rows = corpus(seed)
    assert run(spark, rows, **more) == brute(rows)


def test_common_samples(spark, monkeypatch):
    """A passage in every document, with ends that differ: dealt by windows, in one pack or many."""
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = noise(120)
    rows = [(i, noise(rnd.randint(0, 80)) + passage[rnd.randint(0, 30):rnd.randint(70, 120)] + noise(rnd.randint(0, 80))) for i in range(150)]
    for more in ({}, {"pack_bytes": 6000, "bucket_bytes": 4000}):
        assert run(spark, rows, **more) == brute(rows)


def test_edges(spark):
    long = "word " * 30_000
    rows = [(1, None), (2, ""), (None, "x" * 60), (3, "x" * 60), (3, "x" * 60), (4, "y" * 49), (5, "y" * 50), (6, "y" * 50), (7, long), (8, long[:-3]), (9, "é" * 40), (10, "aé" + "é" * 39)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_kept_text_and_other_columns(spark):
    rows = [(1, "é" * 40 + "tail", "a"), (2, "b" + "é" * 40 + "end", "b"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _pack string")
    got = {r.doc_id: r for r in remove_repeats(df, ["_pack"]).collect()}
    assert got[1].kept_text == rows[0][1] and got[2].kept_text == "bend" and got[3].kept_text is None
    assert [tuple(s) for s in got[2].spans] == [(1, 81)] and got[2].keep__pack == "b"
