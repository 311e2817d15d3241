"""The bigram model against plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from assayloom.llm.ngram import discounts, score_documents


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def held(doc_id, parts=7, fold=2):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == fold


def brute(rows):
    """(id, held_out, n_tokens, n_known, train_tokens, base, score) per row."""
    grams, unigrams = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = ["\0begin", *words(t), "\0end"]
            grams.update(zip(w, w[1:]))
            unigrams.update(w[1:])
    before, after = Counter(), defaultdict(list)
    for (u, w), c in grams.items():
        before[w] += 1
        after[u].append(c)
    kinds = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)] + [len(values)]
    d, e = discounts(kinds(list(grams.values()))), discounts(kinds(list(before.values())))
    n, v = sum(unigrams.values()), len(unigrams)
    spare_low = sum(e[min(c, 3)] for c in before.values()) / len(grams) if grams else 1.0

    def low(w):
        c = before[w]
        return (max(c - e[min(c, 3)], 0) / len(grams) if grams else 0) + spare_low / (v + 1)

    def p(u, w):
        if not after[u]:
            return low(w)
        c = grams[u, w]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in after[u]) * low(w)) / sum(after[u])
    out = []
    for i, t in rows:
        w = ["\0begin", *words(t), "\0end"]
        out.append((i, held(i), len(w) - 1, sum(unigrams[x] > 0 for x in w[1:]), n, sum(math.log10((unigrams[x] + 1) / (n + 1 * (v + 1))) for x in w[1:]),
                    sum(math.log10(p(a, b)) for a, b in zip(w, w[1:]))))
    return out


def compare(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:7] for r in score_documents(df, **more).collect()]
    key = lambda r: tuple(str(x) for x in r[:5]) + (round(r[5], 6),)
    got, want = sorted(got, key=key), sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("more", [{}, {"pack_bytes": 20_000, "bucket_bytes": 50_000}])
def test_documents(spark, sf, more):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    compare(spark, rows, **more)


def test_edges(spark):
    compare(spark, [(1, None), (2, ""), (None, "A b a"), (3, "a b"), (3, "a b"), (4, "a " * 50_000), (5, "\x0b x\x85y  "), (12, "Ä a"), (30, "b a")], pack_bytes=1000, bucket_bytes=1000)
    compare(spark, [])
    only_held = next(i for i in range(100) if held(i))
    compare(spark, [(only_held, "a b")])


def test_probabilities_sum_to_one():
    rows = [(1, "a b a c a b"), (3, "b a"), (4, "c c a b d")]
    rows = [r for r in rows if not held(r[0])]
    vocabulary = sorted({w for _, t in rows for w in words(t)})
    # every continuation of "a", the end and one unknown word, scored as the last token of a held-out text
    free = [i for i in range(1000) if held(i)]
    texts = [(free[k], f"a {w}") for k, w in enumerate([*vocabulary, "zzz"])] + [(free[-1], "a")]
    scored = {i: s for i, *_, s in brute(rows + texts)}
    ends = {w: scored[free[k]] for k, w in enumerate([*vocabulary, "zzz"])}
    assert len(ends) == len(vocabulary) + 1 and all(math.isfinite(s) and s < 0 for s in scored.values())
