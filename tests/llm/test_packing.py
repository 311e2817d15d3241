"""Packing: token ids, cuts, tightness and places."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayloom.llm.packing import RANKS, TOKENIZER, Bins, best_fit, cut_points, pack, tokens_of


def plain_best_fit(lengths, capacity):
    room, out = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
        out.append(sorted(room))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_takes_the_tightest(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 64, 100])
    lengths = [rnd.randint(1, capacity) for _ in range(300)]
    bins, left = Bins(capacity), []
    for n, want in zip(lengths, plain_best_fit(lengths, capacity)):
        number, offset = bins.put(n)
        if number == len(left):
            left.append(capacity)
        assert offset == capacity - left[number]
        left[number] -= n
        assert sorted(left) == want


def test_best_fit_decreasing_places():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 5000)
    number, offset = best_fit(lengths, 2048)
    by = defaultdict(list)
    for k, (b, o) in enumerate(zip(number, offset)):
        by[b].append((int(o), int(lengths[k])))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.02 * lengths.sum() / 2048 + 1


def test_cut_points():
    assert cut_points(5, 10) == [0] and cut_points(10, 10) == [0] and cut_points(11, 10) == [0, 1] and cut_points(30, 10) == [0, 10, 20] and cut_points(35, 10) == [0, 5, 15, 25]


def test_both_encoders_agree():
    whole = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    tokens = tokens_of(TOKENIZER, RANKS)
    rnd = random.Random(2)
    latin = [chr(c) for c in range(0x20, 0x250)] + list("\t\n\r\x0b\x0c\x85\xa0 ‐—’…")
    odd = ["", " ", "\n\n  \n", "it's we'll I'M", "<|endoftext|>", "a<|endoftext|>b", "日本語 テスト", "Привет, мир", "😀👍🏽", "١٢٣", "a​b", "é", "\x00\x1c\x1f", "x" * 5000, "1234567890" * 20]
    texts = odd + ["".join(rnd.choice(latin) for _ in range(rnd.randint(1, 60))) for _ in range(500)] + ["".join(chr(rnd.choice([rnd.randint(32, 0x24F), rnd.randint(0x250, 0xD7FF), rnd.randint(0x1F300, 0x1FAFF)])) for _ in range(20)) for _ in range(100)]
    for t in texts:
        assert tokens.ids(t) == whole.encode(t, add_special_tokens=False).ids


def test_edges(spark):
    schema = "doc_id long, text string, sequence_id string, length int"
    rows = [(1, None, "x", 1), (2, "", None, None), (None, "a b", "y", 2), (3, "w " * 3000, "z", 3), (3, "w " * 3000, "z", 3)]
    got = pack(spark.createDataFrame(rows, schema), with_ids=True).collect()
    assert sorted(r.doc_id for r in got if r.doc_id in (1, 2)) == [1, 2] and [r.length for r in got if r.doc_id is None] == [3]
    assert [r.ids for r in got if r.doc_id == 1] == [[0]]
    assert sum(r.length for r in got if r.doc_id == 3) == 2 * len(tokens_of(TOKENIZER, RANKS).ids("w " * 3000) + [0])
    assert pack(spark.createDataFrame([], schema)).collect() == []


def test_groups(spark):
    df = spark.range(400).selectExpr("id as doc_id", "repeat('word ', cast(id % 97 as int) * 7) as text")
    got = pack(df, group_pieces=50).collect()
    by = defaultdict(int)
    for r in got:
        by[r.sequence_id] += r.length
    assert len(got) == 400 and max(by.values()) <= 2048 and len(by) <= sum(by.values()) / 2048 + 16
