"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

1. Packs of documents send their different bigrams with training counts to buckets, dealt by the first word (words that make up a large
   share of all words: by both words).
2. Buckets merge them into one sorted hash array with counts, answer each pack's bigrams, and send on what words need: how many different
   words they follow, how often they are followed, and by how many different words once, twice and more often.
3. Buckets of words add this up and answer each pack's words.
4. Each pack stores its answers as sorted hash arrays in a memory-mapped file and scores its documents by looking words and bigrams up.

Nothing is collected or broadcast but the hashes of at most ``1 / HOT_SHARE`` frequent words; sums over the whole corpus reach a pack as
one small block in the answer of every bucket. All bigrams are kept, however rare. The texts are shuffled once.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assayloom.llm.common import NO_ID, Words, fold, long_values, mix, release, runs, short_bytes, slices, utf8
from assayloom.llm.packs import buckets_of, by_id, in_packs, split_by, text_bytes

PACK_BYTES = 8 << 20
BUCKET_BYTES = 40 << 20
SLICE_BYTES = 1 << 21
HOT_SHARE = 1 / 500
WIDTH = 6                   # bytes of a word's hash beside its bucket
BEGIN, END = np.uint64(1), np.uint64(2)
_LOW = np.uint64(8 * (8 - WIDTH))

_ASK_COLUMNS = ("lefts", "follows", "rights", "counts")
_ASK = "_to int, _pack int, " + ", ".join(f"{c} binary" for c in _ASK_COLUMNS)
_ASK_SCHEMA = pa.schema([("_to", pa.int32()), ("_pack", pa.int32()), *[(c, pa.binary()) for c in _ASK_COLUMNS]])
_TELL = "_pack int, _from int, _kind int, numbers binary, totals binary"
_TELL_SCHEMA = pa.schema([("_pack", pa.int32()), ("_from", pa.int32()), ("_kind", pa.int32()), ("numbers", pa.binary()), ("totals", pa.binary())])
_PART = "_to int, words binary, numbers binary"
_PART_SCHEMA = pa.schema([("_to", pa.int32()), ("words", pa.binary()), ("numbers", pa.binary())])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _squeeze(values: np.ndarray) -> bytes:
    """Counts, most of them small, column by column and byte by byte."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _stretch(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _hash(w: np.ndarray) -> np.ndarray:
    """Word hashes keep clear of the two marks and of the bits that are cut off."""
    return np.where(w >> _LOW > 2, w, w | (np.uint64(1) << np.uint64(63)))


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word >> _LOW) % np.uint64(buckets)).astype(np.int64) if len(word) else np.zeros(0, np.int64)


class Tokens:
    """Bigrams of a pack: text, first and second word of every token, the end of the text being one."""

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        hashes, docs = [], []
        lo, n = 0, len(limits) - 1
        while lo < n:       # whole texts, a few megabytes at a time
            hi = max(lo + 1, int(np.searchsorted(limits, limits[lo] + SLICE_BYTES, side="right")) - 1)
            words = Words(data[limits[lo]:limits[hi]], limits[lo:hi + 1] - limits[lo])
            hashes.append(_hash(words.hash) >> _LOW << _LOW)
            docs.append(words.doc + lo)
            lo = hi
        word = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        doc = np.concatenate([*docs, np.zeros(0, np.int64)])
        count = np.bincount(doc, minlength=n)
        self.n_tokens = count + 1
        stop = np.cumsum(self.n_tokens)
        self.doc = np.repeat(np.arange(n), self.n_tokens)
        self.right = np.full(len(self.doc), END << _LOW, np.uint64)
        inner = np.ones(len(self.doc), bool)
        inner[stop - 1] = False
        self.right[inner] = word
        self.left = np.empty_like(self.right)
        self.left[1:] = self.right[:-1]
        self.left[stop - self.n_tokens] = BEGIN << _LOW


class Bigrams:
    """Different bigrams of a pack, sorted by bucket, first and second word, with their training counts."""

    def __init__(self, tokens: Tokens, trained: np.ndarray, buckets: int, hot: np.ndarray):
        self.buckets = buckets
        order = np.lexsort((tokens.right, tokens.left))
        left, right = tokens.left[order], tokens.right[order]
        new = np.ones(len(order), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        at = np.flatnonzero(new)
        self.left, self.right = left[at], right[at]
        self.count = np.add.reduceat(trained[tokens.doc[order]].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        self.of_token = np.empty(len(order), np.int64)
        self.of_token[order] = np.cumsum(new) - 1
        by_word = _bucket(self.left, buckets)
        frequent = np.isin(self.left, hot)
        by_word[frequent] = _bucket(mix(self.left[frequent] * np.uint64(3) + self.right[frequent]), buckets)
        self.order, self.at = split_by(by_word, buckets)
        # different words and the frequent ones, by their own bucket
        self.word = np.unique(np.concatenate([self.left, self.right, hot]))
        self.word_order, self.word_at = split_by(_bucket(self.word, buckets), buckets)


def _bigrams_of(table: pa.Table, buckets: int, hot: np.ndarray) -> tuple[pa.Table, Tokens, Bigrams]:
    table = by_id(table)
    tokens = Tokens(*utf8(table["_text"]))
    return table, tokens, Bigrams(tokens, table["c0"].to_numpy(), buckets, hot)


def _ask(table: pa.Table, buckets: int, hot: np.ndarray) -> pa.Table:
    """One row per bucket, also where nothing is asked, as every bucket's totals are wanted."""
    pack = table["_pack"][0].as_py()
    _, _, b = _bigrams_of(table, buckets, hot)
    rows = []
    for k in range(buckets):
        e = b.order[b.at[k]:b.at[k + 1]]
        first = runs(b.left[e])
        rows.append((k, pack, short_bytes(b.left[e][first] >> _LOW, WIDTH), _squeeze(np.diff(np.append(first, len(e)))), short_bytes(b.right[e] >> _LOW, WIDTH), _squeeze(b.count[e])))
    return _table(_ASK_SCHEMA, rows)


class Counted:
    """A bucket's bigrams from all packs: sorted arrays of first word, second word and count."""

    def __init__(self, table: pa.Table):
        release()
        self.rows = [{c: table[c][k].as_py() for c in table.column_names} for k in range(table.num_rows)]
        lefts, rights, counts = [], [], []
        for r in self.rows:
            follows = _stretch(r["follows"])
            lefts.append(np.repeat(long_values(r["lefts"], WIDTH), follows))
            rights.append(long_values(r["rights"], WIDTH))
            counts.append(_stretch(r["counts"]))
        self.sizes = [len(x) for x in rights]
        left, right, count = np.concatenate(lefts), np.concatenate(rights), np.concatenate(counts)
        del lefts, rights, counts
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.ones(len(order), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        at = np.flatnonzero(new)
        self.left, self.right = left[at], right[at]
        self.count = np.add.reduceat(count[order], at) if len(at) else np.zeros(0, np.int64)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1


def _kinds(count: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and how many are above 0."""
    return np.array([*[(count == k).sum() for k in (1, 2, 3, 4)], (count > 0).sum()], np.int64)


def _answer_bigrams(table: pa.Table) -> pa.Table:
    c = Counted(table)
    totals = _squeeze(_kinds(c.count))
    all_counts, out, at = c.count[c.of], [], 0
    for r, size in zip(c.rows, c.sizes):
        out.append((r["_pack"], r["_to"], 0, _squeeze(all_counts[at:at + size]), totals))
        at += size
    return _table(_TELL_SCHEMA, out)


def _word_parts(table: pa.Table, buckets: int) -> pa.Table:
    """Numbers of words for the buckets of words: followed once, twice, more often, in all; words followed."""
    c = Counted(table)
    seen = c.count > 0
    left, right, count = c.left[seen], c.right[seen], c.count[seen]
    parts = []
    if len(left):
        at = runs(left)
        n = np.column_stack([np.add.reduceat((count == 1).astype(np.int64), at), np.add.reduceat((count == 2).astype(np.int64), at),
                             np.add.reduceat((count > 2).astype(np.int64), at), np.add.reduceat(count, at), np.zeros(len(at), np.int64)])
        word, followed = np.unique(right, return_counts=True)
        m = np.zeros((len(word), 5), np.int64)
        m[:, 4] = followed
        parts = [(left[at], n), (word, m)]
    rows = []
    for word, n in parts:
        order, cut_at = split_by(_bucket(word << _LOW, buckets), buckets)
        for b in range(buckets):
            k = order[cut_at[b]:cut_at[b + 1]]
            if len(k):
                rows.append((b, short_bytes(word[k], WIDTH), _squeeze(n[k].T.ravel())))
    return _table(_PART_SCHEMA, rows)


def _answer_words(asked: pa.Table, parts: pa.Table, buckets: int, hot: np.ndarray) -> pa.Table:
    """Five numbers per word; totals: kinds of the numbers of words followed, training tokens, different training words.

    A pack wants the words of this bucket that it asked bigrams of, which are all its words here but the frequent ones, and those.
    """
    word, number = np.zeros(0, np.uint64), np.zeros((0, 5), np.int64)
    if parts.num_rows:
        all_words = np.concatenate([long_values(x.as_py(), WIDTH) for x in parts["words"]])
        all_numbers = np.concatenate([_stretch(x.as_py()).reshape(5, -1).T for x in parts["numbers"]])
        order = np.argsort(all_words, kind="stable")
        at = runs(all_words[order])
        word, number = all_words[order][at], np.add.reduceat(all_numbers[order], at, axis=0)
    # the end of a text is followed by nothing; it is counted by how often a text begins
    is_word = word > np.uint64(2)
    tokens = number[is_word | (word == BEGIN), 3].sum()
    distinct = int((number[is_word, 3] > 0).sum()) + int(((word == BEGIN) & (number[:, 3] > 0)).sum())
    totals = _squeeze(np.append(_kinds(number[:, 4]), [tokens, distinct]))
    out = []
    own = asked["_to"][0].as_py() if asked.num_rows else 0
    always = (hot >> _LOW)[_bucket(hot, buckets) == own]
    for k in range(asked.num_rows):
        want = long_values(asked["lefts"][k].as_py(), WIDTH)
        want = np.unique(np.concatenate([want[~np.isin(want << _LOW, hot)], always]))
        place = np.searchsorted(word, want)
        found = place < len(word)
        found[found] = word[place[found]] == want[found]
        got = np.zeros((len(want), 5), np.int64)
        got[found] = number[place[found]]
        out.append((asked["_pack"][k].as_py(), own, 1, _squeeze(got.T.ravel()), totals))
    return _table(_TELL_SCHEMA, out)


class MappedTable:
    """Sorted hashes with columns of numbers in a memory-mapped file that goes with its last reader."""

    def __init__(self, hashes: np.ndarray, columns: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        handle, path = tempfile.mkstemp(prefix="table-")
        with os.fdopen(handle, "wb") as file:
            file.write(hashes[order].astype("<u8").tobytes())
            file.write(columns[order].astype("<i8").tobytes())
        n, width = columns.shape
        if n:
            self.hashes = np.memmap(path, "<u8", "r", 0, (n,))
            self.columns = np.memmap(path, "<i8", "r", 8 * n, (n, width))
        else:
            self.hashes, self.columns = np.zeros(0, np.uint64), np.zeros((0, width), np.int64)
        os.unlink(path)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the hashes; zeros where one is not there."""
        out = np.zeros((len(hashes), self.columns.shape[1]), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = self.hashes[at] == hashes
            out[found] = self.columns[at[found]]
        return out


def discounts(kinds: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and from 3 on, from the numbers of counts 1 to 4; fixed ones where a number is zero."""
    n1, n2, n3, n4 = (float(x) for x in kinds[:4])
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def probabilities(pair: np.ndarray, left: np.ndarray, right: np.ndarray, pair_kinds: np.ndarray, word_kinds: np.ndarray, words: int) -> np.ndarray:
    """Interpolated modified Kneser-Ney probabilities of tokens.

    ``pair``: counts of the bigrams; ``left``: for their first words, different followers once, twice, more often, and all; ``right``:
    different words before their second words. The lowest order falls back on one share for each known word and one for all others.
    """
    d, e = discounts(pair_kinds), discounts(word_kinds)
    types = float(pair_kinds[4])
    low = np.full(len(pair), 1.0 / (words + 1))
    if types:
        spare = (e[1] * word_kinds[0] + e[2] * word_kinds[1] + e[3] * (word_kinds[4] - word_kinds[0] - word_kinds[1])) / types
        low = np.maximum(right - e[np.minimum(right, 3)], 0) / types + spare * low
    total = left[:, 3].astype(float)
    spare = left[:, :3] @ d[1:]
    high = (np.maximum(pair - d[np.minimum(pair, 3)], 0) + spare * low) / np.maximum(total, 1)
    return np.where(total > 0, high, low)


_OUT = "_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, _train boolean"
_OUT_SCHEMA = pa.schema([("_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                         ("score", pa.float64()), ("_train", pa.bool_())])


def _score(left: pa.Table, right: pa.Table, buckets: int, hot: np.ndarray) -> pa.Table:
    if not left.num_rows:
        return _OUT_SCHEMA.empty_table()
    table, tokens, b = _bigrams_of(left, buckets, hot)
    pair = np.zeros((len(b.left), 1), np.int64)
    number = np.zeros((len(b.word), 5), np.int64)
    pair_kinds, word_kinds = np.zeros(5, np.int64), np.zeros(7, np.int64)
    for r in right.to_pylist():
        k, got = r["_from"], _stretch(r["numbers"])
        if r["_kind"] == 0:
            pair[b.order[b.at[k]:b.at[k + 1]], 0] = got
            pair_kinds += _stretch(r["totals"])
        else:
            number[b.word_order[b.word_at[k]:b.word_at[k + 1]]] = got.reshape(5, -1).T
            word_kinds += _stretch(r["totals"])
    pairs = MappedTable(mix(b.left * np.uint64(3) + mix(b.right)), pair)
    words = MappedTable(b.word, number)
    trained, distinct = int(word_kinds[5]), int(word_kinds[6])
    own = words.get(b.word)
    index = lambda w: np.searchsorted(b.word, w)
    right_at, left_at = index(b.right), index(b.left)
    p = probabilities(pairs.get(mix(b.left * np.uint64(3) + mix(b.right)))[:, 0], own[left_at], own[right_at, 4], pair_kinds, word_kinds, distinct)
    # how often a token stands in training: a word as often as it is followed, the end as often as a text begins
    begin = np.searchsorted(b.word, BEGIN << _LOW)
    own[b.word == END << _LOW, 3] = own[begin, 3] if len(b.word) else 0
    count = own[right_at, 3]
    base = np.log10((count + 1) / (trained + 1 * (distinct + 1)))
    n, doc, of = len(tokens.n_tokens), tokens.doc, b.of_token
    add = lambda v: np.bincount(doc, v[of], n)
    return pa.table([table["_id"], pa.array(tokens.n_tokens), pa.array(add(count > 0).astype(np.int64)), pa.array(np.full(n, trained, np.int64)),
                     pa.array(add(base)), pa.array(add(np.log10(p))), table["c0"]], schema=_OUT_SCHEMA)


def frequent_words(docs: DataFrame, share: float = HOT_SHARE) -> np.ndarray:
    """Hashes of the words that make up at least ``share`` of all words, so at most 1 / share of them, and the marks of begin and end.

    Only words with half that share in some slice of texts are counted up; the list steers the dealing, not the result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            word, count = np.unique(_hash(Words(*utf8(batch.column("text"))).hash) >> _LOW << _LOW, return_counts=True)
            keep = count >= share / 2 * count.sum()
            # a row of its own holds the number of all words
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[keep].view(np.int64), 0)), pa.array(np.append(count[keep], 0)),
                                              pa.array(np.append(np.zeros(keep.sum(), np.int64), count.sum()))], ["w", "n", "all"])
    rows = docs.select("text").mapInArrow(run, "w long, n long, all long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = rows.select("w", "n", F.sum("all").over(whole).alias("all"))        # one row per word that is frequent somewhere
    found = [r[0] for r in total.where((F.col("n") >= share * F.col("all")) & (F.col("n") > 0)).select("w").collect()]
    return np.concatenate([np.array(found, np.int64).view(np.uint64), [BEGIN << _LOW, END << _LOW]])


def score_documents(docs: DataFrame, parts: int = 7, held: int = 2, pack_bytes: int = PACK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity per token.

    Learned from the rows outside the held-out fold; a text that repeats counts as often as it stands there. Null text is empty, its only
    token is the end. If nothing is learned, every token has probability 1. An empty table gives an empty result.
    """
    size = text_bytes(docs)
    buckets = buckets_of(size, bucket_bytes)
    hot = frequent_words(docs)
    trained = docs.select("doc_id", "text", (fold("doc_id", parts) != held).alias("trained"))
    texts = in_packs(trained, size, pack_bytes, ["trained"])
    asked = texts.groupBy("_pack").applyInArrow(lambda t: _ask(t, buckets, hot), _ASK)
    counts = asked.groupBy("_to").applyInArrow(_answer_bigrams, _TELL)
    word_parts = asked.groupBy("_to").applyInArrow(lambda t: _word_parts(t, buckets), _PART)
    words = asked.groupBy("_to").cogroup(word_parts.groupBy("_to")).applyInArrow(lambda a, b: _answer_words(a, b, buckets, hot), _TELL)
    answers = counts.unionByName(words)
    out = texts.groupBy("_pack").cogroup(answers.groupBy("_pack")).applyInArrow(lambda a, b: _score(a, b, buckets, hot), _OUT)
    return out.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
