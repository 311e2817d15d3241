"""Removal of passages that repeat across documents, by a distributed difference-cover suffix sort.

A byte goes if a string of ``window`` bytes around it also starts in a document with a smaller id. For that, all suffixes have to be
sorted by their first ``window`` bytes. Sorting every suffix moves many times the corpus, so suffixes are settled in two steps:

1. Names. A sample position is taken where a short string has the smallest hash of a window, so equal windows have equal samples. All
   windows with the same sample form a stretch, about sixteen at a time. Stretches are named by their content. A stretch that a smaller
   document has too is settled for all its windows, and so is one whose sample occurs in no other stretch.
2. Order. The windows of the rest, at the ends of shared passages, are dealt by their sample and sorted by the difference cover modulo 3:
   triples at two thirds of the positions are sorted and named, the names are sorted by recursion until they span a window, the
   remaining suffixes are merged in, and neighbours are compared byte by byte. The smallest id among equal neighbours decides.

Samples with many different stretches in one pack (the ends of a very common passage) are dealt by the windows themselves, each sent
once per pack, so that no task gets more than a few rows of each pack for one string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayloom.llm.common import NO_ID, Rolling, long_values, release, runs, short_bytes, utf8
from assayloom.llm.packs import buckets_of, by_id, in_packs, split_by, text_bytes

WINDOW, GRAM = 50, 20
PACK_BYTES = 2 << 20
BUCKET_BYTES = 20 << 20
SORT_BYTES = 1 << 19        # bytes of one suffix sort, if one sample does not have more
COMMON = 16                 # different stretches of one sample in a pack from which on it is common
WIDTH = 6                   # bytes of a name
_MASK = np.uint64((1 << 8 * WIDTH) - 1)


# ---- suffix sort ------------------------------------------------------------------------------------------

def _dense(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows of non-negative numbers; equal rows have equal ranks."""
    key = columns[0]
    for c in columns[1:]:
        base = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + c
    return np.unique(key, return_inverse=True)[1] + 1


def suffix_order(s: np.ndarray, levels: int) -> np.ndarray:
    """Positions sorted by the suffixes of ``s`` (numbers from 1), right for prefixes of 3 ** (levels + 1) numbers at least."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    wide = np.concatenate([s, np.zeros(3, np.int64)])
    first, second, others = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([first, second])
    names = _dense(wide[sample], wide[sample + 1], wide[sample + 2])
    if levels and names.max() < len(sample):
        # names of the first class, a limit below all names, names of the second class
        line = np.concatenate([names[:len(first)] + 1, [1], names[len(first):] + 1])
        order = suffix_order(line, levels - 1)
        place = np.empty(len(line), np.int64)
        place[order] = np.arange(1, len(line) + 1)
        names = np.concatenate([place[:len(first)], place[len(first) + 1:]])
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sample = sample[np.argsort(names, kind="stable")]
    one = _pair_keys(wide, rank, others, first, 1)
    two = _pair_keys(wide, rank, others, second, 2)
    at = np.argsort(one[0], kind="stable")
    below = np.searchsorted(np.sort(one[1]), one[0][at]) + np.searchsorted(np.sort(two[1]), two[0][at])
    # suffixes that agree as far as the levels reach may be counted out of order among themselves
    below = np.maximum.accumulate(below)
    out = np.full(n, -1, np.int64)
    out[np.arange(len(others)) + below] = others[at]
    out[out < 0] = sample
    return out


def _pair_keys(wide, rank, left, right, reach):
    """Keys that compare suffixes of two classes: the next ``reach`` numbers, then the rank of what follows."""
    both = np.concatenate([left, right])
    key = _dense(*[wide[both + k] for k in range(reach)], rank[both + reach])
    return key[:len(left)], key[len(left):]


def equal_windows(text: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in suffix order, and where a new string of ``window`` bytes begins among them."""
    levels, reach = 0, 3
    while reach < window:
        levels, reach = levels + 1, reach * 3
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    order = number[suffix_order(text.astype(np.int64) + 1, levels)]
    order = order[order >= 0]
    view = np.lib.stride_tricks.sliding_window_view(text, window)
    new = np.ones(len(order), bool)
    for lo in range(1, len(order), 1 << 16):
        hi = min(lo + (1 << 16), len(order))
        part = view[starts[order[lo - 1:hi]]]
        new[lo:hi] = (part[1:] != part[:-1]).any(1)
    return order, np.flatnonzero(new)


# ---- stretches --------------------------------------------------------------------------------------------

class Stretches:
    """Stretches of a pack's texts: first and last window start, text, sample and content hash."""

    def __init__(self, data: np.ndarray, limits: np.ndarray, window: int, gram: int):
        self.data, self.limits, self.window = data, limits, window
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.doc = empty
        self.sample = self.content = np.zeros(0, np.uint64)
        if len(data) < window:
            return
        self.rolling = Rolling(data)
        grams = self.rolling.every(gram)
        bits = np.uint64(len(data).bit_length())
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)      # equal hashes: the first counts
        reach, span = window - gram + 1, 1
        while span * 2 <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < reach:
            low = np.minimum(low[:len(low) - (reach - span)], low[reach - span:])
        at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        step = np.zeros(len(data) + 1, np.int8)
        long = np.flatnonzero(np.diff(limits) >= window)
        np.add.at(step, limits[long], 1)
        np.add.at(step, limits[long + 1] - window + 1, -1)
        inside = np.cumsum(step[:len(at)], dtype=np.int8) > 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
        end = inside.copy()
        end[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
        self.first, self.last = np.flatnonzero(begin), np.flatnonzero(end)
        self.doc = np.searchsorted(limits, self.first, side="right") - 1
        self.sample = grams[at[self.first]]
        self.content = self.rolling.span(self.first, self.last + window)
        self._name()

    def _name(self) -> None:
        """Number equal stretches alike. ``entry``: the first of each; texts stand by id, so that is one of the smallest id."""
        order = np.lexsort((self.doc, self.content, self.sample))
        s, c = self.sample[order], self.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.entry = order[new]
        self.entry_sample = self.sample[self.entry]
        at = runs(self.entry_sample)
        kinds = np.diff(np.append(at, len(self.entry)))
        self.common = np.repeat(kinds >= COMMON, kinds)
        self.common_first = at[kinds >= COMMON]     # one entry of each common sample

    def __len__(self) -> int:
        return len(self.first)

    def asked(self) -> np.ndarray:
        """Entries sent out by name."""
        return np.flatnonzero(~self.common) if len(self) else np.zeros(0, np.int64)


def _pack_of(table: pa.Table, window: int, gram: int) -> tuple[pa.Table, Stretches, np.ndarray]:
    table = by_id(table)
    stretches = Stretches(*utf8(table["_text"]), window, gram)
    return table, stretches, table["_id"].to_numpy()


_ASK = "_to int, _pack int, names binary, contents binary, owners binary, ids binary, marks binary"
_TELL = "_pack int, _from int, _kind int, bits binary, more binary"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_ASK_SCHEMA = pa.schema([("_to", pa.int32()), ("_pack", pa.int32()), *[(c, pa.binary()) for c in ("names", "contents", "owners", "ids", "marks")]])
_TELL_SCHEMA = pa.schema([("_pack", pa.int32()), ("_from", pa.int32()), ("_kind", pa.int32()), ("bits", pa.binary()), ("more", pa.binary())])


def _ask_names(table: pa.Table, window: int, gram: int, buckets: int) -> pa.Table:
    """Names of a pack's different stretches, one row per bucket of samples."""
    pack = table["_pack"][0].as_py()
    _, st, ids = _pack_of(table, window, gram)
    if not len(st):
        return _ASK_SCHEMA.empty_table()
    asked = st.asked()
    to = (st.entry_sample % np.uint64(buckets)).astype(np.int64)
    order, at = split_by(to[asked], buckets)
    mark_order, mark_at = split_by(to[st.common_first], buckets)
    rows = []
    for b in range(buckets):
        e = asked[order[at[b]:at[b + 1]]]
        m = st.common_first[mark_order[mark_at[b]:mark_at[b + 1]]]
        if not len(e) and not len(m):
            continue
        run = st.entry[e]
        owner, owner_at = np.unique(st.doc[run], return_inverse=True)
        rows.append((b, pack, short_bytes(st.sample[run] >> np.uint64(16), WIDTH), short_bytes(st.content[run], WIDTH), owner_at.astype("<u4" if len(owner) > 65535 else "<u2").tobytes(),
                     ids[owner].astype("<i8").tobytes(), short_bytes(st.entry_sample[m] >> np.uint64(16), WIDTH)))
    return _rows(_ASK_SCHEMA, rows)


def _owners(row: dict) -> np.ndarray:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids[np.frombuffer(row["owners"], "<u4" if len(ids) > 65535 else "<u2")]


def _answer_names(table: pa.Table) -> pa.Table:
    """Per entry asked: whether a smaller document has the stretch; whether its windows have to be sorted; whether its sample is common."""
    release()
    rows = [{c: table[c][k].as_py() for c in table.column_names} for k in range(table.num_rows)]
    name = np.concatenate([long_values(r["names"], WIDTH) for r in rows])
    content = np.concatenate([long_values(r["contents"], WIDTH) for r in rows])
    owner = np.concatenate([_owners(r) for r in rows])
    marks = np.unique(np.concatenate([long_values(r["marks"], WIDTH) for r in rows]))
    order = np.lexsort((owner, content, name))
    n, c = name[order], content[order]
    new_name = np.ones(len(order), bool)
    new_name[1:] = n[1:] != n[:-1]
    new = new_name.copy()
    new[1:] |= c[1:] != c[:-1]
    number = np.cumsum(new) - 1
    smallest = owner[order][np.flatnonzero(new)]
    seen, several, common = (np.zeros(len(order), bool) for _ in range(3))
    seen[order] = owner[order] > smallest[number]
    kinds = np.add.reduceat(new, np.flatnonzero(new_name), dtype=np.int64) if len(order) else np.zeros(0, np.int64)
    several[order] = kinds[np.cumsum(new_name) - 1] > 1
    common = np.isin(name, marks)
    need = (several | common) & ~seen
    out, at = [], 0
    for r in rows:
        size = len(r["names"]) // WIDTH
        part = slice(at, at + size)
        out.append((r["_pack"], r["_to"], 0, np.packbits(seen[part]).tobytes(), np.packbits(np.concatenate([need[part], common[part]])).tobytes()))
        at += size
    return _rows(_TELL_SCHEMA, out)


def _states(st: Stretches, answers: list[dict], buckets: int) -> np.ndarray:
    """Per entry: 0 settled as new, 1 settled as seen, 2 sort its windows, 3 the same with a common sample."""
    state = np.where(st.common, 3, 0)
    asked = st.asked()
    order, at = split_by((st.entry_sample[asked] % np.uint64(buckets)).astype(np.int64), buckets)
    for r in answers:
        e = asked[order[at[r["_from"]]:at[r["_from"] + 1]]]
        seen = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(e)).astype(bool)
        need, common = np.unpackbits(np.frombuffer(r["more"], np.uint8), count=2 * len(e)).astype(bool).reshape(2, -1)
        state[e] = np.where(seen, 1, np.where(need, np.where(common, 3, 2), 0))
    return state


def _open(st: Stretches, state: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is left to sort: first and last window start, owner run and name of each part.

    Entries with a common sample become parts of one window, each different window once.
    """
    whole = st.entry[state == 2]
    runs3 = st.entry[state == 3]
    length = st.last[runs3] - st.first[runs3] + 1
    run = np.repeat(runs3, length)
    start = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + st.first[run]
    h = st.rolling.span(start, start + window)
    order = np.lexsort((st.doc[run], h))
    keep = order[runs(h[order])]
    return (np.concatenate([st.first[whole], start[keep]]), np.concatenate([st.last[whole], start[keep]]), np.concatenate([st.doc[whole], st.doc[run[keep]]]),
            np.concatenate([st.sample[whole], h[keep]]))


_REST = "_to int, _pack int, names binary, sizes binary, owners binary, bytes binary"
_REST_SCHEMA = pa.schema([("_to", pa.int32()), ("_pack", pa.int32()), *[(c, pa.binary()) for c in ("names", "sizes", "owners", "bytes")]])


def _ask_windows(left: pa.Table, right: pa.Table, window: int, gram: int, buckets: int, parts: int) -> pa.Table:
    """Parts left to sort, one row per bucket, and the states of the pack, which the buckets hand on to the last pass."""
    if not left.num_rows:
        return _REST_SCHEMA.empty_table()
    pack = left["_pack"][0].as_py()
    _, st, ids = _pack_of(left, window, gram)
    if not len(st):
        return _REST_SCHEMA.empty_table()
    state = _states(st, right.to_pylist(), buckets)
    first, last, doc, name = _open(st, state, window)
    order, at = split_by((name % np.uint64(parts)).astype(np.int64), parts)
    rows = [(pack % parts, pack, None, state.astype(np.uint8).tobytes(), None, None)]
    for b in range(parts):
        k = order[at[b]:at[b + 1]]
        if len(k):
            size = last[k] + window - first[k]
            where = np.repeat(first[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rows.append((b, pack, short_bytes(name[k] >> np.uint64(16), WIDTH), size.astype("<u2").tobytes(), ids[doc[k]].astype("<i8").tobytes(), st.data[where].tobytes()))
    return _rows(_REST_SCHEMA, rows)


def _answer_windows(table: pa.Table, window: int) -> pa.Table:
    """Per window asked: whether it stands in a document with a smaller id."""
    release()
    out = []
    rows = [{c: table[c][k].as_py() for c in table.column_names} for k in range(table.num_rows)]
    for r in rows:
        if r["names"] is None:
            out.append((r["_pack"], r["_to"], 1, r["sizes"], None))
    rows = [r for r in rows if r["names"] is not None]
    if not rows:
        return _rows(_TELL_SCHEMA, out)
    name = np.concatenate([long_values(r["names"], WIDTH) for r in rows])
    size = np.concatenate([np.frombuffer(r["sizes"], "<u2") for r in rows]).astype(np.int64)
    owner = np.concatenate([np.frombuffer(r["owners"], "<i8") for r in rows])
    text = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    begin = np.cumsum(size) - size
    count = size - window + 1
    answer_at = np.cumsum(count) - count
    answer = np.zeros(count.sum(), bool)
    order = np.argsort(name, kind="stable")
    # sorts of about SORT_BYTES, each of whole names
    change = runs(name[order])
    filled = np.cumsum(size[order])[np.append(change[1:], len(order)) - 1] if len(order) else np.zeros(0, np.int64)
    for lo, hi in _batches(change, filled, len(order)):
        k = order[lo:hi]
        where = np.repeat(begin[k] - (np.cumsum(size[k]) - size[k]), size[k]) + np.arange(size[k].sum())
        part = np.repeat(np.arange(len(k)), count[k])
        inner = np.arange(count[k].sum()) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
        starts = (np.cumsum(size[k]) - size[k])[part] + inner
        sorted_windows, new = equal_windows(text[where], starts, window)
        by = owner[k][part[sorted_windows]]
        smallest = np.repeat(np.minimum.reduceat(by, new), np.diff(np.append(new, len(by))))
        place = answer_at[k][part[sorted_windows]] + inner[sorted_windows]
        answer[place] = smallest < by
    at = 0
    for r in rows:
        n = int(count[at:at + len(r["sizes"]) // 2].sum())
        lo = int(answer_at[at]) if n else 0
        out.append((r["_pack"], r["_to"], 2, np.packbits(answer[lo:lo + n]).tobytes(), None))
        at += len(r["sizes"]) // 2
    return _rows(_TELL_SCHEMA, out)


def _batches(change: np.ndarray, filled: np.ndarray, total: int):
    """Ranges of whole names of about SORT_BYTES."""
    k = 0
    while k < len(change):
        base = filled[k - 1] if k else 0
        end = max(k + 1, int(np.searchsorted(filled, base + SORT_BYTES, side="right")))
        yield int(change[k]), int(change[end]) if end < len(change) else total
        k = end


def _covered(st: Stretches, answers: list[dict], window: int, parts: int) -> np.ndarray:
    """Which bytes of the pack go."""
    cover = np.zeros(len(st.data), bool)
    if not len(st):
        return cover
    state = np.frombuffer(next(r["bits"] for r in answers if r["_kind"] == 1), np.uint8)
    step = np.zeros(len(st.data) + 1, np.int32)
    # a copy in a later document of the pack, or in a smaller document elsewhere
    gone = (st.doc > st.doc[st.entry[st.number]]) & (_ids_differ(st))
    gone |= state[st.number] == 1
    np.add.at(step, st.first[gone], 1)
    np.add.at(step, st.last[gone] + window, -1)
    first, last, doc, name = _open(st, state, window)
    order, at = split_by((name % np.uint64(parts)).astype(np.int64), parts)
    count = last - first + 1
    flag_at = np.cumsum(count) - count
    flag = np.zeros(count.sum(), bool)
    for r in answers:
        if r["_kind"] == 2:
            k = order[at[r["_from"]]:at[r["_from"] + 1]]
            got = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(count[k].sum())).astype(bool)
            inner = np.arange(len(got)) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
            flag[np.repeat(flag_at[k], count[k]) + inner] = got
    # windows of the runs that share an open entry with its first document
    whole = int((state == 2).sum())
    number_of = np.full(len(st.entry), -1, np.int64)
    number_of[np.flatnonzero(state == 2)] = np.arange(whole)
    run = np.flatnonzero((state[st.number] == 2) & ~gone)
    windows, hit = _windows(st, run)
    part = number_of[st.number[windows[0]]]
    hit_flag = flag[flag_at[part] + (hit - st.first[windows[0]])] if len(hit) else np.zeros(0, bool)
    hit = hit[hit_flag]
    # single windows, by their hash; those of a later document than the one that asked are seen
    run = np.flatnonzero((state[st.number] == 3) & ~gone)
    windows, start = _windows(st, run)
    if len(start):
        h = st.rolling.span(start, start + window)
        by = np.argsort(name[whole:], kind="stable")
        k = whole + by[np.searchsorted(name[whole:], h, sorter=by)]
        seen = flag[flag_at[k]] | (st.ids[st.doc[windows[0]]] > st.ids[doc[k]])
        hit = np.concatenate([hit, start[seen]])
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    return np.cumsum(step[:-1]) > 0


def _ids_differ(st: Stretches) -> np.ndarray:
    """Whether a run's document has another id than the first document of its entry; rows may repeat an id."""
    return st.ids[st.doc] > st.ids[st.doc[st.entry[st.number]]]


def _windows(st: Stretches, run: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """All window starts of the given runs, with the run of each."""
    length = st.last[run] - st.first[run] + 1
    owner = np.repeat(run, length)
    return [owner], np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + st.first[owner]


def _result(left: pa.Table, right: pa.Table, window: int, gram: int, parts: int, schema: pa.Schema) -> pa.Table:
    if not left.num_rows:
        return schema.empty_table()
    table, st, ids = _pack_of(left, window, gram)
    st.ids = ids
    gone = _covered(st, right.to_pylist(), window, parts)
    limits = st.limits
    total = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
    removed = total[limits[1:]] - total[limits[:-1]]
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1
    edge[limits[:-1][np.diff(limits) > 0]] = gone[limits[:-1][np.diff(limits) > 0]]       # a document's first byte begins a run of its own
    begins = np.flatnonzero(edge)
    spans = np.searchsorted(begins, limits)
    close = gone.copy()
    if len(close):
        close[:-1] &= ~gone[1:]
        last = limits[1:][np.diff(limits) > 0] - 1
        close[last] = gone[last]
    ends = np.flatnonzero(close) + 1
    doc_of = np.repeat(np.arange(len(limits) - 1), np.diff(spans))
    kept = [st.data[lo:hi][~gone[lo:hi]].tobytes() for lo, hi in zip(limits, limits[1:])]
    # whole characters for the text: a character goes only if all its bytes do
    text = []
    for k, (lo, hi) in enumerate(zip(limits, limits[1:])) if "_text" in schema.names else ():
        if table["_text"][k].as_py() is None or not removed[k]:
            text.append(table["_text"][k].as_py())
            continue
        head = np.flatnonzero((st.data[lo:hi] & 0xC0) != 0x80)
        stay = np.logical_or.reduceat(~gone[lo:hi], head)
        text.append(st.data[lo:hi][np.repeat(stay, np.diff(np.append(head, hi - lo)))].tobytes().decode())
    span_list = pa.ListArray.from_arrays(pa.array(spans - spans[0], pa.int32()), pa.StructArray.from_arrays(
        [pa.array(begins - limits[doc_of]), pa.array(ends - limits[doc_of])], fields=list(schema.field("spans").type.value_type)))
    values = {"_id": table["_id"], "n_bytes": np.diff(limits), "n_removed": removed, "n_spans": np.diff(spans), "spans": span_list,
              "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "_text": text}
    columns = [values.get(f.name, table[f.name] if f.name in table.column_names else None) for f in schema]
    return pa.table([c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def remove_repeats(docs: DataFrame, keep: list[str] = [], with_text: bool = True, window: int = WINDOW, gram: int = GRAM,  # noqa: B006
                   pack_bytes: int = PACK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans (start and end bytes removed), kept_sha256, and on demand ``kept_text``;
    the columns in ``keep`` come back as keep_<name>.

    Null text is empty and stays null in ``kept_text``; texts shorter than the window lose nothing. Rows with the same id do not remove
    each other's bytes, as neither id is smaller; null ids count as largest. ``kept_text`` keeps characters of which a byte stays.
    An empty table gives an empty result.
    """
    size = text_bytes(docs)
    buckets = buckets_of(size, bucket_bytes)
    parts = 4 * buckets
    texts = in_packs(docs, size, pack_bytes, keep)
    kept = [f"c{k}" for k in range(len(keep))]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(span)),
                        ("kept_sha256", pa.string()), *[("_text", pa.string())] * with_text, *[(c, to_arrow_schema(texts.select(c).schema).field(0).type) for c in kept]])
    spark_schema = ("_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string" + ", _text string" * with_text
                    + "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in kept))
    names = texts.groupBy("_pack").applyInArrow(lambda t: _ask_names(t, window, gram, buckets), _ASK)
    told = names.groupBy("_to").applyInArrow(_answer_names, _TELL)
    rest = texts.groupBy("_pack").cogroup(told.groupBy("_pack")).applyInArrow(lambda a, b: _ask_windows(a, b, window, gram, buckets, parts), _REST)
    answers = rest.groupBy("_to").applyInArrow(lambda t: _answer_windows(t, window), _TELL)
    out = texts.groupBy("_pack").cogroup(answers.groupBy("_pack")).applyInArrow(lambda a, b: _result(a, b, window, gram, parts, schema), spark_schema)
    return out.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", *[F.col("_text").alias("kept_text")] * with_text,
                      *[F.col(k).alias(f"keep_{c}") for k, c in zip(kept, keep)])
