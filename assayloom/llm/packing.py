"""Best-fit decreasing packing of token sequences.

Documents are tokenised and cut into pieces in one pass over the texts; from then on a piece is a small row. Pieces are dealt into
groups of about ``GROUP_PIECES`` by a hash. Each group is packed by best fit decreasing; a segment tree over remaining capacities finds
the tightest open sequence. A group wastes less than one sequence, so groups cost next to nothing in tightness.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayloom.llm.common import release, slices
from assayloom.session import cut

CAPACITY = 2_048
GROUP_PIECES = 100_000
END_ID = 0
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[tuple, tuple] = {}


class TextTokens:
    """Ids of texts by the tokenizer file.

    The same vocabulary exists as ranks, which a much faster encoder takes. It is used for texts of Latin letters, digits, marks and
    blanks without special tokens, where both agree by construction; all others go through the tokenizer file itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        where = lambda name: name if "/" in name else public_tokenizers.path(name)
        self.whole = Tokenizer.from_file(where(tokenizer))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            with open(where(ranks), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        # code points below U+0250: Latin letters, whose classes no Unicode version changes; U+2000 to U+2044: dashes, quotes, dots
        if self.fast and (text.isascii() or all(c < "ɐ" or "‐" <= c <= "‧" for c in set(text))) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def tokens_of(tokenizer: str, ranks: str | None) -> TextTokens:
    """One instance per task."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (tokenizer, ranks)
    if key not in _loaded:
        _loaded[key] = TextTokens(tokenizer, ranks)
    return _loaded[key]


def cut_points(length: int, capacity: int) -> list[int]:
    """Where pieces begin: whole pieces at the end, the rest first."""
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


class Bins:
    """Open sequences by remaining capacity, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.capacity = capacity
        self.made = 0

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """Smallest remaining capacity of an open sequence that is at least ``need``, or -1."""
        count, node = self.count, need + self.leaves
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.leaves

    def put(self, length: int) -> tuple[int, int]:
        """Number of the sequence and the place in it."""
        room = self.tightest(length) if length < self.capacity else -1
        if room < 0:
            number, room = self.made, self.capacity
            self.made += 1
        else:
            number = self.open[room].pop()
            self._add(room, -1)
        left = room - length
        if left:
            self.open[left].append(number)
            self._add(left, 1)
        return number, self.capacity - room


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the order of falling length."""
    bins = Bins(capacity)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        number[k], offset[k] = bins.put(int(lengths[k]))
    return number, offset


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves.

    Null text is empty: its only id is the end id. Every document is tokenised whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer, ranks)
        for batch in slices(batches, "text", 1 << 21):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*tokens.ids(text or ""), END_ID], "<u4")
                at = cut_points(len(ids), capacity)
                for k, (lo, hi) in enumerate(zip(at, [*at[1:], len(ids)])):
                    row = (doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()))
                    out.append(row + (ids[lo:hi],) if with_ids else row)
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                columns.append(pa.array([r[5].astype(np.int64) for r in out], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])
        del tokens
        _loaded.clear()     # workers live on after the task
        release()

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES + (", ids array<long>" if with_ids else ""))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, group_pieces: int = GROUP_PIECES,
         with_ids: bool = False) -> DataFrame:
    """Pieces with the sequence they stand in (``sequence_id``) and their place there (``offset``).

    Rows that repeat a document are packed as often as they stand there; null ids are kept. Sequence numbers are the group's number
    times 2**32 plus the number inside the group. An empty table gives an empty result.
    """
    pieces = cut(token_pieces(docs, capacity, tokenizer, ranks, with_ids))     # texts are tokenised once
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    schema = pa.schema([(f.name, t) for f, t in zip(pieces.schema.fields, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                       + [("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        number, offset = best_fit(table["length"].to_numpy(), capacity)
        group = table["_group"][0].as_py()
        return pa.table([*table.drop_columns(["_group"]).columns, pa.array(number + (group << 32)), pa.array(offset)], schema=schema)

    return dealt.groupBy("_group").applyInArrow(place, pieces.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long")
