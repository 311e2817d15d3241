"""Shared helpers: column checks, folds, and texts as byte, word and hash arrays.

Hashes are polynomials modulo 2**64 over bytes or words, taken from running sums, so that any stretch of a text costs two look-ups.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1       # stands for a null id inside arrays; null ids sort last

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids belong to no fold and count as -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts, F.lit(-1))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the base and of its inverse, kept between calls."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _BASE), ("q", _BASE_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"][:n], _powers["q"][:n]


class Rolling:
    """Hashes of stretches of one byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        term = data.astype(np.uint64)
        term += _U(1)
        term *= up[:-1]
        np.cumsum(term, out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of ``data[start:end]``; depends on the bytes and the length only."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Mixed hashes of all stretches of one length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + _U(length)) if n > 0 else np.zeros(0, np.uint64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, with the limits of each (one more than there are texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):     # no chunks at all
        column = pa.array([], column.type)
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


SLICE_ROWS = 1 << 14


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``limit`` bytes, and it at most ``rows`` rows; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        at = np.flatnonzero(np.diff(part, prepend=-1))
        at = np.unique(np.concatenate([np.arange(lo, hi, rows) for lo, hi in zip(at, [*at[1:], batch.num_rows])]))
        for lo, hi in zip(at, [*at[1:], batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))
    _powers.clear()
    release()


def let_go(spark) -> None:
    """Let the driver notice which shuffles and checkpoints nothing refers to any more, so that their files go.

    Spark deletes them when the driver collects its garbage; a job of many small rounds may end before that happens by itself. Planning and
    compiling a round also leave freed native memory with the driver's JVM; it goes back to the system where the JVM has a command for it.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(commands, "systemTrimNativeHeap", None, None)
    except Py4JError:       # Linux only, and not every JVM
        pass


class Words:
    """Words of a batch of texts: limits in the byte array, number of the text, hash; A-Z is lower-cased first."""

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        data = _LOWER[data]
        # a blank before and after every text keeps words apart
        n = len(limits) - 1
        wide = np.full(len(data) + n + 1, 32, np.uint8)
        self.shift = limits + np.arange(n + 1)
        letters = np.ones(len(wide), bool)
        letters[self.shift] = False
        wide[letters] = data
        blank = _BLANK[wide]
        edge = np.diff(blank.astype(np.int8))
        self.start = np.flatnonzero(edge == -1) + 1
        self.end = np.flatnonzero(edge == 1) + 1
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(wide))
        self.doc = np.searchsorted(self.shift, self.start - 1, side="right") - 1
        self.hash = Rolling(wide).span(self.start, self.end)
        self.texts = n
        self.data = wide

    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.doc, minlength=self.texts)


def runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted or grouped array."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def short_bytes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each 64-bit value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def long_values(data: bytes, width: int) -> np.ndarray:
    """Inverse of ``short_bytes``."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()
