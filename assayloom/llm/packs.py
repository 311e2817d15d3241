"""Texts in packs that ask buckets and get answers.

A pack is a few megabytes of whole documents, chosen by a hash of the id. What a pack wants to know about the whole corpus it sends as
sorted arrays, one row per bucket of hashes; buckets answer each pack in the order it asked. So hundreds of millions of hashes
travel as a few thousand rows, no table grows on the driver, and every step is an ordinary shuffle that Spark can run again.

The texts are shuffled once: all passes over packs read the same exchange.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayloom.llm.common import NO_ID, quoted, release


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def in_packs(docs: DataFrame, size: int, pack_bytes: int, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``_pack``, ``_id`` (null as the largest), ``_text`` and the columns in ``keep`` as c0, c1, ..."""
    packs = max(1, math.ceil(size / pack_bytes))
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(packs)).cast("int").alias("_pack"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.col("text").alias("_text"),
                       *[quoted(c).alias(f"c{k}") for k, c in enumerate(keep)])


def by_id(table: pa.Table) -> pa.Table:
    """Rows of a pack in one order, however they arrived."""
    release()
    return table.sort_by([("_id", "ascending"), ("_text", "ascending")])


def buckets_of(size: int, bucket_bytes: int) -> int:
    return max(1, math.ceil(size / bucket_bytes))


def split_by(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by bucket, order kept inside, and where each bucket begins (one more than buckets)."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))
