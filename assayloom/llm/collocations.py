"""Collocations: phrases that stand together more often than their parts would, by dynamic itemset counting.

Texts are dealt into shards, which are scanned in turn, again and again. A scan counts words from the first shard on. Once both parts of a longer
phrase (without its last and without its first word) have reached the threshold, the phrase is counted from the next shard on; so phrases of all
lengths are counted in one scan. A phrase is counted over one full cycle of shards, no more and no less, so every count is exact. The scan
ends when no phrase is left whose cycle is open.

Counts live in buckets of hashes, written to the shared folder after every shard. What the tasks of a shard must know, which phrases have
reached the threshold, they get as a bit set of fixed size. Two phrases may share a bit: then a phrase is counted that need not be, over a full
cycle like any other, and its parts are looked at again in the end. So the bit set bounds memory and never changes a result.

Phrases are 64-bit hashes of language, words and length. Their words are read from the texts in the end, each from one pack that is known to hold it.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayloom.llm.common import _LOWER, Rolling, mix, release, runs, slices, utf8
from assayloom.llm.packs import buckets_of, split_by, text_bytes
from assayloom.session import cut, scratch_path

LEAST = 100
LONGEST = 5
BEST = 2_000
SHARDS = 4
FILTER_BITS = 1 << 26
PACK_BYTES = 8 << 20
SLICE_BYTES = 2 << 20
BUCKET_BYTES = 20 << 20
HELD = 4_000_000            # hashes a task gathers before it adds them up
RANK_PARTS = 16
SALTS = (64, 16, 8, 8, 8, 8, 8, 8)        # by length: totals of languages and words are asked for most often

_U = np.uint64
_ODD = _U(0xD6E8FEB86659FD93)
_LENGTH = _U(7)
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1                                          # between words
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2               # between pieces

_STATE = "bucket int, hashes binary, counts binary, firsts binary, packs binary, bits binary"
_STATE_SCHEMA = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("hashes", "counts", "firsts", "packs", "bits")]])


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, most of them small, byte by byte."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_STATE_SCHEMA)], schema=_STATE_SCHEMA)


def _language(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Phrases:
    """Words of a batch of texts with their pieces, and hashes of phrases that begin at them."""

    def __init__(self, column: pa.Array, langs: list[str]):
        data, limits = utf8(column)
        n = len(limits) - 1
        wide = np.full(len(data) + n + 1, 10, np.uint8)         # a line end before and after every text
        shift = limits + np.arange(n + 1)
        letters = np.ones(len(wide), bool)
        letters[shift] = False
        wide[letters] = _LOWER[data]
        kind = _KIND[wide]
        edge = np.diff((kind > 0).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.start]
        self.doc = np.searchsorted(shift, self.start - 1, side="right") - 1
        self.data = wide
        names = {lang: _U(_language(lang)) for lang in set(langs)}
        self.lang = np.array([names[lang] for lang in langs], np.uint64)
        self.chain = mix(Rolling(wide).span(self.start, self.end) ^ self.lang[self.doc])

    def longer(self, k: int, at: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Chains of ``k`` words from those of one word fewer, at the words ``at``."""
        return mix(shorter * _ODD + self.chain[at + k - 1])

    def inside(self, k: int) -> np.ndarray:
        """Words at which ``k`` words of one piece begin."""
        n = max(0, len(self.piece) - k + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1:k - 1 + n])

    def words(self, at: int, k: int) -> str:
        return b" ".join(self.data[self.start[j]:self.end[j]].tobytes() for j in range(at, at + k)).decode("utf-8", "replace")


def _named(chain: np.ndarray, k: int) -> np.ndarray:
    """Hash of a phrase: its chain with the length in the last three bits."""
    return (chain & ~_LENGTH) | _U(k)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


class Bits:
    """Bit set of phrases that reached the threshold; every bucket owns a stretch of it."""

    def __init__(self, data: np.ndarray, buckets: int):
        self.data, self.buckets = data, buckets
        self.stretch = len(data) * 8 // buckets

    def places(self, h: np.ndarray) -> np.ndarray:
        return _bucket(h, self.buckets) * self.stretch + (mix(h) % _U(self.stretch)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _counted(p: Phrases, first: bool, new: Bits | None, old: Bits | None, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all occurrences of phrases whose cycle is open, and the words they begin at."""
    n = len(p.chain)
    if first:
        yield _named(p.chain, 1), np.arange(n)
        yield _named(mix(p.lang[p.doc]), 0), np.arange(n)       # words of the language
    if new is None or not n:
        return
    none = np.zeros(n, bool)
    started = new.has(_named(p.chain, 1))
    ended = old.has(_named(p.chain, 1)) if old else none
    chain = p.chain.copy()
    for k in range(2, longest + 1):
        at = p.inside(k)
        at = at[started[at] & started[at + 1]]
        done = ended[at] & ended[at + 1]
        chain[at] = p.longer(k, at, chain[at])
        h = _named(chain[at], k)
        yield h[~done], at[~done]
        if k < longest:
            # a bit may be on by chance before the phrase's own parts are, so these count too, then and now
            started, ended = none.copy(), none.copy()
            started[at] = new.has(h)
            if old:
                ended[at] = done & old.has(h)


def _dealt(docs: DataFrame, path: str, shards: int) -> DataFrame:
    """Texts in packs of a few megabytes, packs in shards, written once: every scan reads one shard only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = pack = 0
        for batch in batches:       # all of one partition
            for part in slices(iter([batch]), "text", SLICE_BYTES):
                n = part.num_rows
                size += part.column("text").nbytes
                number = (part.column("part")[0].as_py() << 24) + pack
                yield pa.RecordBatch.from_arrays([pa.array([(number + (number >> 24)) % shards] * n, pa.int32()), pa.array([number] * n, pa.int64()), part.column("lang"), part.column("text")],
                                                 ["shard", "pack", "lang", "text"])
                if size >= PACK_BYTES:
                    size, pack = 0, pack + 1

    kind = "shard int, pack long, lang string, text string"
    rows = docs.select(F.spark_partition_id().alias("part"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("text <> ''")
    rows.mapInArrow(run, kind).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema("pack long, lang string, text string, shard int").parquet(path)


def _scan(shard: DataFrame, step: int, shards: int, buckets: int, new, old, longest: int) -> DataFrame:
    """Counts of one shard, one row per bucket and stretch of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Bits(np.frombuffer(new.value, np.uint8), buckets) if new else None
        before = Bits(np.frombuffer(old.value, np.uint8), buckets) if old else None
        hashes, packs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            h, at, count = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            pack = np.concatenate(packs)[at]
            limits = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            return _rows([(b, h[lo:hi].tobytes(), _pack(count[lo:hi]), _pack(np.full(hi - lo, step)), _pack(pack[lo:hi]), None)
                          for b, (lo, hi) in enumerate(zip(limits, limits[1:])) if hi > lo])

        for part in slices(batches, "text", SLICE_BYTES):
            p = Phrases(part.column("text"), part.column("lang").to_pylist())
            pack = part.column("pack").to_numpy()
            for h, at in _counted(p, step < shards, now, before, longest):
                if len(h):
                    hashes.append(h)
                    packs.append(pack[p.doc[at]])
                    held += len(h)
            if held > HELD:
                yield flush()
                hashes, packs, held = [], [], 0
        if held:
            yield flush()
        release()

    return shard.select("lang", "text", "pack").mapInArrow(run, _STATE)


def _merged(rows: DataFrame, step: int, shards: int, buckets: int, least: int, longest: int, filter_bytes: int) -> DataFrame:
    """One row per bucket: all counts so far without those whose cycle ended below the threshold, and its stretch of the bit set."""
    def run(table: pa.Table) -> pa.Table:
        release()
        bucket = table["bucket"][0].as_py()
        # counts so far come first and keep their packs; the others in an order of the bucket's own, so that packs are asked for alike
        order = np.lexsort((np.random.default_rng(bucket).random(table.num_rows), np.array([b is None for b in table["bits"].to_pylist()])))
        table = table.take(pa.array(order))
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]])
        count, first, pack = (np.concatenate([_unpack(x.as_py()) for x in table[c]]) for c in ("counts", "firsts", "packs"))
        order = np.argsort(h, kind="stable")
        h = h[order]
        at = runs(h)
        h, count, first, pack = h[at], np.add.reduceat(count[order], at), np.minimum.reduceat(first[order], at), pack[order][at]
        keep = (count >= least) | (first + shards - 1 > step) | (h & _LENGTH == 0)
        h, count, first, pack = h[keep], count[keep], first[keep], pack[keep]
        bits = Bits(np.zeros(filter_bytes, np.uint8), buckets)
        on = h[(count >= least) & (h & _LENGTH > 0) & (h & _LENGTH < longest)]
        at = bits.places(on) - bucket * bits.stretch
        own = np.zeros(bits.stretch, np.uint8)
        own[at] = 1
        out = [(bucket, h.tobytes(), _pack(count), _pack(first), _pack(pack), zlib.compress(np.packbits(own, bitorder="little").tobytes(), 1))]
        return pa.Table.from_batches([_rows(out)])

    return rows.groupBy("bucket").applyInArrow(run, _STATE)


def _bit_set(state: DataFrame, buckets: int, filter_bytes: int) -> bytes:
    """The stretches of all buckets as one: always ``filter_bytes``."""
    stretch = filter_bytes // buckets
    out = np.zeros(filter_bytes, np.uint8)
    for bucket, bits in state.select("bucket", "bits").toLocalIterator():
        out[bucket * stretch:(bucket + 1) * stretch] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return out.tobytes()


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, filter_bits: int = FILTER_BITS,
                  bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The dealt texts, and ``h``, ``k``, ``f``, ``pack``: all phrases of up to ``longest`` words with at least ``least`` occurrences in their language, and totals (k 0)."""
    spark = docs.sparkSession
    buckets = buckets_of(text_bytes(docs), bucket_bytes)
    filter_bytes = math.ceil(filter_bits / 8 / buckets) * buckets       # whole bytes per bucket
    texts = _dealt(docs, scratch_path(spark, "phrases-texts"), shards)
    share = lambda bits: spark.sparkContext.broadcast(bits) if bits else None
    state, step, reached = None, 0, [None]      # reached[t]: before step t
    while True:
        new, old = reached[step], reached[step - shards] if step >= shards else None
        if step >= shards and new == old:
            break
        sent = share(new), share(old)
        rows = _scan(texts.where(F.col("shard") == step % shards), step, shards, buckets, *sent, longest)
        if state is not None:
            rows = state.unionByName(rows)
        path = scratch_path(spark, f"phrases-{step}")
        _merged(rows, step, shards, buckets, least, longest, filter_bytes).write.parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        reached.append(_bit_set(state, buckets, filter_bytes))
        if step >= shards:
            reached[step - shards] = None       # no later step asks for it
        for b in sent:
            if b:
                b.destroy()
        step += 1

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h = np.frombuffer(batch.column("hashes")[k].as_py(), np.uint64)
                count, pack = _unpack(batch.column("counts")[k].as_py()), _unpack(batch.column("packs")[k].as_py())
                length = (h & _LENGTH).astype(np.int32)
                at = (count >= least) | (length == 0)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(length[at]), pa.array(count[at]), pa.array(pack[at])], ["h", "k", "f", "pack"])
        release()

    return texts, cut(state.mapInArrow(expand, "h long, k int, f long, pack long"))


_FOUND = "lang string, phrase string, h long, k int, a long, total long, lefts array<long>, rights array<long>"
_FOUND_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("k", pa.int32()), ("a", pa.int64()), ("total", pa.int64()),
                           ("lefts", pa.list_(pa.int64())), ("rights", pa.list_(pa.int64()))])


def _spelled(texts: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """Candidates with language, words, and the hashes of what stands before and after each cut; each is read from its own pack."""
    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows or not wanted.num_rows:
            return _FOUND_SCHEMA.empty_table()
        release()
        h = wanted["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, count = h[order], wanted["f"].to_numpy()[order]
        missing = np.ones(len(h), bool)
        out = []
        for part in slices(iter(docs.combine_chunks().to_batches()), "text", SLICE_BYTES):
            langs = part.column("lang").to_pylist()
            p = Phrases(part.column("text"), langs)
            chains = [None, p.chain]
            for k in range(2, longest + 1):
                n = max(0, len(p.chain) - k + 1)
                chains.append(p.longer(k, np.arange(n), chains[k - 1][:n]))
                at = p.inside(k)
                found = _named(chains[k][at], k)
                place = np.minimum(np.searchsorted(h, found), len(h) - 1)
                hit = (h[place] == found) & missing[place]
                which, first = np.unique(place[hit], return_index=True)
                missing[which] = False
                for w, i in zip(which.tolist(), at[hit][first].tolist()):
                    left = [int(_named(chains[j][i:i + 1], j)[0]) for j in range(1, k)]
                    right = [int(_named(chains[k - j][i + j:i + j + 1], k - j)[0]) for j in range(1, k)]
                    total = int(_named(mix(p.lang[p.doc[i:i + 1]]), 0)[0])
                    out.append((langs[p.doc[i]], p.words(i, k), int(h[w]), k, int(count[w]), total, left, right))
        signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
        table = [(lang, phrase, signed(x), k, a, signed(t), [signed(v) for v in left], [signed(v) for v in right]) for lang, phrase, x, k, a, t, left, right in out]
        return pa.table([pa.array([r[c] for r in table], f.type) for c, f in enumerate(_FOUND_SCHEMA)], schema=_FOUND_SCHEMA)

    wanted = counts.where("k >= 2").select("pack", "h", "f")
    return texts.select("pack", "lang", "text").groupBy("pack").cogroup(wanted.groupBy("pack")).applyInArrow(run, _FOUND)


def _salts(h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SALTS]), (h.bitwiseAND(F.lit(7)) + 1).cast("int"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int | None = BEST, covered: int = 100, shards: int = SHARDS,
                 filter_bits: int = FILTER_BITS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per language its ``best`` phrases (all if None): lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to ``longest`` (at most 7) words that occur at least ``least`` times. A candidate goes where a longer one that
    holds its words in a row occurs at least ``covered`` percent as often; as counts fall with length, one word more decides. The score is
    floor(1000 * a * n / (l * r)) at the cut where it is lowest.

    Null texts are empty, null languages are ``und``; repeated rows count as often as they stand there; phrases never cross rows. Texts without words
    count for nothing, an empty table gives an empty result. Ids are not read. Ties go to the higher count, then to the phrase by bytes.
    """
    if not 2 <= longest <= 7 or least < 1 or shards < 1:
        raise ValueError("longest is 2 to 7, least and shards are 1 or more")
    texts, counts = count_phrases(docs.select("lang", "text"), least, longest, shards, filter_bits, bucket_bytes)
    found = cut(_spelled(texts, counts, longest))
    # l, r and n of every cut from one join; what is asked for often is dealt over several tasks
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col("c.lefts").alias("key")), F.struct(F.lit("r").alias("side"), F.col("c.rights").alias("key")),
                    F.struct(F.lit("n").alias("side"), F.col("total").alias("key")))
    asked = found.select("h", "k", "a", "total", F.posexplode(F.arrays_zip("lefts", "rights")).alias("at", "c"))
    asked = asked.select("h", "k", "a", (F.col("at") + 1).alias("at"), F.explode(sides).alias("s")).select("h", "k", "a", "at", "s.side", "s.key")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("h", "at"), _salts(F.col("key"))))
    told = counts.select(F.col("h").alias("key"), "f", F.explode(F.sequence(F.lit(0).cast("long"), _salts(F.col("h")).cast("long") - 1)).alias("salt"))
    known = cut(asked.join(told, ["key", "salt"]).select("h", "k", "a", "at", "side", "key", "f"))
    shorter = known.where("k > 2 and ((side = 'l' and at = k - 1) or (side = 'r' and at = 1))")
    gone = shorter.where(F.col("a") * 100 >= F.col("f") * covered).select(F.col("key").alias("h")).distinct()
    cuts = known.groupBy("h", "at").agg(F.first("a").alias("a"), *[F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lrn"])
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", score).groupBy("h").agg(F.min(F.struct("score", "at", "l", "r", "n")).alias("c"))
    rows = found.select("h", "lang", "phrase", "a").join(gone, "h", "left_anti").join(lowest, "h")
    rows = rows.select("lang", "phrase", "a", "c.l", "c.r", "c.n", "c.score")
    place = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if best is not None:        # the best of every part of a language first, so that no task ranks more than RANK_PARTS * best
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*place)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= best).drop("rank")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*place)).cast("long"))
    rows = rows if best is None else rows.where(F.col("rank") <= best)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
