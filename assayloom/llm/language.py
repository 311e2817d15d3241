"""Language identification by hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. An n-gram is the product of its letters' vectors, each turned by its place; a document
is the sum of its n-grams, a language the sum of its documents. A document gets the language with the highest cosine.

Letters a-z are classes of their own; other letters share 37 classes by code point; everything else is one blank, and runs of blanks
count once. Vectors of n-grams are fixed by a seed, so workers build those they meet by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayloom.llm.common import fold, fresh, quoted, release, slices

DIMENSIONS = 1_024
GRAM = 3
CLASSES = 64
UNKNOWN = "und"
SEED = 11
SLICE_BYTES = 1 << 19
SLICE_ROWS = 1 << 10
LEAST_SHARE = 1e-5     # of the training documents may stay below the least cosine
KEPT = 1 << 16          # n-gram vectors a worker keeps: 64 MB at 1,024 dimensions
PIECE = 2_048           # n-grams whose vectors are added at a time

_cache: dict = {}


def _letter_classes() -> np.ndarray:
    if "classes" not in _cache:
        points = np.arange(0x110000, dtype=np.uint32)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        spread = (points * np.uint32(2654435761)) >> np.uint32(16)
        out = np.where(alpha, 27 + spread % (CLASSES - 27), 0).astype(np.uint8)
        out[97:123] = np.arange(1, 27)
        _cache["classes"] = out
    return _cache["classes"]


class GramVectors:
    """Vectors of n-grams, made when first met; the first ``KEPT`` of them are kept in a row, others are made again."""

    def __init__(self, dimensions: int):
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, dimensions))
        self.turned = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        self.rows = np.zeros((KEPT, dimensions), np.int8)       # takes memory as it fills
        self.place = np.full(CLASSES ** GRAM, -1, np.int32)
        self.used = 0

    def _made(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.rows.shape[1]), np.int8)
        for k in range(GRAM):
            out *= self.turned[k][grams // CLASSES ** (GRAM - 1 - k) % CLASSES]
        return out

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of different n-grams."""
        new = grams[self.place[grams] < 0][:KEPT - self.used]
        if len(new):
            end = self.used + len(new)
            self.rows[self.used:end] = self._made(new)
            self.place[new] = np.arange(self.used, end)
            self.used = end
        at = self.place[grams]
        out = self.rows[np.maximum(at, 0)]
        missing = at < 0
        if missing.any():
            out[missing] = self._made(grams[missing])
        return out


def gram_vectors(dimensions: int) -> GramVectors:
    if _cache.get("dimensions") != dimensions:
        _cache["dimensions"], _cache["vectors"] = dimensions, GramVectors(dimensions)
    return _cache["vectors"]


def _forget() -> None:
    """Drop the vectors at the end of a task, as workers live on."""
    _cache.pop("dimensions", None)
    _cache.pop("vectors", None)
    release()


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text with their counts: arrays of (text * CLASSES**GRAM + n-gram) and counts."""
    low = [" " + (t or "").lower() + " " for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _letter_classes()[points].astype(np.int64)
    doc = np.repeat(np.arange(len(low)), sizes)
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != 0) | (cls[:-1] != 0) | (doc[1:] != doc[:-1])
    cls, doc = cls[keep], doc[keep]
    if len(cls) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(cls) - GRAM + 1
    code = np.zeros(n, np.int64)
    for k in range(GRAM):
        code = code * CLASSES + cls[k:k + n]
    inside = doc[:n] == doc[GRAM - 1:]
    return np.unique((doc[:n] * CLASSES ** GRAM + code)[inside], return_counts=True)


def bundles(texts: list[str | None], dimensions: int) -> np.ndarray:
    """One vector per text; zeros for a text without letters."""
    found, counts = grams(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    limits = np.searchsorted(found, np.arange(len(texts) + 1) * CLASSES ** GRAM)
    vectors = gram_vectors(dimensions)
    for k, (lo, hi) in enumerate(zip(limits, limits[1:])):
        for at in range(lo, hi, PIECE):
            end = min(at + PIECE, hi)
            out[k] += counts[at:end].astype(np.float32) @ vectors.of(found[at:end] - k * CLASSES ** GRAM).astype(np.float32)
    return out


def learn_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their prototypes, from all rows with a language and a text.

    Each task adds up its n-gram counts per language and sends one vector for each, so the driver gets languages times dimensions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            langs = np.array(batch.column("lang").to_pylist(), object)
            found, counts = grams(batch.column("text").to_pylist())
            name, gram = langs[found // CLASSES ** GRAM], found % CLASSES ** GRAM
            for lang in set(langs):
                at = name == lang
                np.add.at(total.setdefault(lang, np.zeros(CLASSES ** GRAM, np.int64)), gram[at], counts[at])
        for lang, count in total.items():
            met = np.flatnonzero(count)
            vector = np.zeros(dimensions, np.int64)
            for at in range(0, len(met), PIECE):
                part = met[at:at + PIECE]
                vector += count[part] @ gram_vectors(dimensions).of(part).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)], ["lang", "at", "value"])
        _forget()

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(run, "lang string, at int, value long")
    rows = rows.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    table = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).select("lang", "v.value").collect()
    table = sorted((r for r in table if any(r[1])), key=lambda r: r[0])
    return [r[0] for r in table], np.array([r[1] for r in table], np.float64).reshape(len(table), dimensions)


def classify(docs: DataFrame, languages: list[str], prototypes: np.ndarray, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the language and its score, the cosine with the language's prototype, 0 where it is below.

    Null texts, texts without a letter, and all texts where nothing was learned are ``und`` with score 0.
    """
    dimensions = prototypes.shape[1]
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)).astype(np.float32)
    letters_of = _letter_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE_BYTES, SLICE_ROWS):
            texts = batch.column("_text").to_pylist()
            vectors = bundles(texts, dimensions)
            has = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
            cosine = vectors @ unit.T / np.maximum(has, 1e-300)[:, None] if len(languages) else np.zeros((len(texts), 1))
            letters = np.array([any(letters_of()[ord(c)] for c in set(t or "".lower())) for t in texts], bool)
            best = cosine.argmax(1)
            known = letters & bool(languages)
            found = [languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            value = np.where(known, np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(value)], names)
        _forget()

    kept = [f"_c{k}" for k in range(len(docs.columns))]
    names = [*kept, "_pred", "_score"]
    inner = docs.select(*[quoted(c).alias(k) for c, k in zip(docs.columns, kept)])
    schema = inner.schema.add("_pred", "string").add("_score", "double")
    out = inner.withColumn("_text", F.col(kept[docs.columns.index("text")])).mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip([*docs.columns, pred, score], names)])


def least_cosine(docs: DataFrame, languages: list[str], prototypes: np.ndarray, share: float = LEAST_SHARE) -> float:
    """Cosine that all but a ``share`` of the documents with a language reach, halved: below it a text is like none of the languages.

    A quantile by counts of cosines in thousandths, so the driver sees at most a thousand rows; 0 where nothing was learned.
    """
    if not languages:
        return 0.0
    rows = classify(docs.where(F.col("lang").isNotNull()).select("text"), languages, prototypes, "p", "s").where(F.col("p") != UNKNOWN)
    counts = sorted((r["at"], r["n"]) for r in rows.groupBy(F.floor(F.col("s") * 1000).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect())
    left = share * sum(n for _, n in counts)
    for at, n in counts:
        left -= n
        if left < 0:
            return 0.5 * float(at) / 1000
    return 0.0


def with_language(docs: DataFrame, parts: int = 3, held: int = 1, dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows of ``docs`` whose text is like a language learned: those with a letter whose cosine is at least the least cosine of the training folds.

    Where no language was learned, all rows with a letter stay. Rows of null or empty text, or without a letter, go.
    """
    trained = docs.where(fold("doc_id", parts) != held).select("text", "lang")
    languages, prototypes = learn_prototypes(trained, dimensions)
    if not languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    least = least_cosine(trained, languages, prototypes)
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    found = classify(docs, languages, prototypes, pred, score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).drop(pred, score)


def identify(docs: DataFrame, keep: list[str], parts: int = 3, held: int = 1, dimensions: int = DIMENSIONS, pred: str = "lang_pred",
             score: str = "score", held_out: str = "held_out") -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict all: ``keep``, whether held out, language, score.

    Texts that repeat count as often as they stand there. Only text and lang are learned from; the language of a row is never an input
    of its prediction.
    """
    languages, prototypes = learn_prototypes(docs.where(fold("doc_id", parts) != held), dimensions)
    wanted = docs.select(*[quoted(c) for c in dict.fromkeys([*keep, "doc_id", "text"])])
    out = classify(wanted, languages, prototypes, pred, score)
    return out.select(*[quoted(c) for c in keep], (fold("doc_id", parts) == held).alias(held_out), pred, score)
