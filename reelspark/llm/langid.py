"""Language identification by nearest centroid over TF-IDF character n-grams.

Each language has several centroids, found by spherical k-means over a bounded sample of its documents; document
frequencies are counted over all labelled documents. A text goes to the centroid of greatest cosine, and is marked as rejected
where it lies farther from that centroid than nearly all of the centroid's own documents.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import quoted, tune
from .ngrams import word_ngrams

SIZES = (1, 2, 3)
BUCKETS = 1 << 13
#: The bound of the clustering sample: rows of each language, rows in all, characters of a text
LANGUAGE_ROWS = 400
SAMPLE_ROWS = 4_000
SAMPLE_CHARS = 20_000
CENTROIDS = 3
ROUNDS = 10
#: Part of a centroid's own documents that its radius leaves out
OUTSIDE = 0.01
#: Texts whose vectors are held at a time
HELD = 256
UNKNOWN = "und"


@dataclass
class Model:
    rarity: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    owners: np.ndarray
    radii: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, for each text."""
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names, scores, rejected = [], [], []
        if not self.languages:
            none = len(texts)
            return [UNKNOWN] * none, np.zeros(none), np.ones(none, bool)
        for vectors in _blocks(texts, self.rarity):
            cosine = vectors @ self.centroids.T
            best = cosine.argmax(axis=1)
            near = cosine[np.arange(len(best)), best]
            names += [self.languages[i] for i in self.owners[best]]
            scores.append(near)
            rejected.append(near < self.radii[best])
        scores = np.clip(np.concatenate(scores).astype(np.float64), 0, 1) if scores else np.zeros(0)
        rejected = np.concatenate(rejected) if rejected else np.zeros(0, bool)
        return [name if has else UNKNOWN for name, has in zip(names, letters)], np.where(letters, scores, 0.0), rejected | ~letters


def _counts(texts: pa.Array):
    """How often each bucket occurs in each text."""
    for sizes in word_ngrams(texts, SIZES, BUCKETS):
        counts = np.bincount(sizes[0], minlength=BUCKETS)
        for values in sizes[1:]:
            counts += np.bincount(values, minlength=BUCKETS)
        counts[0] = 0
        yield counts


def _blocks(texts: pa.Array, rarity: np.ndarray):
    """Unit TF-IDF vectors, some texts at a time; a text without n-grams is the zero vector."""
    held: list[np.ndarray] = []

    def done():
        vectors = np.log1p(np.array(held, np.float32)) * rarity
        return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-12)

    for counts in _counts(texts):
        held.append(counts)
        if len(held) == HELD:
            yield done()
            held = []
    if held:
        yield done()


def clusters(vectors: np.ndarray, count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and the centroid of each vector."""
    count = min(count, len(vectors))
    random = np.random.default_rng(seed)
    # Each next start is the vector farthest from those so far
    starts = [int(random.integers(len(vectors)))]
    for _ in range(count - 1):
        starts.append(int((vectors @ vectors[starts].T).max(axis=1).argmin()))
    centers = vectors[starts].copy()
    for _ in range(ROUNDS):
        owner = (vectors @ centers.T).argmax(axis=1)
        for i in range(count):
            if (owner == i).any():
                mean = vectors[owner == i].sum(axis=0)
                centers[i] = mean / max(float(np.sqrt(mean @ mean)), 1e-12)
    return centers, (vectors @ centers.T).argmax(axis=1)


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Fit on documents with a text and a language; the others teach nothing.

    Document frequencies cover all of them. Centroids come from at most ``LANGUAGE_ROWS`` documents of a language and about
    ``SAMPLE_ROWS`` in all, the first by a hash of the id, of at most ``SAMPLE_CHARS`` characters; an id
    counts once in a language, by its least text. Of more than ``SAMPLE_ROWS`` languages the last are never learned. Without any such document every text is ``und``.
    """
    tune(docs.sparkSession)
    known = docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text"), quoted(lang_column).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL AND text <> ''")

    def spread(batches):
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for counts in _counts(batch.column(0)):
                total += counts > 0
                rows += 1
        # Bucket 0 is no n-gram: its place holds the number of texts
        total[0] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], ["bucket", "n"])

    sums = known.select("text").mapInArrow(spread, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(BUCKETS, np.int64)
    frequency[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    rarity = np.log((1 + frequency[0]) / (1 + frequency)).astype(np.float32)
    rarity[0] = 0
    short = known.where(F.length("text") <= SAMPLE_CHARS)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ranked = short.select("id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= LANGUAGE_ROWS)
    ids = F.broadcast(ranked.orderBy("rank", "lang").limit(SAMPLE_ROWS).select("id", "lang"))

    def vectors(batches):
        for batch in batches:
            bags = [(np.flatnonzero(counts).astype(np.int16), counts[counts > 0].astype(np.int32)) for counts in _counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([held.tobytes() for held, _ in bags], pa.binary()),
                pa.array([times.tobytes() for _, times in bags], pa.binary())], ["language", "held", "times"])

    # Of rows that repeat an id in a language, the least text teaches
    texts = short.join(ids, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    chosen = texts.select(F.col("lang").alias("language"), "text").mapInArrow(vectors, "language string, held binary, times binary").toArrow()
    by_language: dict[str, list[np.ndarray]] = {}
    for language, held, times in sorted(zip(*[chosen.column(i).to_pylist() for i in range(3)])):
        vector = np.zeros(BUCKETS, np.float32)
        vector[np.frombuffer(held, np.int16)] = np.log1p(np.frombuffer(times, np.int32))
        vector *= rarity
        norm = float(np.sqrt(vector @ vector))
        if norm > 0:
            by_language.setdefault(language, []).append(vector / norm)
    languages, centroids, owners, radii = sorted(by_language), [], [], []
    for number, language in enumerate(languages):
        own = np.array(by_language[language])
        centers, owner = clusters(own, CENTROIDS)
        near = (own * centers[owner]).sum(axis=1)
        for i, center in enumerate(centers):
            centroids.append(center)
            owners.append(number)
            radii.append(float(np.quantile(near[owner == i], OUTSIDE)) if (owner == i).any() else 1.0)
    return Model(rarity, languages, np.array(centroids, np.float32).reshape(len(owners), BUCKETS), np.array(owners, np.int64), np.array(radii))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected`` of every row's whole text.

    Null texts and texts without a letter are ``und`` with score 0. Other texts have the nearest language, and ``rejected``
    says whether they lie outside its centroid's radius. Null and repeated ids keep their rows; no other column is read.
    """
    narrow = docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        for batch in batches:
            names, scores, rejected = Model(**shared.value).predict(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
