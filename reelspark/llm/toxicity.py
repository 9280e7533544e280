"""Toxicity by averaged subword embeddings under a linear softmax.

A text is the set of its words' character n-grams. Each n-gram has an embedding; their average, rare n-grams weighing
more, goes through a linear softmax over (clean, toxic). Embeddings and softmax are trained together, so a misspelling that
was never seen still shares most of its n-grams' vectors with the word it hides.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, quoted
from .ngrams import word_ngrams

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
#: The bound of the training sample: so many labelled rows of each class, of texts of so many characters, at most
TRAINING_ROWS = 1_500
TRAINING_CHARS = 20_000
DIMENSIONS = 4
EPOCHS = 8
BATCH = 64
RATE = 0.5
DECAY = 1e-5
#: N-grams of a smaller part of the training rows are left out
RARE = 0.01


@dataclass
class Model:
    """``weight`` is an n-gram's rarity, ``pull`` its weighted embedding seen through the softmax: toxic minus clean."""

    weight: np.ndarray
    pull: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of class 1 of each text; null and empty texts get that of no evidence."""
        sums = []
        for sizes in word_ngrams(texts, SIZES, BUCKETS):
            pull = weight = 0.0
            for values in sizes:
                pull += float(self.pull[values].sum(dtype=np.float64))
                weight += float(self.weight[values].sum(dtype=np.float64))
            sums.append(self.bias + pull / (weight + 1e-9))
        return 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -40, 40)))


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-gram buckets of each text and how often each occurs."""
    out = []
    for sizes in word_ngrams(texts, SIZES, BUCKETS):
        held, times = np.unique(np.concatenate(sizes), return_counts=True)
        out.append((held[held > 0].astype(np.int32), times[held > 0].astype(np.int32)))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """Train on bags of buckets with labels 0 and 1; ``share`` is the share of label 1 among all labelled rows.

    Plain NumPy with per-bucket adaptive steps; the same input gives the same model. ``rows`` is emptied on the way, so that the
    bags are held once.
    """
    random = np.random.default_rng(seed)
    count = len(rows)
    spread = np.bincount(np.concatenate([row[0] for row in rows]), minlength=BUCKETS) if count else np.zeros(BUCKETS, int)
    weight = np.log((1 + count) / (1 + spread)).astype(np.float32)
    # N-grams of a few training rows say nothing about other rows
    weight[spread < max(2, RARE * count)] = 0
    weight[0] = 0
    embed = random.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    embed[weight == 0] = 0
    soft = random.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    share = min(max(share, 0.02), 0.98)
    ones = max(1, int(labels.sum()))
    cost = np.where(labels == 1, share * count / ones, (1 - share) * count / max(1, count - ones)).astype(np.float32)
    second, slow = np.zeros(BUCKETS, np.float32), [np.zeros_like(soft), np.zeros_like(bias)]
    kept = []
    for number, (held, times) in enumerate(rows):
        rows[number] = None
        strength = weight[held] * times
        used = strength > 0
        kept.append((held[used], strength[used] / max(strength[used].sum(), 1e-9)))
    for epoch in range(EPOCHS):
        order, rate = random.permutation(count), RATE * (1 - epoch / EPOCHS)
        for at in range(0, count, BATCH):
            chosen = order[at:at + BATCH]
            lengths = np.array([len(kept[i][0]) for i in chosen])
            flat, part = np.concatenate([kept[i][0] for i in chosen]), np.concatenate([kept[i][1] for i in chosen])
            if not len(flat):
                continue
            owner = np.repeat(np.arange(len(chosen)), lengths)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            vectors, full = np.zeros((len(chosen), DIMENSIONS), np.float32), lengths > 0
            vectors[full] = np.add.reduceat(embed[flat] * part[:, None], starts[full], axis=0)
            logits = vectors @ soft + bias
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            error *= (cost[chosen] / len(chosen))[:, None]
            back = error @ soft.T
            for value, grad, past in ((soft, vectors.T @ error, slow[0]), (bias, error.sum(axis=0), slow[1])):
                past += grad * grad
                value -= rate * grad / (np.sqrt(past) + 1e-8)
            unique, inverse = np.unique(flat, return_inverse=True)
            push = np.empty((len(unique), DIMENSIONS), np.float32)
            for d in range(DIMENSIONS):
                push[:, d] = np.bincount(inverse, back[owner, d] * part, len(unique))
            push += DECAY * embed[unique]
            second[unique] += (push * push).mean(axis=1)
            embed[unique] -= rate * push / (np.sqrt(second[unique])[:, None] + 1e-8)
    side = (soft[:, 1] - soft[:, 0]).astype(np.float64)
    return Model(weight, (embed.astype(np.float64) @ side * weight).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled documents, the first of each class by a hash of the id.

    Rows without id, text or label teach nothing; an id labelled more than once counts as toxic if any label says so.
    Without labelled rows, or with one class only, the model gives every text that class's share.
    """
    spark = docs.sparkSession
    label = quoted(label_column).cast("int")
    marked = (
        labels.select(quoted(id_column).alias("id"), label.alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    texts = docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text")).where(
        F.length("text").between(1, TRAINING_CHARS))
    known = Scratch(spark, "toxicity").keep(
        marked.join(texts.select("id").distinct(), "id", "left_semi"), "labelled")
    share = known.agg(F.avg("label")).first()[0]
    classes = [known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(TRAINING_ROWS) for value in (0, 1)]
    # At most 2 * TRAINING_ROWS rows
    sample = F.broadcast(classes[0].unionByName(classes[1]))
    # Of rows that repeat an id, the least text teaches
    chosen = texts.join(sample, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bags = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([held.tobytes() for held, _ in bags], pa.binary()),
                pa.array([times.tobytes() for _, times in bags], pa.binary())], ["id", "label", "held", "times"])

    bags = chosen.mapInArrow(run, f"id {kind}, label int, held binary, times binary").toArrow()
    found = {}
    for batch in bags.to_batches():
        for name, label, held, times in zip(*[batch.column(i) for i in range(4)]):
            found[name.as_py()] = label.as_py(), (held.as_py(), times.as_py())
    del bags
    marks = np.array([found[name][0] for name in sorted(found)], np.int64)
    rows = [tuple(np.frombuffer(part, np.int32) for part in found.pop(name)[1]) for name in sorted(found)]
    if len(set(marks.tolist())) < 2:
        flat = min(max(share or 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), float(np.log(flat / (1 - flat))))
    return fit(rows, marks, share)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``score`` (the probability of class 1) and ``predicted`` (1 from 0.5 on) of every row's whole text.

    Null and empty texts, and texts without any n-gram the model knows, get the probability of no evidence. Null and
    repeated ids keep their rows; no other column is read.
    """
    narrow = docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        for batch in batches:
            found = Model(**shared.value).score(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below 0.5."""
    shared, place = docs.sparkSession.sparkContext.broadcast(vars(model)), docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(Model(**shared.value).score(batch.column(place)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
