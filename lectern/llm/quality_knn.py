"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are trigrams of byte classes and a few repetition measures. A bounded labelled sample
gives term weights, a truncated singular value decomposition and the labelled vectors; these
are broadcast. Every document's cosines with all labelled vectors are computed exactly, in
blocks, and its neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept
from .textblocks import NOT_SPACE, Block, blocks, mix, shingle_hashes
from .workers import mapped

#: Most labelled rows of each class that the fit reads.
SAMPLE_PER_CLASS = 2000
TERMS = 1024
DIMENSIONS = 48
NEIGHBOURS = 15
#: Rows that are scored at a time: with ``TERMS`` and the sample's size it bounds the arrays.
ROWS = 512
#: Steps of a latent coordinate: products of 48 of them stay below 2**24, exact in single precision.
STEPS = 512
_FINE = 1 << 20

_MARKS = b".,!?;:'\"()-|#*$%&<>=+@/_"
_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[32, 9, 13]], _CLASS[10] = 5, 6
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = 7 + _k
WIDTH = TERMS + 3


def features(block: Block) -> np.ndarray:
    """Term weights of each text before scaling: logarithmic rates of the hashed trigrams, then shares of repeated neighbours, five-word windows and lines."""
    n = len(block)
    out = np.zeros((n, WIDTH), np.float32)
    sizes = np.diff(block.at)
    if len(block.data) >= 3:
        c = _CLASS[block.data]
        code = (mix(c[:-2] << np.uint64(10) | c[1:-1] << np.uint64(5) | c[2:]) % np.uint64(TERMS)).astype(np.int64)
        doc = np.repeat(np.arange(n), sizes)
        inside = doc[:-2] == doc[2:]
        counts = np.bincount(doc[:-2][inside] * TERMS + code[inside], minlength=n * TERMS).reshape(n, TERMS)
        out[:, :TERMS] = np.log1p(counts * (1000.0 / np.maximum(sizes, 1))[:, None])
    starts, ends, first = block.words(NOT_SPACE)
    h = block.span_hashes(starts, ends)
    grams, at = shingle_hashes(h, first, 5)
    not_break = np.ones(256, bool)
    not_break[10] = False
    ls, le, lf = block.words(not_break)
    lines = block.span_hashes(ls, le)
    for d in range(n):
        own = h[first[d] : first[d + 1]]
        if len(own):
            g, rows = grams[at[d] : at[d + 1]], lines[lf[d] : lf[d + 1]]
            out[d, TERMS:] = 20 * (own[1:] == own[:-1]).mean() if len(own) > 1 else 0, 20 * (1 - len(np.unique(g)) / len(g)), 10 * (1 - len(np.unique(rows)) / max(len(rows), 1))
    return out


@dataclass
class Model:
    """What a vote needs. ``basis`` and ``vectors`` hold whole numbers, so that every product is exact and a score is the same in any block of rows, on any machine."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Latent-semantic unit vectors times ``STEPS``, rounded."""
        v = np.rint(_unit((x * self.weights).astype(np.float64)) * _FINE) @ self.basis
        return np.rint(_unit(v) * STEPS).astype(np.float32)

    def neighbours(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest labelled vectors of each row and their cosines, nearest first; of equally near ones those that the model lists first."""
        n = len(self.labels)
        near = (v @ self.vectors.T).astype(np.int64)
        k = min(NEIGHBOURS, n)
        # Distinct whole numbers: the product, then the place from the end of the list.
        rank = near * n + (n - 1 - np.arange(n))
        at = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(rank, at, 1), axis=1), 1)
        return at, np.take_along_axis(near, at, 1) / STEPS**2

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        at, cosine = self.neighbours(self.project(x))
        weight = np.maximum(cosine, 0) ** 8 * self.votes[at]
        total = weight.sum(1)
        out = np.where(total > 0, (weight * self.labels[at]).sum(1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0.0, 1.0)


def small_blocks(texts: pa.Array) -> Iterator[Block]:
    """Blocks of at most ``ROWS`` texts."""
    for at in range(0, len(texts), ROWS):
        for block in blocks(texts.slice(at, ROWS)):
            yield Block(block.data, block.at, block.first + at)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def held_out(key: str) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from at most ``SAMPLE_PER_CLASS`` labelled rows of each class, those whose key and text hash lowest; only they come to the driver.

    A key with both labels counts as the larger one. Of rows of one key with equal text one is
    taken; different texts of one key each count. Held-out and null keys, other labels and
    labels without a document are never learned from.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_key is not null and _label in (0, 1)")
    known = known.where(~F.coalesce(held_out("_key"), F.lit(True))).groupBy("_key").agg(F.max("_label").alias("_label"))
    share = dict(known.groupBy("_label").count().collect())
    bodies = docs.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_hash"))
    labelled = kept(bodies.join(known, "_key").distinct(), "labelled")
    parts = [labelled.where(F.col("_label") == c).orderBy(F.xxhash64("_key", "_hash"), "_key", "_hash").limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))  # 2 * SAMPLE_PER_CLASS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in small_blocks(batch.column(1)):
                x = features(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), batch.column(2).slice(block.first, len(block)), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "label", "x"])

    said = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).withColumn("_hash", F.xxhash64(F.coalesce("_text", F.lit(""))))
    rows = said.join(sample, ["_key", "_hash"]).select(F.col("_key").cast("string").alias("key"), "_text", "_label")
    got = {(r[0], r[1], bytes(r[2])) for r in mapped(rows, run, "key string, label int, x binary").dropDuplicates().collect()}
    got = sorted(got)
    total = sum(share.values())
    prior = share.get(1, 0) / total if total else 0.5
    if not got:
        empty = np.zeros((0, DIMENSIONS), np.float32)
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, DIMENSIONS)), empty, np.zeros(0), np.zeros(0), prior)
    x = np.stack([np.frombuffer(r[2], np.float32) for r in got])
    y = np.array([r[1] for r in got], np.float64)
    seen = (x > 0).sum(0)
    weights = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 0.2
    weights[TERMS:] = 1
    scaled = _unit(x * weights).astype(np.float64)
    _, vectors = np.linalg.eigh(scaled.T @ scaled)
    basis = np.rint(vectors[:, ::-1][:, :DIMENSIONS] * _FINE)
    # A class of which fewer rows are in the sample than in the labels votes with more weight.
    drawn = [max((y == c).sum(), 1) for c in (0, 1)]
    votes = np.where(y == 1, share.get(1, 0) / drawn[1], share.get(0, 0) / drawn[0])
    model = Model(weights, basis, np.zeros(0), y, votes / votes.max(), prior)
    model.vectors = model.project(x)
    return model


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: ``key, held_out, score, predicted``.

    Texts without features, such as null and empty ones, score the share of label 1 among the
    labelled rows; without any labels that is 0.5. Of equally near neighbours those that the
    model lists first vote, so equal texts score alike wherever they stand. Rows are scored one
    by one, whole texts of any length, repeated rows a row each; a null key counts as not held
    out, an empty table gives an empty one, other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([np.zeros(0), *[shared.value.score(features(b)) for b in small_blocks(batch.column(2))]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key), F.coalesce(held_out(key), F.lit(False)).alias("_held"), F.col(text).cast("string").alias("_text"))
    return mapped(rows, run, f"`{key}` {kind}, held_out boolean, score double, predicted int")
