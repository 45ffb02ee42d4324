"""Approximate dense search: vectors dealt into cells, questions compared with those of the nearest cells only.

The cells' centres are fitted on a bounded sample (``PER_CELL`` rows for each of at most
``MOST_CELLS`` cells); every row goes to the cell of its nearest centre. The index is a table
partitioned by cell, whose rows are blocks of unit vectors. How many cells a question is
compared with is measured when the index is made: as few as give the wanted recall on sampled
questions. A search reads only the partitions of the cells that its questions probe.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import QUESTION_BLOCK, VECTOR_BLOCK, compared

#: Bounds of the sample: rows for each cell, and cells. Rounds of fitting, sampled questions of which the recall is measured.
PER_CELL, MOST_CELLS, ROUNDS, ASKED = 50, 4096, 10, 500
_CELLS = "cell int, centre array<double>, probes int"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _vectors(lists: pa.Array) -> np.ndarray:
    return _unit(np.array(lists.to_pylist(), np.float64))


def _sample(vectors: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """Unit vectors of at most ``most`` rows, the first by a hash of their keys."""
    rows = vectors.select(F.xxhash64(key).alias("_hash"), F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")
    found = rows.orderBy("_hash", "_key").limit(most).select("_v").toArrow()  # a bounded sample
    return _vectors(found.column(0).combine_chunks()) if len(found) else np.zeros((0, 0))


def centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical means of the sample, begun with its first rows; a centre without vectors stays."""
    out = sample[:cells].copy()
    for _ in range(rounds):
        own = _nearest(sample, out, 1)[:, 0]
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        some = (sums * sums).sum(1) > 0
        out[some] = _unit(sums[some])
    return out


def _nearest(x: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """Each row's ``n`` nearest cells, nearest first; of equally near ones the first."""
    return np.concatenate([np.argsort(-np.rint(x[at : at + 4096] @ cells.T * 1e9), axis=1, kind="stable")[:, :n] for at in range(0, len(x), 4096)] or [np.zeros((0, n), np.int64)])


def _probes(sample: np.ndarray, cells: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells that hold the wanted share of the ``k`` nearest sample rows of sampled questions."""
    asked = sample[:: max(1, len(sample) // ASKED)]
    own = _nearest(sample, cells, 1)[:, 0]
    score = asked @ sample.T
    best = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
    place = np.argsort(_nearest(asked, cells, len(cells)), axis=1)  # of each cell in a question's order
    places = np.take_along_axis(place, own[best], 1).ravel()
    reached = np.cumsum(np.bincount(places, minlength=len(cells))) / len(places)
    return int(np.searchsorted(reached, recall) + 1)


class CellIndex:
    """An index at ``folder``: ``cells`` (number and centre of each) and ``blocks`` (``cell``, keys, unit vectors)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        rows = spark.read.schema(_CELLS).parquet(f"{self.folder}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        self.cells = np.array([r["centre"] for r in rows], np.float64)
        self.probes = rows[0]["probes"] if rows else 0
        self.blocks = spark.read.schema("keys array<long>, points binary, cell int").parquet(f"{self.folder}/blocks")

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", k: int = 40, recall: float = 0.95) -> CellIndex:
        """Index every row of ``vectors``; null vectors are in no cell. ``recall`` is what the sample's ``k`` nearest rows are asked for. Keys are integers."""
        spark = vectors.sparkSession
        n = vectors.count()
        wanted = max(1, min(MOST_CELLS, round(2 * math.sqrt(n))))
        sample = _sample(vectors, key, vector, PER_CELL * wanted)
        cells = centres(sample, min(wanted, len(sample)))
        probes = _probes(sample, cells, k, recall) if len(sample) else 0
        spark.createDataFrame([(c, v.tolist(), probes) for c, v in enumerate(cells)], _CELLS).coalesce(1).write.parquet(f"{folder}/cells")
        placed = _placed(vectors.select(F.col(key).cast("long").alias(key), vector), key, vector, cells, 1)
        blocks = _in_blocks(placed, "bigint", VECTOR_BLOCK, ("keys", "points"))
        blocks.write.partitionBy("cell").parquet(f"{folder}/blocks")
        return cls(spark, folder)

    def search(self, questions: DataFrame, k: int, qid: str = "qid", vector: str = "embedding", key: str = "vec_id", probes: int | None = None, digits: int = 6) -> DataFrame:
        """``qid, key, score``: for every pair of a block of the index and a block of questions that probe its cell the ``k`` nearest of each question; :func:`retrieval.top` merges them. Of each question's list all are its nearest within the probed cells."""
        kind = questions.schema[qid].dataType.simpleString()
        if not len(self.cells):
            return self.spark.createDataFrame([], f"{qid} {kind}, {key} bigint, score double")
        placed = _placed(questions, qid, vector, self.cells, probes or self.probes)
        asked = _in_blocks(placed, kind, QUESTION_BLOCK, ("qids", "aims"))
        probed = [r[0] for r in placed.select("cell").distinct().collect()]  # no more than there are cells
        there = self.blocks.where(F.col("cell").isin(probed))
        return compared(there.join(asked, "cell").select("keys", "points", "qids", "aims"), k, key, qid, digits)


def _placed(rows: DataFrame, key: str, vector: str, cells: np.ndarray, n: int) -> DataFrame:
    """``cell, key, v``: each row's unit vector with its ``n`` nearest cells, which all tasks hold."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _vectors(batch.column(1))
                own = _nearest(x, shared.value, n)
                packed = pa.array([v.tobytes() for v in x], pa.binary())
                at = pa.array(np.repeat(np.arange(len(x)), own.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel(), pa.int32()), batch.column(0).take(at), packed.take(at)], ["cell", "key", "v"])

    return rows.select(key, F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull()).mapInArrow(run, f"cell int, key {kind}, v binary")


def _in_blocks(placed: DataFrame, kind: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Rows of one cell in blocks of at most ``size``. Spark deals the cells to tasks of even size and splits a large one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for at in range(a, b, size):
                    part = batch.slice(at, min(size, b - at))
                    ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(1))
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[a])], pa.int32()), ids, pa.array([b"".join(part.column(2).to_pylist())], pa.binary())], ["cell", *names])

    return placed.hint("rebalance", "cell").sortWithinPartitions("cell").mapInArrow(run, f"cell int, {names[0]} array<{kind}>, {names[1]} binary")
