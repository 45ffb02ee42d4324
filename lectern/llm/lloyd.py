"""Clusters of vectors by plain Lloyd rounds in whole numbers.

Vectors become whole numbers once and are kept as bytes in the shared folder. In each round the
centroids, at most ``k`` vectors, go to all tasks; every task gives one row of sums for each of
its centroids, and a ``groupBy`` adds these rows up. No vector is moved and nothing but ``k``
rows comes to the driver, so each round can be run again from the files at any loss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept
from .workers import mapped

#: Whole numbers to the unit, and the largest size of one: with 64 components every squared distance is below 2**63.
SCALE, LARGEST = 1024, 1 << 27
#: Vectors whose differences are held at once; sums of distances beyond the largest long count as that.
ROWS, MOST = 4096, (1 << 63) - 1


def whole(vectors: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """``key`` and ``v``, the components as little-endian 32-bit integers: floor(``SCALE`` * x).

    Only vectors of exactly ``dimensions`` components, none of them null or non-finite.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(sizes == dimensions)
            flat = lists.take(pa.array(rows)).flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # nulls become NaN
            good = np.isfinite(x).all(1)
            v = np.clip(np.floor(x[good] * SCALE), -LARGEST, LARGEST).astype("<i4")
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dimensions), len(v), [None, pa.py_buffer(v.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[good])), packed], [key, "v"])

    return mapped(vectors.select(F.col(key), F.col(vector).cast("array<double>")), run, f"`{key}` {kind}, v binary")


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, of equally near ones the first, and its squared distance."""
    distances = np.empty((len(centroids), len(v)), np.int64)
    for at in range(0, len(v), ROWS):
        part = v[at : at + ROWS]
        for c, centroid in enumerate(centroids):
            difference = part - centroid
            distances[c, at : at + ROWS] = np.einsum("ij,ij->i", difference, difference)
    best = distances.argmin(0)
    return best, np.take_along_axis(distances, best[None], 0)[0]


def _rows(values: Iterable[bytes], dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i4").reshape(-1, dimensions).astype(np.int64)


def _sums(points: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """For each centroid with vectors their number, summed distances and summed components, exactly."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        total = [[0] * (2 + own.shape[1]) for _ in own]  # Python's integers have no largest one
        for part in parts:
            v = _rows(part["v"], own.shape[1])
            best, distance = nearest(v, own)
            for c in np.unique(best).tolist():
                mine = best == c
                far = distance[mine]
                sums = [len(far), (int((far >> 32).sum()) << 32) + int((far & 0xFFFFFFFF).sum()), *v[mine].sum(0).tolist()]
                total[c] = [a + b for a, b in zip(total[c], sums, strict=True)]
        yield pd.DataFrame([(c, at, Decimal(x)) for c, sums in enumerate(total) if sums[0] for at, x in enumerate(sums)], columns=["cluster", "at", "total"])

    sums = points.select("v").mapInPandas(run, "cluster int, at int, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
    found: dict[int, dict[int, int]] = {}
    for c, at, x in sums.collect():  # a row for each component of each centroid
        found.setdefault(c, {})[at] = int(x)
    shared.unpersist()
    return {c: (x[0], x[1], [x[2 + j] for j in range(centroids.shape[1])]) for c, x in found.items()}


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per kept vector: ``key, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of exactly ``dimensions`` components, none null or non-finite, count; the others give
    no row. The first centroids are the ``k`` vectors of smallest sha256 of ``seed:key`` (a null
    key is written as nothing; repeated keys go by their components), all of them where there are
    fewer. Of equally near centroids the smaller number wins; a centroid without vectors stays.
    Repeated rows count each for itself. Components beyond ``LARGEST`` / ``SCALE`` in size count
    as that. No kept vector, no rows; other columns are left out, whatever their names.
    """
    kind = vectors.schema[key].dataType.simpleString()
    points = kept(whole(vectors, key, vector, dimensions), "points")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    first = points.select(order.alias("_order"), "v").orderBy("_order", "v").limit(k).collect()
    centroids = np.frombuffer(b"".join(bytes(r["v"]) for r in first), "<i4").reshape(-1, dimensions).astype(np.int64)
    schema = f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        for c, (n, _, sums) in _sums(points, centroids).items():
            centroids[c] = [s // n for s in sums]
    last = _sums(points, centroids)
    inertia = [last[c][1] if c in last else 0 for c in range(len(centroids))]
    by_cluster, of_all = np.array([min(x, MOST) for x in inertia]), min(sum(inertia), MOST)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(_rows(batch.column(1).to_pylist(), dimensions), centroids)
            columns = [pa.array(best, pa.int32()), pa.array(distance), pa.array(by_cluster[best]), pa.array(np.full(len(best), of_all)), pa.array(digests).take(pa.array(best))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return mapped(points, run, schema)
