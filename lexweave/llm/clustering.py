"""Centroid clustering by delta Lloyd, in exact integers.

A round doesn't start over. Assignments are a table, written each round, and the sums of each cluster are
kept beside it. A centroid that stands where it stood can't take a vector from another such centroid, so a
vector whose owner stayed is compared with the changed centroids only, and one whose owner moved with all.
Vectors that change hands are signed transfers, +x to one cluster and -x to the other: only these are summed
and added to the sums kept. All of it is whole numbers, so the result doesn't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Components beyond this are an error: squared distances of 64 components must fit in a long.
LARGEST = 1 << 27
#: Where all components are this small, distances are exact in doubles too.
_SMALL = 1 << 22
_STATE = "vec_id long, v array<long>, cluster int, distance long, was int"


@dataclass
class Centroids:
    """Where they stand, which of them moved in the last round, and the sums and sizes of their clusters."""

    at: np.ndarray
    moved: np.ndarray
    sums: np.ndarray
    sizes: np.ndarray

    def stepped(self, transfers: list[tuple[int, int, list[int]]]) -> Centroids:
        """After a round's (cluster, signed size, signed sums): floor(sum / count), empty ones stay."""
        sums, sizes = self.sums.copy(), self.sizes.copy()
        for c, n, s in transfers:
            sizes[c] += n
            sums[c] += s
        at = np.where(sizes[:, None] > 0, sums // np.maximum(sizes, 1)[:, None], self.at)
        return Centroids(at, (at != self.at).any(1), sums, sizes)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all to all, exact: through one product in doubles where every number in it is
    below 2^53, else in longs, a centroid at a time."""
    if not len(vectors) or not len(centroids):
        return np.zeros((len(vectors), len(centroids)), np.int64)
    if max(np.abs(vectors).max(), np.abs(centroids).max()) <= _SMALL and vectors.shape[1] <= 64:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(vectors: np.ndarray, owner: np.ndarray, distance: np.ndarray, at: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, of equal ones the smaller number, and its squared distance. owner -1
    has none yet; other owners and distances are those of the round before."""
    owner, distance = owner.copy(), distance.copy()
    anew = np.flatnonzero((owner < 0) | moved[owner])
    if len(anew):
        d = distances(vectors[anew], at)
        owner[anew] = d.argmin(1)
        distance[anew] = d[np.arange(len(anew)), owner[anew]]
    kept, changed = np.setdiff1d(np.arange(len(owner)), anew), np.flatnonzero(moved)
    if len(kept) and len(changed):
        d = distances(vectors[kept], at[changed])
        k = d.argmin(1)
        rival, gap = changed[k], d[np.arange(len(kept)), k]
        wins = (gap < distance[kept]) | ((gap == distance[kept]) & (rival < owner[kept]))
        owner[kept[wins]], distance[kept[wins]] = rival[wins], gap[wins]
    return owner, distance


def whole_numbers(vector: str, size: int, scale: int = 256) -> tuple[Column, Column]:
    """Whether a vector has exactly `size` components, none null or non-finite, and floor(scale * x) of each."""
    c = F.col(vector)
    finite = ~F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    fits = lambda x: F.when(F.abs(scaled(x)) < float(LARGEST), F.floor(scaled(x))).otherwise(F.raise_error(F.lit(f"components must be under {LARGEST} / {scale}")).cast("long"))
    return c.isNotNull() & (F.size(c) == size) & finite, F.transform(c, fits)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(-1, width)


def _assigned(state: DataFrame, centroids: Centroids) -> DataFrame:
    """One round of a state (vec_id, v, cluster, distance, ...): `was` is the cluster before."""
    shared = state.sparkSession.sparkContext.broadcast((centroids.at, centroids.moved))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, moved = shared.value
        for batch in batches:
            was = np.asarray(batch.column(2))
            owner, distance = nearest(_numbers(batch.column(1), at.shape[1]), was.astype(np.int64), np.asarray(batch.column(3)), at, moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(owner.astype(np.int32)), pa.array(distance), pa.array(was.astype(np.int32))], ["vec_id", "v", "cluster", "distance", "was"])

    return state.select("vec_id", "v", "cluster", "distance").mapInArrow(mapped, _STATE)


def _transfers(state: DataFrame, clusters: int, width: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, signed size, signed sums) of the vectors that changed hands, summed in each task first:
    at most one row a cluster reaches the driver."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((clusters, width), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            v, now, was = _numbers(batch.column(0), width), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            np.add.at(sums, now, v)
            sizes += np.bincount(now, minlength=clusters)
            old = was >= 0
            np.subtract.at(sums, was[old], v[old])
            sizes -= np.bincount(was[old], minlength=clusters)
        hit = np.flatnonzero((sizes != 0) | (sums != 0).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(sizes[hit]), pa.array(list(sums[hit]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    part = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(mapped, "cluster int, n long, s array<long>")
    total = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[k]) for k in range(width)]).alias("s"))
    return [(r["cluster"], r["n"], r["s"]) for r in total.collect()]


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hash of salt and id, in that order; of equal ones the smaller vector."""
    mark = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.orderBy(mark, "v").select("v").limit(k).collect()], np.int64)


def cluster(table: DataFrame, *, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2:", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Centroids]:
    """(vec_id, v, cluster, distance) of every vector kept, and the centroids after `rounds` rounds.

    Kept are vectors of exactly `size` components, none null or non-finite. Rows that repeat a vec_id are
    vectors of their own; a null vec_id stays null and is hashed as empty text. With fewer than k vectors
    each starts a cluster; of equal seeds the smaller number owns all. Of an empty table, or one without a
    kept vector, nothing is returned. Other columns, whatever their names, are ignored.
    """
    fits, numbers = whole_numbers(vector, size, scale)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias(vector)).where(fits)
    state = written(rows.select("vec_id", numbers.alias("v"), F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(-1).alias("was")))
    at = seeds(state, k, salt).reshape(-1, size)
    now = Centroids(at, np.ones(len(at), bool), np.zeros_like(at), np.zeros(len(at), np.int64))
    for done in range(rounds + 1):
        if not len(at) or not now.moved.any():
            break
        state, before = written(_assigned(state, now)), state
        forget(before)
        if done < rounds:
            now = now.stepped(_transfers(state, len(at), size))
    return state.select("vec_id", "v", "cluster", "distance"), now


def with_inertia(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector. One row a cluster
    is broadcast."""
    names = assigned.sparkSession.createDataFrame([(c, ",".join(map(str, x))) for c, x in enumerate(centroids.at.tolist())], "cluster int, line string")
    of_each = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = of_each.agg(F.sum("cluster_inertia")).first()[0] or 0
    told = of_each.join(F.broadcast(names), "cluster").select("cluster", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), F.sha2("line", 256).alias("centroid_sha256"))
    return assigned.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
