"""Centroid clustering with bounds that remember where centroids were.

Vectors are integers, distances are squared Euclidean ones in 64-bit integers, so results
do not depend on the order of sums. A vector keeps, for every centroid, the distance at
its last evaluation and the round of it. All earlier centroids are kept (rounds x k x
dimensions, bounded by the parameters), so a stored distance is loosened by the length of
the *total* displacement of its centroid since then, the norm of the sum, and not by the
sum of the moves of each round, which is never smaller.

A centroid whose loosened lower bound lies above the loosened upper bound of the assigned
one cannot be nearer and is left out. If any fails, the assigned distance is taken anew
first; the centroids that still fail are evaluated exactly, ties to the smaller number.
Bounds are floating-point numbers with a margin that covers their rounding, so a tie is
always decided by the exact integers.

A round is one pass over the vectors with their bounds, written to the shared folder, and
sums per cluster and dimension that are added up in the tasks first: k x dimensions rows
reach the driver, however many vectors or equal vectors there are.

Vectors of another length than ``width`` and those that are null or hold null or
non-finite components take no part, nor do those with a component beyond 2**27 after
scaling, whose squared distances do not fit 64 bits. Repeated rows are vectors of their
own. Rows without vec_id are assigned but never seed a centroid; seeds with one id are
taken in the order of their components. With fewer vectors than k there are fewer
centroids; equal centroids leave all vectors to the smallest number. An empty table gives
no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import drop_folder, written

LARGEST = 2**27
_MARGIN = 1e-6
_STATE = pa.schema([
    ("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("upper_round", pa.int32()),
    ("lower", pa.list_(pa.float32())), ("lower_round", pa.list_(pa.int8())), ("evaluated", pa.int32()),
])
_STATE_DDL = "vec_id long, v array<int>, cluster int, upper double, upper_round int, lower array<float>, lower_round array<tinyint>, evaluated int"


def scaled(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id and ``v``, the integers floor(scale * x), of all vectors that take part."""

    def fits(x):
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("d"))
    doubles = doubles.filter((F.size("d") == width) & F.forall("d", fits))
    floors = doubles.select("vec_id", F.transform("d", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(2.0 * LARGEST)), F.lit(-2.0 * LARGEST)))).alias("v"))
    return floors.filter(F.forall("v", lambda x: F.abs(x) <= LARGEST)).select("vec_id", F.col("v").cast("array<int>").alias("v"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs of rows."""
    apart = v - c
    return np.einsum("ij,ij->i", apart, apart)


def _below(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are not above x."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _first(centroids: np.ndarray):
    """All distances: the start of the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch["v"], np.int64)
            apart = np.stack([squared(v, c[None]) for c in centroids], axis=1)
            cluster = apart.argmin(axis=1)
            best = apart[np.arange(len(v)), cluster]
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"], batch["v"], pa.array(cluster.astype(np.int32)), pa.array(np.sqrt(best.astype(np.float64))), pa.array(np.zeros(len(v), np.int32)),
                _lists(_below(np.sqrt(apart.astype(np.float64))), pa.float32()), _lists(np.zeros(apart.shape, np.int8), pa.int8()),
                pa.array(np.full(len(v), len(centroids), np.int32)),
            ], schema=_STATE)

    return run


def reassigned(v, cluster, upper, upper_round, lower, lower_round, history):
    """One round of bounds: new cluster, bounds and the number of distances that were evaluated, per vector.

    ``history[s]`` holds the centroids of round s, the last ones are the present ones.
    """
    now = len(history) - 1
    centroids = history[now]
    moves = np.sqrt(((history - centroids[None]).astype(np.float64) ** 2).sum(axis=2))  # (round, centroid) -> total displacement
    k = len(centroids)
    numbers = np.arange(k)
    low = lower.astype(np.float64) - moves[lower_round, numbers[None]]
    high = upper + moves[upper_round, cluster]
    fails = low * (1 - _MARGIN) <= high[:, None] * (1 + _MARGIN)
    fails[np.arange(len(v)), cluster] = False
    evaluated = np.zeros(len(v), np.int32)
    again = np.flatnonzero(fails.any(axis=1))
    if len(again):
        own = cluster[again]
        best = squared(v[again], centroids[own])
        distance = np.sqrt(best.astype(np.float64))
        upper[again], upper_round[again] = distance, now
        lower[again, own], lower_round[again, own] = _below(distance), now
        fails = fails[again] & (low[again] * (1 - _MARGIN) <= distance[:, None] * (1 + _MARGIN))
        evaluated[again] = 1 + fails.sum(axis=1)
        i, j = np.nonzero(fails)
        apart = squared(v[again[i]], centroids[j])
        lower[again[i], j], lower_round[again[i], j] = _below(np.sqrt(apart.astype(np.float64))), now
        # the present cluster competes with the exact distances; j ascends within a vector, so the first smallest wins
        rows, where = np.concatenate([np.arange(len(again)), i]), np.concatenate([own, j])
        order = np.lexsort((where, np.concatenate([best, apart]), rows))
        rows, where, values = rows[order], where[order], np.concatenate([best, apart])[order]
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        cluster[again], upper[again] = where[head], np.sqrt(values[head].astype(np.float64))
    return cluster, upper, upper_round, lower, lower_round, evaluated


def _again(history: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            held = [np.array(batch[c].to_numpy(zero_copy_only=False)) for c in ("cluster", "upper", "upper_round")]
            lower, lower_round = np.array(_matrix(batch["lower"], np.float32)), np.array(_matrix(batch["lower_round"], np.int8))
            cluster, upper, upper_round, lower, lower_round, evaluated = reassigned(_matrix(batch["v"], np.int64), *held, lower, lower_round, history)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"], batch["v"], pa.array(cluster, pa.int32()), pa.array(upper), pa.array(upper_round, pa.int32()),
                _lists(lower, pa.float32()), _lists(lower_round, pa.int8()), pa.array(evaluated),
            ], schema=_STATE)

    return run


def _sums(k: int, width: int):
    """Sums of a task per cluster and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, cluster = _matrix(batch["v"], np.int64), batch["cluster"].to_numpy()
            for j in np.unique(cluster):
                total[j] += v[cluster == j].sum(axis=0)
            count += np.bincount(cluster, minlength=k)
        j, at = np.nonzero(np.repeat(count[:, None] > 0, width, axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(j.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[j, at]), pa.array(count[j])], ["cluster", "at", "total", "count"]
        )

    return run


def moved(centroids: np.ndarray, state: DataFrame) -> np.ndarray:
    """Floored means of the non-empty clusters; empty ones stay."""
    k, width = centroids.shape
    parts = state.select("v", "cluster").mapInArrow(_sums(k, width), "cluster int, at int, total long, count long")
    whole = "decimal(38,0)"
    rows = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast(whole)).alias("total"), F.sum(F.col("count").cast(whole)).alias("count")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["at"]] = int(r["total"]) // int(r["count"])
    return out


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = squared(_matrix(batch["v"], np.int64), centroids[batch["cluster"].to_numpy()])
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], pa.array(found)], ["vec_id", "cluster", "distance"])

    return run


def rounds(vectors: DataFrame, k: int, n_rounds: int, seed: int, width: int, scale: int):
    """(history of centroids, state after the last assignment, its folder); state is None without vectors."""
    spark = vectors.sparkSession
    kept = scaled(vectors, width, scale)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.filter(F.col("vec_id").isNotNull()).orderBy(rank, "v").limit(k).collect()
    if not first:
        return np.zeros((1, 0, width), np.int64), None, None
    history = np.array([[r["v"] for r in first]], np.int64)
    state, folder = written(kept.mapInArrow(_first(history[0]), _STATE_DDL), "state")
    for _ in range(n_rounds):
        history = np.concatenate([history, moved(history[-1], state)[None]])
        state, after = written(state.mapInArrow(_again(history), _STATE_DDL), "state")
        drop_folder(spark, folder)
        folder = after
    return history, state, folder


def cluster(vectors: DataFrame, k: int = 40, n_rounds: int = 5, seed: int = 2, width: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    history, state, folder = rounds(vectors, k, n_rounds, seed, width, scale)
    if state is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = history[-1]
    found, _ = written(state.select("vec_id", "v", "cluster").mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long"), "distances")
    drop_folder(spark, folder)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(j, sums.get(j, 0), sum(sums.values()), name) for j, name in enumerate(names)]
    # k rows
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
