"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors by ROUNDS times random signs and a fast Hadamard
transform; a vector's bucket is the signed axis it then lies nearest to. Every vector
is posted once per table; a query looks into the buckets of its PROBES nearest axes in
each table (multiprobe), so that few tables, and few copies of the data, are enough.
Candidates are ranked by their exact cosine on the original vectors in double
precision.

Vectors with equal components are one entry with its k + 1 smallest ids: more of them
cannot be among a query's nearest, and they all have the same score, so copies cost
nothing and no result changes. A bucket is dealt over blocks by size, so that however
many vectors fall into one of them, no task holds it whole: queries visit every block
of their buckets, each block gives its nearest, and these are merged.

Null, empty and zero vectors and those with null or non-finite components take no
part, neither as queries nor as candidates, nor do rows without id. Vectors are
compared with vectors of their own length. Repeated rows with one id and different
vectors are several candidates; an id is listed once, with its best score. A query
with fewer than k candidates gets all of those found. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.common import saved

TABLES, PROBES, ROUNDS = 4, 24, 3
BLOCK = 4096


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and its vector ``v`` in doubles, for all vectors that can be compared."""

    def finite(x):
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    # an empty vector has no component that is not zero
    return doubles.filter(F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def _entries(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids; Spark cuts each task's rows before it moves them."""
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    return (
        vectors.withColumn("place", place)
        .filter(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    )


def rotations(table: int, width: int) -> np.ndarray:
    """Random signs of each round, the same on every machine."""
    return np.random.default_rng([table, width, 5]).choice(np.array([-1.0, 1.0]), size=(ROUNDS, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, width) / np.sqrt(width)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def buckets(units: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row after the rotation: 2 * axis + (negative)."""
    width = 1 << max(0, (units.shape[1] - 1)).bit_length()
    x = np.zeros((len(units), width))
    x[:, : units.shape[1]] = units
    for signs in rotations(table, width):
        x = hadamard(x * signs)
    both = np.stack([x, -x], axis=2).reshape(len(x), 2 * width)
    probes = min(probes, 2 * width)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, computed alike wherever the rows stand."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _hashed(tables: int, probes: int):
    """Each row with all its (table, bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array([len(v) for v in batch["v"]])
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                part = batch.take(pa.array(rows))
                units = unit(_matrix(part["v"], width))
                for table in range(tables):
                    found = buckets(units, table, probes)
                    again = np.repeat(np.arange(len(rows)), found.shape[1])
                    out = part.take(pa.array(again))
                    extra = [np.full(len(again), width, np.int32), np.full(len(again), table, np.int32), found.ravel().astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, *map(pa.array, extra)], names=[*out.schema.names, "width", "table", "bucket"]
                    )

    return run


def _nearest(k: int):
    """A block of candidates and the queries that visit it: each query's k nearest entries there, with ids."""

    def run(key, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            ours, theirs = np.stack(queries["q"].to_numpy()), np.stack(entries["v"].to_numpy())
            unit_theirs = unit(theirs).T
            ids, query_ids = entries["ids"].to_numpy(), queries["query_id"].to_numpy()
            # an entry may hold nothing but the query itself, so one more is looked at
            most = min(k + 1, len(entries))
            for low in range(0, len(ours), 512):
                rough = unit(ours[low : low + 512]) @ unit_theirs
                least = np.partition(rough, -most, axis=1)[:, -most] - 1e-9
                i, j = np.nonzero(rough >= least[:, None])
                i += low
                for a, b, score in zip(i.tolist(), j.tolist(), cosines(ours[i], theirs[j]).tolist(), strict=True):
                    out += [(query_ids[a], x, score) for x in ids[b] if x != query_ids[a]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's nearest found, ties to the smaller id.

    ``vectors`` and ``queries`` hold vec_id and embedding; a query is no candidate of itself.
    """
    posted = saved(
        _entries(clean(vectors), k).mapInArrow(_hashed(tables, 1), "v array<double>, ids array<bigint>, width int, `table` int, bucket int"),
        "posted",
    )
    asked = clean(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    probed = asked.withColumnRenamed("q", "v").mapInArrow(
        _hashed(tables, probes), "query_id bigint, v array<double>, width int, `table` int, bucket int"
    )
    probed = saved(probed.withColumnRenamed("v", "q"), "probed")
    place = ["width", "table", "bucket"]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    # a row for each table, dimension and signed axis: bounded by the dimensions, not by the rows
    sizes = F.broadcast(saved(blocks(posted, "blocks").join(blocks(probed, "query_blocks"), place), "sizes"))

    def numbers(upto: str):
        return F.explode(F.sequence(F.lit(0), F.col(upto) - 1))

    dealt = posted.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    dealt = dealt.select("v", "ids", *place, "block", numbers("query_blocks").alias("query_block"))
    visits = probed.join(sizes, place).withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int"))
    visits = visits.select("query_id", "q", *place, numbers("blocks").alias("block"), "query_block")
    key = [*place, "block", "query_block"]
    found = (
        dealt.groupBy(*key)
        .cogroup(visits.groupBy(*key))
        .applyInPandas(_nearest(k), "query_id bigint, vec_id bigint, score double")
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
