"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.session import fresh_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``saved``, with the folder, for tables that go once their successor is written."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``written`` made."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def row_key(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[Column]:
    """Two null-free columns that tell rows apart: id and hash of the text.

    Rows that agree in both are repeated rows; they get the same decision.
    """
    return [
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(F.col(text)).alias("_text_hash"),
    ]


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key``, or all if there are no more.

    A bound on the hash goes first, so that tasks give away a little more than ``n`` rows
    together, and not ``n`` rows each.
    """
    total = rows.count()
    if total <= n:
        return rows
    hashed = F.xxhash64(F.lit(n), F.col(key))
    bound = min(2**63 - 1, (n + 10 * int(n**0.5) + 10) * 2**63 // total)
    near = rows.filter(F.shiftrightunsigned(hashed, 1) <= bound)
    return near.orderBy(hashed, key).limit(n)


def frequent(counts: DataFrame, n: str, size: int) -> DataFrame:
    """The rows among which the ``size`` largest counts are, and no more of them than a power of two brings along."""
    power = F.floor(F.log2(F.col(n)))
    held = sorted(((r.power, r.rows) for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    least, so_far = 0, 0
    for at, rows in held:
        if so_far >= size:
            break
        least, so_far = at, so_far + rows
    return counts.filter(F.col(n) >= 2**least)


def _bit_words(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """(word, bits): the words of 64 bits of a bitmap over 64-bit hashes that are not zero."""
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    return hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(_bit_of(at)).alias("bits"))


def _bit_of(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of 2**bits bits over 64-bit hashes, in words of 64 bits.

    Its size is fixed, however many hashes there are: at most 2**bits / 64 partial
    words reach the driver. A full filter lets everything through and loses nothing.
    """
    words = _bit_words(hashes, column, bits)
    out = np.zeros(max(1, 2**bits // 64), np.uint64)
    rows = words.toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def rows_without(rows: DataFrame, gone: DataFrame, key: list[Column], bits: int = 24) -> DataFrame:
    """The rows whose ``key`` no row of ``gone`` holds (its columns stand in the key's order); columns as they are.

    Rows stay where they lie: a bitmap of fixed size over the keys of ``gone`` goes to them, and
    only those with its bit set, the gone ones and few others, move to be joined. A full bitmap
    moves them all and loses nothing. A key with a null equals no other.
    """
    names = [f"_gone_{n}" for n in range(len(key))]
    gone = saved(gone.toDF(*names).distinct(), "gone")
    words = F.broadcast(_bit_words(gone.select(F.xxhash64(*names).alias("hash")), "hash", bits))
    held = rows.select(F.struct(*rows.columns).alias("_row"), F.struct(*(k.alias(n) for k, n in zip(key, names, strict=True))).alias("_key"))
    at = F.shiftrightunsigned(F.xxhash64(*(F.col("_key")[n] for n in names)), 64 - bits)
    marked = held.withColumn("_at", at).join(words, F.shiftright("_at", 6) == F.col("word"), "left")
    marked = marked.withColumn("_marked", F.coalesce(F.col("bits").bitwiseAND(_bit_of(F.col("_at"))) != 0, F.lit(False)))
    same = [F.col("_key")[n] == F.col(n) for n in names]
    left = marked.filter("_marked").select("_row", "_key").join(gone, same, "left_anti")
    return marked.filter(~F.col("_marked")).select("_row.*").union(left.select("_row.*"))


def in_bitmap(filter_words: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (filter_words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers so that every bit depends on all others (public-domain finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive word hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(size, np.uint64(n))
        for i in range(n):
            out = (out ^ words[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mixed(out)
