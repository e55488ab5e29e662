"""Lookups and membership tests that stay safe when a side or a key is large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators.layout import estimated_bytes

SALTS = 64


def broadcast_limit(df: DataFrame) -> int:
    """The session's own bound for broadcasts, in bytes."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(limit)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    spread_by: list[str | Column],
    how: str = "inner",
    max_bytes: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join ``rows`` with a table that has one row per key, however hot a key is.

    A table whose estimated size is within the broadcast bound is broadcast, so
    ``rows`` does not move. A larger one is joined by shuffle: each of its rows is
    repeated once per salt, and ``spread_by`` (a unique id of ``rows``) decides
    which copy a row meets, so that no key, however frequent, ends in one task.
    """
    bound = broadcast_limit(table) if max_bytes is None else max_bytes
    if estimated_bytes(table) <= bound:
        return rows.join(F.broadcast(table), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def not_in(rows: DataFrame, key: str, excluded: DataFrame, excluded_key: str) -> DataFrame:
    """SQL's NOT IN without its broadcast of the whole list.

    One null in the list leaves no row at all, and a null key passes only an empty
    list. Both facts are found once, as two counters; what remains is a plain anti join
    against the distinct keys, which are thinned out before they are shuffled.
    """
    listed = excluded.select(F.col(excluded_key).alias("_listed"))
    nulls = listed.agg(F.count_if(F.col("_listed").isNull())).scalar()
    size = listed.agg(F.count(F.lit(1))).scalar()
    kept = rows.join(listed.distinct(), F.col(key) == F.col("_listed"), "left_anti")
    return kept.filter((size == 0) | (F.col(key).isNotNull() & (nulls == 0)))
