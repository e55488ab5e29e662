"""Equal keys and one value below the other, with keys that hold very many rows.

A plain join brings all rows of a key into one task and compares every pair there. Here
the rows of a hot key are cut into bins of about equal size along the value. A row of the
other side meets the bins below its own value, where every pair fits and none is compared,
and the bin its value lies in, the border, where pairs are compared. So the work follows
the result, and a key is dealt over its bins. A bin that one value fills alone is dealt
over blocks besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 1_000_000
BINS = 64


def hot_keys(rows: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys of more than ``hot_rows`` rows: fewer than the rows divided by that number."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows).select(key)


def dealt(left: DataFrame, right: DataFrame, key: str, upper: Column, lower: Column, bin_rows: int, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_bin`` and ``_block``; ``upper`` and ``lower`` are numbers that never fall where the values rise.

    ``left`` rows are repeated for every bin and block they meet, ``_border`` says where pairs are to be compared.
    """
    shares = [i / bins for i in range(1, bins)]
    bounds = F.broadcast(right.groupBy(key).agg(F.percentile_approx(lower, shares, 1000).alias("_bounds")))

    def place(number: Column) -> Column:
        return F.size(F.filter("_bounds", lambda b: b < number))

    binned = right.join(bounds, key).withColumn("_bin", place(lower)).drop("_bounds")
    blocks = binned.groupBy(key, "_bin").agg(F.ceil(F.count(F.lit(1)) / bin_rows).cast("int").alias("_blocks"))
    blocks = F.broadcast(blocks)  # ``bins`` rows a hot key
    columns = [F.col(c) for c in right.columns]
    there = binned.join(blocks, [key, "_bin"]).withColumn("_block", F.pmod(F.xxhash64(*columns), F.col("_blocks")).cast("int"))
    own = left.join(bounds, key).withColumn("_own", place(upper)).drop("_bounds")
    met = own.withColumn("_bin", F.explode(F.sequence(F.lit(0), "_own"))).join(blocks, [key, "_bin"])
    met = met.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.withColumn("_border", F.col("_bin") == F.col("_own")).drop("_own", "_blocks"), there.drop("_blocks")


def join_below(
    left: DataFrame,
    right: DataFrame,
    key: str,
    upper: str,
    lower: str,
    number=lambda c: c.cast("double"),
    hot_rows: int = HOT_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """Rows of both sides with one key where ``lower`` (right) is below ``upper`` (left).

    Both sides name the key alike and no other column. Rows without a key or a value meet nothing.
    """
    left, right = left.dropna(subset=[key, upper]), right.dropna(subset=[key, lower])
    hot = F.broadcast(hot_keys(right, key, hot_rows))
    below = F.col(lower) < F.col(upper)
    cold = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key).filter(below)
    met, there = dealt(
        left.join(hot, key, "left_semi"), right.join(hot, key, "left_semi"), key, number(F.col(upper)), number(F.col(lower)), max(1, hot_rows // bins * 2), bins
    )
    warm = met.join(there, [key, "_bin", "_block"]).filter(~F.col("_border") | below)
    return cold.unionByName(warm.select(*cold.columns))
