"""Order-dependent operators that do not put a whole key into one task.

A running number over a key normally sends all rows of that key to one task. Here
every key is cut into ordered buckets first: the buckets are added up (a small
aggregate), each bucket learns the sum of those before it, and only the rows of
one bucket are sorted together.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.operators.layout import estimated_bytes

BUCKET_BITS = 16  # 65536 consecutive positions
HASH_DIGITS = 3  # 4096 buckets per key for hash-ordered rows,
HUGE_INPUT = 1 << 40  # and 16 times as many from this input size on
SPLIT_BYTES = 128 * 1024 * 1024  # one scan task
GATHERED_ROWS = 1_000_000  # of one key in one task
SALTS = 64
GROUP_LIMIT = 1000  # up to here Spark cuts each key to the limit before the shuffle


def by_range(position: Column, bits: int = BUCKET_BITS) -> Column:
    """Buckets of 2^bits consecutive positions."""
    return F.shiftright(position.cast("bigint"), bits)


def even_ranges(df: DataFrame, position: str, ranges: int = 4096) -> Column:
    """At most ``ranges`` buckets of equal width over the positions that occur, whatever their number.

    Evaluates ``df`` once for its smallest and largest position; give it a stored table.
    """
    ends = df.agg(F.min(position).alias("low"), F.max(position).alias("high")).first()
    low, width = (ends.low, (ends.high - ends.low) // ranges + 1) if ends.low is not None else (0, 1)
    return F.floor((F.col(position) - low) / width).cast("bigint")


def running_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including each row, per key.

    ``bucket`` (a number, or a struct of several columns) must not decrease along
    ``order``. The sum of all earlier buckets
    enters its bucket as one extra row in front, so rows need no join and null keys
    count like any other. Without keys, one task handles one row per bucket only.
    """
    rows = df.withColumns({"_bucket": bucket, "_value": value.cast("bigint")})
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    fronts = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_value"))
    marked = rows.withColumn("_front", F.lit(False)).unionByName(
        fronts.withColumn("_front", F.lit(True)), allowMissingColumns=True
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(F.col("_front").desc(), *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        marked.withColumn(out, F.sum("_value").over(inside))
        .filter(~F.col("_front"))
        .drop("_bucket", "_value", "_front")
    )


def running_number(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each key from 1."""
    return running_sum(df, keys, bucket, order, F.lit(1), out)


def first_rows_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    limit: int,
    out: str,
    spread_by: list[str],
    gather_rows: int = GATHERED_ROWS,
) -> DataFrame:
    """The first ``limit`` rows of each key, numbered from 1 in ``out``.

    Every task cuts each key to the limit before the shuffle. Over very many tasks
    a key in all of them would still bring tasks x limit rows into one task; then keys
    are cut once per salt first, which leaves salts x limit rows.
    """
    splits = estimated_bytes(df) // SPLIT_BYTES + 1
    if splits * limit > gather_rows:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
        place = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
        df = salted.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place", "_salt")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, number).filter(F.col(out) <= limit)


def fixed_seed(seed: int) -> int:
    """Seed 0 means a new order for every run; it is drawn once, before the job starts.

    A random number per row would change when a lost task is run again.
    """
    return seed if seed != 0 else time.time_ns()


def shuffle_key(seed: Column, db_id: Column, position: Column) -> Column:
    """Same seed, same order, whatever the partitioning."""
    text = F.concat_ws(":", seed.cast("string"), F.coalesce(db_id, F.lit("")), position.cast("string"))
    return F.md5(text.cast("binary"))


def number_questions(
    questions: DataFrame,
    keys: list[str],
    seed: int | Column = -1,
    largest_limit: int = -1,
    db_id: str = "db_id",
    position: str = "ord",
) -> DataFrame:
    """Add ``pos``, the place of each question in its key's chosen order, from 1.

    Seed -1 keeps file order. If only the first ``largest_limit`` questions of a
    key are wanted and that number is small, each task drops the others before the
    shuffle; otherwise keys are numbered bucket by bucket. The result is the same.
    """
    seed_col = F.lit(fixed_seed(seed)) if isinstance(seed, int) else seed
    in_order = seed_col == -1
    place = F.col(position)
    rows = questions.withColumn("_hash", F.when(~in_order, shuffle_key(seed_col, F.col(db_id), place)))
    order = [F.col("_hash").asc_nulls_first(), place]
    if 0 <= largest_limit <= GROUP_LIMIT:
        first = first_rows_per_key(rows, keys, order, largest_limit, "pos", [position])
        numbered = first.withColumn("pos", F.col("pos").cast("bigint"))
    else:
        digits = HASH_DIGITS if estimated_bytes(questions) < HUGE_INPUT else HASH_DIGITS + 1
        hashed = F.conv(F.substring("_hash", 1, digits), 16, 10).cast("bigint")
        bucket = F.coalesce(hashed, by_range(place))
        numbered = running_number(rows, keys, bucket, order, "pos")
        if largest_limit >= 0:
            numbered = numbered.filter(F.col("pos") <= largest_limit)
    return numbered.drop("_hash")


def batch_number(pos: Column, size: int) -> Column:
    """Batches of ``size`` questions, from 0."""
    return F.call_function("div", pos - 1, F.lit(size)).cast("bigint")
