"""Label tables that lie ready for joins: cut into buckets by the pair key, sorted inside.

Tables with the same keys and number of buckets are joined bucket by bucket without
moving a row. The session's catalog only knows the layout while a table is read or
written; what counts are the files, so any later session can read them again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def default_buckets(spark: SparkSession) -> int:
    """As many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> int:
    """Write one sorted file a bucket; returns the number of buckets.

    A key with very many rows is one bucket: keys should name a pair, not a database.
    """
    buckets = buckets or default_buckets(df.sparkSession)
    name = _name("written")
    rows = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")
    return buckets


def read_bucketed(spark: SparkSession, path: str, keys: list[str], buckets: int) -> DataFrame:
    """The table, with its layout made known to the planner."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    name, by = _name("read"), ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def chained(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows that all tables have, on one row; of equally bucketed tables no row moves."""
    return reduce(lambda left, right: left.join(right.hint("merge"), keys), tables)
