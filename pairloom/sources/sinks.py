"""Writers of the curation tables.

Tables are partitioned by the keys that name a file in the exchange layout. The
``rebalance`` hint lets AQE cut the rows of a hot partition over several tasks and
put small ones together, so files come out evenly sized. A stage always writes to
a table other than the one it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.sources.files import existing

PAIR_KEYS = ("target_dataset", "model", "target_db_id", "source_db_id")


def replace_partitions(df: DataFrame, path: str, keys=PAIR_KEYS) -> None:
    """Overwrite only the partitions that ``df`` holds rows for."""
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def write_mappings(mappings: DataFrame, path: str) -> None:
    replace_partitions(mappings, path)


def write_labelled(labelled: DataFrame, path: str, keys=PAIR_KEYS) -> None:
    replace_partitions(labelled, path, keys)


def replace_run(df: DataFrame, path: str, run_ts: str, keys=()) -> None:
    """Write the rows of one run; a repeated run takes the place of its first attempt, earlier runs stay."""
    rows = df.hint("rebalance", *keys) if keys else df
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    folder = f"{path}/run_ts={run_ts}"
    (writer.partitionBy(*keys) if keys else writer).parquet(folder)
    if keys and not existing(df.sparkSession, f"{folder}/{keys[0]}=*"):
        # no rows, no partitions: a file without rows keeps the columns known
        df.limit(0).write.mode("overwrite").parquet(folder)


def append_run(df: DataFrame, path: str, run_ts: str | Column) -> None:
    """Add the rows of one run; earlier runs stay."""
    stamp = F.lit(run_ts) if isinstance(run_ts, str) else run_ts
    df.withColumn("run_ts", stamp).write.mode("append").partitionBy("run_ts").parquet(path)


def append_transcripts(prompts: DataFrame, path: str, run_ts: str) -> None:
    """Prompt and answer of every attempt that got a non-empty answer."""
    answered = prompts.filter(F.coalesce("response", F.lit("")) != "")
    append_run(answered, path, run_ts)


def write_summaries(summary: DataFrame, path: str) -> None:
    """One folder per level: source, target, total; AQE puts small partitions together."""
    summary.hint("rebalance", "level").write.mode("overwrite").partitionBy("level").json(path)


def write_rejects(rejects: DataFrame, path: str, run_ts: str) -> None:
    append_run(rejects, path, run_ts)


def write_ratings_raw(items: DataFrame, path: str, keys=("target_db_id", "source_db_id")) -> None:
    """Raw ratings, as the judge gave them, one JSON text per pair."""
    text = items.withColumn("rating_json", F.to_json("item")).drop("item")
    replace_partitions(text, path, keys)


def upsert_stats(old: DataFrame, new: DataFrame, key: str = "source_db_id") -> DataFrame:
    """Counters per key: new values win, keys and counters only known before stay."""
    counters = [name for name in dict.fromkeys(old.columns + new.columns) if name != key]

    def newest(name: str) -> Column:
        sides = [F.col(f"{side}.{name}") for side, df in (("n", new), ("o", old)) if name in df.columns]
        return F.coalesce(*sides).alias(name)

    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[newest(name) for name in counters])


def snapshot_settings(settings: DataFrame, path: str, run_ts: str) -> None:
    """A copy of the settings a run was made with."""
    append_run(settings.select(F.to_json(F.struct("*")).alias("settings_json")), path, run_ts)
