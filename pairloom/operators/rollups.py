"""Counts and rates per source, per target, and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ("target_db_id", "source_db_id")
LEVELS = ("total", "target", "source")


def rate(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def sums_by_level(rows: DataFrame, measures: dict[str, Column], keys=KEYS, levels=LEVELS) -> DataFrame:
    """Aggregate at the finest level, then roll the small result up.

    The data is shuffled once, as partial aggregates of the finest level, so a hot
    key costs one row per task. Rolling up the raw rows instead would first
    multiply every row by the number of levels.
    """
    finest = rows.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])
    depth = F.lit(len(keys)) - F.bit_count(F.grouping_id())
    return (
        finest.rollup(*keys)
        .agg(depth.alias("_depth"), *[F.sum(name).alias(name) for name in measures])
        .select(
            F.element_at(F.lit(list(levels)), F.col("_depth") + 1).alias("level"), *keys, *measures
        )
    )


def at_level(summary: DataFrame, level: str) -> DataFrame:
    return summary.filter(F.col("level") == level)


def template_summary(labelled: DataFrame) -> DataFrame:
    """Not-generated rows count as errors and are also counted on their own."""
    same = F.col("same_template") == "True"
    return sums_by_level(
        labelled,
        {
            "not_generated_query": F.count_if(F.col("is_generated") == "False"),
            "success": F.count_if(same),
            "error": F.count(F.lit(1)) - F.count_if(same),
            "total": F.count(F.lit(1)),
        },
    ).withColumn("success_rate", rate(F.col("success"), F.col("total")))


def execution_summary(labelled: DataFrame) -> DataFrame:
    status = F.col("result_status")
    return (
        sums_by_level(
            labelled,
            {
                "success": F.count_if(status.startswith("Success")),
                "empty": F.count_if(status == "Empty"),
                "error": F.count_if(status.startswith("Error")),
                "null_query": F.count_if(status == "Null_Query"),
                "total": F.count(F.lit(1)),
            },
        )
        .withColumn("success_result_rate", rate(F.col("success"), F.col("total")))
        .withColumn("success_run_rate", rate(F.col("success") + F.col("empty"), F.col("total")))
    )


def semantic_summary(labelled: DataFrame) -> DataFrame:
    """Per target and in total; the rates belong to the total line only."""
    yes = lambda name: F.count_if(F.lower(F.col(name)) == "yes")
    total_only = lambda c: F.when(F.col("level") == "total", c)
    return (
        sums_by_level(
            labelled,
            {
                "meaningful_nl_question": yes("meaningful_nl_question"),
                "correct_sql_mapping": yes("correct_target_nl_sql_mapping"),
                "total": F.count(F.lit(1)),
            },
            keys=("target_db_id",),
            levels=("total", "target"),
        )
        .withColumn("meaningfulness_rate", total_only(rate(F.col("meaningful_nl_question"), F.col("total"))))
        .withColumn("correct_sql_mapping_rate", total_only(rate(F.col("correct_sql_mapping"), F.col("total"))))
    )
