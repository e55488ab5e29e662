"""Execution labels from the outcome of running a pair's query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.vocabulary import NULL_QUERY, PREVIEW_ROWS
from pairloom.operators.ordering import first_rows_per_key


def is_null_query(sql: Column) -> Column:
    """Nothing to run."""
    return F.coalesce(sql, F.lit("")) == ""


def result_status(sql: Column, outcome: Column, fetched: Column) -> Column:
    """``outcome`` is ok, error or timeout; ``fetched`` counts at most one row over the preview."""
    return (
        F.when(is_null_query(sql), NULL_QUERY)
        .when(outcome == "timeout", "Error (Timeout)")
        .when(outcome == "error", "Error")
        .when(fetched == 0, "Empty")
        .when(fetched > PREVIEW_ROWS, f"Success (more than {PREVIEW_ROWS} rows)")
        .otherwise("Success")
    )


def label_executions(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "result_status", result_status(F.col("target_query"), F.col("outcome"), F.col("fetched_rows"))
    )


def fetch_cap(results: DataFrame, query: list[str], order: list[str]) -> DataFrame:
    """The first rows of every query's result, one more than the preview keeps."""
    return first_rows_per_key(results, query, [F.col(name) for name in order], PREVIEW_ROWS + 1, "row_no", order)


def preview_rows(capped: DataFrame, query: list[str], row: Column) -> DataFrame:
    """The kept rows of each query in order, and how many were fetched."""
    rows = F.array_sort(F.collect_list(F.struct("row_no", row.alias("row"))))
    kept = F.slice(F.transform(rows, lambda r: r["row"]), 1, PREVIEW_ROWS)
    return capped.groupBy(*query).agg(kept.alias("execution_result"), F.count(F.lit(1)).alias("fetched_rows"))
