"""Structural labels on mapped pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.templates import as_flag, is_generated, sql_template
from pairloom.operators.layout import spread_small


def label_generated(pairs: DataFrame, strict_null: bool = False) -> DataFrame:
    made = is_generated(F.col("source_query"), F.col("target_query"), F.col("target_question"), strict_null)
    return pairs.withColumn("is_generated", as_flag(made))


def label_templates(pairs: DataFrame, strict_null: bool = False) -> DataFrame:
    """Add ``is_generated, same_template, source_query_template, target_query_template``.

    A narrow step: only a small table is spread over the cores first, and pairs that
    were not generated skip the regexes.
    """
    made = F.col("is_generated") == "True"
    return (
        label_generated(spread_small(pairs), strict_null)
        .withColumns(
            {
                f"{side}_query_template": F.when(made, sql_template(F.col(f"{side}_query"))).otherwise("null")
                for side in ("source", "target")
            }
        )
        .withColumn(
            "same_template",
            as_flag(made & (F.col("source_query_template") == F.col("target_query_template"))),
        )
    )


def not_generated(labelled: DataFrame) -> DataFrame:
    """The rejects of the structural step."""
    return labelled.filter(F.col("is_generated") == "False")
