"""Judge ratings: meeting the rated pairs by position, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.json_text import rating_part, rating_value
from pairloom.functions.vocabulary import NO_SCHEMA, RATING_FORMAT
from pairloom.operators.joins import lookup
from pairloom.operators.ordering import by_range, running_number

FILE = ["target_db_id", "source_db_id"]
RATED = ("meaningful_nl_question", "correct_target_nl_sql_mapping", "nl_thought", "sql_thought")


def select_pairs(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows whose JSON names both a question and a query, even if with null."""
    keys = F.json_object_keys(F.col(raw))
    named = F.array_contains(keys, "target_question") & F.array_contains(keys, "target_query")
    return rows.filter(named)


def part_of(position: Column, size: int | None) -> Column:
    """Which prompt of its file a pair stands in; without a size a file is one prompt."""
    return F.lit(0).cast("bigint") if size is None else F.floor(position / size).cast("bigint")


def rating_parts(pairs: DataFrame, keys: list[str] | None = None, size: int | None = None) -> DataFrame:
    """One row per judge prompt: the pairs of a file in order, as a JSON array.

    A file makes one prompt, or, with ``size``, one per so many positions.
    """
    keys = keys or FILE
    pair = F.struct("ord", F.col("target_question").alias("nl_question"), F.col("target_query").alias("sql_query"))
    plain = F.transform(
        F.array_sort(F.collect_list(pair)),
        lambda p: F.struct(p["nl_question"].alias("nl_question"), p["sql_query"].alias("sql_query")),
    )
    return (
        pairs.withColumn("part", part_of(F.col("ord"), size))
        .groupBy(*keys, "part")
        .agg(
            F.to_json(plain, {"ignoreNullFields": "false"}).alias("pairs_json"),
            F.count(F.lit(1)).alias("n_sent"),
            F.min("ord").alias("first_ord"),
        )
    )


def place_in_part(pairs: DataFrame, keys: list[str] | None = None, size: int | None = None) -> DataFrame:
    """Add ``part`` and ``pos``, where each pair stands in the prompt that holds it.

    A file is numbered in ranges of positions, so one with very many pairs is many tasks' work.
    """
    keys = keys or FILE
    parts = pairs.withColumn("part", part_of(F.col("ord"), size))
    numbered = running_number(parts, [*keys, "part"], by_range(F.col("ord")), [F.col("ord")], "pos")
    return numbered.withColumn("pos", F.col("pos") - 1)


def read_ratings(items: DataFrame, keep: list[str]) -> DataFrame:
    """The four labels out of one rating element each (column ``item``)."""
    nl = rating_part(F.col("item"), "clarity_and_alignment_of_NL", "clarity")
    sql = rating_part(F.col("item"), "correctness_of_query", "correctness")
    parts = items.select(*keep, nl.alias("_nl"), sql.alias("_sql"))
    return parts.select(
        *keep,
        rating_value(F.col("_nl"), "is_clear_and_meaningful").alias("meaningful_nl_question"),
        rating_value(F.col("_sql"), "is_correct_mapping").alias("correct_target_nl_sql_mapping"),
        rating_value(F.col("_nl"), "thought_process").alias("nl_thought"),
        rating_value(F.col("_sql"), "thought_process").alias("sql_thought"),
    )


def is_yes(label: Column) -> Column:
    return F.coalesce(F.lower(label) == "yes", F.lit(False))


def complete_files(pairs: DataFrame, ratings: DataFrame, file: list[str] | None = None) -> DataFrame:
    """Files that got exactly as many ratings as they have rows."""
    file = file or FILE
    one = pairs.select(*file, F.lit(1).alias("sent"), F.lit(0).alias("rated"))
    other = ratings.select(*file, F.lit(0).alias("sent"), F.lit(1).alias("rated"))
    counts = one.unionByName(other).groupBy(*file).agg(F.sum("sent").alias("sent"), F.sum("rated").alias("rated"))
    return counts.filter("sent = rated").select(*file)


def zip_ratings(pairs: DataFrame, ratings: DataFrame, file: list[str] | None = None) -> DataFrame:
    """Row n of a file meets rating n; files with a different count stay out.

    The join key holds the position, so a huge file spreads over all tasks. The
    short list of complete files is matched with ``lookup``, which does not gather
    a file either.
    """
    file = file or FILE
    zipped = pairs.join(ratings, [*file, "ord"])
    return lookup(zipped, complete_files(pairs, ratings, file), file, ["ord"])


def label_rated(zipped: DataFrame) -> DataFrame:
    """Only generated pairs are labelled; the others leave here."""
    return zipped.filter(F.col("is_generated") == "True")


def rating_prompt(base: str, pairs_json: Column, ddl: Column) -> Column:
    """What the judge reads; a database without schema shows as ``None``."""
    return F.format_string(RATING_FORMAT, F.lit(base), F.coalesce(ddl, F.lit(NO_SCHEMA)), pairs_json)
