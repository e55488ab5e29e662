"""From source questions to prompts: choice of pipelines, questions, batches, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.vocabulary import GUIDED_FIELDS, PROMPT_FORMAT, QUESTIONS_PER_PROMPT, ZEROSHOT_FIELDS
from pairloom.operators.joins import lookup
from pairloom.operators.ordering import batch_number, number_questions

QUESTION_FIELDS = ("dataset", "db_id", "question", "query")


def method_fields(method: str) -> tuple[str, ...]:
    """The columns of a mapped pair under each method."""
    known = {"guided": GUIDED_FIELDS, "zeroshot": ZEROSHOT_FIELDS}
    if method not in known:
        raise ValueError(f"unknown method {method!r}, expected one of {sorted(known)}")
    return known[method]


def allow(df: DataFrame, column: str, ids) -> DataFrame:
    """Keep the listed ids; an empty list keeps everything."""
    return df.filter(F.col(column).isin(list(ids))) if ids else df


def skipped_dbs(dbs: DataFrame, column: str, ids) -> DataFrame:
    """How many databases an allow-list leaves out."""
    left_out = ~F.col(column).isin(list(ids)) if ids else F.lit(False)
    return dbs.agg(F.count_if(left_out).alias("skipped"))


def unknown_dbs(settings: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every database that a pipeline names and no schema describes."""
    sources = settings.select(
        "pipeline_no", F.col("source_dataset").alias("dataset"), F.explode("source_db_ids").alias("db_id")
    )
    targets = settings.select(
        "pipeline_no", F.col("target_dataset").alias("dataset"), F.col("target_db_id").alias("db_id")
    )
    named = sources.unionByName(targets)
    return named.join(schemas.select("dataset", "db_id"), ["dataset", "db_id"], "left_anti")


def known_pipelines(settings: DataFrame, schemas: DataFrame) -> DataFrame:
    """Pipelines whose source and target databases all have a schema."""
    return settings.join(unknown_dbs(settings, schemas).select("pipeline_no").distinct(), "pipeline_no", "left_anti")


def skipped_pipelines(pipelines: DataFrame, schemas: DataFrame, samples: DataFrame, questions: DataFrame) -> DataFrame:
    """(pipeline_no, dataset, db_id, reason): why a pipeline, or one of its sources, gives no prompts."""
    unknown = unknown_dbs(pipelines, schemas).select("pipeline_no", "dataset", "db_id", F.lit("no schema").alias("reason"))
    target = pipelines.select("pipeline_no", F.col("target_dataset").alias("dataset"), F.col("target_db_id").alias("db_id"))
    no_samples = target.join(samples.select("dataset", "db_id"), ["dataset", "db_id"], "left_anti")
    listed = pipelines.select("pipeline_no", F.col("source_dataset").alias("dataset"), F.explode("source_db_ids").alias("db_id"))
    known = questions.select("dataset", "db_id").distinct()
    no_questions = listed.join(known, ["dataset", "db_id"], "left_anti")
    no_folder = pipelines.select("pipeline_no", F.col("source_dataset").alias("dataset"), F.lit(None).cast("string").alias("db_id"))
    no_folder = no_folder.join(known.select("dataset").distinct(), "dataset", "left_anti")
    out = unknown
    for rows, reason in ((no_samples, "no samples"), (no_questions, "no questions"), (no_folder, "no questions")):
        out = out.unionByName(rows.withColumn("reason", F.lit(reason)))
    return out.distinct()


def pair_sources(settings: DataFrame, dbs: DataFrame) -> DataFrame:
    """Each pipeline with each source database of its data set that it allows; no list allows all."""
    keys = dbs.select(F.col("dataset").alias("source_dataset"), F.col("db_id").alias("source_db_id"))
    listed = F.array_contains("source_db_ids", F.col("source_db_id"))
    return settings.join(keys, "source_dataset").filter((F.size("source_db_ids") == 0) | listed)


def choose_questions(questions: DataFrame, settings: DataFrame, largest_limit: int = -1) -> DataFrame:
    """The questions each pipeline takes from each of its databases, numbered from 1.

    A limit of -1 takes all, 0 takes none. ``largest_limit`` is the largest limit of
    the settings, or -1 if one of them takes all; knowing it lets tasks drop
    questions before they are shuffled.
    """
    named = questions.withColumnsRenamed({"dataset": "source_dataset", "db_id": "source_db_id"})
    wanted = settings.filter(F.col("question_limit") != 0)
    dbs = questions.select("dataset", "db_id").distinct()
    taken = lookup(named, pair_sources(wanted, dbs), ["source_dataset", "source_db_id"], ["ord"])
    numbered = number_questions(
        taken,
        ["pipeline_no", "source_db_id"],
        F.col("seed"),
        largest_limit,
        db_id="source_db_id",
    )
    return numbered.filter((F.col("question_limit") < 0) | (F.col("pos") <= F.col("question_limit")))


def batch_questions(numbered: DataFrame, keys: list[str], size: int = QUESTIONS_PER_PROMPT) -> DataFrame:
    """One row per prompt: up to ``size`` questions in order, as a JSON array."""
    fields = F.struct("pos", *[F.col(name) for name in QUESTION_FIELDS])
    in_order = F.array_sort(F.collect_list(fields))
    plain = F.transform(in_order, lambda q: F.struct(*[q[name].alias(name) for name in QUESTION_FIELDS]))
    return (
        numbered.withColumn("batch_no", batch_number(F.col("pos"), size))
        .groupBy(*keys, "batch_no")
        .agg(F.to_json(plain, {"ignoreNullFields": "false"}).alias("questions_json"), F.count(F.lit(1)).alias("n_questions"))
    )


def prompt_text(base: str) -> Column:
    """The whole prompt, from ``source_*``, ``target_*``, ``samples_json`` and ``questions_json``."""
    parts = ("source_db_id", "source_ddl", "target_db_id", "target_ddl", "samples_json", "questions_json")
    return F.format_string(PROMPT_FORMAT, F.lit(base), *parts)


def with_source_schema(rows: DataFrame, schemas: DataFrame, spread_by: list[str]) -> DataFrame:
    table = schemas.select(
        F.col("dataset").alias("source_dataset"), F.col("db_id").alias("source_db_id"), F.col("schema_ddl").alias("source_ddl")
    )
    return lookup(rows, table, ["source_dataset", "source_db_id"], spread_by)


def with_target_schema(rows: DataFrame, schemas: DataFrame, spread_by: list[str]) -> DataFrame:
    table = schemas.select(
        F.col("dataset").alias("target_dataset"), F.col("db_id").alias("target_db_id"), F.col("schema_ddl").alias("target_ddl")
    )
    return lookup(rows, table, ["target_dataset", "target_db_id"], spread_by)


def with_target_samples(rows: DataFrame, samples: DataFrame, spread_by: list[str]) -> DataFrame:
    """``samples``: one JSON text per target database."""
    table = samples.select(
        F.col("dataset").alias("target_dataset"), F.col("db_id").alias("target_db_id"), "samples_json"
    )
    return lookup(rows, table, ["target_dataset", "target_db_id"], spread_by)
