"""The whole runs: each stage reads tables and leaves tables for the next one.

    prompts -> (a model answers elsewhere) -> mappings -> template -> execution -> ratings

Settings have the shape of the two settings files: ``data`` and ``generation`` for
the mapping run, ``data`` and ``evaluation`` for the evaluators. All paths may lie
on any file system Spark reaches; ``work`` is where the tables go. Every table lies below
``<table>/run_ts=<run>``: a stage that is repeated overwrites its own run and reads no other.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.vocabulary import (
    ATTEMPTS_PER_PROMPT,
    FAILURE_LIMIT,
    QUERY_SECONDS,
    QUESTIONS_PER_PROMPT,
    RATING_FAILURES,
)
from pairloom.operators import attempts as A
from pairloom.operators import prompts as P
from pairloom.operators import ratings as R
from pairloom.operators.joins import lookup
from pairloom.operators.rollups import execution_summary, semantic_summary, template_summary
from pairloom.operators.template_labels import label_templates, not_generated
from pairloom.operators.workload import label_workload, run_workload
from pairloom.sources import files, sinks
from pairloom.sources.sinks import PAIR_KEYS

#: What a pair's file is called by; the method comes first, so that two methods never meet.
FILE_KEYS = ("method", *PAIR_KEYS)

PROMPT = ["pipeline_no", "source_db_id", "batch_no"]
SETTINGS = (
    "pipeline_no int, source_dataset string, source_db_ids array<string>, seed bigint, "
    "question_limit int, target_dataset string, target_db_id string"
)
RESPONSES = (
    "pipeline_no int, source_db_id string, batch_no bigint, attempt int, response string, prompt_tokens bigint, "
    "response_tokens bigint, time_taken double, real_time double, finish_reason string, error string"
)
RATINGS = (
    "method string, target_dataset string, model string, target_db_id string, source_db_id string, part bigint, attempt int, "
    "response string, finish_reason string, error string"
)


METHODS = ("guided", "zeroshot")


def method_of(options: Mapping) -> str:
    """The method the settings name; ``method_names`` may map other names to these. An unknown one is refused."""
    name = options.get("method")
    name = options.get("method_names", {}).get(name, name)
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}, expected one of {METHODS}")
    return name


def fields_of(options: Mapping) -> tuple[str, ...]:
    """The fields an answer must have: those of the settings, else those of the method."""
    method = method_of(options)
    listed = options.get("fields_to_check_zeroshot" if method == "zeroshot" else "fields_to_check")
    return tuple(listed) if listed else P.method_fields(method)


def read_text(spark: SparkSession, *parts: str) -> str:
    """A small text file, from any file system; a missing or empty one stops the run."""
    path = "/".join(part.rstrip("/") for part in parts if part)
    if not files.existing(spark, path):
        raise FileNotFoundError(f"{path} not found")
    text = "".join(row.value for row in spark.read.text(path, wholetext=True).collect())
    if not text:
        raise ValueError(f"{path} is empty; put a space in it if that is intended")
    return text


def prompt_texts(spark: SparkSession, options: Mapping, root: str) -> tuple[str, str]:
    """(base, system) text of the mapping prompts, from the files the settings name."""
    zeroshot = method_of(options) == "zeroshot"
    folder = f"{root}/{options.get('prompt_directory', 'prompts')}"
    base = "" if zeroshot else options.get("base_prompt_file")
    system = options.get("system_instruction_file_zeroshot" if zeroshot else "system_instruction_file")
    return (
        read_text(spark, folder, base) if base else options.get("base_prompt", ""),
        read_text(spark, folder, system) if system else options.get("system_prompt", ""),
    )


def judge_text(spark: SparkSession, options: Mapping, root: str) -> str:
    """What the judge reads first: its instructions, then the examples."""
    folder = f"{root}/{options.get('prompt_directory', 'prompts')}"
    names = [options[name] for name in ("prompt_file", "examples_file") if options.get(name)]
    return "".join(read_text(spark, folder, name) for name in names)


def settings_table(spark: SparkSession, data: list[Mapping]) -> DataFrame:
    rows = [
        (
            number,
            one["source_dataset"],
            list(one.get("source_db_ids", [])),
            one.get("source_questions_shuffle_seed", -1),
            one.get("source_questions_limit", -1),
            one["target_dataset"],
            one["target_db_id"],
        )
        for number, one in enumerate(data)
    ]
    return spark.createDataFrame(rows, SETTINGS)


def _per_dataset(names, scan) -> DataFrame:
    """Scan each data set's files and mark the rows with the data set."""
    scans = [scan(name).withColumn("dataset", F.lit(name)) for name in sorted(set(names))]
    return reduce(DataFrame.unionByName, scans)


def prompts_stage(spark: SparkSession, settings: Mapping, root: str, work: str, run_ts: str) -> DataFrame:
    """Source questions, schemas and samples to one prompt per batch of questions."""
    data, options = settings["data"], settings["generation"]
    base, system = prompt_texts(spark, options, root)
    pipelines = settings_table(spark, data)
    sources = [one["source_dataset"] for one in data]
    targets = [one["target_dataset"] for one in data]

    def own(name: str) -> DataFrame:
        return files.scan_questions(spark, f"{root}/{name}/questions").withColumnRenamed("dataset", "own_dataset")

    questions = _per_dataset(sources, own)
    schemas = _per_dataset(sources + targets, lambda name: files.scan_schemas(spark, f"{root}/{name}/schemas.json"))
    samples = _per_dataset(targets, lambda name: files.scan_samples(spark, f"{root}/{name}/target_samples"))
    sinks.replace_run(P.skipped_pipelines(pipelines, schemas, samples, questions), f"{work}/skipped", run_ts)
    skipped = read_run(spark, f"{work}/skipped", run_ts).filter("reason <> 'no questions'").select("pipeline_no").distinct()
    limits = [one.get("source_questions_limit", -1) for one in data]
    chosen = P.choose_questions(
        questions,
        pipelines.join(skipped, "pipeline_no", "left_anti"),
        largest_limit=-1 if min(limits) < 0 else max(limits),
    )
    named = chosen.withColumns({"dataset": F.col("own_dataset"), "db_id": F.col("source_db_id")})
    keys = ["pipeline_no", "source_dataset", "source_db_id", "target_dataset", "target_db_id"]
    batches = P.batch_questions(named, keys, options.get("max_question_length_per_prompt", QUESTIONS_PER_PROMPT))
    rows = P.with_source_schema(batches, schemas, PROMPT)
    rows = P.with_target_samples(P.with_target_schema(rows, schemas, PROMPT), samples, PROMPT)
    prompts = rows.select(
        *keys,
        "batch_no",
        "n_questions",
        "questions_json",
        F.lit(system).alias("system"),
        P.prompt_text(base).alias("prompt"),
    )
    sinks.replace_run(prompts, f"{work}/prompts", run_ts)
    snapshot = spark.createDataFrame([(json.dumps(settings),)], "settings string")
    sinks.replace_run(snapshot.select(F.to_json(F.struct("*")).alias("settings_json")), f"{work}/settings", run_ts)
    return read_run(spark, f"{work}/prompts", run_ts)


def read_run(spark: SparkSession, path: str, run_ts: str) -> DataFrame:
    """The rows of one run; no other run's folder is looked at."""
    return spark.read.option("basePath", path).parquet(f"{path}/run_ts={run_ts}").drop("run_ts")


def mappings_stage(
    spark: SparkSession, settings: Mapping, responses: DataFrame, work: str, run_ts: str, model: str
) -> DataFrame:
    """Model answers (``RESPONSES``) to mapped pairs, rejects, transcripts and counters."""
    options = settings["generation"]
    method, fields = method_of(options), fields_of(options)
    checks = options.get("validation", {})
    prompts = read_run(spark, f"{work}/prompts", run_ts)
    asked = prompts.select(*PROMPT, "source_dataset", "target_dataset", "target_db_id")
    tries = options.get("max_retry_per_prompt", ATTEMPTS_PER_PROMPT)
    answers = responses.filter(F.col("attempt") < tries).join(asked, PROMPT)
    read = A.classify(answers, fields, checks.get("fields_checking", True), checks.get("db_id_matching", True))
    used = A.used_attempts(read, PROMPT, tries)
    # written once, read by everything below: answers are validated a single time
    as_text = F.transform("items", lambda item: F.to_json(item))
    sinks.replace_run(used.withColumn("items", as_text), f"{work}/attempts", run_ts)
    stored = read_run(spark, f"{work}/attempts", run_ts)
    run = A.stop_after_failures(stored, [*PROMPT, "attempt"], options.get("max_fail_limit", FAILURE_LIMIT))
    used = run.withColumn("items", F.transform("items", lambda text: F.parse_json(text)))
    file = ["target_dataset", "target_db_id", "source_db_id"]
    named = A.accepted(used).withColumn("target_dataset", files.folder_name(F.col("target_dataset")))
    items = A.last_pipelines(A.explode_items(named, ["pipeline_no", *file, "batch_no"]), file)
    numbered = A.number_mappings(items, file)
    rest = [name for name in fields if name not in ("target_db_id", "source_db_id")]
    mapped = A.as_mappings(numbered, rest, [*file, "ord"])
    mapped = mapped.withColumns({"model": F.lit(model), "method": F.lit(method)})
    sinks.replace_run(mapped, f"{work}/mappings", run_ts, FILE_KEYS)
    with_prompt = A.rejected(used).select(*PROMPT, "attempt", "error_class", "response").join(
        prompts.select(*PROMPT, "system", "prompt", "questions_json"), PROMPT
    )
    sinks.replace_run(with_prompt.withColumn("errors", A.error_flags(F.col("error_class"))), f"{work}/rejects", run_ts)
    transcript = used.select(*PROMPT, "attempt", "response").join(prompts.select(*PROMPT, "system", "prompt"), PROMPT)
    sinks.replace_run(transcript.filter(F.coalesce("response", F.lit("")) != ""), f"{work}/transcripts", run_ts)
    sinks.replace_run(A.generation_stats(used, ["pipeline_no", "source_db_id"]), f"{work}/stats", run_ts)
    sinks.replace_run(A.exception_stats(used, ["pipeline_no", "source_db_id"]), f"{work}/exceptions", run_ts)
    merge_counters(spark, f"{work}/stats", run_ts, f"{work}/counters")
    return read_run(spark, f"{work}/mappings", run_ts)


def merge_counters(spark: SparkSession, stats: str, run_ts: str, path: str) -> None:
    """Counters per source over all runs up to each one: the newest run that knows a value wins.

    Every run leaves its own small sums, and those are merged, never an earlier merged table. So a run
    that is repeated, or ends after a later one, gives the same counters as runs one after the other.
    """
    new = read_run(spark, stats, run_ts).filter("depth = 2").drop("depth")
    new = new.groupBy("source_db_id").agg(*[F.sum(c).alias(c) for c in new.columns if c not in ("source_db_id", "pipeline_no")])
    sinks.replace_run(new, f"{path}_by_run", run_ts)
    runs = files.existing_runs(spark, f"{path}_by_run")
    for run in runs:
        if run >= run_ts:
            sinks.replace_run(_newest(spark, f"{path}_by_run", [r for r in runs if r <= run]), path, run)


def _newest(spark: SparkSession, path: str, runs: list[str]) -> DataFrame:
    """Per source the last value of every counter over the named runs, in their order."""
    sums = [read_run(spark, path, run).withColumn("_run", F.lit(number)) for number, run in enumerate(runs)]
    every = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), sums)
    counters = [c for c in every.columns if c not in ("source_db_id", "_run")]
    return every.groupBy("source_db_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_run"))).alias(c) for c in counters])


def _allowed(pairs: DataFrame, settings: Mapping) -> DataFrame:
    """The evaluators' allow-lists, and the one data set and model they look at."""
    data, options = settings.get("data", {}), settings.get("evaluation", {})
    for column, wanted in (("target_dataset", options.get("dataset_name")), ("model", options.get("model_dir"))):
        if wanted:
            pairs = pairs.filter(F.col(column) == wanted)
    pairs = P.allow(pairs, "target_db_id", data.get("target_databases", []))
    return P.allow(pairs, "source_db_id", data.get("source_databases", []))


def template_stage(spark: SparkSession, settings: Mapping, pairs: DataFrame, work: str, run_ts: str) -> DataFrame:
    """Structural labels, rejects and the three-level summary."""
    if "method" not in pairs.columns:
        pairs = pairs.withColumn("method", F.lit(method_of(settings.get("evaluation", {"method": "guided"}))))
    sinks.replace_run(label_templates(_allowed(pairs, settings)), f"{work}/labelled_template", run_ts, FILE_KEYS)
    labelled = read_run(spark, f"{work}/labelled_template", run_ts)
    sinks.replace_run(not_generated(labelled), f"{work}/not_generated", run_ts)
    sinks.write_summaries(template_summary(labelled), f"{work}/summary_template/run_ts={run_ts}")
    return labelled


def execution_stage(
    spark: SparkSession,
    settings: Mapping,
    sessions: Mapping[str, SparkSession],
    work: str,
    run_ts: str,
    seconds: float = QUERY_SECONDS,
    parallel: int = 8,
    shard: int = 0,
    shards: int = 1,
) -> DataFrame:
    """Runs every distinct query once and labels all pairs with its outcome.

    Of several applications each runs its shard; the last one to end, run again or not, labels all.
    """
    pairs = _allowed(read_run(spark, f"{work}/labelled_template", run_ts), settings)
    outcomes = run_workload(pairs, sessions, f"{work}/outcomes/run_ts={run_ts}", seconds, parallel, shard=shard, shards=shards)
    labelled = label_workload(pairs, outcomes, [*FILE_KEYS, "ord"])
    sinks.replace_run(labelled, f"{work}/labelled_execution", run_ts, FILE_KEYS)
    labelled = read_run(spark, f"{work}/labelled_execution", run_ts)
    sinks.write_summaries(execution_summary(labelled), f"{work}/summary_execution/run_ts={run_ts}")
    return labelled


def rating_prompts_stage(
    spark: SparkSession, settings: Mapping, schemas: DataFrame, work: str, run_ts: str, base_prompt: str | None = None, root: str = "."
) -> DataFrame:
    """Judge prompts of the labelled pairs: one per file, or one per ``pairs_per_prompt`` of the settings.

    ``schemas``: db_id, schema_ddl of the targets. The judge's text comes from the
    settings' files unless it is given.
    """
    options = settings.get("evaluation", {})
    base = judge_text(spark, options, root) if base_prompt is None else base_prompt
    pairs = _allowed(read_run(spark, f"{work}/labelled_execution", run_ts), settings)
    parts = R.rating_parts(pairs, list(FILE_KEYS), options.get("pairs_per_prompt"))
    ddl = schemas.select(F.col("db_id").alias("target_db_id"), "schema_ddl")
    found = lookup(parts, ddl, ["target_db_id"], [*FILE_KEYS, "part"], how="left")
    prompt = R.rating_prompt(base, F.col("pairs_json"), F.col("schema_ddl"))
    sinks.replace_run(found.select(*FILE_KEYS, "part", "n_sent", prompt.alias("prompt")), f"{work}/rating_prompts", run_ts)
    return read_run(spark, f"{work}/rating_prompts", run_ts)


def semantic_stage(spark: SparkSession, settings: Mapping, answers: DataFrame, work: str, run_ts: str) -> DataFrame:
    """Judge answers (``RATINGS``) to labels. A file is labelled whole or, if an answer of its never fits, not at all."""
    options = settings.get("evaluation", {})
    file, part = list(FILE_KEYS), [*FILE_KEYS, "part"]
    failures = options.get("max_retry_per_prompt", RATING_FAILURES)
    asked = read_run(spark, f"{work}/rating_prompts", run_ts).select(*part, "n_sent")
    judged = A.rating_attempts(answers.join(asked, part), part, "n_sent", failures)
    sinks.replace_run(judged.withColumn("items", F.transform("items", lambda item: F.to_json(item))), f"{work}/judged", run_ts)
    judged = read_run(spark, f"{work}/judged", run_ts)
    good = A.accepted(judged).select(*part, F.posexplode("items").alias("pos", "rating_json"))
    sinks.replace_run(good, f"{work}/ratings_raw", run_ts, FILE_KEYS)
    raw = read_run(spark, f"{work}/ratings_raw", run_ts)
    ratings = R.read_ratings(raw.withColumn("item", F.parse_json("rating_json")), [*part, "pos"])
    pairs = _allowed(read_run(spark, f"{work}/labelled_execution", run_ts), settings)
    placed = R.place_in_part(pairs, file, options.get("pairs_per_prompt"))
    whole = R.complete_files(pairs, raw, file)
    sinks.replace_run(asked.select(*file).distinct().join(whole, file, "left_anti"), f"{work}/unrated", run_ts)
    zipped = lookup(placed.join(ratings, [*part, "pos"]), whole, file, ["ord"])
    sinks.replace_run(R.label_rated(zipped).drop("part", "pos"), f"{work}/labelled_semantic", run_ts, FILE_KEYS)
    labelled = read_run(spark, f"{work}/labelled_semantic", run_ts)
    sinks.write_summaries(semantic_summary(labelled), f"{work}/summary_semantic/run_ts={run_ts}")
    return labelled
