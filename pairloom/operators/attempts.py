"""Model answers: reading, validation, choice of the valid attempt, bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions import json_text as J
from pairloom.functions.vocabulary import ATTEMPTS_PER_PROMPT, ERROR_CLASSES, FAILURE_LIMIT
from pairloom.operators.joins import lookup
from pairloom.operators.layout import spread_small
from pairloom.operators.ordering import by_range, running_sum


def finish_reason(code: Column) -> Column:
    """Service codes to names; anything else is no reason at all."""
    upper = F.upper(code.cast("string"))
    return F.when(upper.isin("4", "RECITATION"), "RECITATION").when(upper.isin("2", "MAX_TOKENS"), "MAX_TOKENS").otherwise("")


def early_error(error: Column, response: Column, reason: Column) -> Column:
    """Failures that show before any JSON is read, first match wins."""
    reason = F.upper(reason)
    return (
        F.when(error.isNotNull(), "unexpected")
        .when(F.coalesce(response, F.lit("")) == "", "empty_output")
        .when(reason.isin("MAX_TOKEN", "MAX_TOKENS"), "max_token")
        .when(reason == "RECITATION", "recitation")
    )


def read_items(attempts: DataFrame, body: Column) -> DataFrame:
    """Add ``items`` (the array's elements), ``corrected`` and ``json_problem``.

    The native parser reads nearly everything. Only what it turns down is handed
    to Python, where missing commas are put in and errors are told apart.
    """
    first = spread_small(attempts).withColumn("_body", body).withColumn("_items", J.json_items(F.col("_body")))
    again = J.reread_json(F.when(F.col("_items").isNull(), F.col("_body")))
    second = first.withColumn("_again", again).withColumn("_mended", J.json_items(F.col("_again.text")))
    return second.withColumns(
        {
            "items": F.coalesce("_items", "_mended"),
            "corrected": F.coalesce(F.col("_again.mended"), F.lit(False)),
            "json_problem": F.when(
                F.col("_body").isNotNull() & F.col("_items").isNull() & F.col("_mended").isNull(),
                F.coalesce(F.col("_again.problem"), F.lit("json_decode")),
            ),
        }
    ).drop("_body", "_items", "_again", "_mended")


def classify(
    attempts: DataFrame, fields, check_fields: bool = True, check_db_ids: bool = True
) -> DataFrame:
    """Add ``items, corrected, mismatches, error_class, valid`` to each attempt.

    Needs ``response, finish_reason, error, source_db_id, target_db_id``. A narrow
    step: nothing is shuffled.
    """
    early = attempts.withColumn(
        "_early", early_error(F.col("error"), F.col("response"), F.col("finish_reason"))
    )
    read = read_items(early, F.when(F.col("_early").isNull(), J.slice_json_array(F.col("response"))))
    wrong_fields = F.lit(False)
    if check_fields:
        wrong_fields = F.coalesce(~J.has_fields(F.col("items"), fields), F.lit(False))
    checked = read.withColumn("_wrong_fields", wrong_fields)
    mismatches = F.lit(0)
    if check_db_ids:
        counted = J.db_id_mismatches(F.col("items"), F.col("source_db_id"), F.col("target_db_id"))
        mismatches = F.when(F.col("items").isNotNull() & ~F.col("_wrong_fields"), counted)
    return (
        checked.withColumn("mismatches", mismatches)
        .withColumn(
            "error_class",
            F.coalesce(
                F.col("_early"),
                F.col("json_problem"),
                F.when(F.col("_wrong_fields"), "fields_mismatch"),
                F.when(F.col("mismatches") > 0, "db_id_matching"),
            ),
        )
        .withColumn("valid", F.col("error_class").isNull())
        .drop("_early", "_wrong_fields", "json_problem")
    )


def error_flags(error_class: Column) -> Column:
    """The same as eight switches, of which at most one is on."""
    return F.struct(*[F.coalesce(error_class == name, F.lit(False)).alias(name) for name in ERROR_CLASSES])


def used_attempts(attempts: DataFrame, prompt: list[str], limit: int = ATTEMPTS_PER_PROMPT) -> DataFrame:
    """Attempts that really take place: up to the first valid one, ``limit`` at most.

    Adds ``first_valid`` (null if none) and ``last_attempt``. Each prompt has at
    most ``limit`` rows left when it is shuffled, so no prompt can be hot.
    """
    per_prompt = Window.partitionBy(*prompt)
    return (
        attempts.filter(F.col("attempt") < limit)
        .withColumn("first_valid", F.min(F.when(F.col("valid"), F.col("attempt"))).over(per_prompt))
        .withColumn("last_attempt", F.max("attempt").over(per_prompt))
        .filter(F.col("attempt") <= F.coalesce("first_valid", "last_attempt"))
    )


def accepted(used: DataFrame) -> DataFrame:
    return used.filter(F.col("valid"))


def rejected(used: DataFrame) -> DataFrame:
    """One row per prompt that stayed without a valid answer, with its last failure."""
    return used.filter(F.col("first_valid").isNull() & (F.col("attempt") == F.col("last_attempt")))


def explode_items(answers: DataFrame, keep: list[str]) -> DataFrame:
    """One row per element of an accepted answer, with its place in the answer."""
    return answers.select(*keep, F.posexplode("items").alias("pos", "item"))


def last_pipelines(items: DataFrame, keys: list[str]) -> DataFrame:
    """Of pipelines with the same source and target only the last one's rows stay, as a later file replaces an earlier."""
    last = items.groupBy(*keys).agg(F.max("pipeline_no").alias("pipeline_no"))
    return lookup(items, last, [*keys, "pipeline_no"], ["batch_no", "pos"], how="left_semi")


def as_mappings(items: DataFrame, fields, keep: list[str]) -> DataFrame:
    """Elements as columns, one text column per field."""
    return items.select(*keep, *[J.text_field(F.col("item"), name).alias(name) for name in fields])


def number_mappings(items: DataFrame, keys: list[str], batch: str = "batch_no", pos: str = "pos", out: str = "ord") -> DataFrame:
    """Batches put one after the other: a running place per key, from 0."""
    bucket = by_range(F.col(batch), 12)
    numbered = running_sum(items, keys, bucket, [F.col(batch), F.col(pos)], F.lit(1), out)
    return numbered.withColumn(out, F.col(out) - 1)


def is_exception(error_class: Column) -> Column:
    return F.coalesce(error_class == "unexpected", F.lit(False))


def count_failures(used: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Add ``failures``: exceptions in the whole run up to and including each attempt."""
    failed = is_exception(F.col("error_class")).cast("bigint")
    return running_sum(used, [], bucket, [F.col(name) for name in order], failed, "failures")


def stop_after_failures(used: DataFrame, order: list[str], limit: int = FAILURE_LIMIT) -> DataFrame:
    """The run up to and including the attempt whose exception reaches the limit.

    That attempt is the last of the first ``limit`` exceptions, a top-k of keys only.
    The attempts themselves are filtered where they lie.
    """
    at = F.struct(*order)
    first = used.filter(is_exception(F.col("error_class"))).select(at.alias("at")).orderBy("at").limit(limit)
    stop = first.agg(F.when(F.count(F.lit(1)) == limit, F.max("at"))).scalar()
    return used.filter(F.coalesce(at <= stop, F.lit(True)))


STATS = (
    "time_taken", "real_time", "input_token", "output_token", "request", "response",
    "success_response", "error_response", "corrected_response", "unexpected_error",
)


def generation_stats(used: DataFrame, keys: list[str]) -> DataFrame:
    """The ten counters per key and rolled up over the keys.

    Every answer counts with its tokens and time, also an invalid one; an attempt
    that ended in an exception counts as a request only. The columns
    ``prompt_tokens, response_tokens, time_taken`` come with the attempts;
    ``real_time`` is taken from there too if present.
    """
    answered = F.coalesce(F.col("error_class") != "unexpected", F.lit(True))
    number = lambda c: F.coalesce(c, F.lit(0))
    real_time = F.col("real_time") if "real_time" in used.columns else F.lit(0.0)
    measures = {
        "time_taken": F.sum(F.when(answered, number(F.col("time_taken"))).otherwise(0.0)),
        "real_time": F.sum(number(real_time)),
        "input_token": F.sum(F.when(answered, number(F.col("prompt_tokens"))).otherwise(0)),
        "output_token": F.sum(F.when(answered, number(F.col("response_tokens"))).otherwise(0)),
        "request": F.count(F.lit(1)),
        "success_response": F.count_if(F.col("valid") & ~F.col("corrected")),
        "error_response": F.count_if(answered & ~F.col("valid")),
        "corrected_response": F.count_if(F.col("valid") & F.col("corrected")),
        "unexpected_error": F.count_if(~answered),
    }
    finest = used.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])
    return (
        finest.rollup(*keys)
        .agg(
            (F.lit(len(keys)) - F.bit_count(F.grouping_id())).alias("depth"),
            *[F.sum(name).alias(name) for name in measures],
        )
        .withColumn("response", F.col("success_response") + F.col("error_response") + F.col("corrected_response"))
        .select("depth", *keys, *STATS)
    )


def exception_stats(used: DataFrame, keys: list[str]) -> DataFrame:
    """Exceptions per key and text. A count per text stays small where a list would not."""
    return used.filter(F.col("error_class") == "unexpected").groupBy(*keys, "error").agg(F.count(F.lit(1)).alias("n"))


def rating_attempts(attempts: DataFrame, prompt: list[str], expected: str, failures: int) -> DataFrame:
    """Judge answers up to the first usable one: readable, and as long as what was sent.

    One attempt more than ``failures`` takes place before a prompt stays unrated.
    """
    early = attempts.withColumn("_early", early_error(F.col("error"), F.col("response"), F.col("finish_reason")))
    read = read_items(early, F.when(F.col("_early").isNull(), J.slice_json_array(F.col("response"))))
    usable = F.coalesce(F.size("items") == F.col(expected), F.lit(False)) & F.col("_early").isNull()
    return used_attempts(read.withColumn("valid", usable).drop("_early"), prompt, failures + 1)
