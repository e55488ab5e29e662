"""Checked queries: model answers (view ``responses``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import json_text as J
from pairloom.functions.vocabulary import ERROR_CLASSES, RATING_FAILURES
from pairloom.operators import attempts as A
from pairloom.operators.ordering import even_ranges
from pairloom.plans.registry import check
from pairloom.session import stored

FIELDS = ("source_db_id", "target_db_id", "target_query")


def attempts(t):
    return t.view("responses").withColumn("target_db_id", F.lit("tgt"))


def classified(t):
    return A.classify(attempts(t), FIELDS)


def used(t):
    return A.used_attempts(classified(t), ["prompt_id"])


# The twin reads the answers with the other engine's own JSON functions. The view
# holds no answer that a comma would save, so unreadable means json_decode.
_CLASSIFIED = """
SELECT *, CASE
    WHEN error IS NOT NULL THEN 'unexpected'
    WHEN response = '' THEN 'empty_output'
    WHEN finish_reason = 'MAX_TOKENS' THEN 'max_token'
    WHEN finish_reason = 'RECITATION' THEN 'recitation'
    WHEN NOT readable THEN 'json_decode'
    WHEN NOT fields_ok THEN 'fields_mismatch'
    WHEN mismatches > 0 THEN 'db_id_matching' END AS error_class
FROM (SELECT *,
    body <> '' AND json_valid(body) AS readable,
    CASE WHEN body <> '' AND json_valid(body) THEN list_bool_and([list_sort(json_keys(e)) = ['source_db_id', 'target_db_id', 'target_query'] FOR e IN elements]) END AS fields_ok,
    CASE WHEN body <> '' AND json_valid(body) THEN list_sum([CAST(json_extract_string(e, '$.source_db_id') IS DISTINCT FROM source_db_id AS INT)
      + CAST(json_extract_string(e, '$.target_db_id') IS DISTINCT FROM 'tgt' AS INT) FOR e IN elements]) END AS mismatches
  FROM (SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN CAST(json_extract(CASE WHEN json_valid(body) THEN body ELSE '[]' END, '$[*]') AS JSON[]) END AS elements
    FROM (SELECT *, regexp_extract(response, '\\[.*\\]', 0, 's') AS body FROM responses)))
"""
_USED = f"""
SELECT * FROM (SELECT *, min(CASE WHEN error_class IS NULL THEN attempt END) OVER (PARTITION BY prompt_id) AS first_valid,
    max(attempt) OVER (PARTITION BY prompt_id) AS last_attempt
  FROM ({_CLASSIFIED}) WHERE attempt < 3)
WHERE attempt <= coalesce(first_valid, last_attempt)
"""
_ITEMS = f"""
SELECT prompt_id, source_db_id, pos, elements[pos + 1] AS item
FROM (SELECT *, unnest(range(len(elements))) AS pos FROM ({_USED}) WHERE error_class IS NULL)
"""


@check("slice_json_array", "SELECT prompt_id, attempt, regexp_extract(response, '\\[.*\\]', 0, 's') AS body FROM responses", "responses")
def _(t):
    return attempts(t).select("prompt_id", "attempt", J.slice_json_array(F.col("response")).alias("body"))


@check("error_class", f"SELECT prompt_id, attempt, error_class FROM ({_CLASSIFIED})", "responses")
def _(t):
    return classified(t).select("prompt_id", "attempt", "error_class")


@check(
    "error_flags",
    f"SELECT prompt_id, attempt, {', '.join(f'coalesce(error_class = {chr(39)}{n}{chr(39)}, false) AS {n}' for n in ERROR_CLASSES)} FROM ({_CLASSIFIED})",
    "responses",
)
def _(t):
    return classified(t).select("prompt_id", "attempt", A.error_flags(F.col("error_class")).alias("f")).select("prompt_id", "attempt", "f.*")


_READABLE = f"FROM ({_CLASSIFIED}) WHERE error IS NULL AND response <> '' AND finish_reason = '' AND readable"


@check("check_fields", f"SELECT prompt_id, attempt, fields_ok {_READABLE}", "responses")
def _(t):
    ok = J.has_fields(F.col("items"), FIELDS)
    return classified(t).filter(F.col("items").isNotNull()).select("prompt_id", "attempt", ok.alias("fields_ok"))


@check("key_set_equal", f"SELECT fields_ok, count(*) AS n {_READABLE} GROUP BY fields_ok", "responses")
def _(t):
    ok = J.has_fields(F.col("items"), FIELDS)
    return classified(t).filter(F.col("items").isNotNull()).groupBy(ok.alias("fields_ok")).agg(F.count("*").alias("n"))


@check("db_id_mismatches", f"SELECT prompt_id, attempt, CAST(mismatches AS INT) AS mismatches {_READABLE} AND fields_ok", "responses")
def _(t):
    return classified(t).filter(F.col("mismatches").isNotNull()).select("prompt_id", "attempt", "mismatches")


@check("check_db_id", f"SELECT prompt_id, attempt, mismatches = 0 AS ids_ok {_READABLE} AND fields_ok", "responses")
def _(t):
    ids_ok = (F.col("mismatches") == 0).alias("ids_ok")
    return classified(t).filter(F.col("mismatches").isNotNull()).select("prompt_id", "attempt", ids_ok)


@check(
    "finish_reason",
    "SELECT c, reason, count(*) AS n FROM (SELECT c, CASE WHEN c IN ('4', 'RECITATION') THEN 'RECITATION' WHEN c IN ('2', 'MAX_TOKENS') THEN 'MAX_TOKENS' ELSE '' END AS reason "
    "FROM (SELECT CASE WHEN finish_reason <> '' THEN finish_reason ELSE CAST(attempt AS VARCHAR) END AS c FROM responses)) GROUP BY c, reason",
    "responses",
)
def _(t):
    code = F.when(F.col("finish_reason") != "", F.col("finish_reason")).otherwise(F.col("attempt").cast("string"))
    coded = t.view("responses").select(code.alias("c"))
    return coded.groupBy("c", A.finish_reason(F.col("c")).alias("reason")).agg(F.count("*").alias("n"))


@check("first_valid_attempt", f"SELECT prompt_id, attempt, error_class, first_valid FROM ({_USED})", "responses")
def _(t):
    return used(t).select("prompt_id", "attempt", "error_class", "first_valid")


@check(
    "any_error",
    f"SELECT prompt_id, max(first_valid) IS NULL AS skipped, CASE WHEN max(first_valid) IS NULL THEN arg_max(error_class, attempt) END AS last_error FROM ({_USED}) GROUP BY prompt_id",
    "responses",
)
def _(t):
    skipped = F.max("first_valid").isNull()
    last = F.max_by("error_class", "attempt")
    return used(t).groupBy("prompt_id").agg(skipped.alias("skipped"), F.when(skipped, last).alias("last_error"))


@check(
    "sink_rejects",
    f"SELECT prompt_id, source_db_id, attempt, error_class, response FROM ({_USED}) WHERE first_valid IS NULL AND attempt = last_attempt",
    "responses",
)
def _(t):
    return A.rejected(used(t)).select("prompt_id", "source_db_id", "attempt", "error_class", "response")


@check(
    "explode_mappings",
    "SELECT prompt_id, pos, json_extract_string(item, '$.source_db_id') AS source_db_id, "
    f"json_extract_string(item, '$.target_db_id') AS target_db_id, json_extract_string(item, '$.target_query') AS target_query FROM ({_ITEMS})",
    "responses",
)
def _(t):
    items = A.explode_items(A.accepted(used(t)), ["prompt_id"])
    return A.as_mappings(items, FIELDS, ["prompt_id", F.col("pos").cast("bigint")])


@check(
    "concat_batches",
    "SELECT source_db_id, prompt_id, pos, row_number() OVER (PARTITION BY source_db_id ORDER BY prompt_id, pos) - 1 AS ord, "
    f"json_extract_string(item, '$.target_query') AS target_query FROM ({_ITEMS})",
    "responses",
)
def _(t):
    items = A.explode_items(A.accepted(used(t)), ["source_db_id", "prompt_id"])
    query = J.text_field(F.col("item"), "target_query").alias("target_query")
    # numbering looks at its rows twice, the answers are to be read once
    items = stored(items.select("source_db_id", "prompt_id", F.col("pos").cast("bigint").alias("pos"), query), "items")
    return A.number_mappings(items, ["source_db_id"], batch="prompt_id")


_STATS = f"""
SELECT CASE WHEN grouping(pipeline_no) = 1 THEN 0 WHEN grouping(source_db_id) = 1 THEN 1 ELSE 2 END AS depth, pipeline_no, source_db_id,
  CAST(coalesce(sum(time_taken) FILTER (WHERE error IS NULL), 0) AS DOUBLE) AS time_taken, CAST(0 AS DOUBLE) AS real_time,
  CAST(coalesce(sum(prompt_tokens) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS input_token,
  CAST(coalesce(sum(response_tokens) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS output_token,
  count(*) AS request, count(*) FILTER (WHERE error IS NULL) AS response,
  count(*) FILTER (WHERE error_class IS NULL) AS success_response,
  count(*) FILTER (WHERE error IS NULL AND error_class IS NOT NULL) AS error_response,
  CAST(0 AS BIGINT) AS corrected_response, count(*) FILTER (WHERE error IS NOT NULL) AS unexpected_error
FROM ({_USED}) GROUP BY ROLLUP (pipeline_no, source_db_id)
"""


@check("generation_stats", _STATS, "responses")
def _(t):
    return A.generation_stats(used(t), ["pipeline_no", "source_db_id"])


@check("response_total", f"SELECT source_db_id, pipeline_no, success_response + error_response + corrected_response AS response FROM ({_STATS}) WHERE depth = 2", "responses")
def _(t):
    stats = A.generation_stats(used(t), ["pipeline_no", "source_db_id"])
    return stats.filter(F.col("depth") == 2).select("pipeline_no", "source_db_id", "response")


@check("exception_stats", f"SELECT source_db_id, error, count(*) AS n FROM ({_USED}) WHERE error IS NOT NULL GROUP BY source_db_id, error", "responses")
def _(t):
    return A.exception_stats(used(t), ["source_db_id"])


_COUNTED = f"""SELECT *, CAST(sum(CAST(error IS NOT NULL AS INT)) OVER (ORDER BY prompt_id, attempt) AS BIGINT) AS failures FROM ({_USED})"""


@check("failure_count", f"SELECT prompt_id, attempt, failures FROM ({_COUNTED})", "responses")
def _(t):
    attempts = stored(used(t).select("prompt_id", "attempt", "error_class"), "attempts")
    counted = A.count_failures(attempts, ["prompt_id", "attempt"], even_ranges(attempts, "prompt_id"))
    return counted.select("prompt_id", "attempt", "failures")


@check(
    "failure_cutoff",
    f"SELECT prompt_id, attempt, error_class FROM ({_COUNTED}) WHERE failures - CAST(error IS NOT NULL AS INT) < 10",
    "responses",
)
def _(t):
    run = A.stop_after_failures(used(t), ["prompt_id", "attempt"], limit=10)
    return run.select("prompt_id", "attempt", "error_class")


@check(
    "rating_retry",
    f"""SELECT prompt_id, attempt, usable, first_valid FROM (
      SELECT *, min(CASE WHEN usable THEN attempt END) OVER (PARTITION BY prompt_id) AS first_valid, max(attempt) OVER (PARTITION BY prompt_id) AS last_attempt
      FROM (SELECT *, error IS NULL AND response <> '' AND finish_reason = '' AND readable AND coalesce(len(elements), 0) = 2 AS usable FROM ({_CLASSIFIED}))
      WHERE attempt < 6) WHERE attempt <= coalesce(first_valid, last_attempt)""",
    "responses",
)
def _(t):
    judged = A.rating_attempts(attempts(t).withColumn("n_sent", F.lit(2)), ["prompt_id"], "n_sent", RATING_FAILURES)
    return judged.select("prompt_id", "attempt", F.col("valid").alias("usable"), "first_valid")


# Damaged answers made from the orders: what is wrong with each is known in advance.
_BROKEN = """
SELECT o_orderkey AS ord, CASE o_orderkey % 8
    WHEN 0 THEN '[{{"a":"' || o_orderpriority || '"}},{{"a":"y"}}]'
    WHEN 1 THEN '[{{"a":"' || o_orderpriority || '"}} {{"a":"y"}}]'
    WHEN 2 THEN '[' || chr(10) || '{{"a":"' || o_orderpriority || '"}}' || chr(10) || '{{"a":"y"}}' || chr(10) || '{{"a":"z"}}]'
    WHEN 3 THEN '[{{"a":"' || o_orderpriority || '\\d"}}]'
    WHEN 4 THEN '[{{"a":"' || o_orderpriority || '"}},]'
    WHEN 5 THEN '[{{"a":"' || o_orderpriority || '"}}] and [1]'
    WHEN 6 THEN '[{{"a":"' || o_orderpriority || '" "b":"\\q"}}]'
    ELSE '[{{"a":"x","a":"' || o_orderpriority || '"}}]' END AS body
FROM {orders}"""
_EXPECTED = """
SELECT o_orderkey AS ord,
  CASE o_orderkey % 8 WHEN 3 THEN 'invalid_escape' WHEN 6 THEN 'invalid_escape' WHEN 4 THEN 'json_decode' WHEN 5 THEN 'json_decode' END AS problem,
  o_orderkey % 8 IN (1, 2) AS corrected,
  CASE o_orderkey % 8 WHEN 0 THEN '[{"a":"' || o_orderpriority || '"},{"a":"y"}]' WHEN 1 THEN '[{"a":"' || o_orderpriority || '"},{"a":"y"}]'
    WHEN 2 THEN '[{"a":"' || o_orderpriority || '"},{"a":"y"},{"a":"z"}]' WHEN 7 THEN '[{"a":"' || o_orderpriority || '"}]' END AS fixed
FROM orders"""


def broken(t):
    return t.sql(_BROKEN.replace("\\", "\\\\"))


@check("classify_json", f"SELECT ord, CASE WHEN corrected THEN 'missing_comma' ELSE coalesce(problem, 'valid') END AS kind FROM ({_EXPECTED})")
def _(t):
    read = A.read_items(broken(t), F.col("body"))
    kind = F.when(F.col("corrected"), "missing_comma").otherwise(F.coalesce("json_problem", F.lit("valid")))
    return read.select("ord", kind.alias("kind"))


@check("repair_commas", f"SELECT ord, corrected, fixed FROM ({_EXPECTED})")
def _(t):
    read = A.read_items(broken(t), F.col("body"))
    fixed = F.concat(F.lit("["), F.array_join(F.transform("items", lambda item: F.to_json(item)), ","), F.lit("]"))
    return read.select("ord", "corrected", fixed.alias("fixed"))
