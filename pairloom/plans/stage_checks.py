"""Checked queries: what the stages keep apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import json_text as J
from pairloom.operators import attempts as A
from pairloom.operators import prompts as P
from pairloom.plans.prompt_checks import _SAMPLES, samples, settings
from pairloom.plans.registry import check
from pairloom.plans.response_checks import _USED, used
from pairloom.session import fresh_folder, stored
from pairloom.sources import sinks

col = F.col

_LISTED = "SELECT pipeline_no, source_dataset AS dataset, unnest(split(source_db_list, ',')) AS db_id FROM settings WHERE source_db_list <> ''"
_TARGETS = "SELECT pipeline_no, target_dataset AS dataset, target_db_id AS db_id FROM settings"


@check(
    "skipped_pipelines",
    f"""SELECT *, 'no schema' AS reason FROM ({_LISTED} UNION {_TARGETS}) n
      WHERE NOT EXISTS (SELECT 1 FROM schemas s WHERE s.dataset = n.dataset AND s.db_id = n.db_id)
    UNION SELECT *, 'no samples' FROM ({_TARGETS}) n WHERE NOT EXISTS (SELECT 1 FROM {_SAMPLES} s WHERE s.dataset = n.dataset AND s.db_id = n.db_id)
    UNION SELECT *, 'no questions' FROM ({_LISTED}) n WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.dataset = n.dataset AND q.db_id = n.db_id)
    UNION SELECT pipeline_no, source_dataset, NULL, 'no questions' FROM settings WHERE source_dataset NOT IN (SELECT dataset FROM questions)""",
    "settings",
    "schemas",
    "questions",
)
def _(t):
    skipped = P.skipped_pipelines(settings(t), t.view("schemas"), samples(t), t.view("questions"))
    return skipped.select("pipeline_no", "dataset", "db_id", "reason")


@check(
    "mappings_of_overlapping_pipelines",
    f"""SELECT source_db_id, prompt_id, pos, row_number() OVER (PARTITION BY source_db_id ORDER BY prompt_id, pos) - 1 AS ord
        FROM (SELECT *, unnest(range(len(elements))) AS pos, max(pipeline_no) OVER (PARTITION BY source_db_id) AS newest
          FROM ({_USED}) WHERE error_class IS NULL AND len(elements) > 0) WHERE pipeline_no = newest""",
    "responses",
)
def _(t):
    # every pipeline asks about the same sources; of each source the last pipeline's pairs stay
    items = A.explode_items(A.accepted(used(t)), ["pipeline_no", "source_db_id", col("prompt_id").alias("batch_no")])
    query = J.text_field(col("item"), "target_query").alias("target_query")
    items = stored(items.select("pipeline_no", "source_db_id", "batch_no", col("pos").cast("bigint").alias("pos"), query), "items")
    numbered = A.number_mappings(A.last_pipelines(items, ["source_db_id"]), ["source_db_id"])
    return numbered.select("source_db_id", col("batch_no").alias("prompt_id"), "pos", "ord")


@check(
    "repeated_run",
    "SELECT ord, target_db_id, source_db_id FROM pairs WHERE ord % 3 = 0",
    "pairs",
)
def _(t):
    path, keys = fresh_folder(t.spark, "runs"), ["target_db_id", "source_db_id"]
    pairs = t.view("pairs").select("ord", *keys)
    # a stage that is repeated leaves nothing of its first attempt; another run is not looked at
    for run, rows in (("a", pairs), ("b", pairs.filter("ord % 5 = 0")), ("a", pairs.filter("ord % 3 = 0"))):
        sinks.replace_run(rows, path, run, keys)
    return t.spark.read.parquet(f"{path}/run_ts=a").select("ord", *keys)
