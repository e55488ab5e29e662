"""Checked queries: readers and writers, over files that Spark makes from the tables.

Every query writes to a folder of its own below the shared folder and reads that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.operators import attempts as A
from pairloom.operators.ordering import by_range
from pairloom.operators.rollups import template_summary
from pairloom.operators.template_labels import label_templates
from pairloom.plans.label_checks import raw_ratings
from pairloom.plans.prompt_checks import samples, settings
from pairloom.plans.registry import check
from pairloom.plans.response_checks import _STATS, used
from pairloom.plans.template_checks import _LABELLED, SUMMARY_SQL
from pairloom.session import fresh_folder
from pairloom.sources import files, sinks
from pairloom.sources.sinks import PAIR_KEYS

col = F.col
RUN = "2025-01-01_00-00-00"


def write_texts(texts: DataFrame, folder: str, *keys: str) -> str:
    """One text per folder ``<key>=<value>/..``, as the exchange layout has one text per file."""
    texts.write.partitionBy(*keys).text(folder)
    return folder


def json_arrays(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows as JSON arrays of at most one bucket of consecutive ``ord`` each."""
    item = F.struct("ord", *fields)
    plain = F.transform(F.array_sort(F.collect_list(item)), lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    grouped = rows.withColumn("chunk", by_range(col("ord"))).groupBy(*keys, "chunk")
    return grouped.agg(F.to_json(plain, {"ignoreNullFields": "false"}).alias("text"))


def file_name(prefix: str, db_id: str):
    return F.concat(F.lit(prefix), db_id, F.lit("."), col("chunk").cast("string"), F.lit(".json"))


@check(
    "scan_questions",
    "SELECT dataset, db_id, question, query, row_number() OVER (PARTITION BY dataset, db_id, ord // 65536 ORDER BY ord) - 1 AS ord FROM questions",
    "questions",
)
def _(t):
    fields = ["dataset", "db_id", "question", "query"]
    arrays = json_arrays(t.view("questions"), ["dataset", "db_id"], fields)
    texts = arrays.select("text", "dataset", file_name("question_", "db_id").alias("file"))
    folder = write_texts(texts, fresh_folder(t.spark, "questions"), "dataset", "file")
    return files.scan_questions(t.spark, folder, deep=True).select(*fields, "ord")


@check(
    "scan_samples",
    "SELECT dataset, db_id, 'orders' AS table_name, CAST(n - 1 AS INT) AS row_ord, '[' || CAST(o AS VARCHAR) || ']' AS row_values FROM "
    "(SELECT o_orderstatus AS dataset, o_orderpriority AS db_id, o_orderkey AS o, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3",
)
def _(t):
    texts = samples(t).select(
        col("samples_json").alias("text"), "dataset", F.concat(F.lit("sample_"), "db_id", F.lit(".json")).alias("file")
    )
    folder = write_texts(texts, fresh_folder(t.spark, "samples"), "dataset", "file")
    rows = files.sample_rows(files.scan_samples(t.spark, folder, deep=True))
    dataset = F.regexp_extract("path", "dataset=([^/]*)/", 1).alias("dataset")
    return rows.select(dataset, "db_id", "table_name", "row_ord", F.to_json("row_values").alias("row_values"))


@check("scan_schemas", "SELECT dataset, db_id, schema_ddl FROM schemas", "schemas")
def _(t):
    entry = F.struct("db_id", "schema_ddl")
    chunk = F.pmod(F.xxhash64("db_id"), F.lit(16)).alias("chunk")
    texts = t.view("schemas").groupBy("dataset", chunk).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text")
    )
    folder = write_texts(texts, fresh_folder(t.spark, "schemas"), "dataset", "chunk")
    dataset = F.regexp_extract("path", "dataset=([^/]*)/", 1).alias("dataset")
    return files.scan_schemas(t.spark, folder).select(dataset, "db_id", "schema_ddl")


def keyed_pairs(t):
    return t.view("pairs").withColumns({"target_dataset": F.lit("dev"), "model": F.lit("m1")})


_PAIR_COLUMNS = "target_db_id, source_db_id, source_query, target_query, target_question"


@check(
    "scan_mappings",
    f"SELECT 'dev' AS target_dataset, 'm1' AS model, {_PAIR_COLUMNS}, row_number() OVER (PARTITION BY target_db_id, source_db_id, ord // 65536 ORDER BY ord) - 1 AS ord FROM pairs",
    "pairs",
)
def _(t):
    fields = ["source_query", "target_query", "target_question"]
    arrays = json_arrays(keyed_pairs(t), list(PAIR_KEYS), fields)
    texts = arrays.select(
        "text", "target_dataset", "model", "target_db_id", "chunk",
        F.concat(F.lit("response_"), "source_db_id", F.lit(".json")).alias("file"),
    )
    folder = fresh_folder(t.spark, "mappings")
    write_texts(texts, folder, "chunk", "target_dataset", "model", "target_db_id", "file")
    return files.scan_mappings(t.spark, folder, fields=["source_db_id", "target_db_id", *fields])


@check("sink_mappings", f"SELECT ord, 'dev' AS target_dataset, 'm1' AS model, {_PAIR_COLUMNS} FROM pairs WHERE source_db_id <> '5-LOW' OR ord % 2 = 0", "pairs")
def _(t):
    path, pairs = fresh_folder(t.spark, "mappings"), keyed_pairs(t)
    sinks.write_mappings(pairs, path)
    # a second write for one source replaces that source and nothing else
    sinks.write_mappings(pairs.filter((col("source_db_id") == "5-LOW") & (col("ord") % 2 == 0)), path)
    return t.spark.read.parquet(path)


@check("sink_labelled", f"SELECT ord, target_db_id, source_db_id, same_template FROM ({_LABELLED})", "pairs")
def _(t):
    path = fresh_folder(t.spark, "labelled")
    sinks.write_labelled(label_templates(t.view("pairs")), path, ["target_db_id", "source_db_id"])
    return t.spark.read.parquet(path).select("ord", "target_db_id", "source_db_id", "same_template")


@check("scan_evaluated", f"SELECT ord, target_db_id, source_db_id, is_generated FROM ({_LABELLED}) WHERE target_db_id = 'F' AND source_db_id IN ('2-HIGH', '5-LOW')", "pairs")
def _(t):
    path = fresh_folder(t.spark, "labelled")
    sinks.write_labelled(label_templates(t.view("pairs")), path, ["target_db_id", "source_db_id"])
    rows = files.scan_table(t.spark, path, targets=["F"], sources=["2-HIGH", "5-LOW"])
    return rows.select("ord", "target_db_id", "source_db_id", "is_generated")


@check("sink_transcript", f"SELECT prompt_id, attempt, response, '{RUN}' AS run_ts FROM responses WHERE response <> ''", "responses")
def _(t):
    path = fresh_folder(t.spark, "transcripts")
    answers = t.view("responses").select("prompt_id", "attempt", "response")
    sinks.append_transcripts(answers.filter(col("attempt") % 2 == 0), path, RUN)
    sinks.append_transcripts(answers.filter(col("attempt") % 2 == 1), path, RUN)
    return t.spark.read.parquet(path).withColumn("run_ts", col("run_ts").cast("string"))


@check("sink_summaries", f"SELECT level, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, CAST(sum(success) AS BIGINT) AS success FROM ({SUMMARY_SQL}) GROUP BY level", "pairs")
def _(t):
    path = fresh_folder(t.spark, "summaries")
    sinks.write_summaries(template_summary(label_templates(t.view("pairs"))), path)
    written = t.spark.read.schema("level string, total bigint, success bigint").json(path)
    return written.groupBy("level").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.sum("success").alias("success"))


@check("sink_ratings_raw", "SELECT ord, target_db_id, source_db_id, is_clear_and_meaningful AS clear FROM ratings", "ratings")
def _(t):
    path = fresh_folder(t.spark, "ratings")
    sinks.write_ratings_raw(raw_ratings(t).select("ord", "target_db_id", "source_db_id", "item"), path)
    rating = F.parse_json("rating_json")
    clear = F.coalesce(
        F.try_variant_get(rating, "$.clarity_and_alignment_of_NL.is_clear_and_meaningful", "string"),
        F.try_variant_get(rating, "$.clarity_of_NL.is_clear_and_meaningful", "string"),
    )
    return t.spark.read.parquet(path).select("ord", "target_db_id", "source_db_id", clear.alias("clear"))


@check(
    "upsert_stats",
    f"""SELECT coalesce(n.source_db_id, o.source_db_id) AS source_db_id, coalesce(n.request, o.request) AS request, o.response AS response
        FROM (SELECT source_db_id, request, response FROM ({_STATS}) WHERE depth = 2 AND pipeline_no = 0) o
        FULL JOIN (SELECT source_db_id, request + 100 AS request FROM ({_STATS}) WHERE depth = 2 AND pipeline_no = 1 AND source_db_id <> 'db0') n
        ON o.source_db_id = n.source_db_id""",
    "responses",
)
def _(t):
    stats = A.generation_stats(used(t), ["pipeline_no", "source_db_id"]).filter(col("depth") == 2)
    old = stats.filter(col("pipeline_no") == 0).select("source_db_id", "request", "response")
    new = stats.filter((col("pipeline_no") == 1) & (col("source_db_id") != "db0"))
    return sinks.upsert_stats(old, new.select("source_db_id", (col("request") + 100).alias("request")))


@check(
    "run_snapshot",
    f"SELECT '{RUN}' AS run_ts, pipeline_no, target_db_id, question_limit FROM settings",
    "settings",
)
def _(t):
    path = fresh_folder(t.spark, "snapshots")
    sinks.snapshot_settings(settings(t), path, RUN)
    kept = F.from_json("settings_json", "pipeline_no int, target_db_id string, question_limit int")
    return t.spark.read.parquet(path).select(col("run_ts").cast("string").alias("run_ts"), kept.alias("s")).select("run_ts", "s.*")
