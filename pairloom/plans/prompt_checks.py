"""Checked queries: from source questions to prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import prompts as P
from pairloom.operators.ordering import batch_number, number_questions
from pairloom.plans.registry import check

col = F.col


def settings(t):
    ids = F.when(col("source_db_list") == "", F.array().cast("array<string>")).otherwise(F.split("source_db_list", ","))
    return t.view("settings").withColumn("source_db_ids", ids).drop("source_db_list")


def samples(t):
    """One JSON text of sample rows per target database: its three smallest orders."""
    return t.sql(
        """SELECT dataset, db_id, '{{"orders": [' || listagg('[' || CAST(o AS STRING) || ']', ', ') WITHIN GROUP (ORDER BY o) || ']}}' AS samples_json
        FROM (SELECT o_orderstatus AS dataset, o_orderpriority AS db_id, o_orderkey AS o,
                row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM {orders})
        WHERE n <= 3 GROUP BY dataset, db_id"""
    )


_SAMPLES = """(SELECT dataset, db_id, '{"orders": [' || string_agg('[' || CAST(o AS VARCHAR) || ']', ', ' ORDER BY o) || ']}' AS samples_json
  FROM (SELECT o_orderstatus AS dataset, o_orderpriority AS db_id, o_orderkey AS o,
    row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3 GROUP BY dataset, db_id)"""


@check("filter_targets", "SELECT ord, target_db_id FROM pairs WHERE target_db_id IN ('F', 'P')", "pairs")
def _(t):
    return P.allow(t.view("pairs"), "target_db_id", ["F", "P"]).select("ord", "target_db_id")


@check("filter_sources", "SELECT db_id, count(*) AS n FROM questions WHERE db_id IN ('1-URGENT', '5-LOW') GROUP BY db_id", "questions")
def _(t):
    return P.allow(t.view("questions"), "db_id", ["1-URGENT", "5-LOW"]).groupBy("db_id").agg(F.count("*").alias("n"))


@check("skipped_db_count", "SELECT count(*) FILTER (WHERE db_id NOT IN ('1-URGENT', '5-LOW')) AS skipped FROM (SELECT DISTINCT db_id FROM questions)", "questions")
def _(t):
    return P.skipped_dbs(t.view("questions").select("db_id").distinct(), "db_id", ["1-URGENT", "5-LOW"])


@check(
    "method_columns",
    "SELECT target_db_id AS source_dataset, source_db_id, source_query, 'q' AS source_question, target_db_id, target_query, target_question FROM pairs",
    "pairs",
)
def _(t):
    rows = t.view("pairs").withColumns({"source_dataset": col("target_db_id"), "source_question": F.lit("q")})
    return rows.select(*P.method_fields("zeroshot"))


_UNKNOWN = """
SELECT * FROM (SELECT pipeline_no, source_dataset AS dataset, unnest(CASE WHEN source_db_list = '' THEN [] ELSE split(source_db_list, ',') END) AS db_id FROM settings
  UNION ALL SELECT pipeline_no, target_dataset, target_db_id FROM settings) WHERE (dataset, db_id) NOT IN (SELECT (dataset, db_id) FROM schemas)
"""


@check("anti_unknown_dbs", f"SELECT pipeline_no FROM settings WHERE pipeline_no NOT IN (SELECT pipeline_no FROM ({_UNKNOWN}))", "settings", "schemas")
def _(t):
    return P.known_pipelines(settings(t), t.view("schemas")).select("pipeline_no")


@check("subset_check", _UNKNOWN, "settings", "schemas")
def _(t):
    return P.unknown_dbs(settings(t), t.view("schemas")).select("pipeline_no", "dataset", "db_id")


_CROSS = """
SELECT s.*, q.db_id AS source_db_id FROM settings s JOIN (SELECT DISTINCT dataset, db_id FROM questions) q
  ON q.dataset = s.source_dataset AND (s.source_db_list = '' OR list_contains(split(s.source_db_list, ','), q.db_id))
"""


@check("cross_source_target", f"SELECT pipeline_no, target_db_id, source_dataset, source_db_id FROM ({_CROSS})", "settings", "questions")
def _(t):
    dbs = t.view("questions").select("dataset", "db_id").distinct()
    return P.pair_sources(settings(t), dbs).select("pipeline_no", "target_db_id", "source_dataset", "source_db_id")


def _shuffled(seed: int) -> str:
    key = "ord" if seed == -1 else f"md5('{seed}:' || db_id || ':' || CAST(ord AS VARCHAR))"
    return f"SELECT *, row_number() OVER (PARTITION BY dataset, db_id ORDER BY {key}, ord) AS pos FROM questions"


def _numbered(t, seed, limit=-1):
    return number_questions(t.view("questions"), ["dataset", "db_id"], seed, limit)


@check("seeded_shuffle", f"SELECT dataset, db_id, ord, pos FROM ({_shuffled(12)})", "questions")
def _(t):
    return _numbered(t, 12).select("dataset", "db_id", "ord", "pos")


@check("seeded_shuffle_file_order", f"SELECT dataset, db_id, ord, pos FROM ({_shuffled(-1)})", "questions")
def _(t):
    return _numbered(t, -1).select("dataset", "db_id", "ord", "pos")


@check("seeded_shuffle_by_time", "SELECT dataset, db_id, count(*) AS n, count(*) AS places, count(*) AS last FROM questions GROUP BY ALL", "questions")
def _(t):
    places = (F.count("*").alias("n"), F.count_distinct("pos").alias("places"), F.max("pos").alias("last"))
    return _numbered(t, 0).groupBy("dataset", "db_id").agg(*places)


@check("per_db_limit", f"SELECT dataset, db_id, ord, pos FROM ({_shuffled(12)}) WHERE pos <= 20", "questions")
def _(t):
    return _numbered(t, 12, 20).select("dataset", "db_id", "ord", "pos")


@check("batch_number", f"SELECT dataset, db_id, ord, (pos - 1) // 10 AS batch_no FROM ({_shuffled(12)})", "questions")
def _(t):
    return _numbered(t, 12).select("dataset", "db_id", "ord", batch_number(col("pos"), 10).alias("batch_no"))


_JSON = (
    "'[' || string_agg('{\"dataset\":\"' || dataset || '\",\"db_id\":\"' || db_id || '\",\"question\":\"' || question || '\",\"query\":\"' || query || '\"}', ',' ORDER BY pos) || ']'"
)


@check(
    "batch_to_json",
    f"SELECT dataset, db_id, (pos - 1) // 10 AS batch_no, {_JSON} AS questions_json, count(*) AS n_questions FROM ({_shuffled(12)}) GROUP BY ALL",
    "questions",
)
def _(t):
    return P.batch_questions(_numbered(t, 12), ["dataset", "db_id"])


@check(
    "join_source_schema",
    "SELECT q.ord, q.db_id AS source_db_id, s.schema_ddl AS source_ddl FROM questions q JOIN schemas s ON q.dataset = s.dataset AND q.db_id = s.db_id",
    "questions",
    "schemas",
)
def _(t):
    rows = t.view("questions").withColumnsRenamed({"dataset": "source_dataset", "db_id": "source_db_id"})
    return P.with_source_schema(rows, t.view("schemas"), ["ord"]).select("ord", "source_db_id", "source_ddl")


@check(
    "join_target_schema",
    "SELECT s.pipeline_no, s.target_db_id, d.schema_ddl AS target_ddl FROM settings s JOIN schemas d ON s.target_dataset = d.dataset AND s.target_db_id = d.db_id",
    "settings",
    "schemas",
)
def _(t):
    found = P.with_target_schema(settings(t), t.view("schemas"), ["pipeline_no"])
    return found.select("pipeline_no", "target_db_id", "target_ddl")


@check(
    "join_target_samples",
    f"SELECT s.pipeline_no, s.target_db_id, d.samples_json FROM settings s JOIN {_SAMPLES} d ON s.target_dataset = d.dataset AND s.target_db_id = d.db_id",
    "settings",
)
def _(t):
    return P.with_target_samples(settings(t), samples(t), ["pipeline_no"]).select("pipeline_no", "target_db_id", "samples_json")


_CHOSEN = f"""
SELECT * FROM (SELECT p.pipeline_no, p.source_dataset, p.source_db_id, p.target_dataset, p.target_db_id, p.question_limit,
    q.dataset, q.db_id, q.question, q.query, q.ord,
    row_number() OVER (PARTITION BY p.pipeline_no, p.source_db_id ORDER BY CASE WHEN p.seed <> -1 THEN md5(CAST(p.seed AS VARCHAR) || ':' || q.db_id || ':' || CAST(q.ord AS VARCHAR)) END NULLS FIRST, q.ord) AS pos
  FROM ({_CROSS}) p JOIN questions q ON q.dataset = p.source_dataset AND q.db_id = p.source_db_id
  WHERE p.question_limit <> 0 AND p.pipeline_no NOT IN (SELECT pipeline_no FROM ({_UNKNOWN})))
WHERE question_limit < 0 OR pos <= question_limit
"""


def batches(t):
    schemas = t.view("schemas")
    chosen = P.choose_questions(t.view("questions"), P.known_pipelines(settings(t), schemas), largest_limit=35)
    named = chosen.withColumns({"dataset": col("source_dataset"), "db_id": col("source_db_id")})
    return P.batch_questions(
        named, ["pipeline_no", "source_dataset", "source_db_id", "target_dataset", "target_db_id"]
    )


_BATCHES = f"""
SELECT pipeline_no, source_dataset, source_db_id, target_dataset, target_db_id, (pos - 1) // 10 AS batch_no, {_JSON} AS questions_json, count(*) AS n_questions
FROM ({_CHOSEN}) GROUP BY pipeline_no, source_dataset, source_db_id, target_dataset, target_db_id, batch_no
"""


@check("prompt_batches", _BATCHES, "settings", "schemas", "questions")
def _(t):
    return batches(t)


@check(
    "build_prompt",
    f"""SELECT b.pipeline_no, b.source_db_id, b.batch_no, 'base' || chr(10) || chr(10) || '## Generate the query for the following query:' || chr(10) || chr(10)
  || '# Source schema' || chr(10) || '{{' || chr(10) || '    "db_id": "' || b.source_db_id || '",' || chr(10) || '    "schema": "' || s.schema_ddl || '"' || chr(10) || '}}' || chr(10) || chr(10)
  || '# Target schema' || chr(10) || '{{' || chr(10) || '    "db_id": "' || b.target_db_id || '",' || chr(10) || '    "schema": "' || g.schema_ddl || '"' || chr(10) || '}}' || chr(10) || chr(10)
  || '# Target sample data' || chr(10) || m.samples_json || chr(10) || chr(10) || '# Source query:' || chr(10) || b.questions_json || chr(10) || chr(10) || '#Output:' || chr(10) || chr(10) AS prompt
FROM ({_BATCHES}) b JOIN schemas s ON s.dataset = b.source_dataset AND s.db_id = b.source_db_id
JOIN schemas g ON g.dataset = b.target_dataset AND g.db_id = b.target_db_id
JOIN {_SAMPLES} m ON m.dataset = b.target_dataset AND m.db_id = b.target_db_id""",
    "settings",
    "schemas",
    "questions",
)
def _(t):
    schemas, unique = t.view("schemas"), ["pipeline_no", "source_db_id", "batch_no"]
    rows = P.with_source_schema(batches(t), schemas, unique)
    rows = P.with_target_samples(P.with_target_schema(rows, schemas, unique), samples(t), unique)
    return rows.select(*unique, P.prompt_text("base").alias("prompt"))


@check(
    "union_batches",
    f"SELECT pipeline_no, batch_no, n_questions FROM ({_BATCHES}) WHERE pipeline_no % 2 = 0 UNION ALL SELECT pipeline_no, batch_no, n_questions FROM ({_BATCHES}) WHERE pipeline_no % 2 = 1",
    "settings",
    "schemas",
    "questions",
)
def _(t):
    even = batches(t).filter(col("pipeline_no") % 2 == 0)
    odd = batches(t).filter(col("pipeline_no") % 2 == 1)
    return even.unionByName(odd).select("pipeline_no", "batch_no", "n_questions")


@check(
    "path_keys",
    "SELECT ord, target_db_id AS sample_db, source_db_id AS response_db, 'F_' || target_db_id AS folder FROM pairs",
    "pairs",
)
def _(t):
    from pairloom.sources.files import folder_name, path_key

    pairs = t.view("pairs")
    sample = F.concat(F.lit("file:/data/target_samples/sample_"), "target_db_id", F.lit(".old.json"))
    response = F.concat(F.lit("file:/data/m/t/response_"), "source_db_id", F.lit(".json"))
    folder = F.concat(F.lit("data/F_"), "target_db_id")
    return pairs.select(
        "ord",
        path_key(sample, "sample_", to_first_dot=True).alias("sample_db"),
        path_key(response, "response_").alias("response_db"),
        folder_name(folder).alias("folder"),
    )
