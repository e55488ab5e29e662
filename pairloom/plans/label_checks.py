"""Checked queries: execution outcomes, judge ratings, and labels put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import json_text as J
from pairloom.operators import execution_labels as X
from pairloom.operators import ratings as R
from pairloom.operators.joins import lookup
from pairloom.operators.rollups import at_level, execution_summary, semantic_summary
from pairloom.operators.template_labels import label_templates
from pairloom.plans.registry import check
from pairloom.plans.template_checks import _LABELLED
from pairloom.session import fresh_folder
from pairloom.sources.buckets import chained, read_bucketed, write_bucketed

col = F.col

_STATUS = """CASE WHEN coalesce(target_query, '') = '' THEN 'Null_Query' WHEN outcome = 'timeout' THEN 'Error (Timeout)' WHEN outcome = 'error' THEN 'Error'
  WHEN fetched_rows = 0 THEN 'Empty' WHEN fetched_rows > 50 THEN 'Success (more than 50 rows)' ELSE 'Success' END"""
_LEVEL = "CASE WHEN grouping(target_db_id) = 1 THEN 'total' WHEN grouping(source_db_id) = 1 THEN 'target' ELSE 'source' END AS level"
EXECUTION_SQL = f"""
SELECT *, CAST(success AS DOUBLE) / total AS success_result_rate, CAST(success + empty AS DOUBLE) / total AS success_run_rate FROM (
  SELECT {_LEVEL}, target_db_id, source_db_id, count(*) FILTER (WHERE s LIKE 'Success%') AS success, count(*) FILTER (WHERE s = 'Empty') AS empty,
    count(*) FILTER (WHERE s LIKE 'Error%') AS error, count(*) FILTER (WHERE s = 'Null_Query') AS null_query, count(*) AS total
  FROM (SELECT *, {_STATUS} AS s FROM executions) GROUP BY ROLLUP (target_db_id, source_db_id))
"""


@check("null_query", "SELECT ord, coalesce(target_query, '') = '' AS nothing_to_run FROM executions", "executions")
def _(t):
    return t.view("executions").select("ord", X.is_null_query(col("target_query")).alias("nothing_to_run"))


@check("result_status", f"SELECT ord, {_STATUS} AS result_status FROM executions", "executions")
def _(t):
    return X.label_executions(t.view("executions")).select("ord", "result_status")


def executions(t):
    return execution_summary(X.label_executions(t.view("executions")))


for _name, _level, _gone in (
    ("execution_by_source", "source", ["level"]),
    ("execution_by_target", "target", ["level", "source_db_id"]),
    ("execution_total", "total", ["level", "source_db_id", "target_db_id"]),
):
    check(_name, f"SELECT * EXCLUDE ({', '.join(_gone)}) FROM ({EXECUTION_SQL}) WHERE level = '{_level}'", "executions")(
        lambda t, level=_level, gone=_gone: at_level(executions(t), level).drop(*gone)
    )


@check("execution_rates", f"SELECT level, target_db_id, source_db_id, success_result_rate, success_run_rate FROM ({EXECUTION_SQL})", "executions")
def _(t):
    return executions(t).select("level", "target_db_id", "source_db_id", "success_result_rate", "success_run_rate")


# each nation's orders stand for the result of one query
_RESULTS = """(SELECT c_nationkey AS query_no, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS row_no
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def results(t):
    return t.orders.join(t.customer, col("o_custkey") == col("c_custkey")).select(
        col("c_nationkey").alias("query_no"), "o_orderkey"
    )


@check("fetch_cap", f"SELECT query_no, o_orderkey, CAST(row_no AS INT) AS row_no FROM {_RESULTS} WHERE row_no <= 51")
def _(t):
    return X.fetch_cap(results(t), ["query_no"], ["o_orderkey"])


@check(
    "preview_rows",
    "SELECT query_no, least(max(row_no), 51) AS fetched_rows, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY row_no) FILTER (WHERE row_no <= 50) AS execution_result "
    f"FROM {_RESULTS} GROUP BY query_no",
)
def _(t):
    capped = X.fetch_cap(results(t), ["query_no"], ["o_orderkey"])
    kept = X.preview_rows(capped, ["query_no"], col("o_orderkey").cast("string"))
    return kept.withColumn("execution_result", F.array_join("execution_result", ","))


def sent(t):
    """Pairs as they were sent to the judge."""
    return t.view("ratings").select("ord", "target_db_id", "source_db_id", "is_generated")


def rated(t):
    """The answers. Source src3 of every target lost its answers of every third document."""
    kept = (col("source_db_id") != "src3") | (col("ord") % 3 != 0)
    labels = {
        "meaningful_nl_question": F.coalesce("is_clear_and_meaningful", F.lit("N/A")),
        "correct_target_nl_sql_mapping": F.coalesce("is_correct_mapping", F.lit("N/A")),
    }
    return t.view("ratings").filter(kept).withColumns(labels).select("ord", *R.FILE, *labels)


_KEPT = "(SELECT * FROM ratings WHERE source_db_id <> 'src3' OR ord % 3 <> 0)"
_ZIPPED = f"""
SELECT ord, target_db_id, source_db_id, is_generated, coalesce(is_clear_and_meaningful, 'N/A') AS meaningful_nl_question,
  coalesce(is_correct_mapping, 'N/A') AS correct_target_nl_sql_mapping FROM {_KEPT}
WHERE (target_db_id, source_db_id) IN (SELECT (target_db_id, source_db_id) FROM ratings GROUP BY target_db_id, source_db_id
  HAVING count(*) = count(*) FILTER (WHERE source_db_id <> 'src3' OR ord % 3 <> 0))
"""
_RATED = f"(SELECT * FROM ({_ZIPPED}) WHERE is_generated = 'True')"
SEMANTIC_SQL = f"""
SELECT *, CASE WHEN level = 'total' THEN meaningful_nl_question / total END AS meaningfulness_rate,
  CASE WHEN level = 'total' THEN correct_sql_mapping / total END AS correct_sql_mapping_rate FROM (
  SELECT CASE WHEN grouping(target_db_id) = 1 THEN 'total' ELSE 'target' END AS level, target_db_id,
    count(*) FILTER (WHERE lower(meaningful_nl_question) = 'yes') AS meaningful_nl_question,
    count(*) FILTER (WHERE lower(correct_target_nl_sql_mapping) = 'yes') AS correct_sql_mapping, count(*) AS total
  FROM {_RATED} GROUP BY ROLLUP (target_db_id))
"""


def zipped(t):
    return R.zip_ratings(sent(t), rated(t))


@check("zip_ratings", _ZIPPED, "ratings")
def _(t):
    return zipped(t)


@check("keep_generated", f"SELECT * FROM {_RATED}", "ratings")
def _(t):
    return R.label_rated(zipped(t))


def semantics(t):
    return semantic_summary(R.label_rated(zipped(t)))


@check("semantic_by_target", f"SELECT target_db_id, meaningful_nl_question, correct_sql_mapping, total FROM ({SEMANTIC_SQL}) WHERE level = 'target'", "ratings")
def _(t):
    return at_level(semantics(t), "target").select("target_db_id", "meaningful_nl_question", "correct_sql_mapping", "total")


@check("semantic_total", f"SELECT meaningful_nl_question, correct_sql_mapping, total FROM ({SEMANTIC_SQL}) WHERE level = 'total'", "ratings")
def _(t):
    return at_level(semantics(t), "total").select("meaningful_nl_question", "correct_sql_mapping", "total")


@check("semantic_rates", f"SELECT meaningfulness_rate, correct_sql_mapping_rate FROM ({SEMANTIC_SQL}) WHERE level = 'total'", "ratings")
def _(t):
    return at_level(semantics(t), "total").select("meaningfulness_rate", "correct_sql_mapping_rate")


# Ratings as the judge writes them: the names of the two parts may drift.
_RAW = """
SELECT ord, target_db_id, source_db_id, CASE WHEN part IS NULL THEN '{{"nl_question":"q"}}'
  ELSE '{{"' || CASE ord % 3 WHEN 0 THEN 'clarity_and_alignment_of_NL' ELSE 'clarity_of_NL' END || '":{{"thought_process":"t","is_clear_and_meaningful":"' || part
    || '"}},"' || CASE ord % 2 WHEN 0 THEN 'correctness_of_query' ELSE 'correctness' END || '":{{"thought_process":"s' || CAST(ord AS STRING) || '"}}}}' END AS raw
FROM (SELECT ord, target_db_id, source_db_id, is_clear_and_meaningful AS part FROM ({ratings}))"""


def raw_ratings(t):
    from pairloom.plans.inputs import VIEWS

    return t.sql(_RAW.replace("{ratings}", VIEWS["ratings"])).withColumn("item", F.parse_json("raw"))


@check(
    "rating_lookup",
    "SELECT ord, is_clear_and_meaningful AS clear, CASE WHEN is_clear_and_meaningful IS NOT NULL THEN 's' || CAST(ord AS VARCHAR) END AS thought FROM ratings",
    "ratings",
)
def _(t):
    nl = J.rating_part(col("item"), "clarity_and_alignment_of_NL", "clarity")
    sql = J.rating_part(col("item"), "correctness_of_query", "correctness")
    return raw_ratings(t).select(
        "ord",
        F.try_variant_get(nl, "$.is_clear_and_meaningful", "string").alias("clear"),
        F.try_variant_get(sql, "$.thought_process", "string").alias("thought"),
    )


@check(
    "rating_values",
    "SELECT ord, coalesce(is_clear_and_meaningful, 'N/A') AS meaningful_nl_question, 'N/A' AS correct_target_nl_sql_mapping, "
    "CASE WHEN is_clear_and_meaningful IS NULL THEN 'N/A' ELSE 't' END AS nl_thought, CASE WHEN is_clear_and_meaningful IS NULL THEN 'N/A' ELSE 's' || CAST(ord AS VARCHAR) END AS sql_thought, "
    "coalesce(lower(is_clear_and_meaningful) = 'yes', false) AS counts FROM ratings",
    "ratings",
)
def _(t):
    labels = R.read_ratings(raw_ratings(t), ["ord"])
    return labels.withColumn("counts", R.is_yes(col("meaningful_nl_question")))


@check(
    "left_schema_for_rating",
    "SELECT n.n_nationkey AS pair_no, coalesce(s.schema_ddl, 'None') AS ddl FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
    "LEFT JOIN (SELECT r_regionkey, 'CREATE TABLE ' || r_name AS schema_ddl FROM region WHERE r_regionkey < 3) s ON n.n_regionkey = s.r_regionkey",
)
def _(t):
    ddl = t.region.filter(col("r_regionkey") < 3).select(
        col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("CREATE TABLE "), "r_name").alias("schema_ddl")
    )
    pairs = t.customer.join(t.nation, col("c_nationkey") == col("n_nationkey"))
    found = lookup(pairs, ddl, ["n_regionkey"], ["c_custkey"], how="left")
    return found.select(col("n_nationkey").alias("pair_no"), F.coalesce("schema_ddl", F.lit("None")).alias("ddl"))


def _json_text(x: str) -> str:
    quoted = f"replace({x}, chr(34), chr(92) || chr(34))"
    return f"coalesce(chr(34) || {quoted} || chr(34), 'null')"


@check(
    "build_rating_prompt",
    f"""SELECT p.target_db_id, p.source_db_id, p.part, 'base' || chr(10) || chr(10) || '## Rate the following questions and sql:' || chr(10) || chr(10)
      || '# Source schema' || chr(10) || '"' || coalesce(s.schema_ddl, 'None') || '"' || chr(10) || chr(10) || chr(10) || '# Input pairs' || chr(10) || pairs_json
      || chr(10) || chr(10) || '# Output:' || chr(10) || chr(10) AS prompt
    FROM (SELECT target_db_id, source_db_id, ord // 1024 AS part,
        '[' || string_agg('{{"nl_question":' || {_json_text('target_question')} || ',"sql_query":' || {_json_text('target_query')} || '}}', ',' ORDER BY ord) || ']' AS pairs_json
      FROM pairs GROUP BY ALL) p
    LEFT JOIN (SELECT * FROM schemas WHERE dataset <> 'P') s ON s.dataset = p.target_db_id AND s.db_id = p.source_db_id""",
    "pairs",
    "schemas",
)
def _(t):
    ddl = t.view("schemas").filter(col("dataset") != "P").select(
        col("dataset").alias("target_db_id"), col("db_id").alias("source_db_id"), "schema_ddl"
    )
    parts = lookup(R.rating_parts(t.view("pairs"), size=1024), ddl, R.FILE, ["part"], how="left")
    prompt = R.rating_prompt("base", col("pairs_json"), col("schema_ddl")).alias("prompt")
    return parts.select(*R.FILE, "part", prompt)


@check(
    "select_pairs",
    "SELECT o_orderkey AS ord, o_custkey % 3 AS kind FROM orders WHERE o_custkey % 3 <> 1",
)
def _(t):
    raw = t.sql(
        """SELECT o_orderkey AS ord, o_custkey % 3 AS kind, CASE o_custkey % 3 WHEN 0 THEN '{{"target_question":"q","target_query":"s"}}'
           WHEN 1 THEN '{{"target_query":"s"}}' ELSE '{{"target_question":null,"target_query":null}}' END AS raw FROM {orders}"""
    )
    return R.select_pairs(raw).select("ord", "kind")


_CHAIN = f"""SELECT p.ord, p.same_template, {_STATUS.replace('target_query', 'e.target_query')} AS result_status,
    r.is_clear_and_meaningful, r.is_correct_mapping
  FROM ({_LABELLED}) p JOIN executions e ON p.ord = e.ord JOIN ratings r ON p.ord = r.ord AND r.is_generated = 'True'"""


def _label_tables(t):
    """The template, execution and judge labels of each pair."""
    template = label_templates(t.view("pairs")).select("ord", "same_template")
    execution = X.label_executions(t.view("executions")).select("ord", "result_status")
    semantic = R.label_rated(t.view("ratings")).select("ord", "is_clear_and_meaningful", "is_correct_mapping")
    return [template, execution, semantic]


@check("chain_labels", _CHAIN, "pairs", "executions", "ratings")
def _(t):
    """The labels as they are made: each is moved once, to its pair."""
    return chained(_label_tables(t), ["ord"])


@check("chain_label_tables", _CHAIN, "pairs", "executions", "ratings")
def _(t):
    """The labels as written tables in equal buckets: none is moved."""
    tables = []
    for number, labels in enumerate(_label_tables(t)):
        path = fresh_folder(t.spark, f"labels-{number}")
        buckets = write_bucketed(labels, path, ["ord"])
        tables.append(read_bucketed(t.spark, path, ["ord"], buckets))
    return chained(tables, ["ord"])
