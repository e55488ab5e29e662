"""Checked queries: running the SQL of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators.rollups import execution_summary
from pairloom.operators.workload import catalog_per_target, label_workload, run_workload
from pairloom.plans.registry import check
from pairloom.session import fresh_folder

col = F.col
TARGETS = {
    "F": ("orders", "customer", "nation", "lineitem"),
    "O": ("customer", "nation", "lineitem"),
    "P": ("orders", "customer", "nation"),
}

# Every order is a pair. Target O knows no orders and target P no lineitem.
_QUERIES = """
SELECT o_orderkey AS ord, o_orderstatus AS target_db_id, o_orderpriority AS source_db_id, CASE o_custkey % 9
    WHEN 0 THEN NULL WHEN 1 THEN ''
    WHEN 2 THEN 'SELECT n_name FROM nation WHERE n_nationkey < 0'
    WHEN 3 THEN 'SELECT * FROM orders ORDER BY o_orderkey;'
    WHEN 4 THEN 'SELECT count(*) FROM lineitem WHERE l_quantity > 5'
    WHEN 5 THEN 'SELECT nothing FROM nation'
    WHEN 6 THEN 'SELECT count( FROM nation'
    WHEN 7 THEN 'DROP TABLE nation'
    ELSE 'SELECT c_name FROM customer WHERE c_nationkey = ' || CAST(o_custkey % 5 AS STRING) END AS target_query
FROM {orders}"""
_EXPECTED = """
SELECT o_orderkey AS ord, o_orderstatus AS target_db_id, o_orderpriority AS source_db_id,
  CASE WHEN o_custkey % 9 IN (0, 1) THEN 'Null_Query' WHEN o_custkey % 9 = 2 THEN 'Empty'
    WHEN o_custkey % 9 = 3 THEN CASE WHEN o_orderstatus = 'O' THEN 'Error' WHEN (SELECT count(*) FROM orders) > 50 THEN 'Success (more than 50 rows)' ELSE 'Success' END
    WHEN o_custkey % 9 = 4 THEN CASE WHEN o_orderstatus = 'P' THEN 'Error' ELSE 'Success' END
    WHEN o_custkey % 9 IN (5, 6, 7) THEN 'Error'
    WHEN n = 0 OR n IS NULL THEN 'Empty' WHEN n > 50 THEN 'Success (more than 50 rows)' ELSE 'Success' END AS result_status,
  CASE WHEN o_custkey % 9 = 3 AND o_orderstatus = 'O' OR o_custkey % 9 = 4 AND o_orderstatus = 'P' THEN 'TABLE_OR_VIEW_NOT_FOUND'
    WHEN o_custkey % 9 = 5 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' WHEN o_custkey % 9 IN (6, 7) THEN 'PARSE_SYNTAX_ERROR' END AS condition
FROM orders LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) ON c_nationkey = o_custkey % 5
"""


def sessions(t):
    return catalog_per_target(
        t.spark, {target: {name: f"{t.sf_dir}/{name}.parquet" for name in names} for target, names in TARGETS.items()}
    )


def labelled(t):
    pairs = t.sql(_QUERIES)
    outcomes = run_workload(pairs, sessions(t), fresh_folder(t.spark, "outcomes"), seconds=600)
    return label_workload(pairs, outcomes, ["ord"])


@check("run_workload", f"SELECT ord, result_status FROM ({_EXPECTED})")
def _(t):
    return labelled(t).select("ord", "result_status")


@check("workload_error", f"SELECT condition, count(*) AS n FROM ({_EXPECTED}) WHERE result_status = 'Error' GROUP BY condition")
def _(t):
    return labelled(t).filter(col("outcome") == "error").groupBy("condition").agg(F.count("*").alias("n"))


@check(
    "workload_summary",
    f"""SELECT target_db_id, source_db_id, count(*) FILTER (WHERE result_status LIKE 'Success%') AS success, count(*) FILTER (WHERE result_status = 'Empty') AS empty,
        count(*) FILTER (WHERE result_status = 'Error') AS error, count(*) FILTER (WHERE result_status = 'Null_Query') AS null_query, count(*) AS total
        FROM ({_EXPECTED}) GROUP BY ROLLUP (target_db_id, source_db_id)""",
)
def _(t):
    summary = execution_summary(labelled(t))
    return summary.select("target_db_id", "source_db_id", "success", "empty", "error", "null_query", "total")


@check(
    "catalog_per_target",
    "SELECT o_orderstatus AS target_db_id, CASE WHEN o_orderstatus = 'O' THEN 'error' ELSE 'ok' END AS outcome, "
    "CASE WHEN o_orderstatus <> 'O' THEN '[[' || CAST((SELECT count(*) FROM orders) AS VARCHAR) || ']]' END AS found FROM orders GROUP BY o_orderstatus",
)
def _(t):
    pairs = t.orders.select(
        col("o_orderstatus").alias("target_db_id"), F.lit("SELECT count(*) FROM orders").alias("target_query")
    )
    outcomes = run_workload(pairs, sessions(t), fresh_folder(t.spark, "outcomes"), seconds=600)
    return outcomes.select("target_db_id", "outcome", F.when(col("outcome") == "ok", col("execution_result")).alias("found"))


@check(
    "workload_timeout",
    "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'Error (Timeout)' ELSE 'Null_Query' END AS result_status FROM orders",
)
def _(t):
    # an endless query over the orders, stopped by its deadline
    endless = "SELECT sum(sqrt(o_orderkey + i)) FROM orders LATERAL VIEW explode(sequence(1, 10000000)) AS i"
    pairs = t.sql(
        f"""SELECT o_orderkey AS ord, 'F' AS target_db_id, CASE WHEN o_orderkey % 2 = 0 THEN '{endless}' END AS target_query
            FROM {{orders}}"""
    )
    outcomes = run_workload(pairs, sessions(t), fresh_folder(t.spark, "outcomes"), seconds=2)
    return label_workload(pairs, outcomes, ["ord"]).select("ord", "result_status")
