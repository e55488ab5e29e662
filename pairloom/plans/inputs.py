"""The test tables, and stand-in views over them.

The curation jobs read pairs, responses, ratings and execution outcomes. The test
tables hold none of these, so each view below derives them from whole tables, in
text that both Spark and the checking engine understand. Table and view names
stand in braces; ``oracle`` turns the same text into leading WITH clauses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS = {
    # mapped pairs; also serves as the source questions of its target_db_id
    "pairs": """
SELECT o_orderkey AS ord, o_orderstatus AS target_db_id, o_orderpriority AS source_db_id,
  CASE o_orderkey % 4
    WHEN 0 THEN 'SELECT count(*) FROM t WHERE a > ' || CAST(o_custkey AS STRING)
    WHEN 1 THEN 'SELECT a , avg(b) FROM t GROUP BY a ORDER BY count(*) DESC LIMIT 1'
    WHEN 2 THEN 'SELECT a FROM t JOIN MATCH AS T2 ON t.key = T2.key WHERE T2.n = ' || chr(39) || 'x' || chr(39)
    ELSE 'SELECT a FROM t WHERE a NOT IN (SELECT b FROM `u v`)' END AS source_query,
  CASE WHEN o_custkey % 13 = 0 THEN NULL
       WHEN o_custkey % 13 = 1 THEN ' Select NULL '
       WHEN o_custkey % 13 = 2 THEN 'Unable to translate this query'
       WHEN o_orderkey % 4 = 0 AND o_custkey % 13 < 9 THEN 'SELECT COUNT(*) FROM orders WHERE o_custkey <= 7'
       WHEN o_orderkey % 4 = 1 AND o_custkey % 13 < 9 THEN 'SELECT c, AVG(d) FROM orders GROUP BY c ORDER BY COUNT(*) DESC LIMIT 1'
       WHEN o_orderkey % 4 = 2 AND o_custkey % 13 < 9 THEN 'SELECT p FROM orders JOIN nation AS T2 ON orders.k = T2.k WHERE T2.n = "y"'
       ELSE 'SELECT p FROM orders WHERE p IN (SELECT q FROM part)' END AS target_query,
  CASE WHEN o_custkey % 29 = 0 THEN NULL WHEN o_custkey % 31 = 0 THEN 'Unable to translate this query.' ELSE 'How many?' END AS target_question
FROM {orders}""",
    # model answers, several attempts per prompt, attempts counted from 0
    "responses": """
SELECT conv_id AS prompt_id, turn AS attempt, 'db' || CAST(conv_id % 5 AS STRING) AS source_db_id,
  CASE (conv_id * 7 + turn) % 8
    WHEN 0 THEN ''
    WHEN 1 THEN '```json' || chr(10) || '[{{"source_db_id":"db' || CAST(conv_id % 5 AS STRING) || '","target_db_id":"tgt","target_query":"SELECT 1"}}]' || chr(10) || '```'
    WHEN 2 THEN '[{{"source_db_id":"other","target_db_id":"tgt","target_query":"SELECT 1"}}]'
    WHEN 3 THEN '[{{"source_db_id":"x","target_db_id":"tgt"}}]'
    WHEN 4 THEN 'no json here'
    WHEN 5 THEN '[{{"source_db_id":"x"] [}}'
    ELSE '[{{"source_db_id":"db' || CAST(conv_id % 5 AS STRING) || '","target_db_id":"tgt","target_query":"SELECT 2"}},{{"source_db_id":"db' || CAST(conv_id % 5 AS STRING) || '","target_db_id":"tgt","target_query":"SELECT 3"}}]' END AS response,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN 'MAX_TOKENS' WHEN (conv_id + turn) % 11 = 1 THEN 'RECITATION' ELSE '' END AS finish_reason,
  CASE WHEN (conv_id + turn) % 17 = 0 THEN 'boom' END AS error,
  CAST(length(text) AS BIGINT) AS prompt_tokens, CAST(length(role) AS BIGINT) AS response_tokens,
  CAST(turn + 1 AS DOUBLE) AS time_taken, CAST(conv_id % 3 AS INT) AS pipeline_no
FROM {conversations}""",
    "ratings": """
SELECT d.doc_id AS ord, d.lang AS target_db_id, d.source AS source_db_id,
  CASE WHEN l.quality = 1 THEN 'Yes' WHEN l.quality = 0 THEN 'no' WHEN d.doc_id % 3 = 0 THEN 'maybe' END AS is_clear_and_meaningful,
  CASE WHEN l.toxic = 0 THEN 'yes' WHEN l.toxic = 1 THEN 'no' END AS is_correct_mapping,
  CASE WHEN d.doc_id % 10 = 0 THEN 'False' ELSE 'True' END AS is_generated
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "executions": """
SELECT c.c_custkey AS ord, n.n_name AS target_db_id, c.c_mktsegment AS source_db_id,
  CASE WHEN c.c_custkey % 19 = 0 THEN '' WHEN c.c_custkey % 23 = 0 THEN NULL ELSE 'SELECT 1' END AS target_query,
  CASE WHEN c.c_custkey % 17 = 0 THEN 'timeout' WHEN c.c_custkey % 7 = 0 THEN 'error' ELSE 'ok' END AS outcome,
  CASE WHEN c.c_custkey % 11 = 0 THEN CAST(0 AS BIGINT)
       WHEN c.c_custkey % 5 = 0 THEN CAST(51 AS BIGINT) ELSE count(o.o_orderkey) END AS fetched_rows
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, n.n_name, c.c_mktsegment""",
    # source questions: dataset = order status, db = priority
    "questions": """
SELECT o_orderstatus AS dataset, o_orderpriority AS db_id, o_orderkey AS ord,
  'How many ' || CAST(o_custkey AS STRING) || ' are there?' AS question,
  'SELECT count(*) FROM t WHERE a > ' || CAST(o_custkey AS STRING) AS query
FROM {orders}""",
    "schemas": """
SELECT o_orderstatus AS dataset, o_orderpriority AS db_id,
  'CREATE TABLE t (a bigint) /* ' || CAST(count(*) AS STRING) || ' rows */' AS schema_ddl
FROM {orders} GROUP BY o_orderstatus, o_orderpriority""",
    # pipeline settings, one per customer nation and dataset; an empty list of ids means all
    "settings": """
SELECT CAST(n_nationkey AS INT) AS pipeline_no,
  CASE n_regionkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS source_dataset,
  CASE WHEN n_nationkey % 4 = 0 THEN '' WHEN n_nationkey % 4 = 1 THEN '1-URGENT,5-LOW'
       WHEN n_nationkey % 4 = 2 THEN '2-HIGH,3-MEDIUM,nowhere' ELSE '4-NOT SPECIFIED' END AS source_db_list,
  CAST(CASE n_nationkey % 3 WHEN 0 THEN -1 ELSE 12 END AS INT) AS seed,
  CAST(CASE WHEN n_nationkey % 7 = 6 THEN 0 WHEN n_nationkey % 2 = 0 THEN 20 ELSE 35 END AS INT) AS question_limit,
  CASE n_nationkey % 2 WHEN 0 THEN 'F' ELSE 'O' END AS target_dataset,
  CASE WHEN n_nationkey % 5 = 4 THEN 'missing' ELSE '3-MEDIUM' END AS target_db_id
FROM {nation}""",
}

_NAME = re.compile(r"\{(\w+)\}")


class Tables:
    """The tables of one scale-factor folder: ``tables.orders``, ``tables.view("pairs")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        used = {name: getattr(self, name) for name in _NAME.findall(text.replace("{{", "")) if name in TABLES}
        return self.spark.sql(text, **used)


def oracle(text: str, *views: str) -> str:
    """``text`` with the given views in front of it, for the checking engine."""
    if not views:
        return text
    named = {name: name for name in TABLES}
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].format(**named)})" for v in views) + "\n" + text
