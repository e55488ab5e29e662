"""Checked queries: structural labels on the pairs view."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import templates as T
from pairloom.functions.vocabulary import FUNCTIONS, KEYWORDS
from pairloom.operators.layout import spread_small
from pairloom.operators.rollups import at_level, template_summary
from pairloom.operators.template_labels import label_generated, label_templates, not_generated
from pairloom.plans.registry import check

# The checking engine's regexes know no look-around. Its twin of a template
# therefore works in more steps: drop dotted keywords first, catch a function
# together with its bracket, and split the two afterwards.
_KW, _FN = "|".join(KEYWORDS), "|".join(FUNCTIONS)


def _stripped(x: str) -> str:
    for quoted in ("''[^'']*''", '"[^"]*"', "`[^`]*`", r"\[[^\]]*\]"):
        x = f"regexp_replace({x}, '{quoted}', '', 'g')"
    return x


def _plain_ops(x: str) -> str:
    return rf"regexp_replace({x}, '>=|<=|:|/|\+|-|<|>', '=', 'g')"


def _no_reserved_table(x: str) -> str:
    return rf"regexp_replace({x}, '\b(FROM|JOIN|INTO|UPDATE|TABLE)\s+({_KW})\b', '\1 ', 'g')"


def template_sql(x: str) -> str:
    x = _no_reserved_table(_plain_ops(f"upper({_stripped(x)})"))
    x = rf"regexp_replace({x}, '\.(?:{_KW})\b', '.', 'g')"
    x = rf"array_to_string(regexp_extract_all({x}, '\b(?:{_KW})\b|\b(?:{_FN})\s*\(|[(),*/+=\-<>]'), ' ')"
    return rf"regexp_replace({x}, '(\w)\s*\(', '\1 (', 'g')"


_REFUSED = (
    "source_query IS NULL OR target_query IS NULL OR lower(trim(target_query)) = 'select null' "
    "OR contains(coalesce(target_question, ''), 'Unable to translate this query') "
    "OR contains(target_query, 'Unable to translate this query')"
)
_GENERATED = f"SELECT *, CASE WHEN {_REFUSED} THEN 'False' ELSE 'True' END AS is_generated FROM pairs"
_LABELLED = f"""
SELECT * REPLACE (CASE WHEN is_generated = 'True' THEN source_query_template ELSE 'null' END AS source_query_template,
                  CASE WHEN is_generated = 'True' THEN target_query_template ELSE 'null' END AS target_query_template),
  CASE WHEN is_generated = 'True' AND source_query_template = target_query_template THEN 'True' ELSE 'False' END AS same_template
FROM (SELECT *, {template_sql('source_query')} AS source_query_template,
        {template_sql('target_query')} AS target_query_template FROM ({_GENERATED}))
"""
SUMMARY_SQL = f"""
SELECT CASE WHEN grouping(target_db_id) = 1 THEN 'total' WHEN grouping(source_db_id) = 1 THEN 'target' ELSE 'source' END AS level,
  target_db_id, source_db_id,
  count(*) FILTER (WHERE is_generated = 'False') AS not_generated_query,
  count(*) FILTER (WHERE same_template = 'True') AS success,
  count(*) FILTER (WHERE same_template = 'False') AS error,
  count(*) AS total,
  count(*) FILTER (WHERE same_template = 'True') / count(*) AS success_rate
FROM ({_LABELLED}) GROUP BY ROLLUP (target_db_id, source_db_id)
"""


def _summary_at(level: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({SUMMARY_SQL}) WHERE level = '{level}'"


_COUNTS = "not_generated_query, success, error, total, success_rate"


@check("template_summary", SUMMARY_SQL, "pairs")
def _(t):
    return template_summary(label_templates(t.view("pairs")))


@check("template_by_source", _summary_at("source", "target_db_id, source_db_id, " + _COUNTS), "pairs")
def _(t):
    return at_level(template_summary(label_templates(t.view("pairs"))), "source").drop("level")


@check("template_by_target", _summary_at("target", "target_db_id, " + _COUNTS), "pairs")
def _(t):
    return at_level(template_summary(label_templates(t.view("pairs"))), "target").drop("level", "source_db_id")


@check("template_total", _summary_at("total", _COUNTS), "pairs")
def _(t):
    summary = template_summary(label_templates(t.view("pairs")))
    return at_level(summary, "total").drop("level", "target_db_id", "source_db_id")


@check("template_rate", f"SELECT level, target_db_id, source_db_id, success_rate FROM ({SUMMARY_SQL})", "pairs")
def _(t):
    summary = template_summary(label_templates(t.view("pairs")))
    return summary.select("level", "target_db_id", "source_db_id", "success_rate")


@check("is_generated", f"SELECT ord, is_generated FROM ({_GENERATED})", "pairs")
def _(t):
    return label_generated(t.view("pairs")).select("ord", "is_generated")


@check("enrich_row", _LABELLED, "pairs")
def _(t):
    return label_templates(t.view("pairs"))


@check(
    "same_template",
    f"SELECT ord, same_template, source_query_template, target_query_template FROM ({_LABELLED})",
    "pairs",
)
def _(t):
    labelled = label_templates(t.view("pairs"))
    return labelled.select("ord", "same_template", "source_query_template", "target_query_template")


@check("sink_rejects_template", f"SELECT * FROM ({_GENERATED}) WHERE is_generated = 'False'", "pairs")
def _(t):
    return not_generated(label_generated(t.view("pairs")))


def _both_sides(function):
    return lambda t: spread_small(t.view("pairs")).select(
        "ord", function(F.col("source_query")).alias("source_text"), function(F.col("target_query")).alias("target_text")
    )


def _both_sides_sql(function) -> str:
    return f"SELECT ord, {function('source_query')} AS source_text, {function('target_query')} AS target_text FROM pairs"


for _name, _spark, _sql in (
    ("strip_quoted", T.strip_quoted, _stripped),
    ("upper_sql", T.upper_sql, lambda x: f"upper({x})"),
    ("normalise_ops", T.normalise_ops, _plain_ops),
    ("drop_reserved_table", lambda c: T.drop_reserved_table(F.upper(c)), lambda x: _no_reserved_table(f"upper({x})")),
    ("sql_template", T.sql_template, template_sql),
):
    check(_name, _both_sides_sql(_sql), "pairs")(_both_sides(_spark))
