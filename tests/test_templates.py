"""Templates: cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions import templates as T
from pairloom.functions.vocabulary import FUNCTIONS, KEYWORDS
from pairloom.operators.rollups import template_summary
from pairloom.operators.template_labels import label_templates

CASES = {
    "SELECT a FROM `t` WHERE x >= 1": "SELECT FROM =",
    "SELECT count(*) FROM aircraft JOIN MATCH AS T2 ON a != b": "SELECT COUNT ( * ) FROM JOIN ON =",
    "SELECT T1.key, T1.date(x) FROM t WHERE x = -1": "SELECT , DATE ( ) FROM WHERE = =",
    "SELECT x FROM t WHERE n <> 'it''s' AND y == 2": "SELECT FROM WHERE = = AND = =",
    "select current_date from t where d < date('now')": "SELECT CURRENT_DATE FROM WHERE = DATE ( )",
    """SELECT a FROM t WHERE n = "O'Brien" AND m = 'z'""": "SELECT FROM WHERE =",
    "SELECT NULL": "SELECT NULL",
    # a function name without bracket is a column, and one that is no listed function leaves its bracket
    "SELECT count, SUBSTRING(a, 1) FROM t": "SELECT , ( , ) FROM",
    "SELECT MAX  (a) FROM t": "SELECT MAX ( ) FROM",
    # a word that merely begins with a keyword is none; underscores belong to words
    "SELECT inner_id, selected, in1 FROM t": "SELECT , , FROM",
    # reserved word as a table, unless a bracket follows
    "SELECT a FROM order WHERE b": "SELECT FROM WHERE",
    "INSERT INTO values (1)": "INSERT INTO VALUES ( )",
    # letters outside ASCII are letters: no keyword starts inside such a word
    "SELECT éin FROM t WHERE naïf.in = 1": "SELECT FROM WHERE =",
    "SELECT a % b || c ; x [y z] * 2": "SELECT *",
    "": "",
}


def test_cases(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "sql string")
    got = {r.sql: r.t for r in df.select("sql", T.sql_template(F.col("sql")).alias("t")).collect()}
    assert got == CASES


def test_every_word(spark):
    """Each listed word survives alone, and in front of a longer name it does not."""
    words = sorted(set(KEYWORDS) | set(FUNCTIONS))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select(
        "w",
        T.sql_template(F.col("w")).alias("alone"),
        T.sql_template(F.concat("w", F.lit("(x)"))).alias("called"),
        T.sql_template(F.concat("w", F.lit("x"))).alias("longer"),
        T.sql_template(F.concat(F.lit("t."), "w")).alias("dotted"),
        T.sql_template(F.concat(F.lit("t."), "w", F.lit(" (x)"))).alias("dotted_call"),
    ).collect()
    for r in rows:
        assert r.alone == (r.w if r.w in KEYWORDS else ""), r
        assert r.called == f"{r.w} ( )", r
        assert r.longer == (f"{r.w}X" if f"{r.w}X" in KEYWORDS else ""), r
        assert r.dotted == "", r
        assert r.dotted_call == (f"{r.w} ( )" if r.w in FUNCTIONS else "( )"), r
    assert (len(KEYWORDS), len(set(KEYWORDS)), len(FUNCTIONS)) == (146, 146, 27)


@pytest.mark.parametrize(
    "source, target, question, made",
    [
        ("s", "t", "q", "True"),
        (None, "t", "q", "False"),
        ("s", None, "q", "False"),
        ("s", "\n Select NULL\t", "q", "False"),
        ("s", "SELECT NULL;", "q", "True"),
        ("s", "null", "q", "True"),
        ("s", "t", None, "True"),
        ("s", "t", "so: Unable to translate this query, sorry", "False"),
        ("s", "Unable to translate this query", None, "False"),
        ("s", "unable to translate this query", "q", "True"),
        ("s", "", "q", "True"),
    ],
)
def test_is_generated(spark, source, target, question, made):
    pairs = spark.createDataFrame([(source, target, question)], "source_query string, target_query string, target_question string")
    assert label_templates(pairs).first().is_generated == made


def test_strict_null(spark):
    pairs = spark.createDataFrame([("s", " NULL ", "q")], "source_query string, target_query string, target_question string")
    assert label_templates(pairs, strict_null=True).first().is_generated == "False"


def test_summary_adds_up(spark):
    schema = "target_db_id string, source_db_id string, source_query string, target_query string, target_question string"
    rows = [("t", "s1", "SELECT a", "SELECT b", "q"), ("t", "s1", "SELECT a", None, "q"), ("t", "s2", "SELECT a", "b", "q"), ("u", None, "x", "y", "q")]
    summary = template_summary(label_templates(spark.createDataFrame(rows, schema))).collect()
    by_level = {}
    for r in summary:
        by_level.setdefault(r.level, []).append(r)
        assert r.success + r.error == r.total and r.not_generated_query <= r.error
    assert {k: len(v) for k, v in by_level.items()} == {"source": 3, "target": 2, "total": 1}
    for level in by_level.values():
        assert sum(r.total for r in level) == 4 and sum(r.success for r in level) == 2
