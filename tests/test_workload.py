"""Running queries: limits, deadlines, resuming."""

import time

import pytest
from pyspark.sql import functions as F

from pairloom.operators import workload as W

SLOW = "SELECT sum(sqrt(id + i)) FROM range(1000000) LATERAL VIEW explode(sequence(1, 1000000)) AS i"


@pytest.fixture(scope="module")
def sessions(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("dbs")
    spark.range(60).select("id", (F.col("id") + 1).alias("v")).write.parquet(f"{root}/one/things.parquet")
    spark.range(5).write.parquet(f"{root}/two/others.parquet")
    tables = W.tables_below(spark, str(root))
    assert {k: set(v) for k, v in tables.items()} == {"one": {"things"}, "two": {"others"}}
    return W.catalog_per_target(spark, tables)


@pytest.mark.parametrize(
    "sql, outcome, rows, condition",
    [
        ("SELECT * FROM things", "ok", 51, None),
        ("SELECT count(*) FROM things;", "ok", 1, None),
        ("SELECT id FROM things WHERE id < 0 -- none", "ok", 0, None),
        ("SELECT a.id, b.id FROM things a JOIN things b ON a.id = b.v ORDER BY a.id DESC LIMIT 2", "ok", 2, None),
        ("WITH x AS (SELECT 1 AS a) SELECT NULL FROM x", "ok", 1, None),
        ("SELECT id FROM others", "error", 0, "TABLE_OR_VIEW_NOT_FOUND"),
        ("SELECT nope FROM things", "error", 0, "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
        ("DROP VIEW things", "error", 0, "PARSE_SYNTAX_ERROR"),
        ("CREATE TABLE x AS SELECT 1", "error", 0, "PARSE_SYNTAX_ERROR"),
        ("SELECT 1) UNION (SELECT 2", "error", 0, "PARSE_SYNTAX_ERROR"),
        ("SELECT raise_error('x') FROM things", "error", 0, "USER_RAISED_EXCEPTION"),
        ("SELECT 1/0", "error", 0, "DIVIDE_BY_ZERO"),
    ],
)
def test_outcomes(sessions, sql, outcome, rows, condition):
    got = W.run_statement(sessions["one"], "one", sql)
    assert (got[2], got[3], got[5]) == (outcome, rows, condition), got[4]


@pytest.mark.parametrize(
    "sql, condition",
    [
        ("SELECT * FROM parquet.`{root}/two/others.parquet`", None),
        ("SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", "FORBIDDEN_FUNCTION"),
        ("SELECT `reflect` ('java.lang.System', 'lineSeparator')", "FORBIDDEN_FUNCTION"),
    ],
)
def test_nothing_but_the_targets_tables(sessions, sql, condition):
    root = sessions.tables["two"]["others"].rsplit("/two/", 1)[0]
    got = W.run_statement(sessions["one"], "one", sql.format(root=root))
    assert got[2] == "error" and (condition is None or got[5] == condition)
    assert not W.calls_the_host("SELECT 'reflect(1)' FROM things")


def test_shards_make_up_the_whole(spark, sessions, tmp_path):
    pairs = spark.createDataFrame([("one", f"SELECT {i}") for i in range(9)], "target_db_id string, target_query string")
    path = f"{tmp_path}/outcomes"
    first = W.run_workload(pairs, sessions, path, shard=0, shards=2).count()
    assert 0 < first < 9
    both = W.run_workload(pairs, sessions, path, shard=1, shards=2)
    assert both.count() == 9 and both.select("target_query").distinct().count() == 9


def test_order_is_kept(sessions):
    got = W.run_statement(sessions["one"], "one", "SELECT id FROM things ORDER BY id DESC")
    assert got[4].startswith("[[59], [58], [57]") and got[4].count("[") == 51


def test_deadline(sessions):
    start = time.time()
    got = W.run_statement(sessions["one"], "one", SLOW, seconds=1)
    assert got[2] == "timeout" and time.time() - start < 20
    # the thread is free for the next one
    assert W.run_statement(sessions["one"], "one", "SELECT 1")[2] == "ok"


def test_each_query_once_and_resumable(spark, sessions, tmp_path, monkeypatch):
    pairs = spark.createDataFrame(
        [(i, "one", f"SELECT {i % 3}") for i in range(20)] + [(90, "gone", "SELECT 1"), (91, "one", None), (92, "one", "")],
        "ord int, target_db_id string, target_query string",
    )
    ran, original = [], W.run_statement
    monkeypatch.setattr(W, "run_statement", lambda *a: ran.append(a[2]) or original(*a))
    path = f"{tmp_path}/outcomes"
    W.run_workload(pairs.filter("target_query = 'SELECT 0'"), sessions, path, slice_size=2)
    outcomes = W.run_workload(pairs, sessions, path, slice_size=2)
    assert sorted(ran) == ["SELECT 0", "SELECT 1", "SELECT 2"]
    assert outcomes.count() == 4
    labelled = W.label_workload(pairs, outcomes, ["ord"])
    counts = {r.result_status: r["count"] for r in labelled.groupBy("result_status").count().collect()}
    assert counts == {"Success": 20, "Error": 1, "Null_Query": 2}
    assert labelled.filter("ord = 91").first().execution_result == "Null_Query"


def test_equal_queries_written_differently_run_once(spark, sessions, tmp_path, monkeypatch):
    texts = [
        "SELECT count(*) FROM things WHERE id > 5", "select COUNT( * )  as n\nfrom THINGS where id > 5 -- same", "SELECT count(*) FROM things t WHERE t.id > 5;",
        "SELECT count(*) FROM things WHERE id > 6", "SELECT id FROM things ORDER BY id LIMIT 3", "SELECT x.id FROM things AS x ORDER BY x.id LIMIT 3",
        "SELECT raise_error('x') FROM things", "SELECT  raise_error('x') FROM things", "SELECT nope FROM things", "select nope FROM things",
    ]
    apart = {t: W.run_statement(sessions["one"], "one", t)[2:] for t in texts}
    ran = []
    plain = W.run_statement
    monkeypatch.setattr(W, "run_statement", lambda session, target, sql, seconds: ran.append(sql) or plain(session, target, sql, seconds))
    pairs = spark.createDataFrame([("one", t) for t in texts], "target_db_id string, target_query string")
    got = {r.target_query: tuple(r)[2:] for r in W.run_workload(pairs, sessions, str(tmp_path / "equal"), 60).collect()}
    assert got == apart
    # three groups of equal queries and all that end in an error
    assert len(ran) == 3 + 4 and len(set(ran)) == len(ran)


def test_plans_are_forgotten_oldest_first(sessions):
    equal = W.EqualQueries(most=2)
    for n in (1, 2, 3, 1):
        assert equal.run(sessions["one"], "one", f"SELECT id + {n} FROM things LIMIT 1")[2] == "ok"
    assert len(equal.known) == 2
