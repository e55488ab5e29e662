"""Lookups, membership, positions."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import execution_labels as X
from pairloom.operators.joins import lookup, not_in
from pairloom.operators.ratings import FILE, complete_files, place_in_part, rating_parts, select_pairs, zip_ratings
from pairloom.sources.sinks import upsert_stats


@pytest.fixture(scope="module")
def facts(spark):
    """Two thirds of the rows share one key."""
    return spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("k"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_ways_agree(spark, facts, how):
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", None), ("k99", 4)], "k string, v int")
    small = lookup(facts, table, ["k"], ["n"], how)
    large = lookup(facts, table, ["k"], ["n"], how, max_bytes=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.count() == (3000 if how == "left" else 2000 + 200)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_large_lookup_spreads_the_hot_key(spark, facts):
    table = spark.createDataFrame([("hot", 1)], "k string, v int").hint("merge")
    joined = lookup(facts.hint("merge"), table, ["k"], ["n"], max_bytes=0)
    salts = facts.filter("k = 'hot'").select(F.pmod(F.xxhash64("n"), F.lit(64)).alias("s")).groupBy("s").count()
    assert salts.count() == 64 and salts.agg(F.max("count")).first()[0] < 100
    assert joined.count() == 2000


@pytest.mark.parametrize(
    "listed, expected",
    [([], [None, 1, 2, 3]), ([2, 2], [1, 3]), ([2, None], []), ([None], []), ([9], [1, 2, 3])],
)
def test_not_in(spark, listed, expected):
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "a int")
    excluded = spark.createDataFrame([(x,) for x in listed], "b int")
    got = [r.a for r in not_in(rows, "a", excluded, "b").collect()]
    assert sorted(got, key=lambda v: (v is not None, v)) == expected
    rows.createOrReplaceTempView("rows_")
    excluded.createOrReplaceTempView("listed_")
    own = spark.sql("SELECT a FROM rows_ WHERE a NOT IN (SELECT b FROM listed_)").collect()
    assert sorted(map(str, own)) == sorted(str(r) for r in not_in(rows, "a", excluded, "b").collect())


def test_zip(spark):
    pairs = spark.createDataFrame([("t", s, i) for s, n in (("a", 3), ("b", 2), ("c", 1)) for i in range(n)], "target_db_id string, source_db_id string, ord long")
    ratings = spark.createDataFrame([("t", s, i, f"{s}{i}") for s, n in (("a", 3), ("b", 1), ("d", 1)) for i in range(n)], "target_db_id string, source_db_id string, ord long, v string")
    assert sorted((r.source_db_id, r.v) for r in zip_ratings(pairs, ratings).collect()) == [("a", "a0"), ("a", "a1"), ("a", "a2")]
    assert [tuple(r) for r in complete_files(pairs, ratings).collect()] == [("t", "a")]


def test_parts_of_a_long_file(spark):
    pairs = spark.range(10).select(
        F.lit("t").alias("target_db_id"), F.lit("s").alias("source_db_id"), (F.col("id") * 2).alias("ord"),
        F.concat(F.lit("q"), "id").alias("target_question"), F.lit(None).cast("string").alias("target_query"),
    )
    parts = rating_parts(pairs, FILE, size=8).orderBy("part").collect()
    assert [(p.part, p.n_sent, p.first_ord) for p in parts] == [(0, 4, 0), (1, 4, 8), (2, 2, 16)]
    assert parts[2].pairs_json == '[{"nl_question":"q8","sql_query":null},{"nl_question":"q9","sql_query":null}]'
    assert len(rating_parts(pairs, FILE).collect()) == 1
    placed = place_in_part(pairs, FILE, size=8).orderBy("ord").collect()
    assert [(p.part, p.pos) for p in placed] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]


def test_select_pairs(spark):
    raw = ['{"target_question":null,"target_query":null}', '{"target_question":"q"}', '{"target_query":1,"target_question":2,"x":3}', "[]"]
    assert select_pairs(spark.createDataFrame([(r,) for r in raw], "raw string")).count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "source_db_id string, request int, extra int")
    new = spark.createDataFrame([("b", 20, 1), ("c", 30, None)], "source_db_id string, request int, fresh int")
    rows = upsert_stats(old, new).orderBy("source_db_id").collect()
    assert [r.asDict() for r in rows] == [
        {"source_db_id": "a", "request": 1, "extra": 5, "fresh": None},
        {"source_db_id": "b", "request": 20, "extra": 6, "fresh": 1},
        {"source_db_id": "c", "request": 30, "extra": None, "fresh": None},
    ]


STATUS = [
    (None, "ok", 1, "Null_Query"), ("", "timeout", 0, "Null_Query"), ("q", "timeout", 9, "Error (Timeout)"), ("q", "error", 9, "Error"),
    ("q", "ok", 0, "Empty"), ("q", "ok", 1, "Success"), ("q", "ok", 50, "Success"), ("q", "ok", 51, "Success (more than 50 rows)"),
    (" ", "ok", 0, "Empty"),
]


def test_result_status(spark):
    df = spark.createDataFrame([(i, *s[:3]) for i, s in enumerate(STATUS)], "i int, target_query string, outcome string, fetched_rows long")
    assert [r.result_status for r in X.label_executions(df).orderBy("i").collect()] == [s[3] for s in STATUS]


def test_preview_keeps_fifty_and_knows_of_more(spark):
    rows = spark.range(500).select((F.col("id") % 5 * F.when(F.col("id") < 400, 0).otherwise(1)).alias("q"), "id")
    kept = {r.q: r for r in X.preview_rows(X.fetch_cap(rows, ["q"], ["id"]), ["q"], F.col("id")).collect()}
    assert kept[0].fetched_rows == 51 and kept[0].execution_result == list(range(50))
    assert kept[1].fetched_rows == 20 and kept[1].execution_result == list(range(401, 500, 5))


def test_join_below_with_a_hot_key(spark):
    from pairloom.operators.range_join import dealt, join_below

    left = spark.range(400).selectExpr("id AS l", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "CASE WHEN id % 50 = 0 THEN NULL ELSE (id * 37) % 101 END AS u")
    right = spark.range(3000).selectExpr("id AS r", "CASE WHEN id % 3 > 0 THEN 7 ELSE id % 400 END AS k", "CASE WHEN id % 5 = 0 THEN 50 WHEN id % 97 = 0 THEN NULL ELSE (id * 53) % 103 END AS v")
    plain = left.join(right, "k").filter("v < u")
    for hot_rows in (100, 10**6):
        got = join_below(left, right, "k", "u", "v", hot_rows=hot_rows, bins=16)
        assert sorted(got.select("l", "r").collect()) == sorted(plain.select("l", "r").collect())
    # a third of a large table under one key, a fifth of that with one value
    big = spark.range(300_000).selectExpr("id AS r", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "CASE WHEN id % 5 = 0 THEN 50 ELSE (id * 53) % 10007 END AS v")
    few = spark.range(60).selectExpr("id AS l", "7L AS k", "id * 170 AS u")
    met, there = dealt(few, big.filter("k = 7"), "k", F.col("u").cast("double"), F.col("v").cast("double"), 4000, 32)
    parts = there.groupBy("k", "_bin", "_block").count()
    assert parts.agg(F.max("count")).first()[0] < 0.05 * 300_000
    # rows of the other side meet no bin above their own
    assert met.filter("NOT _border").join(there, ["k", "_bin", "_block"]).filter("v >= u").isEmpty()
