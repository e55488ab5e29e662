"""Order-dependent operators against plain loops, with one key far larger than the rest."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.operators import attempts as A
from pairloom.operators import ordering as O
from pairloom.operators.prompts import batch_questions, choose_questions

rng = random.Random(7)
ROWS = [("hot" if i % 3 else rng.choice(["a", "b", None]), i * 5 + 1, rng.randrange(4)) for i in range(900)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(rng.sample(ROWS, len(ROWS)), "db_id string, ord long, v int").repartition(5)


def loop_sums(value):
    expected, sums = {}, defaultdict(int)
    for db, ord_, v in sorted(ROWS, key=lambda r: r[1]):
        sums[db] += value(v)
        expected[ord_] = sums[db]
    return expected


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_running_sum(rows, bits):
    got = O.running_sum(rows, ["db_id"], O.by_range(F.col("ord"), bits), [F.col("ord")], F.col("v"), "s")
    assert got.columns == ["db_id", "ord", "v", "s"]
    assert {r.ord: r.s for r in got.collect()} == loop_sums(lambda v: v)


def test_running_sum_without_keys(rows):
    got = O.running_sum(rows, [], O.by_range(F.col("ord"), 5), [F.col("ord")], F.col("v"), "s").collect()
    total, expected = 0, {}
    for _, ord_, v in sorted(ROWS, key=lambda r: r[1]):
        total += v
        expected[ord_] = total
    assert {r.ord: r.s for r in got} == expected


def test_hot_key_is_cut_into_buckets(rows):
    """No task sorts more than one bucket of the hot key."""
    bucketed = rows.select("db_id", O.by_range(F.col("ord"), 6).alias("b")).groupBy("db_id", "b").count()
    assert bucketed.agg(F.max("count")).first()[0] <= 1 << 6
    plan = O.running_number(rows, ["db_id"], O.by_range(F.col("ord"), 6), [F.col("ord")], "n")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "_bucket" in text


def place_by_loop(seed):
    groups = defaultdict(list)
    for db, ord_, _ in ROWS:
        key = (hashlib.md5(f"{seed}:{db or ''}:{ord_}".encode()).hexdigest(), ord_) if seed != -1 else ("", ord_)
        groups[db].append((key, ord_))
    return {ord_: n for group in groups.values() for n, (_, ord_) in enumerate(sorted(group), 1)}


@pytest.mark.parametrize("seed", [-1, 12, 13])
def test_both_ways_of_numbering_agree(rows, seed):
    expected = place_by_loop(seed)
    everything = O.number_questions(rows, ["db_id"], seed)
    assert {r.ord: r.pos for r in everything.collect()} == expected
    for limit in (0, 7, 5000):
        some = O.number_questions(rows, ["db_id"], seed, largest_limit=limit)
        assert {r.ord: r.pos for r in some.collect()} == {o: p for o, p in expected.items() if p <= limit}


def test_seed_zero_is_a_new_permutation(rows):
    places = O.number_questions(rows, ["db_id"], 0).collect()
    by_db = defaultdict(list)
    for r in places:
        by_db[r.db_id].append(r.pos)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by_db.values())
    # the same frame computed again keeps its order: the seed is drawn once
    frame = O.number_questions(rows, ["db_id"], 0)
    assert sorted(map(str, frame.collect())) == sorted(map(str, frame.collect()))


def test_small_limits_are_cut_before_the_shuffle(rows):
    plan = O.number_questions(rows, ["db_id"], 12, largest_limit=20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_first_rows_with_and_without_salt(rows):
    """The salted way is the one for very many tasks; it must give the same rows."""
    order = [F.col("v").desc(), F.col("ord")]
    plain = O.first_rows_per_key(rows, ["db_id"], order, 9, "n", ["ord"])
    salted = O.first_rows_per_key(rows, ["db_id"], order, 9, "n", ["ord"], gather_rows=0)
    assert plain.columns == salted.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))
    assert salted._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_limits_per_pipeline(spark):
    questions = spark.createDataFrame(
        [("d", db, i, f"q{i}", "s") for db in ("x", "y") for i in range(30)],
        "dataset string, db_id string, ord long, question string, query string",
    )
    settings = spark.createDataFrame(
        [(0, "d", ["x"], -1, 12), (1, "d", [], -1, -1), (2, "d", ["y", "y"], 5, 0), (3, "d", ["y"], 5, 40), (4, "e", [], -1, 3)],
        "pipeline_no int, source_dataset string, source_db_ids array<string>, seed long, question_limit int",
    ).withColumns({"target_dataset": F.lit("t"), "target_db_id": F.lit("g")})
    chosen = choose_questions(questions, settings)
    counts = {tuple(r)[:2]: r["count"] for r in chosen.groupBy("pipeline_no", "source_db_id").count().collect()}
    assert counts == {(0, "x"): 12, (1, "x"): 30, (1, "y"): 30, (3, "y"): 30}
    named = chosen.withColumns({"dataset": F.col("source_dataset"), "db_id": F.col("source_db_id")})
    batches = batch_questions(named, ["pipeline_no", "source_db_id"], 10)
    sizes = sorted((r.pipeline_no, r.source_db_id, r.batch_no, r.n_questions) for r in batches.collect())
    assert [s for s in sizes if s[0] == 0] == [(0, "x", 0, 10), (0, "x", 1, 2)]


def attempts(spark, rows):
    return spark.createDataFrame(rows, "p int, attempt int, valid boolean, error_class string")


def test_used_attempts(spark):
    rows = [
        (1, 0, True, None), (1, 1, True, None),
        (2, 0, False, "json_decode"), (2, 1, True, None), (2, 2, False, "x"),
        (3, 0, False, "a"), (3, 1, False, "b"), (3, 2, False, "c"), (3, 3, True, None),
        (4, 0, False, "a"),
    ]
    used = A.used_attempts(attempts(spark, rows), ["p"])
    assert sorted((r.p, r.attempt) for r in used.collect()) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (4, 0)]
    assert sorted((r.p, r.error_class) for r in A.rejected(used).collect()) == [(3, "c"), (4, "a")]
    assert sorted((r.p, r.attempt) for r in A.accepted(used).collect()) == [(1, 0), (2, 1)]


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_failure_limit(spark, limit):
    rows = [(p, a, False, "unexpected" if (p * 3 + a) % 5 == 0 else "json_decode") for p in range(200) for a in range(3)]
    got = A.stop_after_failures(attempts(spark, rows).repartition(4), ["p", "attempt"], limit)
    expected, failures = [], 0
    for p, a, _, e in rows:
        failures += e == "unexpected"
        expected.append((p, a))
        if failures >= limit:
            break
    assert sorted((r.p, r.attempt) for r in got.collect()) == expected
