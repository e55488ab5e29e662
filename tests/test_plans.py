"""What the plans must not contain, and what they must."""

import pytest

from pairloom.plans import all_checks

QUERIES = all_checks()
# these start jobs while they are built; their parts are checked one by one elsewhere
EAGER = {n for n in QUERIES if n.startswith(("sink_", "scan_", "run_", "workload")) or n == "catalog_per_target"}


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "name, parts",
    [
        ("k_filter_eq", ["PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]"]),
        ("k_between", ["GreaterThanOrEqual(l_quantity,10.0)", "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>"]),
        ("k_count_distinct", ["ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>"]),
        ("first_valid_attempt", ["LessThan(turn,3)"]),
        ("per_db_limit", ["WindowGroupLimit"]),
        ("fetch_cap", ["WindowGroupLimit"]),
        ("template_by_source", ["partial_count"]),
    ],
)
def test_plan_has(spark, sf_dir, name, parts):
    plan = plan_of(spark, sf_dir, name)
    assert all(part in plan for part in parts), plan


@pytest.mark.parametrize("name", ["k_topn", "k_top1", "k_top_group"])
def test_top_k_needs_no_global_sort(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("name", ["failure_count", "concat_batches"])
def test_answers_are_read_once(spark, sf_dir, name):
    # what is counted and numbered is a stored table; reading the answers is not part of the plan any more
    plan = plan_of(spark, sf_dir, name)
    assert "ArrowEvalPython" not in plan and "Python" not in plan


def test_label_tables_are_joined_where_they_lie(spark, sf_dir):
    chain = QUERIES["chain_label_tables"](spark, sf_dir)
    plan = chain._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2, plan
    assert {"same_template", "result_status", "is_clear_and_meaningful", "is_correct_mapping"} < set(chain.columns)


def test_a_file_is_numbered_by_many_tasks(spark):
    from pairloom.operators.ratings import place_in_part

    pairs = spark.range(300_000).selectExpr("id AS ord", "'a' AS target_db_id", "'b' AS source_db_id")
    placed = place_in_part(pairs)
    assert placed.filter("pos <> ord").count() == 0
    windows = [line for line in placed._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [" in line]
    assert windows and all("_bucket" in line for line in windows), windows
