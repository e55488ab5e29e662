"""Readers over files that are good, odd or broken; writers."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pairloom.session import fresh_folder, shared_folder
from pairloom.sources import files, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text, indent=2))


def test_questions(spark, tmp_path):
    rows = [{"dataset": "d", "db_id": "a b+c", "question": f"é{i}", "query": "q"} for i in range(3)]
    put(tmp_path / "questions/question_a b+c.json", rows)
    put(tmp_path / "questions/question_broken.json", '[{"db_id": "x"} {"db_id": "y"}]')
    put(tmp_path / "questions/question_object.json", {"db_id": "x"})
    put(tmp_path / "questions/question_empty.json", [])
    put(tmp_path / "questions/question_nan.json", '[{"db_id": "n", "question": NaN, "query": "q", "query": "last"}]')
    got = files.scan_questions(spark, f"{tmp_path}/questions").orderBy("db_id", "ord").collect()
    assert [(r.db_id, r.ord, r.question, r.query) for r in got] == [
        ("a b+c", 0, "é0", "q"), ("a b+c", 1, "é1", "q"), ("a b+c", 2, "é2", "q"), ("n", 0, "NaN", "last")]
    assert got[0].src_file.endswith("/questions/question_a b+c.json")


def test_files_beyond_the_limit_of_one_value(spark, tmp_path):
    rows = [{"dataset": "d", "db_id": "big", "question": f"{i} " + "x" * 1000, "query": "q"} for i in range(140_000)]
    put(tmp_path / "questions/question_big.json", json.dumps(rows))
    put(tmp_path / "m/dev/m1/tgt/response_s.json", json.dumps(rows))
    assert (tmp_path / "questions/question_big.json").stat().st_size > 128 * 2**20
    got = files.scan_questions(spark, f"{tmp_path}/questions").selectExpr("count(*)", "max(ord)", "min(length(question))").first()
    assert tuple(got) == (140_000, 139_999, 1002)
    assert files.scan_mappings(spark, f"{tmp_path}/m", fields=["query"]).filter("query = 'q'").count() == 140_000


def test_only_the_folders_own_json_files(spark, tmp_path):
    rows = [{"dataset": "d", "db_id": "a", "question": "x", "query": "q"}]
    put(tmp_path / "questions/question_a.json", rows)
    put(tmp_path / "questions/question_parts.json/part-0.json", rows)
    put(tmp_path / "questions/old/question_b.json", rows)
    put(tmp_path / "questions/notes.txt", json.dumps(rows))
    assert files.scan_questions(spark, f"{tmp_path}/questions").count() == 2
    assert files.scan_questions(spark, f"{tmp_path}/none").count() == 0


def test_odd_samples_and_schemas(spark, tmp_path):
    put(tmp_path / "s/sample_x.json", '{"t\\"": [[NaN, 1]], "u": [[1]], "u": [[2]]}')
    put(tmp_path / "s/sample_y.json", '[1, NaN]')
    got = files.sample_rows(files.scan_samples(spark, f"{tmp_path}/s")).select("table_name", F.to_json("row_values"))
    assert sorted(tuple(r) for r in got.collect()) == [('t"', '["NaN",1]'), ("u", "[2]")]
    put(tmp_path / "schemas.json", '{"a": "x", "a": "y"}')
    assert [tuple(r)[1:] for r in files.scan_schemas(spark, f"{tmp_path}/schemas.json").collect()] == [("a", "y")]
    assert files.schema_problems(spark, f"{tmp_path}/schemas.json").count() == 0


def test_samples(spark, tmp_path):
    put(tmp_path / "s/sample_x.v2.json", {"t": [[1, 2.5, None, "a"], [2, 3, "b", "c"]], "u": []})
    put(tmp_path / "s/sample_bad.json", "{")
    samples = files.scan_samples(spark, f"{tmp_path}/s")
    assert [r.db_id for r in samples.collect()] == ["x"]
    rows = files.sample_rows(samples).select("db_id", "table_name", "row_ord", F.to_json("row_values").alias("v")).orderBy("row_ord").collect()
    assert [tuple(r) for r in rows] == [("x", "t", 0, '[1,2.5,null,"a"]'), ("x", "t", 1, '[2,3,"b","c"]')]


def test_schemas(spark, tmp_path):
    put(tmp_path / "good/schemas.json", {"a": "CREATE\nTABLE", "b": "x"})
    put(tmp_path / "bad/schemas.json", "{'a'}")
    put(tmp_path / "empty/schemas.json", '""')
    paths = [f"{tmp_path}/{n}/schemas.json" for n in ("good", "bad", "empty")]
    assert sorted((r.db_id, r.schema_ddl) for r in files.scan_schemas(spark, *paths).collect()) == [("a", "CREATE\nTABLE"), ("b", "x")]
    problems = {r.path.split("/")[-2]: r.reason for r in files.schema_problems(spark, *paths).collect()}
    assert problems == {"bad": "schemas.json files are not valid JSON", "empty": "schemas.json files are empty"}


def test_mappings(spark, tmp_path):
    put(tmp_path / "m/dev/model-1/tgt/response_src_1.json", [{"target_query": "q0", "source_db_id": "ignored"}, {"target_query": None}])
    put(tmp_path / "m/dev/model-1/tgt/raw/response_src_1_llm.json", [{"target_query": "no"}])
    rows = files.scan_mappings(spark, f"{tmp_path}/m").orderBy("ord").collect()
    assert [(r.target_dataset, r.model, r.target_db_id, r.source_db_id, r.ord, r.target_query) for r in rows] == [
        ("dev", "model-1", "tgt", "src_1", 0, "q0"), ("dev", "model-1", "tgt", "src_1", 1, None)]


@pytest.mark.parametrize(
    "path, key",
    [("file:/x/response_a.b.json", "a.b"), ("response_.json", ""), ("/d/f=response_a.json/part-0.txt", "a"), ("/x/other_a.json", "")],
)
def test_path_key(spark, path, key):
    assert spark.range(1).select(files.path_key(F.lit(path), "response_")).first()[0] == key


def test_partition_overwrite_keeps_the_others(spark, tmp_path):
    rows = spark.createDataFrame([("d", "m", "t", s, i) for s in ("a", "b") for i in range(3)], "target_dataset string, model string, target_db_id string, source_db_id string, ord int")
    path = f"{tmp_path}/table"
    sinks.write_mappings(rows, path)
    sinks.write_mappings(rows.filter("source_db_id = 'b' AND ord = 1"), path)
    assert sorted((r.source_db_id, r.ord) for r in spark.read.parquet(path).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 1)]
    plan = files.scan_table(spark, path, sources=["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "source_db_id" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_folders_do_not_collide(spark):
    assert fresh_folder(spark, "x") != fresh_folder(spark, "x")
    assert fresh_folder(spark, "x").startswith(shared_folder(spark))


def _documents(rng, n):
    """Array elements with brackets, quotes and backslashes wherever they can stand."""
    odd = ["}", "{", "]", '"', "\\", "é", "a", ",", "\n", "[{", '\\"}']

    def text():
        return "".join(rng.choice(odd) for _ in range(rng.randrange(8)))

    def value(depth):
        kind = rng.randrange(8)
        if kind < 4 or depth > 2:
            return text()
        if kind == 4:
            return {text() or str(i): value(depth + 1) for i in range(rng.randrange(3))}
        return [value(depth + 1) for _ in range(rng.randrange(3))] if kind == 5 else rng.choice([1, None, True, 2.5])

    return [{"db_id": text(), "query": text(), "question": str(i), "more": value(0)} if rng.random() < 0.9 else value(1) for i in range(n)]


@pytest.fixture
def small_ranges(spark, monkeypatch):
    monkeypatch.setattr(files, "LARGE", 0)
    monkeypatch.setattr(files.split_json, "CHUNK", 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "397")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _plain(path):
    rows = json.loads(path.read_text())
    known = lambda r, k: r[k] if isinstance(r, dict) and k in r else None
    return [(path.name, i, known(r, "db_id"), known(r, "question"), known(r, "query")) for i, r in enumerate(rows)]


def test_one_array_read_by_many_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    expect = []
    for n in range(5):
        path = tmp_path / f"questions/question_{n}.json"
        rows = _documents(rng, 40)
        put(path, json.dumps(rows, ensure_ascii=n % 2 == 0, indent=n % 3 or None))
        expect += _plain(path)
    put(tmp_path / "questions/question_short.json", '[ {"db_id": "x"} , "}", {"db_id": "y", "db_id": "z", "query": NaN} , [1] ]\n')
    put(tmp_path / "questions/question_none.json", " [ ] ")
    got = files.scan_questions(spark, f"{tmp_path}/questions")
    assert got.select("src_file").distinct().count() == 6
    rows = sorted((r.src_file.rsplit("/", 1)[1], r.ord, r.db_id, r.question, r.query) for r in got.collect() if "short" not in r.src_file)
    assert rows == sorted(expect)
    short = [(r.ord, r.db_id, r.query) for r in got.filter(F.col("src_file").contains("short")).orderBy("ord").collect()]
    assert short == [(0, "x", None), (1, None, None), (2, "z", "NaN"), (3, None, None)]


@pytest.mark.parametrize(
    "text",
    ['[{"a": 1} {"a": 2}]', '[{"a": 1}]}', '[{"a": 1}], {"a": 2}]', '[{"a": 1}', '{"a": 1}', '{"a": [{"b": 1}]}', '[{"a": 1},]', "[,{}]", '[{"a": "x]', "", "[{}] x", '[{"a": {"b": 1}}, {"c": }]', "[}{]"],
)
def test_broken_arrays_give_no_rows(spark, tmp_path, small_ranges, text):
    put(tmp_path / "q/question_b.json", text)
    put(tmp_path / "q/question_g.json", [{"db_id": str(i)} for i in range(30)])
    assert [r.db_id for r in files.scan_questions(spark, f"{tmp_path}/q").orderBy("ord").collect()] == [str(i) for i in range(30)]


def test_transducer_composes():
    rng = random.Random(3)
    text = json.dumps(_documents(rng, 50))
    for piece in text.split("}"):
        swaps, outside, inside = files.split_json.piece_moves(piece)
        bare = re.sub(r"\\.", "", piece)
        assert swaps == (bare.count('"') % 2 == 1) and isinstance(outside + inside, int)
    depth, within = 0, False
    for piece in text.split("}")[:-1]:
        swaps, outside, inside = files.split_json.piece_moves(piece)
        depth += inside if within else outside
        within ^= swaps
    assert (depth, within) == (1, False)


def test_long_lists_prune_partitions(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "concat('t', id % 20) AS target_db_id", "concat('s', id % 7) AS source_db_id")
    rows.write.partitionBy("target_db_id", "source_db_id").parquet(f"{tmp_path}/table")
    wanted = [f"t{i}" for i in range(3)] + [f"none{i}" for i in range(10_000)]
    table = spark.createDataFrame([("s1",), ("s2",), (None,)], "db string")
    table.write.parquet(f"{tmp_path}/allowed")
    for targets, sources in ((wanted, ()), (wanted, spark.read.parquet(f"{tmp_path}/allowed")), (wanted[:3], ["s1", "s2"])):
        got = files.scan_table(spark, f"{tmp_path}/table", targets, sources)
        expect = rows.filter(F.col("target_db_id").isin("t0", "t1", "t2"))
        if sources:
            expect = expect.filter(F.col("source_db_id").isin("s1", "s2"))
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in expect.collect())
        plan = got._jdf.queryExecution().toString()
        assert len(plan) < 50_000 and "none77" not in plan
        if targets is wanted:
            assert "dynamicpruning" in plan.lower()
    assert files.scan_table(spark, f"{tmp_path}/table").count() == 200
