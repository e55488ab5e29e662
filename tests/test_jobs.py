"""All stages, one after the other, on a small hand-made corpus."""

import json

import pytest
from pyspark.sql import functions as F

from pairloom.functions.vocabulary import GUIDED_FIELDS
from pairloom.operators.workload import catalog_per_target, tables_below
from pairloom.plans import jobs
from pairloom.sources import files

RUN = "2025-01-01"


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=4))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for db, n in (("cars", 12), ("ships", 3)):
        rows = [{"dataset": "train", "db_id": db, "question": f"Q{i}?", "query": f"SELECT a{i} FROM t"} for i in range(n)]
        dump(root / f"data/train/questions/question_{db}.json", rows)
    dump(root / "data/train/questions/question_broken.json", '[{"db_id": "x" ')
    dump(root / "data/train/questions/question_empty.json", [])
    dump(root / "data/train/schemas.json", {"cars": "CREATE TABLE t(a)", "ships": "CREATE TABLE s(b)"})
    dump(root / "data/dev/schemas.json", {"school": "CREATE TABLE pupils(name)"})
    dump(root / "data/dev/target_samples/sample_school.json", {"pupils": [["Ann", 7], ["Bob", 7.5], [None, 8]]})
    return root


@pytest.fixture(scope="module")
def settings():
    one = {
        "source_dataset": "data/train",
        "source_db_ids": [],
        "source_questions_shuffle_seed": -1,
        "source_questions_limit": 11,
        "target_dataset": "data/dev",
        "target_db_id": "school",
    }
    return {
        "generation": {"max_question_length_per_prompt": 10, "method": "guided", "base_prompt": "BASE"},
        "data": [one, {**one, "source_db_ids": ["cars", "unknown"]}, {**one, "target_db_id": "nowhere"}],
    }


def answer(pipeline, db, batch, attempt, rows, error=None):
    text = None if error else json.dumps(rows) if isinstance(rows, list) else rows
    return pipeline, db, batch, attempt, text, 10, 5, 1.5, 0.5, "", error


def mapped(db, query, question="How many?"):
    values = dict.fromkeys(GUIDED_FIELDS, "x")
    values |= {"source_db_id": db, "target_db_id": "school", "source_query": "SELECT a FROM t"}
    return values | {"target_query": query, "target_question": question}


@pytest.fixture(scope="module")
def work(spark, corpus, settings, tmp_path_factory):
    work = str(tmp_path_factory.mktemp("work"))
    jobs.prompts_stage(spark, settings, str(corpus), work, RUN)
    good = json.dumps([mapped("cars", "SELECT name FROM pupils"), mapped("cars", "SELECT NULL")], indent=1)
    answers = [
        answer(0, "cars", 0, 0, None, error="boom"),
        answer(0, "cars", 0, 1, "```json\n" + good.replace('"x",\n', '"x"\n', 1) + "\n```"),
        answer(0, "cars", 0, 2, [mapped("cars", "never used")]),
        answer(0, "cars", 1, 0, [mapped("cars", "SELECT nope FROM pupils")]),
        answer(0, "ships", 0, 0, [mapped("cars", "SELECT 1")]),
        answer(0, "ships", 0, 1, "sorry"),
        answer(0, "ships", 0, 2, [{"a": 1}]),
    ]
    jobs.mappings_stage(spark, settings, spark.createDataFrame(answers, jobs.RESPONSES), work, RUN, "m1")
    return work


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_prompts(spark, work):
    prompts = spark.read.parquet(f"{work}/prompts")
    # 11 of 12 questions in batches of 10; the other two pipelines name unknown databases
    assert rows(prompts, "pipeline_no", "source_db_id", "batch_no", "n_questions") == [
        (0, "cars", 0, 10), (0, "cars", 1, 1), (0, "ships", 0, 3)]
    text = prompts.filter("source_db_id = 'cars' AND batch_no = 1").first().prompt
    assert text.startswith("BASE\n\n## Generate the query for the following query:\n\n# Source schema\n{\n")
    assert '"schema": "CREATE TABLE t(a)"' in text and '"schema": "CREATE TABLE pupils(name)"' in text
    assert '{"pupils":[["Ann",7],["Bob",7.5],[null,8]]}' in text
    assert text.endswith('"question":"Q10?","query":"SELECT a10 FROM t"}]\n\n#Output:\n\n')


def test_mappings(spark, work):
    pairs = spark.read.parquet(f"{work}/mappings")
    assert rows(pairs, "target_dataset", "model", "source_db_id", "ord", "target_query") == [
        ("dev", "m1", "cars", 0, "SELECT name FROM pupils"),
        ("dev", "m1", "cars", 1, "SELECT NULL"),
        ("dev", "m1", "cars", 2, "SELECT nope FROM pupils"),
    ]
    rejects = spark.read.parquet(f"{work}/rejects")
    assert rows(rejects, "source_db_id", "attempt", "error_class", "errors.fields_mismatch") == [
        ("ships", 2, "fields_mismatch", True)]
    assert rejects.first().prompt.startswith("BASE")
    # every answer that is not empty is in the transcripts, also the useless ones
    assert spark.read.parquet(f"{work}/transcripts").count() == 5


def test_counters(spark, work):
    stats = spark.read.parquet(f"{work}/stats").filter("depth = 2")
    found = rows(
        stats, "source_db_id", "request", "response", "success_response", "error_response", "corrected_response",
        "unexpected_error", "input_token", "output_token", "time_taken",
    )
    assert found == [("cars", 3, 2, 1, 0, 1, 1, 20, 10, 3.0), ("ships", 3, 3, 0, 3, 0, 0, 30, 15, 4.5)]
    assert rows(spark.read.parquet(f"{work}/exceptions"), "source_db_id", "error", "n") == [("cars", "boom", 1)]


def test_evaluation(spark, work, tmp_path):
    settings = {"data": {"source_databases": [], "target_databases": ["school"]}, "evaluation": {"dataset_name": "dev", "model_dir": "m1"}}
    labelled = jobs.template_stage(spark, settings, jobs.read_run(spark, f"{work}/mappings", RUN), work, RUN)
    assert rows(labelled, "ord", "is_generated", "same_template") == [
        (0, "True", "True"), (1, "False", "False"), (2, "True", "True")]
    total = spark.read.json(f"{work}/summary_template").filter("level = 'total'").first()
    assert (total.success, total.error, total.not_generated_query, total.total) == (2, 1, 1, 3)

    spark.range(60).select(F.concat(F.lit("p"), "id").alias("name")).write.parquet(f"{tmp_path}/dbs/school/pupils.parquet")
    sessions = catalog_per_target(spark, tables_below(spark, f"{tmp_path}/dbs"))
    labelled = jobs.execution_stage(spark, settings, sessions, work, RUN)
    assert rows(labelled, "ord", "result_status") == [
        (0, "Success (more than 50 rows)"), (1, "Success"), (2, "Error")]
    assert len(json.loads(labelled.filter("ord = 0").first().execution_result)) == 50

    dump(tmp_path / "schemas.json", {"school": "CREATE TABLE pupils(name)"})
    prompts = jobs.rating_prompts_stage(spark, settings, files.scan_schemas(spark, f"{tmp_path}/schemas.json"), work, RUN, "JUDGE")
    assert prompts.first().n_sent == 3
    assert '"CREATE TABLE pupils(name)"' in prompts.first().prompt

    def rating(clear, right):
        return {
            "clarity_and_alignment_of_NL": {"thought_process": "t", "is_clear_and_meaningful": clear},
            "correctness": {"is_correct_mapping": right},
        }

    key = ("guided", "dev", "m1", "school", "cars", 0)
    full = json.dumps([rating("Yes", "no"), rating("yes", "yes"), rating("maybe", "YES")])
    answers = [(*key, 0, json.dumps([rating("yes", "yes")]), "", None), (*key, 1, full, "", None)]
    labelled = jobs.semantic_stage(spark, settings, spark.createDataFrame(answers, jobs.RATINGS), work, RUN)
    assert rows(labelled, "ord", "meaningful_nl_question", "correct_target_nl_sql_mapping", "nl_thought", "sql_thought") == [
        (0, "Yes", "no", "t", "N/A"), (2, "maybe", "YES", "t", "N/A")]
    assert "result_status" in labelled.columns and "same_template" in labelled.columns
    total = spark.read.json(f"{work}/summary_semantic").filter("level = 'total'").first()
    assert (total.meaningful_nl_question, total.correct_sql_mapping, total.total) == (1, 1, 2)
    assert spark.read.parquet(f"{work}/unrated").count() == 0


def test_skipped_pipelines_have_reasons(spark, work):
    skipped = spark.read.parquet(f"{work}/skipped")
    assert rows(skipped, "pipeline_no", "dataset", "db_id", "reason") == [
        (1, "data/train", "unknown", "no questions"),
        (1, "data/train", "unknown", "no schema"),
        (2, "data/dev", "nowhere", "no samples"),
        (2, "data/dev", "nowhere", "no schema"),
    ]


@pytest.fixture(scope="module")
def real(settings, corpus):
    """Settings of the real shape: texts in files."""
    for name, text in (("base.txt", "BASE FILE"), ("sys.txt", "SYSTEM"), ("zero.txt", "ZERO"), ("judge.txt", "JUDGE "), ("ex.txt", "EXAMPLES")):
        dump(corpus / "prompts" / name, text)
    generation = {
        "max_question_length_per_prompt": 10, "method": "guided", "prompt_directory": "prompts", "base_prompt_file": "base.txt",
        "system_instruction_file": "sys.txt", "system_instruction_file_zeroshot": "zero.txt", "fields_to_check": list(GUIDED_FIELDS),
        "fields_to_check_zeroshot": ["source_db_id", "target_db_id", "target_question", "target_query"],
    }
    return {"generation": generation, "data": settings["data"][:1] * 2}


def zeroshot(real):
    return {**real, "generation": {**real["generation"], "method": "zeroshot"}}


def short(db, query):
    return {"source_db_id": db, "target_db_id": "school", "target_question": "How?", "target_query": query}


def test_texts_come_from_the_settings_files(spark, corpus, real, tmp_path):
    guided = jobs.prompts_stage(spark, real, str(corpus), str(tmp_path), "a").first()
    assert guided.prompt.startswith("BASE FILE\n") and guided.system == "SYSTEM"
    # the row's own data set name, not the folder's
    assert '"dataset":"train"' in guided.prompt
    other = jobs.prompts_stage(spark, zeroshot(real), str(corpus), str(tmp_path), "b").first()
    assert not other.prompt.startswith("BASE") and other.system == "ZERO"
    assert jobs.judge_text(spark, {"prompt_file": "judge.txt", "examples_file": "ex.txt"}, str(corpus)) == "JUDGE EXAMPLES"
    with pytest.raises(FileNotFoundError):
        jobs.prompts_stage(spark, {**real, "generation": {**real["generation"], "base_prompt_file": "no.txt"}}, str(corpus), str(tmp_path), "c")
    with pytest.raises(ValueError, match="unknown method"):
        jobs.method_of({"method": "nonsense"})


def test_methods_pipelines_and_repeated_runs(spark, corpus, real, tmp_path):
    work = str(tmp_path)

    def run(settings, stamp, answers):
        jobs.prompts_stage(spark, settings, str(corpus), work, stamp)
        return jobs.mappings_stage(spark, settings, spark.createDataFrame(answers, jobs.RESPONSES), work, stamp, "m1")

    # two pipelines with the same source and target: the later one's pairs stay, keys are unique
    both = [answer(n, "cars", 0, 0, [mapped("cars", f"SELECT {n}{i}") for i in range(2)]) for n in (0, 1)]
    for _ in range(2):
        pairs = run(real, "a", both)
    assert rows(pairs, "method", "ord", "target_query") == [("guided", 0, "SELECT 10"), ("guided", 1, "SELECT 11")]
    run(zeroshot(real), "b", [answer(0, "cars", 0, 0, [short("cars", "SELECT z")])])
    assert rows(spark.read.option("mergeSchema", "true").parquet(f"{work}/mappings"), "method", "ord") == [("guided", 0), ("guided", 1), ("zeroshot", 0)]
    assert spark.read.parquet(f"{work}/transcripts").filter("run_ts = 'a'").count() == 2
    assert rows(jobs.read_run(spark, f"{work}/counters", "b"), "source_db_id", "request", "real_time") == [("cars", 1, 0.5)]
    # an evaluation sees its own run only, also when nothing is left
    options = {"evaluation": {"dataset_name": "dev"}}
    assert jobs.template_stage(spark, options, jobs.read_run(spark, f"{work}/mappings", "a"), work, "a").count() == 2
    options["evaluation"]["dataset_name"] = "other"
    assert jobs.template_stage(spark, options, jobs.read_run(spark, f"{work}/mappings", "a"), work, "a").count() == 0


def test_a_file_is_rated_whole_or_not_at_all(spark, tmp_path):
    work, n = str(tmp_path), 1500
    pairs = spark.range(n).selectExpr(
        "'guided' AS method", "'dev' AS target_dataset", "'m1' AS model", "'t' AS target_db_id", "'s' AS source_db_id", "id AS ord",
        "'q' AS target_question", "'SELECT 1' AS target_query", "'True' AS is_generated",
    )
    jobs.sinks.replace_run(pairs, f"{work}/labelled_execution", RUN, jobs.FILE_KEYS)
    settings = {"evaluation": {"pairs_per_prompt": 1024}}
    schemas = spark.createDataFrame([("t", "ddl")], "db_id string, schema_ddl string")
    prompts = jobs.rating_prompts_stage(spark, settings, schemas, work, RUN, "J")
    assert rows(prompts, "part", "n_sent") == [(0, 1024), (1, 476)]
    good = json.dumps([{"correctness": {"is_correct_mapping": "yes"}}] * 1024)
    key = ("guided", "dev", "m1", "t", "s")
    answers = spark.createDataFrame([(*key, 0, 0, good, "", None), (*key, 1, 0, "[]", "", None)], jobs.RATINGS)
    assert jobs.semantic_stage(spark, settings, answers, work, RUN).count() == 0
    assert rows(spark.read.parquet(f"{work}/unrated"), "target_db_id", "source_db_id") == [("t", "s")]
    # without the setting a file is one prompt
    assert rows(jobs.rating_prompts_stage(spark, {}, schemas, work, RUN, "J"), "part", "n_sent") == [(0, n)]


def test_counters_do_not_depend_on_the_order_of_runs(spark, tmp_path):
    held = {"1": [("a", 1, 10), ("b", 2, 20)], "2": [("a", 5, None)], "3": [("c", 7, 70)]}

    def merged(name, order):
        for run in order:
            stats = [(2, 0, db, n, t) for db, n, t in held[run]]
            jobs.sinks.replace_run(spark.createDataFrame(stats, "depth int, pipeline_no int, source_db_id string, request long, time long"), f"{tmp_path}/{name}/stats", run)
            jobs.merge_counters(spark, f"{tmp_path}/{name}/stats", run, f"{tmp_path}/{name}/counters")
        return [sorted(tuple(r) for r in jobs.read_run(spark, f"{tmp_path}/{name}/counters", run).collect()) for run in "123"]

    expect = [[("a", 1, 10), ("b", 2, 20)], [("a", 5, 10), ("b", 2, 20)], [("a", 5, 10), ("b", 2, 20), ("c", 7, 70)]]
    assert merged("one", "123") == expect
    assert merged("other", "31223") == expect
