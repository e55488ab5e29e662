"""Readers of the curation inputs.

The JSON files read here hold one array or object each. A file up to LARGE bytes is
one task's work; an array in a larger one is read by many tasks (``split_json``).
That is how questions, samples, schemas and answers are exchanged; the jobs
themselves pass partitioned parquet tables on (see ``sinks``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.functions import json_text as J
from pairloom.functions.vocabulary import BAD_SCHEMA_FILE, EMPTY_SCHEMA_FILE, GUIDED_FIELDS
from pairloom.session import stored
from pairloom.sources import split_json

LARGE = 32 << 20
FEW_IDS = 100


def path_key(path: Column, prefix: str, to_first_dot: bool = False) -> Column:
    """The id inside ``<prefix><id>.json``, as a file or as a folder of part files."""
    known, rest = (r"[^/.]*", r"(?:\.[^/]*)?") if to_first_dot else (r"[^/]*?", "")
    return F.regexp_extract(path, rf"(?:^|[/=]){prefix}({known}){rest}\.json(?:/[^/]*)?$", 1)


def folder_name(path: Column, up: int = 0) -> Column:
    """The last segment of a path, or the one ``up`` levels above it."""
    return F.element_at(F.split(path, "/"), -1 - up)


def existing(spark: SparkSession, *patterns: str) -> list[str]:
    """The patterns that match something; a missing input is an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    hadoop = spark._jsc.hadoopConfiguration()
    return [p for p in patterns if path(p).getFileSystem(hadoop).globStatus(path(p))]


def existing_runs(spark: SparkSession, path: str) -> list[str]:
    """The names of the runs a table holds."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_ts=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(one.getPath().getName().removeprefix("run_ts=") for one in found or [])


def _wanted(spark: SparkSession, paths: tuple[str, ...], deep: bool) -> list[str]:
    return [p for path in paths for p in existing(spark, path if deep or path.endswith(".json") else f"{path}/*.json")]


def read_whole(spark: SparkSession, *paths: str, deep: bool = False, largest: int | None = None) -> DataFrame:
    """Every JSON file of the paths as one row: ``path`` and ``text``.

    A path is a file, or a folder of which the ``*.json`` directly inside are read (each a
    file or a folder of part files), with ``deep`` those at any depth. What does not exist
    gives no rows, nor do files of more than ``largest`` bytes, which are not opened.
    """
    wanted = _wanted(spark, paths, deep)
    if not wanted:
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.option("recursiveFileLookup", "true").text(wanted, wholetext=True)
    if largest is not None:
        files = files.filter(F.col("_metadata.file_size") <= largest)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(path.alias("path"), F.col("value").alias("text"))


def readable(files: DataFrame) -> DataFrame:
    """Add ``value``, the file's JSON as a variant, and ``parts``, its elements or entries as texts.

    ``parts`` holds what the native parser turns down: repeated keys, NaN, and files too
    large for one variant. Nothing is mended here; a broken file has neither.
    """
    boxed = F.concat(F.lit("["), F.col("text"), F.lit("]"))
    alone = lambda items: F.when(F.size(items) == 1, F.get(items, F.lit(0)))
    first = files.withColumn("value", alone(J.json_items(boxed)))
    return first.withColumn("parts", J.json_parts(F.when(F.col("value").isNull(), F.col("text"))))


def _larger(spark: SparkSession, wanted: list[str], only: Callable[[Column], Column]) -> list[str]:
    """The files beyond LARGE, as patterns that match nothing else; their content is not read."""
    if not wanted:
        return []
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(wanted)
    found = listed.filter(F.col("length") > LARGE).filter(only(F.col("path"))).select("path").collect()
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", row.path) for row in found]


def _elements(spark: SparkSession, *paths: str, deep: bool, only: Callable[[Column], Column] = lambda path: F.lit(True)) -> DataFrame:
    """path, ord, item: the elements of the array in each file whose path is wanted."""
    small = readable(read_whole(spark, *paths, deep=deep, largest=LARGE).filter(only(F.col("path"))))
    items = F.try_variant_get("value", "$", "array<variant>")
    again = F.transform(F.filter("parts", lambda p: p["key"].isNull()), lambda p: F.parse_json(p["text"]))
    whole = small.select("path", F.posexplode(F.coalesce(items, again)).alias("ord", "item"))
    large = _larger(spark, _wanted(spark, paths, deep), only)
    return whole.unionByName(split_json.elements(spark, large)) if large else whole


def scan_questions(spark: SparkSession, *folders: str, deep: bool = False) -> DataFrame:
    """Source questions with their place in the file; broken and empty files give no rows."""
    names = ("dataset", "db_id", "question", "query")
    return _elements(spark, *folders, deep=deep).select(
        F.col("path").alias("src_file"),
        F.col("ord").cast("bigint").alias("ord"),
        *[J.text_field(F.col("item"), name).alias(name) for name in names],
    )


def scan_samples(spark: SparkSession, *folders: str, deep: bool = False) -> DataFrame:
    """One JSON text of sample rows per target database, ``db_id`` from the file name."""
    files = readable(read_whole(spark, *folders, deep=deep))
    # '["key"]' without its brackets
    entry = lambda p: F.concat(F.regexp_replace(F.to_json(F.array(p["key"])), r"^\[|\]$", ""), F.lit(":"), p["text"])
    again = F.concat(F.lit("{"), F.array_join(F.transform("parts", entry), ","), F.lit("}"))
    text = F.coalesce(F.to_json("value"), F.when(F.exists("parts", lambda p: p["key"].isNotNull()), again))
    return files.select(
        "path", path_key(F.col("path"), "sample_", to_first_dot=True).alias("db_id"), text.alias("samples_json")
    ).filter(F.col("samples_json").isNotNull())


def sample_rows(samples: DataFrame) -> DataFrame:
    """Samples row by row. Values stay variants: one column may mix integers and fractions."""
    tables = F.try_variant_get(F.parse_json("samples_json"), "$", "map<string,array<variant>>")
    keep = [name for name in samples.columns if name != "samples_json"]
    per_table = samples.select(*keep, F.explode(tables).alias("table_name", "_rows"))
    return per_table.select(*keep, "table_name", F.posexplode("_rows").alias("row_ord", "row_values"))


def scan_schemas(spark: SparkSession, *files: str) -> DataFrame:
    """``(path, db_id, schema_ddl)`` from files that map database ids to DDL text."""
    ddls = F.try_variant_get("value", "$", "map<string,string>")
    named = F.filter("parts", lambda p: p["key"].isNotNull())
    again = F.map_from_entries(
        F.transform(named, lambda p: F.struct(p["key"], F.try_variant_get(F.parse_json(p["text"]), "$", "string")))
    )
    return readable(read_whole(spark, *files, deep=True)).select("path", F.explode(F.coalesce(ddls, again)).alias("db_id", "schema_ddl"))


def schema_problems(spark: SparkSession, *files: str) -> DataFrame:
    """Schema files that cannot be used, and why."""
    empty = F.coalesce(F.try_variant_get("value", "$", "string") == "", F.lit(False))
    reason = F.when(F.col("value").isNull() & F.col("parts").isNull(), BAD_SCHEMA_FILE).when(
        empty, EMPTY_SCHEMA_FILE
    )
    return readable(read_whole(spark, *files, deep=True)).select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def scan_mappings(spark: SparkSession, *folders: str, fields=GUIDED_FIELDS) -> DataFrame:
    """Mapped pairs from ``<dataset>/<model>/<target db>/response_<source db>.json``.

    The path gives the keys and wins over ids inside the rows. Raw judge answers
    (``..llm.json``) lying beside are passed over.
    """

    def answers(path: Column) -> Column:
        return (path_key(path, "response_") != "") & ~F.rlike(path, F.lit(r"llm\.json(?:/[^/]*)?$"))

    segments = F.split(F.regexp_replace("path", r"/[^/]*response_[^/]*\.json(?:/[^/]*)?$", ""), "/")
    plain = lambda c: F.regexp_replace(c, r"^[^=]*=", "")
    keys = {
        "target_dataset": plain(F.element_at(segments, -3)),
        "model": plain(F.element_at(segments, -2)),
        "target_db_id": plain(F.element_at(segments, -1)),
        "source_db_id": path_key(F.col("path"), "response_"),
    }
    rest = [name for name in fields if name not in keys]
    return _elements(spark, *folders, deep=True, only=answers).select(
        *[key.alias(name) for name, key in keys.items()],
        F.col("ord").cast("bigint").alias("ord"),
        *[J.text_field(F.col("item"), name).alias(name) for name in rest],
    )


def _allowed(table: DataFrame, name: str, ids) -> DataFrame:
    """Rows whose partition is on the list: a few ids by value, a longer list or a table by a join that prunes partitions."""
    if not isinstance(ids, DataFrame):
        if len(ids) <= FEW_IDS:
            return table.filter(F.col(name).isin(list(ids))) if ids else table
        ids = stored(table.sparkSession.createDataFrame([(i,) for i in ids], "id string"), "allowed")
    # any comparison lets the planner count on the list being selective
    listed = ids.select(F.col(ids.columns[0]).cast("string").alias(name)).filter(F.col(name) >= "").distinct()
    return table.join(listed, name, "left_semi")


def scan_table(spark: SparkSession, path: str, targets=(), sources=()) -> DataFrame:
    """A labelled table, the input of the next stage; lists of ids, or tables of them (first column), prune its partitions."""
    table = spark.read.parquet(path)
    for name, ids in (("target_db_id", targets), ("source_db_id", sources)):
        table = _allowed(table, name, ids)
    return table.select(*spark.read.parquet(path).columns)
