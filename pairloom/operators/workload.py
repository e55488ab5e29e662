"""Running the queries of pairs, to see whether they work.

Each distinct query is an ordinary Spark job over its target's tables; queries that only
are written differently share one. The driver
only submits them: it holds about one slice of query texts at a time, and of each
result at most one row more than is kept. Several applications can share one table
of outcomes, each with its own shard of the queries.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import CapturedException

from pairloom.functions.vocabulary import NULL_QUERY, PREVIEW_ROWS, QUERY_SECONDS
from pairloom.operators.execution_labels import is_null_query, label_executions
from pairloom.operators.joins import lookup

OUTCOMES = (
    "target_db_id string, target_query string, outcome string, fetched_rows bigint, "
    "execution_result string, condition string"
)
STATEMENT = ["target_db_id", "target_query"]


class TargetSessions(Mapping):
    """A session per target, opened when it is first asked for."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Mapping[str, str]]):
        self.spark, self.tables = spark, tables
        self.opened: dict[str, SparkSession] = {}
        self.lock = threading.Lock()

    def __getitem__(self, target: str) -> SparkSession:
        paths = self.tables[target]
        with self.lock:
            if target not in self.opened:
                session = self.spark.newSession()
                for name, path in paths.items():
                    session.read.parquet(path).createOrReplaceTempView(name)
                # a query must not name files in place of tables
                session.conf.set("spark.sql.runSQLOnFiles", "false")
                self.opened[target] = session
            return self.opened[target]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


def catalog_per_target(spark: SparkSession, tables: Mapping[str, Mapping[str, str]]) -> TargetSessions:
    """One session per target, which sees that target's parquet tables and no others.

    Sessions share executors and caches but not table names, so nothing has to be
    created in, or cleaned from, the cluster's catalog.
    """
    return TargetSessions(spark, tables)


def tables_below(spark: SparkSession, root: str) -> dict[str, dict[str, str]]:
    """Tables laid out as ``<root>/<target>/<table>.parquet``, per target."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*.parquet")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    tables: dict[str, dict[str, str]] = {}
    for status in found or []:
        path = status.getPath()
        tables.setdefault(path.getParent().getName(), {})[path.getName().removesuffix(".parquet")] = path.toString()
    return tables


def first_rows(session: SparkSession, sql: str) -> DataFrame:
    """The query's result up to the fetch limit, without running anything yet.

    ``sql()`` carries out commands at once, so the text is first analysed between
    brackets, where nothing but a query parses.
    """
    query = sql.strip().rstrip(";")
    session.sql(f"SELECT * FROM (\n{query}\n)")
    return session.sql(query).limit(PREVIEW_ROWS + 1)


_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", re.S)
_REFLECTION = re.compile(r"\b(java_method|reflect|try_reflect)\b`?\s*\(", re.I)


def calls_the_host(sql: str) -> bool:
    """Does a query call methods of the machine it runs on?"""
    return bool(_REFLECTION.search(_QUOTED.sub("''", sql)))


def _cancel_when_late(context, tag: str, done: threading.Event, late: threading.Event, seconds: float) -> None:
    if done.wait(seconds):
        return
    late.set()
    while True:
        context.cancelJobsWithTag(tag)
        if done.wait(0.5):
            return


def run_statement(session: SparkSession, target: str, sql: str, seconds: float = QUERY_SECONDS) -> tuple:
    """One row of ``OUTCOMES``."""
    if calls_the_host(sql):
        return target, sql, "error", 0, f"Error in {target}: reflection is not allowed", "FORBIDDEN_FUNCTION"
    context, tag = session.sparkContext, f"pairloom-{uuid.uuid4().hex}"
    done, late = threading.Event(), threading.Event()
    watcher = threading.Thread(target=_cancel_when_late, args=(context, tag, done, late, seconds), daemon=True)
    context.setLocalProperty("spark.scheduler.pool", "pairloom-workload")
    context.addJobTag(tag)
    watcher.start()
    try:
        rows = first_rows(session, sql).collect()
    except Exception as problem:  # whatever stops a query becomes its label
        if late.is_set():
            return target, sql, "timeout", 0, f"Timeout in {target}: {seconds} seconds", None
        condition = problem.getCondition() if isinstance(problem, CapturedException) else None
        return target, sql, "error", 0, f"Error in {target}: {problem}", condition or type(problem).__name__
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    kept = json.dumps([list(row) for row in rows[:PREVIEW_ROWS]], default=str)
    return target, sql, "ok", len(rows), kept, None


class EqualQueries:
    """Runs queries that mean the same once per target, however they are written.

    Texts are analysed, not run; those with one hash of the canonical plan are compared
    in full. Blanks, case, names of tables and of computed columns make no difference; a
    plain column under another name does. Who comes second waits for the first one's result. An error carries its own
    text, so whoever meets one runs by itself. At most ``most`` plans are remembered,
    the oldest goes first.
    """

    def __init__(self, most: int = 10_000):
        self.most, self.lock = most, threading.Lock()
        self.known: OrderedDict[tuple[str, int], list[tuple[DataFrame, Future]]] = OrderedDict()

    def _first(self, target: str, plan: DataFrame) -> tuple[Future, bool]:
        with self.lock:
            alike = self.known.setdefault((target, plan.semanticHash()), [])
            for other, future in alike:
                if other.sameSemantics(plan):
                    return future, False
            alike.append((plan, Future()))
            if len(self.known) > self.most:
                self.known.popitem(last=False)
            return alike[-1][1], True

    def run(self, session: SparkSession, target: str, sql: str, seconds: float = QUERY_SECONDS) -> tuple:
        """As ``run_statement``."""
        try:
            plan = None if calls_the_host(sql) else first_rows(session, sql)
        except Exception:  # it cannot be analysed: running it gives the label
            plan = None
        if plan is None:
            return run_statement(session, target, sql, seconds)
        future, ours = self._first(target, plan)
        if not ours:
            outcome = future.result()
            if outcome is not None and outcome[2] != "error":
                return target, sql, *outcome[2:]
            return run_statement(session, target, sql, seconds)
        outcome = None
        try:
            outcome = run_statement(session, target, sql, seconds)
        finally:
            future.set_result(outcome)
        return outcome


def statements(pairs: DataFrame) -> DataFrame:
    """Distinct queries per target; a query that many pairs share runs once."""
    return pairs.filter(~is_null_query(F.col("target_query"))).select(*STATEMENT).distinct()


def shard_of(rows: DataFrame, shard: int, shards: int) -> DataFrame:
    """One of ``shards`` disjoint parts of the statements, the same on every run."""
    return rows.filter(F.pmod(F.xxhash64(*STATEMENT), F.lit(shards)) == shard) if shards > 1 else rows


def _as_they_end(pool: ThreadPoolExecutor, run, rows: Iterable, ahead: int) -> Iterator[tuple]:
    """Results in the order they come; no more than ``ahead`` are waiting or running."""
    waiting: set[Future] = set()
    for row in rows:
        waiting.add(pool.submit(run, row))
        if len(waiting) >= ahead:
            done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            yield from (one.result() for one in done)
    for one in waiting:
        yield one.result()


def run_workload(
    pairs: DataFrame,
    sessions: Mapping[str, SparkSession],
    outcome_path: str,
    seconds: float = QUERY_SECONDS,
    parallel: int = 8,
    slice_size: int = 1000,
    shard: int = 0,
    shards: int = 1,
) -> DataFrame:
    """Run the queries of all pairs, or of one shard of them, and give the table of outcomes.

    Outcomes are stored slice by slice. A run that was cut off goes on where it
    stopped when it is given the same path.
    """
    spark = pairs.sparkSession
    spark.createDataFrame([], OUTCOMES).write.mode("append").parquet(outcome_path)
    ran = spark.read.schema(OUTCOMES).parquet(outcome_path).select(*STATEMENT)
    todo = shard_of(statements(pairs), shard, shards).join(ran, STATEMENT, "left_anti")
    # the driver takes one partition at a time: as many as there are slices
    slices = todo.count() // slice_size + 1
    rows = todo.repartition(slices, *STATEMENT).toLocalIterator(prefetchPartitions=False)
    equal = EqualQueries()

    def run(row) -> tuple:
        session = sessions.get(row.target_db_id)
        if session is None:
            return row.target_db_id, row.target_query, "error", 0, f"Error in {row.target_db_id}: no such target", "NO_TARGET"
        return equal.run(session, row.target_db_id, row.target_query, seconds)

    def store(outcomes: list[tuple]) -> None:
        spark.createDataFrame(outcomes, OUTCOMES).coalesce(1).write.mode("append").parquet(outcome_path)

    held: list[tuple] = []
    with ThreadPoolExecutor(parallel) as pool:
        for outcome in _as_they_end(pool, run, rows, 2 * parallel):
            held.append(outcome)
            if len(held) >= slice_size:
                store(held)
                held = []
    if held:
        store(held)
    return spark.read.schema(OUTCOMES).parquet(outcome_path)


def label_workload(pairs: DataFrame, outcomes: DataFrame, unique: list[str]) -> DataFrame:
    """Outcomes back on their pairs, with ``result_status``. One query may belong to any number of pairs."""
    found = lookup(pairs, outcomes, STATEMENT, unique, how="left")
    nothing = is_null_query(F.col("target_query"))
    return label_executions(found).withColumn(
        "execution_result", F.when(nothing, NULL_QUERY).otherwise(F.col("execution_result"))
    )
