"""Every query that is checked against its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans.inputs import Tables, oracle


@dataclass(frozen=True)
class Check:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None, *views: str):
    """Register a query; ``sql`` is its twin, run after the named views."""

    def register(build):
        if name in CHECKS:
            raise ValueError(f"query {name} exists already")
        CHECKS[name] = Check(build, oracle(sql, *views) if sql else None)
        return build

    return register
