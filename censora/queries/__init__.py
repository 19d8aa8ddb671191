"""Registered queries: every operator bound to the driver's tables, with the SQL that checks it.

A family module decorates ``fn(t: Tables) -> DataFrame`` with ``@query(name, sql)``. ``sql`` is ``None`` where no
plain SQL over whole tables can say the same; those are checked against brute force in ``tests/``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FAMILIES = (
    "scalars",
    "filters",
    "joins",
    "aggregates",
    "windows",
    "paging",
    "reshape",
    "cubes",
    "surveys",
    "quality",
    "hierarchies",
    "pulse",
    "feeds",
    "storage",
)


class Tables:
    """Lazy access to ``<dir>/<name>.parquet`` as ``tables.<name>``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        frame = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        setattr(self, name, frame)
        return frame


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.build(Tables(spark, directory))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def load() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return REGISTRY
