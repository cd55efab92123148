"""Registered queries: a Spark builder and, where one exists, reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fixtures import views


class Tables:
    """Given and derived tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {}
        self._done: set[str] = set()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._views:
            if name in views.VIEWS:
                self._views[name] = views.view(self.spark, self.sf_dir, name, self._done)
            else:
                self._views[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._views[name]


BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        if name in BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        BUILDERS[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def fields_text(col: str = "fields"):
    """An array of field structs as one text."""
    return F.array_join(F.transform(col, lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",").alias("fields")


def joined(col: str, sep: str = ","):
    return F.array_join(col, sep).alias(col)
