"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fixtures import q_checks, q_controls, q_drafts, q_scan  # noqa: F401
from fixtures.registry import BUILDERS, ORACLES, Tables
from fleetlens.session import ship


def names() -> list[str]:
    return list(BUILDERS)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship(spark)
        return BUILDERS[name](Tables(spark, sf_dir))

    run.__name__ = name
    return run
