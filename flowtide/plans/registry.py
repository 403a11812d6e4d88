"""The catalogue of named queries: each has a Spark plan and, where SQL can say it, a SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``; the session options are set before it is built."""
    from flowtide.session import configure

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(configure(spark), sf_dir)

        PLANS[name] = run
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


def load() -> None:
    """Import every module that registers queries."""
    import importlib
    import importlib.util

    for part in (
        "assembly", "features", "damage", "ingest", "splits", "scores", "metrics", "calibration",
        "policies", "budget", "drift", "serving", "reports", "streams",
    ):
        name = f"flowtide.plans.{part}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
