"""Registry of queries: a Spark job over the given tables and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"{name} is registered twice")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return register


def load_all() -> None:
    from revlens.plans import q_ingest, q_labels, q_models, q_sources, q_stats, q_text, q_trends  # noqa: F401
