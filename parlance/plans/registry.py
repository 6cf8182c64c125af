"""Registered queries: name -> (job, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, tuple[Job, str | None]] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a job; ctes are put before the SQL."""

    def register(job: Job) -> Job:
        JOBS[job.__name__] = (job, (f"with {','.join(ctes)} {sql}" if ctes else sql) if sql else None)
        return job

    return register


def queries() -> dict[str, Job]:
    from . import queries_audio, queries_examples, queries_sessions, queries_streams, queries_text  # noqa: F401

    return {name: job for name, (job, _) in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in JOBS.items() if sql}
