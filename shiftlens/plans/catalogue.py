"""The table of named queries.

A query is a function of (session, table folder).  Where plain SQL can say the same, the SQL is
given next to it and both are run over the same Parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import sized_when_run
from .relations import RELATION_SQL

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Runner
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register the decorated function under its own name."""

    def register(run: Runner) -> Runner:
        if run.__name__ in ENTRIES:
            raise ValueError(f"query {run.__name__} is registered twice")
        ENTRIES[run.__name__] = Entry(run.__name__, run, sql, tuple(covers.split()))
        return run

    return register


def growing(covers: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """As ``query``, for queries whose rows grow far beyond the files they are read from."""

    def register(run: Runner) -> Runner:
        query(covers, sql)(wraps(run)(lambda spark, folder: run(sized_when_run(spark), folder)))
        return run

    return register


def over(relations: str, body: str) -> str:
    """SQL text that defines the named relations and then runs ``body``.

    ``body`` may begin with further definitions, introduced by a comma.
    """
    wanted: list[str] = []

    def need(name: str) -> None:
        parents, _ = RELATION_SQL[name]
        for parent in parents:
            need(parent)
        if name not in wanted:
            wanted.append(name)

    for name in relations.split():
        need(name)
    head = ",\n".join(f"{name} AS ({RELATION_SQL[name][1]})" for name in wanted)
    return f"WITH RECURSIVE {head}\n{body.strip()}"
