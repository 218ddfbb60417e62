"""The registered queries: a Spark job each and, where SQL can say it, the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import NOW, with_clause

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TS = f"TIMESTAMP '{NOW}'"


def query(oracle: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a job under its function name; ``needs`` are fixture views of the oracle.

    An oracle that defines CTEs of its own starts with ``, name AS (...)``.
    """

    def register(job: Query) -> Query:
        QUERIES[job.__name__] = job
        if oracle is not None:
            text = oracle.strip()
            if needs:
                text = f"{with_clause(*needs)}{'' if text.startswith(',') else chr(10)}{text}"
            elif text.startswith(","):
                text = f"WITH {text[1:].lstrip()}"
            ORACLES[job.__name__] = text
        return job

    return register


def iso(column: str) -> str:
    """The SQL of an instant as text."""
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def half_up(value: str, digits: int = 0) -> str:
    """The SQL of rounding halves up."""
    scale = 10**digits
    return f"floor(({value}) + 0.5)" if digits == 0 else f"floor(({value}) * {scale}.0 + 0.5) / {scale}.0"


def load() -> None:
    """Import the modules that register queries."""
    from . import queries_lists, queries_parse, queries_pool, queries_state, queries_tables, queries_text  # noqa: F401
