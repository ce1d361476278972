"""Registry of queries and their SQL counterparts.

SQL texts are put together from named common table expressions, each listing what it builds on.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauseloom.session import plan_by_sizes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = (needs, body.strip())


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in PARTS[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body.strip()
    # RECURSIVE is needed by the few self-referring parts and harmless to the others.
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + body.strip()


def query(name: str, check: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Register a query; ``check`` is its SQL over the parts it ``needs``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @functools.wraps(fn)
        def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
            plan_by_sizes(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = planned
        if check is not None:
            ORACLES[name] = sql(check, *needs)
        return fn

    return add


def load_all() -> None:
    for module in ("text", "dialogue", "io", "weighting", "vectorial", "matching", "modelling", "flow"):
        importlib.import_module(f"clauseloom.plans.{module}")
