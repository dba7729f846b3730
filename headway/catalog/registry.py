"""Registration of queries: one output list serves Spark and SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.session import utc

VIEWS: dict[str, str] = {}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None
    cols: tuple
    module: str = ""
    own: Mapping[str, str] = field(default_factory=dict)

    @property
    def sql(self) -> str | None:
        return _full_sql(self.body, self.cols, VIEWS | self.own) if self.body else None


QUERIES: dict[str, Query] = {}


def view(name: str, sql: str) -> None:
    """A named SQL building block, added to a query that mentions it."""
    VIEWS[name] = sql.strip()


def _columns(out: str) -> list[tuple[str, int | None]]:
    cols = []
    for item in out.split():
        name, _, digits = item.partition("~")
        cols.append((name, int(digits or 6) if "~" in item else None))
    return cols


def _needed(sql: str, views: Mapping[str, str]) -> list[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in views.items():
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(body)
    return [n for n in views if n in found]


def _full_sql(sql: str, cols, views: Mapping[str, str]) -> str:
    parts = [f"{name} AS ({views[name]})" for name in _needed(sql, views)]
    parts.append(f"answer AS ({sql.strip()})")
    items = [n if d is None else f"round({n}, {d}) + 0e0 AS {n}" for n, d in cols]
    return "WITH " + ",\n".join(parts) + "\nSELECT " + ", ".join(items) + " FROM answer"


def query(name: str, out: str, sql: str | None = None, own: Mapping[str, str] | None = None):
    """Register a query; ``col~4`` in ``out`` rounds that column to 4 digits; views in ``own`` stand for those of the same name."""
    cols = _columns(out)

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(utc(spark), sf_dir)
            items = [
                F.col(n) if d is None else (F.round(F.col(n).cast("double"), d) + F.lit(0.0)).alias(n)
                for n, d in cols
            ]
            return df.select(*items)

        run.__name__ = name
        QUERIES[name] = Query(run, sql, tuple(cols), fn.__module__.rsplit(".", 1)[-1], own or {})
        return fn

    return wrap
