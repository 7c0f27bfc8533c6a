"""Register a Spark query together with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clonara.sources.views import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle_text(sql: str) -> str:
    """Prefix the views a query names as CTEs over the base tables."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = []
    for view in used:
        text = re.sub(r"(?<!\{)\{(\w+)\}", r"\1", VIEWS[view][1])
        ctes.append(f"{view} AS ({text.replace('{{', '{').replace('}}', '}')})")
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return build

    return wrap
