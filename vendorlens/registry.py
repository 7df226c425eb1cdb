"""Registered queries: one Spark callable per operator key, plus its DuckDB oracle text.

Every registered result is finalised the same way on both sides: DOUBLE columns are rounded to
``DIGITS`` decimals, so the order in which floating sums are added cannot change the value hash.
"""
from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
_DOUBLES_FILE = Path(__file__).resolve().parent.parent / "oraclesql" / "column_kinds.json"


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    note: str = ""
    tags: list[str] = field(default_factory=list)


REGISTRY: dict[str, Query] = {}


def _kind(dt: T.DataType) -> str | None:
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "double"
    if isinstance(dt, T.DateType):
        return "date"
    return None


def finalise(df: DataFrame) -> DataFrame:
    """Money and rates leave as DOUBLE rounded to ``DIGITS``; dates as ISO text."""
    cols = []
    for f in df.schema.fields:
        kind = _kind(f.dataType)
        if kind == "double":
            cols.append(F.round(F.col(f.name).cast("double"), DIGITS).alias(f.name))
        elif kind == "date":
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def column_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: k for f in df.schema.fields if (k := _kind(f.dataType))}


def register(name: str, sql: str | None = None, note: str = "", tags: list[str] | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalise(fn(spark, sf_dir))

        build.raw = fn
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql, note, tags or [])
        return fn
    return deco


def recorded_kinds() -> dict[str, dict[str, str]]:
    """Per key, the columns finalised as DOUBLE or date text (recorded by tools/check_oracle.py)."""
    if _DOUBLES_FILE.exists():
        return json.loads(_DOUBLES_FILE.read_text())
    return {}


def rounded_sql(name: str, sql: str) -> str:
    kinds = recorded_kinds().get(name, {})
    if not kinds:
        return sql
    repl = []
    for c, k in kinds.items():
        if k == "double":
            repl.append(f'round(CAST("{c}" AS DOUBLE), {DIGITS}) AS "{c}"')
        else:
            repl.append(f'strftime(CAST("{c}" AS DATE), \'%Y-%m-%d\') AS "{c}"')
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{sql}\n) AS q"
