"""Registry that keeps each query next to the SQL that states its expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SOURCE: dict[str, str] = {}


def _digits(spec: str) -> dict[str, int]:
    """``"a b:2"`` -> {"a": 4, "b": 2}."""
    out = {}
    for item in spec.split():
        name, _, places = item.partition(":")
        out[name] = int(places or 4)
    return out


def _guard(places: int) -> float:
    """Small shift before rounding, so that summation noise at a half step rounds one way only."""
    return 0.37 * 10.0 ** -(places + 3)


def _present(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Dates as text, decimals as double, listed doubles rounded: engine-neutral values."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in digits:
            c = F.round(c.cast("double") + F.lit(_guard(digits[field.name])), digits[field.name]) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, digits: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its DuckDB statement."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        places = _digits(digits)

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _present(fn(Tables(spark, folder)), places)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        SOURCE[name] = fn.__module__
        if sql is not None:
            text = sql.strip().rstrip(";")
            if places:
                swaps = ", ".join(f"round({c}::DOUBLE + {_guard(n):.3e}::DOUBLE, {n}) + 0.0 AS {c}" for c, n in places.items())
                text = f"SELECT * REPLACE ({swaps}) FROM ({text}) AS q"
            ORACLES[name] = text
        return fn

    return wrap
