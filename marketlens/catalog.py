"""Registered queries: each one a Spark DataFrame over the whole test tables, and the
equivalent DuckDB statement (the oracle) over the same Parquet files.

The oracle statements are written independently of the Spark code: the fixture views are
the FIXTURES.md SQL (as CTEs), and each operator is restated in plain SQL (window
functions, ASOF JOIN, conditional aggregation).  Double columns are rounded to a number of
significant digits on both sides (a ``%.Ne`` text round trip, identical in both engines)
so that sums taken in different orders compare equal.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sources.fixture_sql import with_views
from .sources.fixtures import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS: dict[str, int] = {}
# Registered queries read the derived warehouse tables written once to the shared checkpoint
# folder (set MARKETLENS_DERIVE=1 to derive them inside every plan instead).
STORED = os.environ.get("MARKETLENS_DERIVE", "0") != "1"


def sig(c: Column, digits: int) -> Column:
    """Round to ``digits`` significant digits with IEEE operations only (bit-identical in
    Spark and DuckDB): scale by a power of ten, floor(v + 0.5), scale back.  Small values are kept: nothing
    but 0 becomes 0."""
    a = F.abs(c)
    e = F.lit(digits - 1) - F.floor(F.log10(a))
    up = F.floor(c * F.pow(F.lit(10.0), e) + 0.5) / F.pow(F.lit(10.0), e)
    down = F.floor(c / F.pow(F.lit(10.0), -e) + 0.5) * F.pow(F.lit(10.0), -e)
    return (F.when(c.isNull(), F.lit(None).cast("double")).when(a == 0, F.lit(0.0))
            .when(e >= 0, up.cast("double")).otherwise(down.cast("double")))


def sig_sql(expr: str, digits: int) -> str:
    e = f"({digits - 1} - floor(log10(abs({expr}))))"
    return (f"(case when {expr} is null then null when {expr} = 0 then 0.0 "
            f"when {e} >= 0 then floor({expr} * pow(10.0, {e}) + 0.5) / pow(10.0, {e}) "
            f"else floor({expr} / pow(10.0, -{e}) + 0.5) * pow(10.0, -{e}) end)")


def fixed(c: Column, places: int) -> Column:
    """Round to ``places`` decimal places with IEEE operations only (see ``sig``)."""
    return F.when(c.isNotNull(), (F.floor(c * F.lit(10.0 ** places) + 0.5) / F.lit(10.0 ** places)).cast("double"))


def fixed_sql(expr: str, places: int) -> str:
    return f"(floor({expr} * {10.0 ** places!r} + 0.5) / {10.0 ** places!r})"


def finish(df: DataFrame, digits: int, places: int | None = None, colplaces: dict | None = None) -> DataFrame:
    """Round every double column to ``digits`` significant digits (or ``places`` decimals;
    ``colplaces`` overrides per column: money sums of 4-decimal values use 5 places, which
    keeps their exact values away from every rounding boundary)."""
    cols = []
    colplaces = colplaces or {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            pl = colplaces.get(f.name, places)
            cols.append((fixed(c, pl) if pl is not None else sig(c, digits)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def oracle(body: str, views: list[str], doubles: list[str], digits: int, places: int | None = None,
           colplaces: dict | None = None) -> str:
    """Wrap an oracle statement: fixture CTEs + rounding of double columns (as ``finish``)."""
    inner = with_views(body, *views)
    if not doubles:
        return inner
    colplaces = colplaces or {}

    def rnd(c):
        pl = colplaces.get(c, places)
        return fixed_sql(q(c), pl) if pl is not None else sig_sql(q(c), digits)

    rep = ", ".join(f"{rnd(c)} as {q(c)}" for c in doubles)
    return f"select * replace ({rep}) from (\n{inner}\n) _q"


def q(name: str) -> str:
    return f'"{name}"'


def register(name: str, sql: str | None = None, views: list[str] | None = None,
             doubles: list[str] | None = None, digits: int = 10, places: int | None = None,
             colplaces: dict | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(Market(spark, sf_dir, stored=STORED)), digits, places, colplaces)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DIGITS[name] = digits
        if sql is not None:
            ORACLE[name] = oracle(sql, views or [], doubles or [], digits, places, colplaces)
        return fn

    return deco


# Import the query modules so they register themselves.
from .plans import queries as _queries  # noqa: E402,F401
from .plans import queries_more as _queries_more  # noqa: E402,F401
from .plans import queries_ext as _queries_ext  # noqa: E402,F401
from .plans import queries_load as _queries_load  # noqa: E402,F401
from .plans import queries_flow as _queries_flow  # noqa: E402,F401
