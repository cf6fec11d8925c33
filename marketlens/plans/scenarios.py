"""Scenarios as rows (V7): every model parameter of a user's assumptions is a column, missing ones take the
default.  A model runs on (ticker, scenario) rows.

Which tickers a scenario is for is a relation of its own: ``selection`` (scenario_id, ticker).  With it both
relations may be of any size and are joined by key.  Without it every scenario is for every
ticker; that product is the result asked for, and the scenarios, of which there are few then, become literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_SCENARIO, SCENARIO

MAX_SCENARIOS = 1000          # without a selection; more are refused, never dropped


def scenario_rows(scenarios: Sequence[dict] | DataFrame | dict | None) -> list[dict]:
    """The scenarios as dictionaries, defaults filled in."""
    if isinstance(scenarios, DataFrame):
        scenarios = [r.asDict() for r in scenarios.limit(MAX_SCENARIOS + 1).collect()]
    elif isinstance(scenarios, dict) or scenarios is None:
        scenarios = [scenarios or {}]
    if len(scenarios) > MAX_SCENARIOS:
        raise ValueError(f"more than {MAX_SCENARIOS} scenarios need a selection of tickers")
    return [dict(DEFAULT_SCENARIO, **{k: v for k, v in s.items() if v is not None}) for s in scenarios]


def with_defaults(scenarios: DataFrame) -> DataFrame:
    """Every scenario column, absent or null ones with the default value."""
    types = {f.name: f.dataType for f in SCENARIO.fields}
    return scenarios.select([
        (F.coalesce(F.col(n), F.lit(DEFAULT_SCENARIO[n])) if n in scenarios.columns else F.lit(DEFAULT_SCENARIO[n])).cast(t).alias(n)
        for n, t in types.items()])


def by_scenario(base: DataFrame, scenarios=None, selection: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """``base`` (one row per ticker) once per scenario, with scenario_id and the scenario ``columns`` asked for."""
    names = ["scenario_id", *columns]
    if selection is not None:
        rows = scenarios if isinstance(scenarios, DataFrame) else \
            base.sparkSession.createDataFrame([tuple(s[f.name] for f in SCENARIO.fields) for s in scenario_rows(scenarios)], SCENARIO)
        chosen = selection.select(F.col("scenario_id").cast("int").alias("scenario_id"), "ticker").distinct()
        return base.join(chosen.join(with_defaults(rows).select(*names), "scenario_id"), "ticker")
    types = {f.name: f.dataType for f in SCENARIO.fields}
    rows = [F.struct(*[F.lit(s[n]).cast(types[n]).alias(n) for n in names]) for s in scenario_rows(scenarios)]
    return base.select("*", F.inline(F.array(*rows)))
