"""Monte Carlo DCF valuation (V1-V7) over tickers x scenarios.

The (ticker, scenario) rows are dealt to a stated number of tasks before they expand; draws, values, quantiles and
histograms are then made inside the group, so no draw ever crosses a shuffle.  A group holds the
``sims`` draws of one ticker and scenario, whatever the number of tickers.

There are two forms of the same arithmetic.  ``draws``, ``valued`` and ``intrinsic_values`` give a row per draw, for
callers that want the draws.  ``monte_carlo_dcf`` and ``histogram`` want a few figures of each group: they
make a group's draws as numpy arrays, once, and no draw becomes a row.

Uniforms come from one SHA-256 of (ticker, scenario, draw), split into three 52-bit slices:
reproducible on task retry and identical in DuckDB (the oracle repeats the exact draws).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import ship_package
from .scenarios import by_scenario

PROJECTION_YEARS = 5
NO_VALUE = "no valid simulation"
RANGES = [f"{p}_{x}" for p in ("growth", "perpetual", "wacc") for x in ("min", "mode", "max")]


def dealt(base: DataFrame, scenarios=None, selection: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """One row per (ticker, scenario) with its parameters as fractions, dealt to ``tasks`` tasks.

    The rows are few and small but expand to ``sims`` draws each, so their number of tasks is stated (default: the
    shuffle partitions, at least two per core) and adaptive execution does not put them together."""
    spark = base.sparkSession
    n = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = by_scenario(base, scenarios, selection, ["sims", *RANGES])
    rows = rows.withColumns({f"_{r}": F.col(r) / 100.0 for r in RANGES}).drop(*RANGES)
    return rows.repartition(n, "ticker", "scenario_id")


BASE_COLUMNS = ["ticker", "status", "base_fcff", "net_debt", "shares_outstanding", "price"]


def draws(base: DataFrame, scenarios=None, selection: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """One row per (ticker, scenario, draw) with triangular growth, perpetual growth and WACC draws
    (V1, percent inputs), for tickers whose DCF base status is 'ok'."""
    b = base.where(F.col("status") == "ok").select(*BASE_COLUMNS)
    return expand(dealt(b, scenarios, selection, tasks))


def expand(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The draws of dealt rows; a row that has none (no DCF base, no simulations) stays as one row without draw."""
    n = F.when((F.col("status") == "ok") & (F.col("sims") > 0), F.sequence(F.lit(0), F.col("sims") - 1))
    d = rows.withColumn("draw", F.explode_outer(n))
    # one hash per draw, three 52-bit uniforms from disjoint slices of it
    d = d.withColumn("_h", F.when(F.col("draw").isNotNull(), F.sha2(F.concat_ws(
        "|", F.col("ticker"), F.col("scenario_id").cast("string"), F.col("draw").cast("string")), 256)))
    d = d.select("*", *[S.hex_uniform(F.col("_h"), i).alias(f"_u{i}") for i in range(3)])

    def tri(i, p):
        u = F.col(f"_u{i}")
        return F.when(u.isNotNull(), S.triangular(u, *[F.col(f"_{p}_{x}") for x in ("min", "mode", "max")]))

    return d.select("ticker", "scenario_id", "status", "draw", "base_fcff", "net_debt", "shares_outstanding", "price", *keep,
                    tri(0, "growth").alias("growth"), tri(1, "perpetual").alias("perpetual"), tri(2, "wacc").alias("wacc"))


def valued(d: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """V2 + V3: ``intrinsic_value`` of every draw: five-year projection, discounting, terminal value clamped at 0,
    equity per share; null where wacc <= perpetual growth and where the value is not finite.  Powers are
    written as repeated products (the same IEEE operations in every engine)."""
    keep = ["ticker", "scenario_id", "status", "draw", "price", "growth", "perpetual", "wacc", "net_debt", "shares_outstanding", *extra]
    v = d.select(*keep, (F.col("base_fcff") * (1 + F.col("growth"))).alias("f1"),
                 (F.lit(1.0) * (1 + F.col("wacc"))).alias("d1"))
    for t in range(2, PROJECTION_YEARS + 1):
        v = v.select("*", (F.col(f"f{t - 1}") * (1 + F.col("growth"))).alias(f"f{t}"),
                     (F.col(f"d{t - 1}") * (1 + F.col("wacc"))).alias(f"d{t}"))
    n = PROJECTION_YEARS
    acc = F.col("f1") / F.col("d1")
    for t in range(2, n + 1):
        acc = acc + F.col(f"f{t}") / F.col(f"d{t}")
    spread = F.col("wacc") - F.col("perpetual")
    v = v.select(*keep, acc.alias("_pv"), f"d{n}",
                 (F.col(f"f{n}") * (1 + F.col("perpetual")) / F.nullif(spread, F.lit(0.0))).alias("_tv"))
    tv = F.when(F.col("_tv") < 0, F.lit(0.0)).otherwise(F.col("_tv"))
    val = (F.col("_pv") + tv / F.col(f"d{n}") - F.col("net_debt")) / F.col("shares_outstanding")
    v = v.select("ticker", "scenario_id", "status", "draw", "price", *extra, "growth", "perpetual", "wacc", val.alias("_iv"))
    # NaN compares above +inf in Spark, so one range test excludes NaN and +-inf
    ok = (F.col("wacc") > F.col("perpetual")) & F.col("_iv").between(-1.7976931348623157e308, 1.7976931348623157e308)
    return v.withColumn("intrinsic_value", F.when(ok, F.col("_iv"))).drop("_iv")


def intrinsic_values(d: DataFrame) -> DataFrame:
    """The draws that have a value (V2, V4).

    The value goes through a generator: a Filter would be pushed below the projections and take the whole
    draw formula into its predicate."""
    v = valued(d)
    return v.select("ticker", "scenario_id", "draw", "price", "growth", "perpetual", "wacc",
                    F.explode(F.when(F.col("intrinsic_value").isNotNull(), F.array("intrinsic_value"))).alias("intrinsic_value"))


def summary(values: DataFrame) -> DataFrame:
    """Mean, median, p10, p90 (linear interpolation, as numpy) and count per ticker and scenario, over the rows
    that have a value.  The exact percentile holds one group's draws (bounded by ``sims``), not the table."""
    p = F.percentile("intrinsic_value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    status = [F.first("status").alias("status")] if "status" in values.columns else []
    g = values.groupBy("ticker", "scenario_id").agg(
        *status, F.avg("intrinsic_value").alias("mean"), p.alias("_p"), F.count("intrinsic_value").alias("n_valid"),
        F.first("price").alias("current_price"))
    return g.select("ticker", "scenario_id", *[c for c in ("status",) if status], "mean", F.col("_p")[1].alias("median"),
                    F.col("_p")[0].alias("p10"), F.col("_p")[2].alias("p90"), "n_valid", "current_price")


# ---- the same by group, as arrays ---------------------------------------------------------------
CHUNK = 1 << 15     # draws made at a time
QUANTILES = (0.5, 0.1, 0.9)
KEY = "ticker string, scenario_id int"


@lru_cache(8)
def _numbers(start: int, stop: int) -> list[bytes]:
    return [b"%d" % i for i in range(start, stop)]


def _uniforms(prefix: bytes, start: int, stop: int) -> list[np.ndarray]:
    """The three uniforms of draws ``start`` to ``stop``: 52-bit slices of a digest each (see ``hex_uniform``)."""
    words = np.frombuffer(b"".join([sha256(prefix + i).digest() for i in _numbers(start, stop)]), ">u8").astype("u8").reshape(-1, 4)
    w0, w1, w2 = words[:, 0], words[:, 1], words[:, 2]
    u64 = np.uint64
    slices = (w0 >> u64(12), ((w0 & u64(0xFFF)) << u64(40)) | (w1 >> u64(24)), ((w1 & u64(0xFFFFFF)) << u64(28)) | (w2 >> u64(36)))
    return [x.astype("f8") / float(2 ** 52) for x in slices]


def _triangular(u: np.ndarray, lo: float, mode: float, hi: float) -> np.ndarray:
    span = hi - lo
    fc = (mode - lo) / span if span > 0 else 0.0
    return np.where(u < fc, lo + np.sqrt(u * span * (mode - lo)), hi - np.sqrt((1 - u) * span * (hi - mode)))


def _values(row: dict) -> np.ndarray:
    """The finite values of a dealt row's draws (V1-V3): the operations of ``expand`` and ``valued`` in their order."""
    n = row["sims"] if row["status"] == "ok" and row["sims"] is not None else 0
    prefix = "".join(f"{x}|" for x in (row["ticker"], row["scenario_id"]) if x is not None).encode()
    number = {k: float("nan") if v is None else v for k, v in row.items()}
    parts = [np.empty(0)]
    for start in range(0, n, CHUNK):
        u = _uniforms(prefix, start, min(n, start + CHUNK))
        with np.errstate(all="ignore"):
            g, p, w = (_triangular(u[i], *[number[f"_{k}_{x}"] for x in ("min", "mode", "max")]) for i, k in enumerate(("growth", "perpetual", "wacc")))
            f, d = number["base_fcff"] * (1 + g), 1.0 * (1 + w)
            pv = f / d
            for _ in range(2, PROJECTION_YEARS + 1):
                f, d = f * (1 + g), d * (1 + w)
                pv = pv + f / d
            tv = f * (1 + p) / (w - p)
            v = (pv + np.where(tv < 0, 0.0, tv) / d - number["net_debt"]) / number["shares_outstanding"]
        parts.append(v[(w > p) & np.isfinite(v)])
    return np.concatenate(parts)


def _by_group(rows: DataFrame, figures: Callable[[dict, np.ndarray], dict], schema: str) -> DataFrame:
    """``figures`` of the first row and all values of each (ticker, scenario); rows of one group lie in one task."""
    ship_package(rows.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
        first, values = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if first is not None and (row["ticker"], row["scenario_id"]) != (first["ticker"], first["scenario_id"]):
                    yield first, np.concatenate(values)
                    first = None
                if first is None:
                    first, values = row, []
                values.append(_values(row))
        if first is not None:
            yield first, np.concatenate(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, values in groups(batches):
            cols = figures(first, values)
            size = len(cols[names[-1]])
            key = {k: [first[k]] * size for k in ("ticker", "scenario_id")}
            yield pa.RecordBatch.from_pydict({c: (key | cols)[c] for c in names}, wanted)

    wanted = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]])
                        for c in schema.split(", ")])
    return rows.sortWithinPartitions("ticker", "scenario_id").mapInArrow(run, schema)


def _quantile(v: np.ndarray, q: float) -> float:
    """Linear interpolation in sorted values, as Spark's ``percentile``."""
    at = q * (len(v) - 1)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    return float(v[lo]) if lo == hi or v[lo] == v[hi] else float((hi - at) * v[lo] + (at - lo) * v[hi])


def _summary_figures(row: dict, values: np.ndarray) -> dict:
    n = len(values)
    v = np.sort(values)
    median, p10, p90 = (_quantile(v, q) if n else None for q in QUANTILES)
    status = NO_VALUE if row["status"] == "ok" and not n else row["status"]
    return {"status": [status], "mean": [float(values.mean()) if n else None], "median": [median], "p10": [p10], "p90": [p90],
            "n_valid": [n], "current_price": [row["price"]]}


def monte_carlo_dcf(base: DataFrame, scenarios=None, selection: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """V4 with a row for every ticker and scenario: ``status`` is 'ok', the reason why the DCF base is missing, or that
    no simulation was valid.  One pass: rows without draws stay in it."""
    rows = dealt(base.select(*BASE_COLUMNS), scenarios, selection, tasks)
    return _by_group(rows, _summary_figures, f"{KEY}, status string, mean double, median double, p10 double, p90 double, "
                                             "n_valid long, current_price double")


def histogram(base: DataFrame, scenarios=None, selection: DataFrame | None = None, bins: int = 100,
              tasks: int | None = None) -> DataFrame:
    """``bins`` equal-width bins between the least and greatest value of each ticker and scenario; counts.

    The draws are made once: a group's values are at hand when their range is known."""
    def figures(row: dict, values: np.ndarray) -> dict:
        if not len(values):
            return {"bin": [], "n": [], "bin_start": []}
        lo, hi = values.min(), values.max()
        with np.errstate(all="ignore"):
            width = hi - lo
            at = np.nan_to_num(np.floor((values - lo) / width * bins)) + 1 if width > 0 else np.ones(len(values))
            n = np.bincount(np.minimum(at, bins).astype("i8"), minlength=bins + 1)
            bin_ = np.flatnonzero(n)
            return {"bin": bin_.astype("i4"), "n": n[bin_], "bin_start": lo + (bin_ - 1) * width / bins}

    b = base.where((F.col("status") == "ok") & F.col("ticker").isNotNull()).select(*BASE_COLUMNS)
    return _by_group(dealt(b, scenarios, selection, tasks), figures, f"{KEY}, bin int, n long, bin_start double")


def margin_of_safety(s: DataFrame) -> DataFrame:
    """V5: mean intrinsic value against the current price; null where there is no value."""
    m, p = F.col("mean"), F.col("current_price")
    return s.select("ticker", "scenario_id", "status", p.alias("current_price"), m.alias("intrinsic_value"),
                    ((m - p) / F.nullif(m, F.lit(0.0))).alias("margin_of_safety"),
                    F.when(m > p, "undervalued").when(m <= p, "overvalued").alias("verdict"))
