"""Rates and bonds (B1-B8) over any (date, ticker, close) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import timeseries as ts
from ..operators.ordering import ranked_detail
from ..schemas import MATURITY_YEARS

# Display names of rate instruments and benchmarks.
RATE_NAMES = {
    "^IRX": "4-Week US T-Bill", "^STIX": "13-Week US T-Bill", "^GTII": "26-Week US T-Bill",
    "^TWS": "2-Year US Treasury", "^FVX": "5-Year US Treasury", "^TNX": "10-Year US Treasury",
    "^TYX": "30-Year US Treasury", "LQD": "Inv. Grade Corp Bond ETF", "HYG": "High-Yield Corp Bond ETF",
    "TIP": "10-Year TIPS Yield (ETF Proxy)", "^GSPC": "S&P 500 Index", "^SOFR": "SOFR Rate (Proxy)",
    "^FFR": "Fed Funds Rate (Proxy)", "^MOVE": "MOVE Index (Volatility)", "THB_RATE_1Y": "THB Interest Rate Proxy (1Y)",
}


def display_name(ticker: Column) -> Column:
    """Dictionary lookup with fallback to the key (a literal map; no join)."""
    m = F.create_map(*[x for k, v in RATE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[ticker], ticker)


def rate_changes(rates: DataFrame, weekly_scale: float = 10000.0) -> DataFrame:
    """B1: previous close, 5-row change x10000 (quirk Q17) and change since the first value."""
    return rates.select("date", "ticker", "close",
                        ts.lag("close", 1).alias("previous_close"),
                        (ts.diff("close", 5) * weekly_scale).alias("weekly_change"),
                        (F.col("close") - ts.first_value("close")).alias("ytd_change"))


def cumulative_change(rates: DataFrame) -> DataFrame:
    """B2: close over the close on the first date of the whole frame, minus 1 (null for
    series without a value on that date), with display names."""
    first_day = rates.select(F.min("date")).scalar()
    base = F.first(F.when(F.col("date") == first_day, F.col("close")), ignorenulls=True).over(ts.whole())
    return rates.select("date", "ticker", (F.col("close") / base - 1).alias("cumulative_change"),
                        display_name(F.col("ticker")).alias("display_name"))


def yield_curve(rates: DataFrame, as_of=None) -> DataFrame:
    """For Today / Last Week / Last Month / Last Year, each treasury's row nearest that
    date (earlier date on ties), mapped to its maturity in years."""
    r = rates.where(F.col("ticker").isin(list(MATURITY_YEARS)))
    latest = S.as_date(as_of) if as_of is not None else rates.select(F.max("date")).scalar()
    targets = {"Today": latest, "Last Week": F.date_sub(latest, 7), "Last Month": F.date_sub(latest, 30),
               "Last Year": F.date_sub(latest, 365)}
    n = ts.nearest(r, targets, ["close"])
    mat = F.create_map(*[x for k, v in MATURITY_YEARS.items() for x in (F.lit(k), F.lit(v))])
    return n.select("period", "ticker", "date", "close", mat[F.col("ticker")].alias("maturity_years"))


def spread(rates: DataFrame, benchmark: str, scale: float = 100.0) -> DataFrame:
    """(series - benchmark) x100 in basis points on dates where both have a value; the
    benchmark is an explicit argument (quirk Q6).  An equi-join on date with the benchmark's
    rows (one row per date)."""
    b = rates.where((F.col("ticker") == benchmark) & F.col("close").isNotNull()).select("date", F.col("close").alias("bench"))
    s = rates.where((F.col("ticker") != benchmark) & F.col("close").isNotNull())
    name = F.concat(display_name(F.col("ticker")), F.lit(" - "), display_name(F.lit(benchmark)))
    return s.join(b, "date").select("date", "ticker", ((F.col("close") - F.col("bench")) * scale).alias("spread"),
                                    name.alias("spread_name"))


NO_SERIES = "no data for this series"


def series(rates: DataFrame, tickers=("^MOVE",)) -> DataFrame:
    """Single series (the volatility view) with a status: a series that the table does not have is one row
    without date that says so, instead of an error."""
    wanted = F.explode(F.array(*[F.lit(t) for t in tickers])).alias("ticker")
    have = rates.where(F.col("ticker").isin(list(tickers))).select("ticker", "date", "close")
    asked = rates.sparkSession.range(1).select(wanted)
    out = asked.join(have, "ticker", "left")
    return out.select("ticker", "date", "close", F.when(F.col("date").isNull(), NO_SERIES).otherwise("ok").alias("status"))


def bond_detail(bonds: DataFrame, view: str = "pricing", sort_by: str | None = None) -> DataFrame:
    """PAR status, clean price, valuation spread; credit / risk / pricing column sets;
    detail sorts are always descending (O4); with ``sort_by`` each row has its ``place``."""
    b = bonds.select("*", S.par_status("dirty_price").alias("par_status"),
                     (F.col("dirty_price") - F.col("accrued")).alias("clean_price"),
                     ((F.col("intrinsic_value") / F.col("dirty_price") - 1) * 100).alias("valuation_spread_pct"))
    views = {
        "credit": ["ticker", "issuer", "coupon", "ytm", "par_status"],
        "risk": ["ticker", "issuer", "duration", "ytm"],
        "pricing": ["ticker", "issuer", "clean_price", "accrued", "dirty_price", "intrinsic_value",
                    "valuation_spread_pct", "par_status"],
    }
    out = b.select(*views[view])
    return ranked_detail(out, sort_by) if sort_by else out
