"""Company profiles (S4, S5): one raw source row per company feeds the dimension and the daily fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans import fundamentals as fu

# Profile field -> column of the fact table.
FACT_FIELDS = {
    "marketCap": "market_cap", "beta": "beta", "trailingPE": "pe_ratio", "priceToBook": "pb_ratio",
    "enterpriseToEbitda": "ev_ebitda", "revenueGrowth": "revenue_growth_yoy", "earningsGrowth": "net_income_growth_yoy",
    "returnOnEquity": "roe", "operatingMargins": "operating_margin", "ebitdaMargins": "ebitda_margin",
    "trailingEps": "trailing_eps", "forwardPE": "forward_pe", "targetMeanPrice": "analyst_target_price",
    "freeCashflow": "fcf_ttm", "totalRevenue": "revenue_ttm",
}
# Profile field -> column of the dimension; the price fields in order; the kind that is loaded.
DIM_FIELDS = {"longName": "company_name", "logo_url": "logo_url", "sector": "sector", "creditRating": "credit_rating"}
PRICE_FIELDS = ["currentPrice", "regularMarketPrice", "previousClose"]
EQUITY = "EQUITY"


def _number(df: DataFrame, name: str) -> Column:
    """A field as a double; absent, unreadable and NaN values are null."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    return F.nanvl(F.expr(f"try_cast(`{name}` as double)"), F.lit(None).cast("double"))


def first_truthy(values: Sequence[Column]) -> Column:
    """The first value that is there and not 0; if there is none the last one as it is, so a last 0 stays 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])


def equities(profile: DataFrame) -> DataFrame:
    """Rows of shares; funds, indices and rows without a kind or ticker are skipped."""
    return profile.where((F.col("quoteType") == EQUITY) & F.col("ticker").isNotNull())


def profile_dim(profile: DataFrame) -> DataFrame:
    """The dimension row of each share."""
    p = equities(profile)
    return p.select("ticker", *[(F.col(f).cast("string") if f in p.columns else F.lit(None).cast("string")).alias(c)
                                for f, c in DIM_FIELDS.items()])


def profile_fact(profile: DataFrame, as_of) -> DataFrame:
    """The fact row of each share for one day: price by the fallback chain (S5), debt to equity from percent."""
    p = equities(profile)
    summary = F.col("longBusinessSummary").cast("string") if "longBusinessSummary" in p.columns else F.lit(None).cast("string")
    return p.select("ticker", S.as_date(as_of).alias("date_updated"),
                    first_truthy([_number(p, f) for f in PRICE_FIELDS]).alias("price"),
                    *[_number(p, f).alias(c) for f, c in FACT_FIELDS.items()],
                    (_number(p, "debtToEquity") / 100).alias("de_ratio"), summary.alias("long_business_summary"))


def company_metrics(profile: DataFrame, statements: DataFrame, as_of) -> DataFrame:
    """The fact row with the two figures that come from statements: revenue CAGR (F1) and cash conversion (F2)."""
    cg = fu.cagr(statements, "revenue", 3).select("ticker", F.col("cagr").alias("revenue_cagr_3y"))
    cc = fu.cash_conversion(statements).select("ticker", "cash_conversion")
    return profile_fact(profile, as_of).join(cg, "ticker", "left").join(cc, "ticker", "left")


def market_caps(profile: DataFrame) -> DataFrame:
    """O6, the market-cap form: (ticker, market_cap) of shares that have one."""
    p = equities(profile)
    return p.select("ticker", _number(p, "marketCap").alias("market_cap")).where(F.col("market_cap").isNotNull())
