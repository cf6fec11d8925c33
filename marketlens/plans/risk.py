"""The 27 credit-risk features (R1-R27) over the risk base table.

All features are window expressions over one (ticker ordered by report_date) specification,
so Spark evaluates them with a single shuffle on ticker and a sort per stage; the only
second stage is Sales_Volatility, a rolling std over a rolling ratio.  Zero denominators give
null (never inf/NaN).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..schemas import RISK_FEATURES, feature_column

K, O = "ticker", "report_date"


def _m(df: DataFrame, name: str):
    """A base column, or null when the source metric is absent."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("double")


def risk_features(base: DataFrame, keep: tuple = ("report_date",), sql_names: bool = True) -> DataFrame:
    ca, cl, ta = _m(base, "Current Assets"), _m(base, "Current Liabilities"), _m(base, "Total Assets")
    inv, liab, eq = _m(base, "Inventory"), _m(base, "Total Liabilities"), _m(base, "Stockholders Equity")
    ebit, rev, ni = _m(base, "EBIT"), _m(base, "Total Revenue"), _m(base, "Net Income")
    ocf, ie = _m(base, "Operating Cash Flow"), _m(base, "Interest Expense")
    ar, ap, cor = _m(base, "Accounts Receivable"), _m(base, "Accounts Payable"), _m(base, "Cost Of Revenue")
    div = ts.safe_div

    def ttm(x):
        return ts.ttm_sum(x, K, O)

    def roll(x, n, how, mp=None):
        return ts.rolling(x, n, how, mp, K, O)

    # Stage 1: per-row ratios that later windows read.
    s1 = base.select(
        "*",
        div(ca, cl).alias("_cr"),
        div(ebit, rev).alias("_om"),
        div(ttm(ni), roll(eq, 4, "mean", 4)).alias("_roe"),
        ts.pct_change(rev, 4, K, O).alias("_rev_yoy"),
        (ca - cl).alias("_nwc"),
    )
    cr, om, roe, rev_yoy, nwc = (F.col(c) for c in ("_cr", "_om", "_roe", "_rev_yoy", "_nwc"))
    rev_ttm = ttm(rev)
    cor_ttm = ttm(cor)
    f = {
        "Current Ratio": cr,
        "Operating Margin": om,
        "Total Assets (ln)": F.ln(F.nullif(ta, F.lit(0.0))),
        "Total Revenue_YoY_Growth": rev_yoy,
        "Net Income_YoY_Growth": ts.pct_change(ni, 4, K, O),
        "Operating Cash Flow_YoY_Growth": ts.pct_change(ocf, 4, K, O),
        "Change in Operating Margin": ts.diff(om, 4, K, O),
        "Change in Current Ratio": ts.diff(cr, 4, K, O),
        "MA_Net Income": roll(ni, 4, "mean", 1),
        "MA_ROE": roll(roe, 4, "mean", 1),
        "Interest Coverage Ratio": div(ebit, ie),
        "Quick Ratio": div(ca - inv, cl),
        "Debt to EBITDA": div(ttm(liab), ttm(ebit)),
        "NWC_to_Total_Assets": div(nwc, ta),
        "CV_Operating_Margin": div(roll(om, 4, "std", 1), roll(om, 4, "mean", 1)),
        "Count_Negative_Net_Income_12Q": ts.rolling_count(ni < 0, 12, K, O).cast("double"),
        "Sales_Volatility": roll(rev_yoy, 4, "std", 1),
        "RETA_Proxy": div(ttm(ni), ta),
        "EBITTA_Proxy": div(ttm(ebit), ta),
        "SATA_Proxy": div(rev_ttm, ta),
        "WCT": rev_ttm / (F.nullif(nwc, F.lit(0.0)) + 1e-6),
        "CCC": (div(roll(ar, 2, "mean", 1), rev_ttm) * 365 + div(roll(inv, 2, "mean", 1), cor_ttm) * 365
                - div(roll(ap, 2, "mean", 1), cor_ttm) * 365),
        "Revenue_QoQ_Growth": ts.pct_change(rev, 1, K, O),
        "AR_QoQ_Growth": ts.pct_change(ar, 1, K, O),
        "Inventory_QoQ_Growth": ts.pct_change(inv, 1, K, O),
        "CFO_to_Net_Income": div(ttm(ocf), ttm(ni)),
        "Asset_Turnover_TTM": div(rev_ttm, roll(ta, 2, "mean", 1)),
    }
    assert list(f) == RISK_FEATURES
    out = s1.select(K, *keep, *[F.nanvl(v, F.lit(None)).alias(feature_column(n) if sql_names else n)
                                for n, v in f.items()])
    return out
