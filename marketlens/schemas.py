"""Table schemas, metric vocabularies and fixed values.

Everything a caller needs to know about the warehouse lives here as data; operators look
metric names up in these small tables (broadcast joins of a fixed, tiny size).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# Warehouse tables (explicit schemas; no inference).
# ---------------------------------------------------------------------------------------
DIM_COMPANY = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("company_name", T.StringType()),
    T.StructField("logo_url", T.StringType()),
    T.StructField("sector", T.StringType()),
    T.StructField("credit_rating", T.StringType()),
])

# Metric columns of a snapshot.
SUMMARY_METRICS = [
    "fcf_ttm", "revenue_ttm", "price", "market_cap", "beta", "pe_ratio", "pb_ratio", "ev_ebitda",
    "revenue_growth_yoy", "revenue_cagr_3y", "net_income_growth_yoy", "roe", "de_ratio",
    "operating_margin", "cash_conversion", "ebitda_margin", "trailing_eps", "forward_pe",
    "analyst_target_price",
]

FACT_COMPANY_SUMMARY = T.StructType(
    [T.StructField("ticker", T.StringType(), False), T.StructField("date_updated", T.DateType(), False)]
    + [T.StructField(m, T.DoubleType()) for m in SUMMARY_METRICS]
    + [T.StructField("long_business_summary", T.StringType()),
       T.StructField("credit_rating", T.StringType()),
       T.StructField("peer_cluster_id", T.IntegerType()),
       T.StructField("predicted_default_prob", T.DoubleType())])

FACT_DAILY_PRICES = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

FACT_FINANCIAL_STATEMENTS = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("report_date", T.DateType(), False),
    T.StructField("statement_type", T.StringType(), False),
    T.StructField("metric_name", T.StringType(), False),
    T.StructField("metric_value", T.DoubleType()),
])

FACT_NEWS_SENTIMENT = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("title", T.StringType()),
    T.StructField("article_url", T.StringType(), False),
    T.StructField("source_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
])

RATES = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("close", T.DoubleType()),
])

# Upsert keys (conflict targets) of the warehouse tables.
KEYS = {
    "dim_company": ["ticker"],
    "fact_company_summary": ["ticker", "date_updated"],
    "fact_daily_prices": ["ticker", "date"],
    "fact_financial_statements": ["ticker", "report_date", "statement_type", "metric_name"],
    "fact_news_sentiment": ["article_url"],
}

STATEMENT_TYPES = ["income_q", "balance_q", "cashflow_q", "income_a", "balance_a", "cashflow_a"]

# ---------------------------------------------------------------------------------------
# Fixed values.  (statement type, metric name, fin_q column) of the test fixture's long
# statement table, in the fixture's order.
# ---------------------------------------------------------------------------------------
STATEMENT_METRICS = [
    ("income_q", "Total Revenue", "revenue"),
    ("income_q", "Cost Of Revenue", "cost_of_revenue"),
    ("income_q", "EBIT", "ebit"),
    ("income_q", "Net Income", "net_income"),
    ("income_q", "Interest Expense", "interest_expense"),
    ("income_q", "Income Tax Expense", "income_tax"),
    ("income_q", "Income Before Tax", "pretax_income"),
    ("income_q", "Basic EPS", "basic_eps"),
    ("balance_q", "Total Assets", "total_assets"),
    ("balance_q", "Current Assets", "current_assets"),
    ("balance_q", "Current Liabilities", "current_liabilities"),
    ("balance_q", "Total Liabilities", "total_liabilities"),
    ("balance_q", "Stockholders Equity", "equity"),
    ("balance_q", "Inventory", "inventory"),
    ("balance_q", "Accounts Receivable", "accounts_receivable"),
    ("balance_q", "Accounts Payable", "accounts_payable"),
    ("balance_q", "Cash And Cash Equivalents", "cash"),
    ("balance_q", "Total Debt", "total_debt"),
    ("cashflow_q", "Operating Cash Flow", "ocf"),
    ("cashflow_q", "Depreciation And Amortization", "d_and_a"),
    ("cashflow_q", "Capital Expenditure", "capex"),
]

# Metric synonym groups (canonical name -> names seen in statements), used by
# the risk-feature base and the trends view.  Order inside a group is the pick priority.
METRIC_ALIASES = {
    "Accumulated Deficit": ["Accumulated Deficit", "Accumulated_Deficit", "Retained Earnings"],
    "Current Ratio": ["Current Ratio", "Current_Ratio"],
    "Stockholders Equity": ["Total Equity", "Stockholders Equity", "Total Stockholders Equity"],
    "Current Assets": ["Current Assets"],
    "Current Liabilities": ["Current Liabilities"],
    "Total Assets": ["Total Assets"],
    "Inventory": ["Inventory"],
    "Total Liabilities": ["Total Liabilities", "Total Liab", "Total Liabilities Net Minority Interest"],
    "EBIT": ["EBIT", "Operating Income"],
    "Total Revenue": ["Total Revenue", "Sales", "Revenues"],
    "Net Income": ["Net Income", "Net Income Common Stockholders"],
    "Operating Cash Flow": ["Operating Cash Flow", "Total Cash Flow From Operating Activities"],
    "Interest Expense": ["Interest Expense"],
    "Accounts Receivable": ["Accounts Receivable"],
    "Accounts Payable": ["Accounts Payable"],
    "Cost Of Revenue": ["Cost Of Revenue", "Cost Of Goods Sold"],
}

# Synonyms used by the DCF base (TTM sums over quarterly statements).
DCF_ALIASES = {
    "EBIT": ["EBIT", "Operating Income"],
    "Depreciation And Amortization": ["Depreciation And Amortization", "Depreciation & Amortization", "Depreciation"],
    "Capital Expenditure": ["Capital Expenditure", "CapEx"],
    "Income Tax Expense": ["Income Tax Expense"],
    "Income Before Tax": ["Income Before Tax"],
    "Interest Expense": ["Interest Expense"],
}

# Labels that a statement may use for one company series, in order of preference (matched
# without regard to case and surrounding space), and the annual statement that holds the series.
SERIES_LABELS = {
    "revenue": ["Total Revenue", "Revenues", "Revenue"],
    "cost_of_revenue": ["Cost Of Revenue", "Cost of Revenue", "Cost Of Goods Sold"],
    "gross_profit": ["Gross Profit"],
    "op_income": ["Operating Income", "Operating Income or Loss", "Ebit", "Earnings Before Interest and Taxes"],
    "net_income": ["Net Income", "Net Income From Continuing Ops", "Net Income Applicable To Common Shares"],
    "cfo": ["Total Cash From Operating Activities", "Operating Cash Flow"],
    "capex": ["Capital Expenditures"],
}
SERIES_STATEMENT = {"revenue": "income_a", "cost_of_revenue": "income_a", "gross_profit": "income_a", "op_income": "income_a",
                    "net_income": "income_a", "cfo": "cashflow_a", "capex": "cashflow_a"}

# The 27 credit-risk features, in contract order.
RISK_FEATURES = [
    "Current Ratio", "Operating Margin", "Total Assets (ln)",
    "Total Revenue_YoY_Growth", "Net Income_YoY_Growth", "Operating Cash Flow_YoY_Growth",
    "Change in Operating Margin", "Change in Current Ratio",
    "MA_Net Income", "MA_ROE",
    "Interest Coverage Ratio", "Quick Ratio", "Debt to EBITDA", "NWC_to_Total_Assets",
    "CV_Operating_Margin", "Count_Negative_Net_Income_12Q", "Sales_Volatility",
    "RETA_Proxy", "EBITTA_Proxy", "SATA_Proxy",
    "WCT",
    "CCC",
    "Revenue_QoQ_Growth", "AR_QoQ_Growth", "Inventory_QoQ_Growth", "CFO_to_Net_Income", "Asset_Turnover_TTM",
]


def feature_column(name: str) -> str:
    """SQL-friendly column name for a risk feature (spaces/brackets -> underscores, lower)."""
    out = "".join(ch if ch.isalnum() else "_" for ch in name.lower())
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_")


RISK_FEATURE_COLUMNS = [feature_column(n) for n in RISK_FEATURES]

# Rate instruments -> maturity in years (yield curve), in curve order.
MATURITY_YEARS = {"^IRX": 0.08, "^STIX": 0.25, "^GTII": 0.5, "^TWS": 2.0, "^FVX": 5.0, "^TNX": 10.0, "^TYX": 30.0}

# Comparison tabs -> displayed columns and metric direction (True: higher is
# better, sorted descending; False: ascending; absent: ascending).
TABS = {
    "valuation": {"columns": ["ticker", "price", "market_cap", "company_size", "pe_ratio", "ev_ebitda", "pb_ratio"],
                  "higher_is_better": {"pe_ratio": False, "pb_ratio": False, "ev_ebitda": False}},
    "growth": {"columns": ["ticker", "revenue_growth_yoy", "revenue_cagr_3y", "net_income_growth_yoy"],
               "higher_is_better": {"revenue_growth_yoy": True, "revenue_cagr_3y": True, "net_income_growth_yoy": True}},
    "fundamentals": {"columns": ["ticker", "operating_margin", "roe", "cash_conversion", "de_ratio"],
                     "higher_is_better": {"operating_margin": True, "roe": True, "de_ratio": False, "cash_conversion": True}},
    "health": {"columns": ["ticker", "net_debt_to_ebitda", "interest_coverage", "current_ratio", "de_ratio"],
               "higher_is_better": {"net_debt_to_ebitda": False, "interest_coverage": True, "current_ratio": True,
                                    "de_ratio": False}},
    "analyst": {"columns": ["ticker", "consensus", "analyst_target_price", "upside_pct", "target_low", "target_high"],
                "higher_is_better": {"upside_pct": True}},
}

# Sector -> benchmark indices, the benchmarks that every selection may choose, and display names.
SECTOR_BENCHMARKS = {
    "Basic Materials": ["XLB"], "Communication Services": ["XLC"], "Consumer Cyclical": ["XRT", "HERO"],
    "Consumer Defensive": ["XLP"], "Energy": ["XLE"], "Financials": ["XLF"], "Healthcare": ["XLV"], "Industrials": ["XLI"],
    "Real Estate": ["XLRE"], "Technology": ["XLK", "SOXX", "SKYY"], "Utilities": ["XLU"],
}
COMMON_BENCHMARKS = ["^GSPC", "^NDX"]
BENCHMARK_NAMES = {
    "HERO": "Gaming (HERO)", "SKYY": "Cloud Computing (SKYY)", "SOXX": "Semiconductors (SOXX)", "XLB": "Basic Materials (XLB)",
    "XLC": "Communication Services (XLC)", "XLE": "Energy (XLE)", "XLF": "Financials (XLF)", "XLI": "Industrials (XLI)",
    "XLK": "US Tech Giants (XLK)", "XLP": "Consumer Staples (XLP)", "XLRE": "Real Estate (XLRE)", "XLU": "Utilities (XLU)",
    "XLV": "Healthcare (XLV)", "XRT": "US Retail (XRT)", "^GSPC": "S&P 500 Index", "^NDX": "NASDAQ 100 Index",
    "^FVX": "5-Year Treasury Yield", "^TNX": "10-Year Treasury Yield", "^TYX": "30-Year Treasury Yield",
    "LQD": "Inv. Grade Corp Bond ETF", "HYG": "High-Yield Corp Bond ETF",
}

# Default Monte Carlo / forecast scenario (percent inputs), the user-assumption defaults.
DEFAULT_SCENARIO = {
    "scenario_id": 1, "forecast_years": 5, "eps_growth": 10.0, "terminal_pe": 20.0, "sims": 10000,
    "growth_min": 3.0, "growth_mode": 5.0, "growth_max": 8.0,
    "perpetual_min": 1.5, "perpetual_mode": 2.5, "perpetual_max": 3.0,
    "wacc_min": 7.0, "wacc_mode": 8.0, "wacc_max": 10.0,
}

SCENARIO = T.StructType([
    T.StructField("scenario_id", T.IntegerType(), False),
    T.StructField("forecast_years", T.IntegerType()),
    T.StructField("eps_growth", T.DoubleType()),
    T.StructField("terminal_pe", T.DoubleType()),
    T.StructField("sims", T.IntegerType()),
] + [T.StructField(f"{p}_{s}", T.DoubleType()) for p in ("growth", "perpetual", "wacc")
     for s in ("min", "mode", "max")])
