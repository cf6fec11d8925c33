"""Fundamentals (F1-F12): CAGR, cash conversion, trailing-twelve-month sums, tax rate,
balance items, shares, cost of capital, FCFF base, statement view, header facts and the
risk-feature base table.

Statements are the long (EAV) table (ticker, report_date, statement_type, metric_name,
metric_value).  Metric synonyms are resolved with small fixed alias tables (broadcast, a few
dozen rows at most), wide layouts come from ``pivot`` with explicit value lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import snapshot as snap
from ..operators import timeseries as ts
from ..operators.labels import label_key, pick_labels
from ..schemas import DCF_ALIASES, METRIC_ALIASES, SERIES_LABELS, SERIES_STATEMENT

RF, RM = 0.04, 0.08          # fixed values: risk-free rate and market return used by WACC
DEFAULT_TAX = 0.21           # fixed value: fallback tax rate
MONEY = "decimal(38,6)"      # exact type for summing money


def _only(df, tickers, col="ticker"):
    return df if not tickers else df.where(F.col(col).isin(list(tickers)))


def normalise(statements: DataFrame, aliases: dict[str, list[str]] = METRIC_ALIASES) -> DataFrame:
    """Add ``canonical`` and ``priority`` columns (P6); a name outside the map is its own canonical
    name, with priority 0."""
    amap = F.create_map(*[x for canon, names in aliases.items() for n in names for x in (F.lit(n), F.lit(canon))])
    pmap = F.create_map(*[x for canon, names in aliases.items() for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return (statements.withColumn("canonical", F.coalesce(amap[F.col("metric_name")], F.col("metric_name")))
            .withColumn("priority", F.coalesce(pmap[F.col("metric_name")], F.lit(0))))


# Rows of a quarterly income or cash-flow statement make a date count for TTM sums.
TTM_TYPES = ["income_q", "cashflow_q"]
QUARTERLY = ["income_q", "cashflow_q", "balance_q"]


def statement_dates(statements: DataFrame, sums: Sequence[str] = (),
                    picks: dict[str, tuple[Sequence[str], str]] | None = None) -> DataFrame:
    """One row per (ticker, report date) from one scan: everything that the per-company figures need.

    ``sum <name>``: the quarterly values of a metric as an exact decimal (the result does not depend on row
    order); ``<out>`` of ``picks`` (out -> statement types, metric): the value, quarterly before annual
    (quirk Q13); ``has <types>``: whether the date has any row of those types, with or without the metric."""
    picks = picks or {}
    kind, name, value = F.col("statement_type"), F.col("metric_name"), F.col("metric_value")
    quarter = kind.endswith("_q")
    types = sorted({t for ts_, _ in picks.values() for t in ts_} | (set(QUARTERLY) if sums else set()))
    aggs = [F.sum(F.when(kind.isin(QUARTERLY) & (name == n), value.cast(MONEY))).alias(f"sum {n}") for n in sums]
    for out, (of, n) in picks.items():
        here = kind.isin(list(of)) & (name == n)
        aggs.append(F.coalesce(F.max(F.when(here & quarter, value)), F.max(F.when(here & ~quarter, value))).alias(out))
    for of in sorted({tuple(of) for of, _ in picks.values()} | ({tuple(TTM_TYPES)} if sums else set())):
        aggs.append(F.max(kind.isin(list(of))).alias(_has(of)))
    return statements.where(kind.isin(types)).groupBy("ticker", "report_date").agg(*aggs)


def _has(types: Sequence[str]) -> str:
    return "has " + " ".join(types)


def company_figures(statements: DataFrame, groups: dict[str, list[str]] | None = None,
                    picks: dict[str, tuple[Sequence[str], str]] | None = None) -> DataFrame:
    """Per ticker, from two shuffles of one scan: TTM sums (F3, A2, J8) and latest figures.

    ``groups``: for each canonical name the aliases in order; the sum over the ticker's latest four report
    dates of quarterly income or cash-flow statements, in quarterly statements only (quirk Q2), of the
    first alias that is present.  ``picks``: the value at the latest date that has any row of the given statement
    types; a newer statement without the metric gives null.  Tickers with no such statement at all have no row;
    ``has <types>`` tells which of them a ticker has."""
    groups, picks = groups or {}, picks or {}
    names = sorted({n for ns in groups.values() for n in ns})
    per_date = statement_dates(statements, names, picks)
    aggs = []
    if groups:
        has = F.col(f"`{_has(TTM_TYPES)}`")
        w = Window.partitionBy("ticker").orderBy(has.desc(), F.col("report_date").desc())
        per_date = per_date.withColumn("_n", F.row_number().over(w))
        last4 = has & (F.col("_n") <= 4)
        for canon, ns in groups.items():
            total = [F.sum(F.when(last4, F.col(f"`sum {n}`"))).cast("double") for n in ns]
            aggs.append(F.coalesce(*total).alias(canon))
        aggs.append(F.max(has).alias(_has(TTM_TYPES)))
    for out, (of, _) in picks.items():
        aggs.append(F.max_by(out, F.when(F.col(f"`{_has(of)}`"), F.col("report_date"))).alias(out))
    for of in sorted({tuple(of) for of, _ in picks.values()} - {tuple(TTM_TYPES)}):
        aggs.append(F.max(f"`{_has(of)}`").alias(_has(of)))
    return per_date.groupBy("ticker").agg(*aggs)


def latest_metrics(statements: DataFrame, types: Sequence[str], mapping: dict[str, str]) -> DataFrame:
    """Per ticker, the metrics of its latest report date among ``types`` as columns named by ``mapping``
    (see ``company_figures``)."""
    return company_figures(statements, None, {v: (types, k) for k, v in mapping.items()}).select("ticker", *mapping.values())


def ttm_metrics(statements: DataFrame, groups: dict[str, list[str]] = DCF_ALIASES) -> DataFrame:
    """TTM sums (F3) of every ticker that has a quarterly income or cash-flow statement."""
    out = company_figures(statements, groups)
    return out.where(F.col(f"`{_has(TTM_TYPES)}`")).select("ticker", *[F.col(f"`{c}`") for c in groups])


def tax_rate(tax: Column, pretax: Column) -> Column:
    """tax / pretax clipped to [0, 0.5]; 0.21 when pretax is 0 or missing."""
    r = F.when(pretax.isNotNull() & (pretax != 0), F.coalesce(tax, F.lit(0.0)) / F.nullif(pretax, F.lit(0.0))) \
        .otherwise(F.lit(DEFAULT_TAX))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.5), r))


BALANCE_TYPES = ["balance_q", "balance_a"]
BALANCE_ITEMS = {"cash": (BALANCE_TYPES, "Cash And Cash Equivalents"), "total_debt": (BALANCE_TYPES, "Total Debt")}


def balance_latest(statements: DataFrame) -> DataFrame:
    """Cash and total debt at each ticker's latest balance-sheet date, null -> 0."""
    b = company_figures(statements, None, BALANCE_ITEMS)
    return b.select("ticker", F.coalesce("cash", F.lit(0.0)).alias("cash"),
                    F.coalesce("total_debt", F.lit(0.0)).alias("total_debt"))


def shares_outstanding(summary: DataFrame) -> DataFrame:
    """Latest price, market cap and beta; shares = market cap / price, rejected when the price
    is 0 or missing (F6)."""
    s = snap.latest(summary.select("ticker", "date_updated", "price", "market_cap", "beta"), "ticker", "date_updated")
    ok = F.col("price").isNotNull() & (F.col("price") != 0) & F.col("market_cap").isNotNull()
    return s.select("ticker", "price", "market_cap", "beta",
                    F.when(ok, F.col("market_cap") / F.col("price")).alias("shares_outstanding"))


def wacc(market_cap: Column, debt: Column, interest: Column, beta: Column, tax: Column,
         rf: float = RF, rm: float = RM) -> Column:
    """E/V (rf + beta (rm - rf)) + D/V rd (1 - t); rd = interest / debt when both are non-zero,
    else rf; null when beta is missing, debt < 0 or E + D <= 0 (F7, quirk Q14)."""
    v = market_cap + debt
    rd = F.when((debt != 0) & interest.isNotNull() & (interest != 0), interest / F.nullif(debt, F.lit(0.0))) \
        .otherwise(F.lit(rf))
    re = F.lit(rf) + beta * F.lit(rm - rf)
    val = market_cap / v * re + debt / v * rd * (1 - tax)
    return F.when(beta.isNotNull() & (debt >= 0) & (v > 0), val)


def dcf_base(statements: DataFrame, summary: DataFrame, tickers=None, rf: float = RF, rm: float = RM) -> DataFrame:
    """Per ticker DCF inputs (F3-F8): TTM EBIT, D&A, CapEx, tax rate, cash, debt, shares,
    WACC, net debt and base FCFF = EBIT (1 - t) + D&A - CapEx, with a ``status`` column that
    names missing inputs instead of raising.  One scan of each table; one join."""
    sh = shares_outstanding(_only(summary, tickers))
    j = company_figures(_only(statements, tickers), DCF_ALIASES, BALANCE_ITEMS).join(sh, "ticker", "full")
    ebit, da, capex = F.col("EBIT"), F.col("Depreciation And Amortization"), F.col("Capital Expenditure")
    t = tax_rate(F.coalesce(F.col("Income Tax Expense"), F.lit(0.0)), F.coalesce(F.col("Income Before Tax"), F.lit(0.0)))
    interest = F.coalesce(F.col("Interest Expense"), F.lit(0.0))
    debt = F.coalesce(F.col("total_debt"), F.lit(0.0))
    cash = F.coalesce(F.col("cash"), F.lit(0.0))
    fcff = ebit * (1 - F.col("tax_rate")) + da - capex
    missing = F.concat_ws(", ", F.when(ebit.isNull(), F.lit("no_ebit")),
                          F.when(da.isNull(), F.lit("no_d_and_a")), F.when(capex.isNull(), F.lit("no_capex")))
    status = (F.when(missing != "", missing)
              .when(F.col("price").isNull() | F.col("market_cap").isNull() | (F.col("price") == 0), F.lit("no_summary"))
              .when(F.col("shares_outstanding") == 0, F.lit("no_shares"))
              .when(F.col("base_fcff") == 0, F.lit("zero_fcff"))
              .otherwise(F.lit("ok")))
    out = (j.withColumn("tax_rate", t)
           .withColumn("base_fcff", fcff)
           .select("ticker", ebit.alias("ebit_ttm"), da.alias("d_and_a_ttm"), capex.alias("capex_ttm"),
                   F.col("Interest Expense").alias("interest_ttm"),
                   F.col("Income Tax Expense").alias("income_tax_ttm"), F.col("Income Before Tax").alias("pretax_ttm"),
                   "tax_rate", cash.alias("cash"),
                   debt.alias("total_debt"), "price", "market_cap", "beta", "shares_outstanding",
                   wacc(F.col("market_cap"), debt, interest, F.col("beta"), F.col("tax_rate"), rf, rm).alias("wacc"),
                   (debt - cash).alias("net_debt"), "base_fcff", status.alias("status")))
    return out


def company_series(statements: DataFrame, series: Sequence[str] = tuple(SERIES_LABELS), tickers=None,
                   labels: dict[str, list[str]] = SERIES_LABELS) -> DataFrame:
    """(ticker, series, report_date, value, label): annual series under whatever label a company reports them
    (P8, P18), from one scan."""
    st = _only(statements, tickers)
    st = st.where(F.col("statement_type").isin(sorted({SERIES_STATEMENT[k] for k in series})))
    # a label counts only in the statement that its series belongs to: both are told apart by one key
    mark = F.concat_ws("/", "statement_type", label_key(F.col("metric_name")))
    marked = {k: [f"{SERIES_STATEMENT[k]}/{n.strip().lower()}" for n in labels[k]] for k in series}
    rows = st.select("ticker", "report_date", "metric_value", mark.alias("_mark"), "metric_name")
    return pick_labels(rows, marked, name="_mark", shown="metric_name")


def cagr(statements: DataFrame, series: str = "revenue", years: int = 3, tickers=None,
         labels: dict[str, list[str]] = SERIES_LABELS) -> DataFrame:
    """CAGR over the latest ``years + 1`` points of an annual series (F1), under the first of its labels that the
    company reports (P8): needs 2 points, a positive start and a positive span in calendar years;
    a negative ratio under a fractional root is null (NaN in the reference)."""
    x = company_series(statements, [series], tickers, labels).select("ticker", "report_date", F.col("value").alias("metric_value"))
    x = snap.top_n(x, years + 1, "ticker", [F.col("report_date").desc()])
    g = x.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min_by("metric_value", "report_date").alias("start_value"),
        F.max_by("metric_value", "report_date").alias("end_value"),
        (F.year(F.max("report_date")) - F.year(F.min("report_date"))).alias("n_years"))
    ok = (F.col("n_points") >= 2) & (F.col("n_years") > 0) & (F.col("start_value") > 0)
    val = F.pow(F.col("end_value") / F.col("start_value"), 1.0 / F.col("n_years")) - 1
    return g.select("ticker", "n_points", "n_years", "start_value", "end_value",
                    F.when(ok & ~F.isnan(val), val).alias("cagr"))


def cash_conversion(statements: DataFrame, tickers=None, labels: dict[str, list[str]] = SERIES_LABELS) -> DataFrame:
    """Operating cash flow / net income at the latest date both annual series share; else
    each series' own latest value (F2, quirk Q9); null when net income is 0.  Each series is taken under the first of
    its labels that the company reports (P8); two aggregates, no join."""
    x = company_series(statements, ["cfo", "net_income"], tickers, labels)
    cfo, ni, day = F.col("cfo"), F.col("ni"), F.col("report_date")
    d = x.groupBy("ticker", "report_date").agg(F.max(F.when(F.col("series") == "cfo", F.col("value"))).alias("cfo"),
                                               F.max(F.when(F.col("series") == "net_income", F.col("value"))).alias("ni"))
    both = F.when(cfo.isNotNull() & ni.isNotNull(), day)
    g = d.groupBy("ticker").agg(
        F.max(both).alias("common_date"), F.max_by(cfo, both).alias("c_cfo"), F.max_by(ni, both).alias("c_ni"),
        F.max_by(cfo, F.when(cfo.isNotNull(), day)).alias("l_cfo"), F.max_by(ni, F.when(ni.isNotNull(), day)).alias("l_ni"))
    common = F.col("common_date").isNotNull()
    c_, n_ = (F.when(common, F.col(f"c_{k}")).otherwise(F.col(f"l_{k}")) for k in ("cfo", "ni"))
    return g.where(F.col("l_cfo").isNotNull() & F.col("l_ni").isNotNull()).select(
        "ticker", "common_date", F.when(n_ != 0, c_ / F.nullif(n_, F.lit(0.0))).alias("cash_conversion"))


def statement_view(statements: DataFrame, kind: str = "income", periods: int = 16, tickers=None) -> DataFrame:
    """Statement view (F9): one statement kind's quarterly rows (quirk Q1: the stored '_q'
    type) for each ticker's latest ``periods`` report dates, newest first, values in millions.
    Long form.  The statement rows meet one row per ticker, the oldest date that is shown, through a hash
    table of these and are not sorted."""
    st = _only(statements, tickers).where(F.col("statement_type") == f"{kind}_q")
    dates = snap.latest_n_dates(st.select("ticker", "report_date").distinct(), periods)
    oldest = dates.groupBy("ticker").agg(F.min("report_date").alias("_from")).hint("shuffle_hash")
    x = st.join(oldest, "ticker").where(F.col("report_date") >= F.col("_from"))
    return x.select("ticker", "metric_name", "report_date",
                    (F.col("metric_value") / 1e6).alias("value_m"), S.fmt_millions("metric_value").alias("display"))


def header_facts(dim: DataFrame, summary: DataFrame, prices: DataFrame, tickers=None) -> DataFrame:
    """Header facts (F10): company facts, latest summary, last close, previous close, daily change
    (summary price - previous close) and change % (0 when the previous close is 0).  With a single
    stored close that one is the previous close; without any the price itself is."""
    s = snap.latest(_only(summary, tickers).select("ticker", "date_updated", "price", "market_cap", "pe_ratio", "beta",
                                                   "predicted_default_prob"), "ticker", "date_updated")
    last2 = snap.top_n(_only(prices, tickers).select("ticker", "date", "close"), 2, "ticker", [F.col("date").desc()])
    pc = last2.groupBy("ticker").agg(F.max_by("close", "date").alias("last_close"),
                                     F.max("date").alias("last_date"),
                                     F.min_by("close", "date").alias("before"))
    prev = F.coalesce(F.col("before"), F.when(F.col("last_date").isNull(), F.col("price")))
    chg = F.col("price") - prev
    pct = F.when(prev != 0, chg / F.nullif(prev, F.lit(0.0)) * 100).otherwise(F.lit(0.0))
    d = _only(dim, tickers).select("ticker", "company_name", "sector", "credit_rating")
    return (d.join(s, "ticker", "left").join(pc, "ticker", "left")
            .select("ticker", "company_name", "sector", "credit_rating", "date_updated", "price", "market_cap",
                    "pe_ratio", "beta", "predicted_default_prob", S.risk_bucket("predicted_default_prob").alias("risk_bucket"),
                    "last_date", "last_close", prev.alias("prev_close"), chg.alias("change"),
                    F.when(chg.isNotNull(), pct).alias("change_pct")))


RISK_BASE_METRICS = list(METRIC_ALIASES)


def risk_base(statements: DataFrame, dim: DataFrame, summary: DataFrame, prices: DataFrame,
              tickers=None, start_year: int | None = None) -> DataFrame:
    """Risk-feature base table (F12): statements (from ``start_year`` if given) with synonyms resolved
    (P6), one value per (ticker, date, metric) -- quarterly before annual, then alias priority
    (quirk Q4) -- pivoted wide, current ratio derived when absent, joined to credit rating,
    latest market cap and shares (J4), and the last close on or before each report date (J5).
    ``tickers`` is honoured (quirk Q11)."""
    st = _only(statements, tickers)
    if start_year is not None:
        st = st.where(F.col("report_date") >= F.lit(f"{start_year}-01-01").cast("date"))
    n = normalise(st.where(F.col("metric_name").isin([x for xs in METRIC_ALIASES.values() for x in xs])))
    # pick and pivot in one hash aggregate: per metric the value of least rank
    rank = F.when(F.col("statement_type").endswith("_q"), 0).otherwise(1000) + F.col("priority")
    n = n.select("ticker", "report_date", "canonical", "metric_value", rank.cast("int").alias("_rank"))
    wide = n.groupBy("ticker", "report_date").agg(*[
        F.min_by("metric_value", F.when(F.col("canonical") == c, F.col("_rank"))).alias(c) for c in RISK_BASE_METRICS])
    cr = F.coalesce(F.col("`Current Ratio`"), ts.safe_div(F.col("`Current Assets`"), F.col("`Current Liabilities`")))
    wide = wide.withColumn("Current Ratio", cr)
    rating = _only(dim, tickers).select("ticker", "credit_rating")
    sh = shares_outstanding(_only(summary, tickers)).select("ticker", "market_cap", "shares_outstanding")
    base = wide.join(rating, "ticker", "left").join(sh, "ticker", "left")
    px = _only(prices, tickers).select("ticker", "date", F.col("close").alias("closing_price")).where(F.col("close").isNotNull())
    return ts.asof_backward(base, px, ["closing_price"], "ticker", left_on="report_date", right_on="date")
