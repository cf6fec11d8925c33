"""Query registrations: Spark side (library calls over whole tables) + DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import q, register
from ..schemas import METRIC_ALIASES, RISK_FEATURE_COLUMNS, feature_column
from . import fundamentals as fu
from . import market as mk
from .risk import risk_features

P = "fact_daily_prices"
ST = "fact_financial_statements"
SUM = "fact_company_summary"
DIM = "dim_company"

SUMMARY_COLS = ["ticker", "date_updated", "price", "market_cap", "beta", "pe_ratio", "pb_ratio", "ev_ebitda",
                "revenue_growth_yoy", "net_income_growth_yoy", "roe", "de_ratio", "operating_margin",
                "cash_conversion", "ebitda_margin", "trailing_eps", "analyst_target_price", "peer_cluster_id",
                "predicted_default_prob"]
SUMMARY_DOUBLES = [c for c in SUMMARY_COLS if c not in ("ticker", "date_updated", "peer_cluster_id")]


def W(order="date", key="ticker"):
    return f"partition by {key} order by {order}"


def FR(n, order="date", key="ticker"):
    return f"(partition by {key} order by {order} rows between {n - 1} preceding and current row)"


# ======================================================================================
# Market comparison
# ======================================================================================
@register("drawdown_1y", f"""
with p as (select ticker, date, close from {P}
           where date >= (select max(date) from {P}) - 365 and date <= (select max(date) from {P}) and close is not null),
obs as (select ticker, date, close,
          close / max(close) over ({W()} rows between unbounded preceding and current row) - 1 as drawdown from p),
cal as (select distinct date from p),
firsts as (select ticker, min(date) d0 from p group by ticker),
grid as (select f.ticker, c.date from firsts f join cal c on c.date >= f.d0)
select g.ticker, g.date, o.close, o.drawdown from grid g asof join obs o on g.ticker = o.ticker and g.date >= o.date
""", [P], ["close", "drawdown"], 12)
def drawdown_1y(m):
    """M2: one-year drawdown of every ticker on the shared calendar, forward filled."""
    return mk.drawdown(m.prices_by_month)


@register("ytd_performance", f"""
with e as (select max(date) as_of from {P}),
p0 as (select ticker, date from {P}, e where date >= date_trunc('year', as_of) and date <= as_of and close is not null),
st as (select case when (select count(distinct date) from p0) < 2 and month(as_of) = 1 then as_of - 365
                   else cast(date_trunc('year', as_of) as date) end s, as_of from e),
p as (select ticker, date, close from {P}, st where date >= s and date <= as_of and close is not null),
d0 as (select min(date) d0 from p),
base as (select p.ticker, p.close base from p, d0 where p.date = d0.d0),
cal as (select distinct date from p),
firsts as (select ticker, min(date) f from p group by ticker),
grid as (select f.ticker, c.date from firsts f join cal c on c.date >= f.f)
select g.ticker, g.date, o.close, o.close / b.base - 1 as performance
from grid g asof join p o on g.ticker = o.ticker and g.date >= o.date left join base b on b.ticker = g.ticker
""", [P], ["close", "performance"], 12)
def ytd_performance(m):
    """M1: performance since the first calendar row of the year, aligned and forward filled."""
    return mk.performance(m.prices_by_month)


@register("latest_snapshot", f"""
select s.*, d.company_name, d.logo_url, d.sector
from {SUM} s
join (select ticker, max(date_updated) m from {SUM} group by ticker) x on s.ticker = x.ticker and s.date_updated = x.m
join {DIM} d on d.ticker = s.ticker
""", [SUM, DIM], SUMMARY_DOUBLES, 10)
def latest_snapshot(m):
    """J1 + J2: latest summary per ticker joined to the company dimension."""
    return mk.latest_snapshot(m.summary, m.dim)


SCORING_SQL = """
case when market_cap is null or market_cap < 0 then null when market_cap >= 1000e9 then 'Mega Cap'
     when market_cap >= 100e9 then 'Large Cap' when market_cap >= 10e9 then 'Mid Cap' else 'Small Cap' end as company_size,
case when beta is null then 'N/A' when beta < 0.5 then 'Core' when beta <= 2 then 'Growth' when beta > 2 then 'Hyper Growth'
     else 'N/A' end as volatility_level,
case when ev_ebitda is null then 'N/A' when ev_ebitda < 10 then 'Cheap' when ev_ebitda <= 25 then 'Fair Value'
     when ev_ebitda > 25 then 'Expensive' else 'N/A' end as valuation_model"""

PROFILE_SQL = """
case when volatility_level = 'Hyper Growth' and valuation_model = 'Fair Value' then 'Promising Growth'
     when volatility_level = 'Core' and valuation_model = 'Cheap' then 'Hidden Value Gem'
     when volatility_level = 'Hyper Growth' and valuation_model = 'Expensive' then 'High-Flyer'
     when volatility_level = 'Core' and valuation_model = 'Fair Value' then 'Stable Compounder'
     when volatility_level = 'Growth' and valuation_model = 'Fair Value' then 'Core Holding'
     when volatility_level = 'Growth' and valuation_model = 'Cheap' then 'Value Opportunity'
     else 'Needs Review' end as stock_profile"""

LATEST_SUMMARY_SQL = f"""(select * from (select *, row_number() over (partition by ticker order by date_updated desc) rn
   from {SUM}) where rn = 1)"""


@register("company_scoring", f"""
with s as (select ticker, date_updated, market_cap, beta, ev_ebitda, {SCORING_SQL} from {LATEST_SUMMARY_SQL})
select ticker, date_updated, market_cap, beta, ev_ebitda, company_size, volatility_level, valuation_model, {PROFILE_SQL}
from s
""", [SUM], ["market_cap", "beta", "ev_ebitda"], 10)
def company_scoring(m):
    """M4-M7 on the latest snapshot of every ticker."""
    s = mk.latest_snapshot(m.summary).select("ticker", "date_updated", "market_cap", "beta", "ev_ebitda")
    return mk.score_companies(s)


@register("company_scoring_history", f"""
with s as (select ticker, date_updated, market_cap, beta, ev_ebitda, {SCORING_SQL} from {SUM})
select ticker, date_updated, company_size, volatility_level, valuation_model, {PROFILE_SQL} from s
""", [SUM], [], 10)
def company_scoring_history(m):
    """M4-M7 over every summary snapshot (the whole summary table)."""
    return mk.score_companies(m.summary).select("ticker", "date_updated", "company_size", "volatility_level",
                                                "valuation_model", "stock_profile")


@register("valuation_quality", f"""
with pts as (select ticker, ebitda_margin, ev_ebitda from {LATEST_SUMMARY_SQL}
             where ebitda_margin is not null and ev_ebitda is not null),
mm as (select avg(ebitda_margin) x, avg(ev_ebitda) y from pts)
select ticker, ebitda_margin, ev_ebitda, x as mean_ebitda_margin, y as mean_ev_ebitda,
  case when ev_ebitda >= y and ebitda_margin < x then 'Expensive / Low Quality'
       when ev_ebitda >= y and ebitda_margin >= x then 'Expensive / High Quality'
       when ev_ebitda < y and ebitda_margin < x then 'Cheap / Low Quality'
       else 'Cheap / High Quality' end as quadrant
from pts, mm
""", [SUM], ["ebitda_margin", "ev_ebitda", "mean_ebitda_margin", "mean_ev_ebitda"], 10)
def valuation_quality(m):
    """M3: valuation-vs-quality points with mean lines and quadrant."""
    return mk.valuation_quality(mk.latest_snapshot(m.summary))


# ======================================================================================
# Risk base (F12 + J5) and the 27 risk features
# ======================================================================================
_ALIAS_ROWS = [(n, c, i) for c, ns in METRIC_ALIASES.items() for i, n in enumerate(ns)]
_BASE_METRICS = list(METRIC_ALIASES)


def _risk_base_sql() -> str:
    canon = "case metric_name " + " ".join(f"when '{n}' then '{c}'" for n, c, _ in _ALIAS_ROWS) + " end"
    prio = "case metric_name " + " ".join(f"when '{n}' then {i}" for n, _, i in _ALIAS_ROWS) + " end"
    names = ", ".join(f"'{n}'" for n, _, _ in _ALIAS_ROWS)
    piv = ",\n  ".join(f"avg(case when canonical = '{c}' then metric_value end) as {q(feature_column(c))}"
                       for c in _BASE_METRICS)
    return f"""
n as (select ticker, report_date, statement_type, metric_value, {canon} as canonical, {prio} as priority
      from {ST} where metric_name in ({names})),
one as (select * from (select *, row_number() over (partition by ticker, report_date, canonical
          order by case when substr(statement_type, length(statement_type) - 1) = '_q' then 0 else 1 end, priority) rn
        from n) where rn = 1),
wide0 as (select ticker, report_date,
  {piv}
  from one group by ticker, report_date),
wide as (select * replace (coalesce(current_ratio, current_assets / nullif(current_liabilities, 0)) as current_ratio) from wide0),
ls as (select ticker, market_cap,
         case when price is not null and price <> 0 and market_cap is not null then market_cap / price end as shares_outstanding
       from {LATEST_SUMMARY_SQL}),
base as (select w.*, d.credit_rating, ls.market_cap, ls.shares_outstanding
         from wide w left join {DIM} d on d.ticker = w.ticker left join ls on ls.ticker = w.ticker),
b as (select base.*, p.close as closing_price from base
      asof left join (select ticker, date, close from {P} where close is not null) p
      on base.ticker = p.ticker and base.report_date >= p.date)"""


BASE_COLS = [feature_column(c) for c in _BASE_METRICS]


def _risk_base_spark(m):
    base = fu.risk_base(m.statements, m.dim, m.summary, m.prices)
    return base.select("ticker", "report_date", *[F.col(f"`{c}`").alias(feature_column(c)) for c in _BASE_METRICS],
                       "credit_rating", "market_cap", "shares_outstanding", "closing_price")


@register("asof_price", f"""
with {_risk_base_sql().strip()}
select ticker, report_date, {", ".join(BASE_COLS)}, credit_rating, market_cap, shares_outstanding, closing_price from b
""", [ST, P, SUM, DIM], BASE_COLS + ["market_cap", "shares_outstanding", "closing_price"], 10)
def asof_price(m):
    """F12 + J5: risk base table (pivoted statements, rating, market cap, shares) with the last
    close on or before each report date."""
    return _risk_base_spark(m)


def _risk_features_sql() -> str:
    w = W("report_date")

    def ttm(x):
        f = FR(4, "report_date")
        return f"(case when count({x}) over {f} >= 4 then sum({x}) over {f} end)"

    def roll(x, n, how, mp):
        f = FR(n, "report_date")
        fn = {"mean": "avg", "std": "stddev_samp"}[how]
        if how == "std":
            mp = max(mp, 2)
        return f"(case when count({x}) over {f} >= {mp} then {fn}({x}) over {f} end)"

    def pct(x, n):
        return f"({x} / nullif(lag({x}, {n}) over ({w}), 0) - 1)"

    def dif(x, n):
        return f"({x} - lag({x}, {n}) over ({w}))"

    def dv(a, b):
        return f"(({a}) / nullif({b}, 0))"

    feats = [
        ("cr", "cr"), ("om", "om"), ("ln_ta", "case when total_assets > 0 then ln(total_assets) end"),
        ("rev_yoy", "rev_yoy"), ("ni_yoy", pct("net_income", 4)), ("ocf_yoy", pct("operating_cash_flow", 4)),
        ("d_om", dif("om", 4)), ("d_cr", dif("cr", 4)),
        ("ma_ni", roll("net_income", 4, "mean", 1)), ("ma_roe", roll("roe", 4, "mean", 1)),
        ("icr", dv("ebit", "interest_expense")), ("quick", dv("current_assets - inventory", "current_liabilities")),
        ("d_ebitda", dv(ttm("total_liabilities"), ttm("ebit"))), ("nwc_ta", dv("nwc", "total_assets")),
        ("cv_om", dv(roll("om", 4, "std", 1), roll("om", 4, "mean", 1))),
        ("neg12", f"cast(sum(coalesce(cast(net_income < 0 as int), 0)) over {FR(12, 'report_date')} as double)"),
        ("sales_vol", roll("rev_yoy", 4, "std", 1)),
        ("reta", dv(ttm("net_income"), "total_assets")), ("ebitta", dv(ttm("ebit"), "total_assets")),
        ("sata", dv(ttm("total_revenue"), "total_assets")),
        ("wct", f"({ttm('total_revenue')} / (nullif(nwc, 0) + 1e-6))"),
        ("ccc", f"({dv(roll('accounts_receivable', 2, 'mean', 1), ttm('total_revenue'))} * 365"
                f" + {dv(roll('inventory', 2, 'mean', 1), ttm('cost_of_revenue'))} * 365"
                f" - {dv(roll('accounts_payable', 2, 'mean', 1), ttm('cost_of_revenue'))} * 365)"),
        ("rev_qoq", pct("total_revenue", 1)), ("ar_qoq", pct("accounts_receivable", 1)),
        ("inv_qoq", pct("inventory", 1)), ("cfo_ni", dv(ttm("operating_cash_flow"), ttm("net_income"))),
        ("at_ttm", dv(ttm("total_revenue"), roll("total_assets", 2, "mean", 1))),
    ]
    sel = ",\n  ".join(f"{e} as {q(c)}" for (_, e), c in zip(feats, RISK_FEATURE_COLUMNS))
    return f"""
with {_risk_base_sql().strip()},
s1 as (select *, current_assets / nullif(current_liabilities, 0) as cr, ebit / nullif(total_revenue, 0) as om,
         {ttm('net_income')} / nullif({roll('stockholders_equity', 4, 'mean', 4)}, 0) as roe,
         {pct('total_revenue', 4)} as rev_yoy, current_assets - current_liabilities as nwc from b)
select ticker, report_date, closing_price, market_cap, shares_outstanding,
  {sel}
from s1"""


@register("risk_features", _risk_features_sql(), [ST, P, SUM, DIM],
          ["closing_price", "market_cap", "shares_outstanding", *RISK_FEATURE_COLUMNS], 8,
          colplaces={"ma_net_income": 7})
def risk_features_q(m):
    """The 27 credit-risk features for every (ticker, report date), with the as-of close (J5),
    market cap and shares."""
    base = fu.risk_base(m.statements, m.dim, m.summary, m.prices)
    return risk_features(base, keep=("report_date", "closing_price", "market_cap", "shares_outstanding"))
