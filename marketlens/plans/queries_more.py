"""Query registrations, part 2: technicals, fundamentals, comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..schemas import DCF_ALIASES, TABS
from . import fundamentals as fu
from . import market as mk
from . import technical as te
from .queries import DIM, FR, LATEST_SUMMARY_SQL, P, SCORING_SQL, ST, SUM, W

# ======================================================================================
# Technical indicators (T1-T12).  Oracle EWM: weights a(1-a)^k (1 on the series' first row)
# summed over a 600-row frame; the truncated tail weighs < (13/14)^600 ~ 5e-20.
# ======================================================================================
A = {"e20": 2 / 21, "e12": 2 / 13, "e26": 2 / 27, "r": 1 / 14, "s9": 2 / 10}
FRAME = 600


def _ewm_terms(alias: str, src: str, a: float) -> str:
    return (f"sum(case when b.i = 0 then 1.0 else {a!r} end * pow({1 - a!r}, a.i - b.i) * b.{src}) as {alias}")


def _ewm_join(rel: str, terms: list[str]) -> str:
    return (f"select a.ticker, a.i, {', '.join(terms)} from {rel} a join {rel} b "
            f"on a.ticker = b.ticker and b.i between a.i - {FRAME} and a.i group by a.ticker, a.i")


def _base_sql(cols="ticker, date, open, high, low, close, volume") -> str:
    return f"""r0 as (select {cols}, row_number() over ({W()}) - 1 as i,
        close - lag(close) over ({W()}) as delta from {P} where close is not null),
r as (select *, coalesce(case when delta > 0 then delta end, 0.0) as gain,
        coalesce(case when delta < 0 then -delta end, 0.0) as loss from r0)"""


def _roll(x, n, how="avg", mp=None):
    mp = n if mp is None else mp
    if how == "stddev_samp":
        mp = max(mp, 2)
    f = FR(n)
    return f"(case when count({x}) over {f} >= {mp} then {how}({x}) over {f} end)"


TECH_SQL = f"""
with {_base_sql()},
e as ({_ewm_join("r", [_ewm_terms("ema20", "close", A["e20"]), _ewm_terms("ema12", "close", A["e12"]),
                       _ewm_terms("ema26", "close", A["e26"]), _ewm_terms("ag", "gain", A["r"]),
                       _ewm_terms("al", "loss", A["r"])])}),
m as (select r.*, e.ema20, e.ema12, e.ema26, e.ag, e.al, e.ema12 - e.ema26 as macd from r join e using (ticker, i)),
s as ({_ewm_join("m", [_ewm_terms("macd_signal", "macd", A["s9"])])}),
f as (select m.*, s.macd_signal, {_roll("close", 50)} as sma50, {_roll("close", 200)} as sma200,
        {_roll("close", 20)} as bb_mid, {_roll("close", 20, "stddev_samp")} as bb_std
      from m join s using (ticker, i)),
g as (select ticker, date, open, high, low, close, volume, sma50, sma200, ema20, bb_mid,
        bb_mid + 2 * bb_std as bb_upper, bb_mid - 2 * bb_std as bb_lower,
        coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 50.0) as rsi,
        macd, macd_signal, macd - macd_signal as macd_hist from f)
select *, case when rsi >= 70 then 'overbought' when rsi <= 30 then 'oversold' else 'neutral' end as rsi_zone,
  case when macd_hist >= 0 then 'positive' else 'negative' end as hist_sign
from g
where sma50 is not null and sma200 is not null and ema20 is not null and bb_upper is not null and bb_lower is not null
  and rsi is not null and macd is not null and macd_signal is not null and macd_hist is not null
"""

TECH_DOUBLES = ["open", "high", "low", "close", "sma50", "sma200", "ema20", "bb_mid", "bb_upper", "bb_lower", "rsi",
                "macd", "macd_signal", "macd_hist"]


@register("technical_indicators", TECH_SQL, [P], TECH_DOUBLES, places=4)
def technical_indicators(m):
    """T1-T12 for every ticker, warm-up rows (any indicator null) dropped."""
    return te.technical_indicators(m.prices)


@register("sma", f"""
select ticker, date, close, {_roll("close", 50)} as sma50, {_roll("close", 200)} as sma200 from {P}
""", [P], ["close", "sma50", "sma200"], places=4)
def sma(m):
    """50- and 200-row simple moving averages (full windows)."""
    return te.sma(m.prices)


@register("bollinger", f"""
select ticker, date, close, bb_mid, bb_mid + 2 * bb_std as bb_upper, bb_mid - 2 * bb_std as bb_lower
from (select ticker, date, close, {_roll("close", 20)} as bb_mid, {_roll("close", 20, "stddev_samp")} as bb_std from {P})
""", [P], ["close", "bb_mid", "bb_upper", "bb_lower"], places=4)
def bollinger(m):
    """20-row Bollinger bands (mean +- 2 sample std)."""
    return te.bollinger(m.prices)


@register("ema", f"""
with {_base_sql("ticker, date, close")},
e as ({_ewm_join("r", [_ewm_terms("ema20", "close", A["e20"])])})
select r.ticker, r.date, r.close, e.ema20 from r join e using (ticker, i)
""", [P], ["close", "ema20"], places=4)
def ema(m):
    """EMA(20), adjust=False."""
    return te.ema(m.prices, 20)


@register("rsi", f"""
with {_base_sql("ticker, date, close")},
e as ({_ewm_join("r", [_ewm_terms("ag", "gain", A["r"]), _ewm_terms("al", "loss", A["r"])])})
select r.ticker, r.date, r.close, coalesce(100 - 100 / (1 + e.ag / nullif(e.al, 0)), 50.0) as rsi
from r join e using (ticker, i)
""", [P], ["close", "rsi"], places=4)
def rsi(m):
    """RSI(14) with Wilder smoothing (EWM alpha 1/14); no losses -> 50."""
    return te.rsi(m.prices)


@register("macd", f"""
with {_base_sql("ticker, date, close")},
e as ({_ewm_join("r", [_ewm_terms("ema12", "close", A["e12"]), _ewm_terms("ema26", "close", A["e26"])])}),
m as (select r.*, e.ema12 - e.ema26 as macd from r join e using (ticker, i)),
s as ({_ewm_join("m", [_ewm_terms("macd_signal", "macd", A["s9"])])})
select m.ticker, m.date, m.close, m.macd, s.macd_signal, m.macd - s.macd_signal as macd_hist
from m join s using (ticker, i)
""", [P], ["close", "macd", "macd_signal", "macd_hist"], places=4)
def macd(m):
    """MACD(12, 26), signal EWM(9) of MACD, histogram."""
    return te.macd(m.prices)


# ======================================================================================
# Fundamentals
# ======================================================================================
def _latest_dates_sql(rel: str, n: int) -> str:
    return (f"(select ticker, report_date from (select ticker, report_date, dense_rank() over "
            f"(partition by ticker order by report_date desc) dr from (select distinct ticker, report_date from {rel})) "
            f"where dr <= {n})")


TTM_GROUPS = dict(zip(["ebit_ttm", "d_and_a_ttm", "capex_ttm", "income_tax_ttm", "pretax_ttm", "interest_ttm"],
                      DCF_ALIASES.values()))


def _ttm_sql() -> str:
    names = sorted({n for ns in TTM_GROUPS.values() for n in ns})
    sums = {n: f"cast(sum(case when metric_name = '{n}' then cast(metric_value as decimal(38,6)) end) as double)" for n in names}
    cols = ", ".join(f"coalesce({', '.join(sums[n] for n in ns)}) as {c}" for c, ns in TTM_GROUPS.items())
    return f"""tq as (select * from {ST} where statement_type in ('income_q', 'cashflow_q', 'balance_q')),
td as {_latest_dates_sql("(select * from tq where statement_type in ('income_q', 'cashflow_q'))", 4)},
ttm as (select td1.ticker, {cols}
        from (select distinct ticker from td) td1
        left join (select tq.* from tq join td on tq.ticker = td.ticker and tq.report_date = td.report_date
                   where metric_name in ({", ".join(f"'{n}'" for n in names)})) x on x.ticker = td1.ticker
        group by td1.ticker)"""


def _ttm_spark(st):
    t = fu.ttm_metrics(st)
    ren = {"EBIT": "ebit_ttm", "Depreciation And Amortization": "d_and_a_ttm", "Capital Expenditure": "capex_ttm",
           "Income Tax Expense": "income_tax_ttm", "Income Before Tax": "pretax_ttm", "Interest Expense": "interest_ttm"}
    return t.select("ticker", *[F.col(f"`{k}`").alias(v) for k, v in ren.items()])


MONEY5 = {c: 5 for c in list(TTM_GROUPS) + ["cash", "total_debt", "net_debt", "base_fcff", "ebit_a", "debt"]}


@register("ttm_metrics", f"with {_ttm_sql()} select * from ttm", [ST], list(TTM_GROUPS), 10, colplaces=MONEY5)
def ttm_metrics(m):
    """TTM sums over each ticker's latest four quarterly report dates, alias fallback."""
    return _ttm_spark(m.statements)


def _latest_metric_sql(types: list[str], mapping: dict[str, str], name: str) -> str:
    tl = ", ".join(f"'{t}'" for t in types)
    nl = ", ".join(f"'{k}'" for k in mapping)
    piv = ", ".join(f"max(case when metric_name = '{k}' then metric_value end) as {v}" for k, v in mapping.items())
    return f"""{name}_s as (select * from {ST} where statement_type in ({tl})),
{name}_d as (select ticker, max(report_date) report_date from {name}_s group by ticker),
{name}_1 as (select * from (select s.*, row_number() over (partition by s.ticker, s.metric_name
               order by case when substr(s.statement_type, length(s.statement_type) - 1) = '_q' then 0 else 1 end) rn
             from {name}_s s join {name}_d d on s.ticker = d.ticker and s.report_date = d.report_date
             where s.metric_name in ({nl})) where rn = 1),
{name} as (select d.ticker, {piv} from {name}_d d left join {name}_1 o on o.ticker = d.ticker group by d.ticker)"""


@register("balance_latest", f"""
with {_latest_metric_sql(["balance_q", "balance_a"], {"Cash And Cash Equivalents": "cash", "Total Debt": "total_debt"}, "bl")}
select ticker, coalesce(cash, 0.0) as cash, coalesce(total_debt, 0.0) as total_debt from bl
""", [ST], ["cash", "total_debt"], 10)
def balance_latest(m):
    """cash and total debt at each ticker's latest balance-sheet date (null -> 0)."""
    return fu.balance_latest(m.statements)


def _dcf_sql(final_cols: str) -> str:
    return f"""
with {_ttm_sql()},
{_latest_metric_sql(["balance_q", "balance_a"], {"Cash And Cash Equivalents": "cash", "Total Debt": "total_debt"}, "bl")},
ls as (select ticker, price, market_cap, beta,
         case when price is not null and price <> 0 and market_cap is not null then market_cap / price end as shares_outstanding
       from {LATEST_SUMMARY_SQL}),
j0 as (select coalesce(ttm.ticker, bl.ticker) as ticker, ttm.* exclude (ticker), bl.cash as cash0, bl.total_debt as debt0
       from ttm full join bl on ttm.ticker = bl.ticker),
j as (select coalesce(j0.ticker, ls.ticker) as ticker, j0.* exclude (ticker), ls.* exclude (ticker)
      from j0 full join ls on j0.ticker = ls.ticker),
k as (select *, greatest(0.0, least(0.5, case when coalesce(pretax_ttm, 0.0) is not null and coalesce(pretax_ttm, 0.0) <> 0
          then coalesce(income_tax_ttm, 0.0) / coalesce(pretax_ttm, 0.0) else 0.21 end)) as tax_rate,
          coalesce(coalesce(debt0, 0.0), 0.0) as total_debt, coalesce(coalesce(cash0, 0.0), 0.0) as cash,
          coalesce(interest_ttm, 0.0) as interest from j),
l as (select *, ebit_ttm * (1 - tax_rate) + d_and_a_ttm - capex_ttm as base_fcff,
        total_debt - cash as net_debt,
        case when beta is not null and total_debt >= 0 and market_cap + total_debt > 0 then
          market_cap / (market_cap + total_debt) * (0.04 + beta * 0.04)
          + total_debt / (market_cap + total_debt)
            * (case when total_debt <> 0 and interest is not null and interest <> 0 then interest / total_debt else 0.04 end)
            * (1 - tax_rate) end as wacc,
        concat_ws(', ', case when ebit_ttm is null then 'no_ebit' end,
                  case when d_and_a_ttm is null then 'no_d_and_a' end, case when capex_ttm is null then 'no_capex' end) as missing
      from k)
select {final_cols},
  case when missing <> '' then missing
       when price is null or market_cap is null or price = 0 then 'no_summary'
       when shares_outstanding = 0 then 'no_shares'
       when base_fcff = 0 then 'zero_fcff' else 'ok' end as status
from l"""


DCF_COLS = ["ebit_ttm", "d_and_a_ttm", "capex_ttm", "interest_ttm", "tax_rate", "cash", "total_debt", "price",
            "market_cap", "beta", "shares_outstanding", "wacc", "net_debt", "base_fcff"]


@register("dcf_base", _dcf_sql("ticker, " + ", ".join(DCF_COLS)), [ST, SUM, P, "fin_q"], DCF_COLS, 10, colplaces=MONEY5)
def dcf_base(m):
    """DCF inputs per ticker with a status column naming missing inputs."""
    return fu.dcf_base(m.statements, m.summary).drop("income_tax_ttm", "pretax_ttm")


@register("tax_rate", _dcf_sql("ticker, income_tax_ttm, pretax_ttm, tax_rate"), [ST, SUM],
          ["income_tax_ttm", "pretax_ttm", "tax_rate"], 10, colplaces=MONEY5)
def tax_rate(m):
    """effective TTM tax rate clipped to [0, 0.5], 0.21 by default."""
    return fu.dcf_base(m.statements, m.summary).select("ticker", "income_tax_ttm", "pretax_ttm", "tax_rate", "status")


@register("wacc", _dcf_sql("ticker, market_cap, total_debt, beta, tax_rate, wacc"), [ST, SUM],
          ["market_cap", "total_debt", "beta", "tax_rate", "wacc"], 10, colplaces=MONEY5)
def wacc(m):
    """weighted average cost of capital."""
    return fu.dcf_base(m.statements, m.summary).select("ticker", "market_cap", "total_debt", "beta", "tax_rate", "wacc",
                                                       "status")


@register("fcff_base", _dcf_sql("ticker, ebit_ttm, tax_rate, d_and_a_ttm, capex_ttm, net_debt, base_fcff"), [ST, SUM],
          ["ebit_ttm", "tax_rate", "d_and_a_ttm", "capex_ttm", "net_debt", "base_fcff"], 10, colplaces=MONEY5)
def fcff_base(m):
    """F8: base free cash flow to the firm and net debt."""
    return fu.dcf_base(m.statements, m.summary).select("ticker", "ebit_ttm", "tax_rate", "d_and_a_ttm", "capex_ttm",
                                                       "net_debt", "base_fcff", "status")


CAGR_SQL = f"""cg_x as (select ticker, report_date, metric_value from {ST}
          where statement_type = 'income_a' and metric_name = 'Total Revenue' and metric_value is not null),
cg_t as (select * from (select *, row_number() over (partition by ticker order by report_date desc) rn from cg_x) where rn <= 4),
cg_g as (select ticker, count(*) as n_points, arg_min(metric_value, report_date) as start_value,
           arg_max(metric_value, report_date) as end_value,
           cast(year(max(report_date)) - year(min(report_date)) as integer) as n_years from cg_t group by ticker),
cg as (select ticker, n_points, n_years, start_value, end_value,
         case when n_points >= 2 and n_years > 0 and start_value > 0
                   and not (end_value / start_value < 0 and n_years > 1)
              then pow(end_value / start_value, 1.0 / n_years) - 1 end as cagr from cg_g)"""


@register("revenue_cagr", f"with {CAGR_SQL} select * from cg", [ST], ["start_value", "end_value", "cagr"], 10)
def revenue_cagr(m):
    """3-year revenue CAGR from the annual income statements."""
    return fu.cagr(m.statements, "revenue", 3).withColumn("n_years", F.col("n_years").cast("int"))


CASH_SQL = f"""cfo as (select ticker, report_date, metric_value as cfo from {ST}
             where statement_type = 'cashflow_a' and metric_name = 'Operating Cash Flow' and metric_value is not null),
ni as (select ticker, report_date, metric_value as ni from {ST}
       where statement_type = 'income_a' and metric_name = 'Net Income' and metric_value is not null),
cm as (select c.ticker, max(c.report_date) as d, arg_max(c.cfo, c.report_date) as c_cfo, arg_max(n.ni, c.report_date) as c_ni
       from cfo c join ni n on c.ticker = n.ticker and c.report_date = n.report_date group by c.ticker),
lc as (select ticker, arg_max(cfo, report_date) as l_cfo from cfo group by ticker),
ln as (select ticker, arg_max(ni, report_date) as l_ni from ni group by ticker),
j as (select lc.ticker, cm.d, case when cm.d is not null then c_cfo else l_cfo end as c_,
        case when cm.d is not null then c_ni else l_ni end as n_
      from lc join ln on lc.ticker = ln.ticker left join cm on cm.ticker = lc.ticker),
cc as (select ticker, d as common_date, case when n_ <> 0 then c_ / n_ end as cash_conversion from j)"""


@register("cash_conversion", f"with {CASH_SQL} select * from cc", [ST], ["cash_conversion"], 10)
def cash_conversion(m):
    """operating cash flow / net income at the latest common annual date."""
    return fu.cash_conversion(m.statements)


@register("statement_16q", f"""
with st as (select * from {ST} where statement_type = 'income_q')
select ticker, metric_name, report_date, metric_value / 1e6 as value_m from st
where exists (select 1 from {_latest_dates_sql("st", 16)} d where d.ticker = st.ticker and d.report_date = st.report_date)
""", [ST], ["value_m"], 10)
def statement_16q(m):
    """quarterly income statement, latest 16 report dates per ticker, in millions."""
    return fu.statement_view(m.statements, "income", 16).drop("display")


RISK_BUCKET_SQL = ("case when predicted_default_prob * 100 is null then null when predicted_default_prob * 100 <= 10 "
                   "then 'Low' when predicted_default_prob * 100 <= 40 then 'Medium' else 'High' end")


@register("header_facts", f"""
with s as (select ticker, date_updated, price, market_cap, pe_ratio, beta, predicted_default_prob from {LATEST_SUMMARY_SQL}),
r as (select ticker, date, close, row_number() over (partition by ticker order by date desc) rn from {P}),
pc as (select ticker, max(case when rn = 1 then close end) as last_close, max(case when rn = 1 then date end) as last_date,
         max(case when rn = 2 then close end) as second_close, count(*) as n_closes from r where rn <= 2 group by ticker),
h as (select s.*, pc.last_close, pc.last_date, pc.n_closes,
        case when n_closes = 2 then second_close when n_closes = 1 then last_close else s.price end as prev_close, d.ticker as dt
      from {DIM} d left join s on s.ticker = d.ticker left join pc on pc.ticker = d.ticker)
select d.ticker, d.company_name, d.sector, d.credit_rating, s.date_updated, s.price, s.market_cap, s.pe_ratio, s.beta,
  s.predicted_default_prob, {RISK_BUCKET_SQL} as risk_bucket, s.last_date, s.last_close, s.prev_close,
  s.price - prev_close as change,
  case when s.price - prev_close is not null then
    case when prev_close <> 0 then (s.price - prev_close) / prev_close * 100 else 0.0 end end as change_pct
from {DIM} d join h s on s.dt = d.ticker
""", [SUM, P, DIM], ["price", "market_cap", "pe_ratio", "beta", "predicted_default_prob", "last_close", "prev_close",
                     "change", "change_pct"], 10)
def header_facts(m):
    """F10 (+F11): company header facts with last/previous close and daily change."""
    return fu.header_facts(m.dim, m.summary, m.prices)


@register("risk_bucket", f"""
select ticker, date_updated, predicted_default_prob, {RISK_BUCKET_SQL} as risk_bucket from {SUM}
""", [SUM], ["predicted_default_prob"], 10)
def risk_bucket(m):
    """default-probability bucket for every summary snapshot."""
    from ..functions.scalar import risk_bucket as rb
    return m.summary.select("ticker", "date_updated", "predicted_default_prob", rb("predicted_default_prob").alias("risk_bucket"))


# ======================================================================================
# Comparison tables (M8-M11), historical P/E (M12), trends
# ======================================================================================
def _health_sql() -> str:
    return f"""{_latest_metric_sql(["balance_q"], {"Total Debt": "debt", "Cash And Cash Equivalents": "cash",
                                              "Current Assets": "ca", "Current Liabilities": "cl",
                                              "Stockholders Equity": "equity"}, "hb")},
hq as (select * from {ST} where statement_type in ('income_q', 'cashflow_q', 'balance_q')),
hd as {_latest_dates_sql("(select * from hq where statement_type in ('income_q', 'cashflow_q'))", 4)},
ht as (select hd1.ticker,
         coalesce(cast(sum(case when metric_name = 'EBIT' then cast(metric_value as decimal(38,6)) end) as double),
                  cast(sum(case when metric_name = 'Operating Income' then cast(metric_value as decimal(38,6)) end) as double))
           as ebit_ttm,
         cast(sum(case when metric_name = 'Depreciation And Amortization' then cast(metric_value as decimal(38,6)) end)
           as double) as da_ttm
       from (select distinct ticker from hd) hd1
       left join (select hq.* from hq join hd on hq.ticker = hd.ticker and hq.report_date = hd.report_date) x
         on x.ticker = hd1.ticker group by hd1.ticker),
{_latest_metric_sql(["income_a"], {"EBIT": "ebit_a", "Operating Income": "opinc_a", "Interest Expense": "int_a"}, "ha")},
hj as (select coalesce(hb.ticker, ht.ticker, ha.ticker) as ticker, debt, cash, ca, cl, equity, ebit_ttm, da_ttm, ebit_a,
         opinc_a, int_a from hb full join ht on hb.ticker = ht.ticker full join ha on ha.ticker = coalesce(hb.ticker, ht.ticker)),
health as (select ticker,
    case when debt is not null and cash is not null and (ebit_ttm + da_ttm) <> 0 then (debt - cash) / (ebit_ttm + da_ttm) end
      as net_debt_to_ebitda,
    case when int_a <> 0 then abs(coalesce(ebit_a, opinc_a) / int_a) end as interest_coverage,
    ca / nullif(cl, 0) as current_ratio, debt / nullif(equity, 0) as de_ratio from hj)"""


@register("financial_health", f"with {_health_sql()} select * from health", [ST],
          ["net_debt_to_ebitda", "interest_coverage", "current_ratio", "de_ratio"], 10)
def financial_health(m):
    """Financial health table (net debt / EBITDA, interest coverage, current ratio, D/E)."""
    return mk.health(m.statements)


def _base_sql_cmp() -> str:
    return f"""{_health_sql()},
{CAGR_SQL},
snap as (select s.* exclude (rn, de_ratio), d.company_name, d.sector, {SCORING_SQL} from {LATEST_SUMMARY_SQL} s
         join {DIM} d on d.ticker = s.ticker),
cmp as (select snap.*, cg.cagr as revenue_cagr_3y, health.net_debt_to_ebitda, health.interest_coverage,
          health.current_ratio, health.de_ratio,
          'None' as consensus, cast(null as double) as target_low, cast(null as double) as target_high,
          case when analyst_target_price <> 0 and price <> 0 then (analyst_target_price / price - 1) * 100 end as upside_pct
        from snap left join cg on cg.ticker = snap.ticker left join health on health.ticker = snap.ticker)"""


def _compare(tab: str):
    cols = TABS[tab]["columns"]
    doubles = [c for c in cols if c not in ("ticker", "company_size", "consensus")]
    sql = f"with {_base_sql_cmp()} select {', '.join(cols)} from cmp"

    @register(f"compare_{tab}", sql, [ST, SUM, DIM, P], doubles, 10)
    def run(m):
        base = mk.comparison_base(m.summary, m.dim, m.statements, columns=cols)
        return mk.comparison_table(base, tab, sort_by=cols[1])

    run.__doc__ = f"M8: the {tab} comparison table over every ticker's latest snapshot."
    return run


for _tab in TABS:
    _compare(_tab)


@register("exit_multiple", f"""
with s as (select ticker, price, trailing_eps from {LATEST_SUMMARY_SQL}),
t as (select *, case when trailing_eps > 0 and price > 0 then trailing_eps * pow(1.1, 5.0) * 20.0 end as forecast_target from s)
select ticker, price, trailing_eps, forecast_target, forecast_target / price - 1 as forecast_upside,
  pow(forecast_target / price, 0.2) - 1 as forecast_irr from t
""", [SUM, P], ["price", "trailing_eps", "forecast_target", "forecast_upside", "forecast_irr"], 10)
def exit_multiple(m):
    """M9: exit-multiple forecast with the default scenario (5 years, 10 % EPS growth, PE 20)."""
    return mk.exit_multiple(mk.latest_snapshot(m.summary)).drop("scenario_id")


@register("historical_pe", f"""
with e as (select max(date) as_of from {P}),
p as (select ticker, date, close from {P}, e where date >= as_of - 1825 and date <= as_of and close is not null),
ab as (select ticker, report_date, metric_value as eps from {ST} where statement_type = 'income_a' and metric_name = 'Basic EPS'),
ad as (select ticker, report_date, metric_value as eps from {ST} where statement_type = 'income_a' and metric_name = 'Diluted EPS'
       and ticker not in (select ticker from ab)),
an as (select * from ab union all select * from ad),
qe as (select ticker, report_date, metric_value as q_eps from {ST} where statement_type = 'income_q' and metric_name = 'Basic EPS'
       and ticker not in (select ticker from an)),
qt as (select ticker, report_date, case when count(q_eps) over {FR(4, "report_date")} >= 1
         then sum(q_eps) over {FR(4, "report_date")} end as eps from qe),
steps as (select * from an union all select * from qt),
d as (select p.ticker, p.date, p.close, s.eps from p asof left join steps s on p.ticker = s.ticker and p.date >= s.report_date),
tr as (select ticker, trailing_eps from {LATEST_SUMMARY_SQL}),
o as (select d.ticker, d.date, d.close,
        case when d.ticker in (select ticker from steps) then d.eps
             else case when tr.trailing_eps <> 0 then tr.trailing_eps end end as eps
      from d left join tr on tr.ticker = d.ticker)
select *, close / nullif(eps, 0) as pe,
  case when close / nullif(eps, 0) is null then null when close / nullif(eps, 0) < 15 then 'below 15'
       when close / nullif(eps, 0) < 20 then '15-20' when close / nullif(eps, 0) < 25 then '20-25' else 'above 25' end as pe_band
from o
""", [P, ST, SUM], ["close", "eps", "pe"], 10)
def historical_pe(m):
    """Daily P/E over the last five years against step-filled EPS."""
    return mk.historical_pe(m.prices_by_month, m.statements, m.summary)


@register("financial_trends", f"""
with e as (select max(report_date) as_of from {ST}),
x as (select ticker, report_date, case when metric_name = 'Net Income Common Stock' then 'Net Income' else metric_name end m,
        metric_value from {ST}, e
      where statement_type = 'income_a' and report_date >= as_of - 1825
        and metric_name in ('Total Revenue', 'Net Income Common Stock', 'Net Income'))
select ticker, report_date, cast(year(report_date) as integer) as year,
  sum(case when m = 'Total Revenue' then metric_value end) as revenue,
  sum(case when m = 'Net Income' then metric_value end) as net_income
from x group by ticker, report_date
""", [ST], ["revenue", "net_income"], 10)
def financial_trends(m):
    """Annual revenue and net income over the last 5*365 days."""
    return mk.financial_trends(m.statements)
