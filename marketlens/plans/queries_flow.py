"""Query registrations, part 5: loads from work list to purge, profiles, series by label, EPS steps, scenarios,
scorers, article lists, benchmarks, ranked orders and texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalar as S
from ..operators import snapshot as snap
from ..operators.ordering import ranked_detail
from ..schemas import (BENCHMARK_NAMES, COMMON_BENCHMARKS, DEFAULT_SCENARIO, FACT_COMPANY_SUMMARY, FACT_NEWS_SENTIMENT,
                       SECTOR_BENCHMARKS, SERIES_LABELS, SERIES_STATEMENT, TABS)
from ..sources import ingest as ing
from ..sources import loads
from ..sources import profile as pr
from ..sources.fixtures import scratch
from ..sources.storage import PartitionTable, by_bucket, by_month, in_period, latest_date, plain
from . import fundamentals as fu
from . import market as mk
from . import news as nw
from . import rates as rt
from .queries import DIM, FR, LATEST_SUMMARY_SQL, P, ST, SUM
from .queries_ext import B, N, R, SCORE_SQL
from .queries_load import wide_statements
from .queries_more import CAGR_SQL, CASH_SQL, _base_sql_cmp
from .scoring import WordScorer, score_batches

K = "cast(substr(ticker, 2) as bigint)"


def _k():
    return F.expr(K)


def _fresh(m, name, df, layout) -> PartitionTable:
    """A table of its own whose first load is ``df``."""
    table = PartitionTable(m.spark, scratch(m.spark, name), df.schema, layout)
    table.merge(df, lambda old, new: new)
    return table


def _scalar(df: DataFrame, column: str):
    return df.select(F.max(column)).first()[0]


# ======================================================================================
# Series by label (P8, P18), profiles
# ======================================================================================
def _relabelled(m) -> DataFrame:
    """Statements in which a third of the companies report revenue as ' revenues ' and a third as 'REVENUE', and some
    have a further row 'Revenue' that only counts where nothing better is there."""
    st, k = m.statements, _k()
    revenue = (F.col("metric_name") == "Total Revenue") & (F.col("statement_type") == "income_a")
    name = F.when(revenue & (k % 3 == 1), " revenues ").when(revenue & (k % 3 == 2), "REVENUE").otherwise(F.col("metric_name"))
    extra = st.where(revenue & (k % 5 == 0)).withColumn("metric_name", F.lit("Revenue")).withColumn(
        "metric_value", F.col("metric_value") * 2)
    return st.withColumn("metric_name", name).unionByName(extra)


def _label_sql() -> str:
    rows = ", ".join(f"('{s}', '{SERIES_STATEMENT[s]}', '{n.lower()}', {i})" for s, ns in SERIES_LABELS.items() for i, n in enumerate(ns))
    return f"""
with st as (select ticker, report_date, statement_type, metric_value,
    case when metric_name = 'Total Revenue' and statement_type = 'income_a' and {K} % 3 = 1 then ' revenues '
         when metric_name = 'Total Revenue' and statement_type = 'income_a' and {K} % 3 = 2 then 'REVENUE' else metric_name end as name
  from {ST}
  union all select ticker, report_date, statement_type, metric_value * 2, 'Revenue' from {ST}
  where metric_name = 'Total Revenue' and statement_type = 'income_a' and {K} % 5 = 0),
c as (select series, kind, label, min(p) as p from (values {rows}) v(series, kind, label, p) group by series, kind, label),
j as (select st.*, c.series, c.p, min(c.p) over (partition by ticker, series) as best
      from st join c on lower(trim(st.name)) = c.label and st.statement_type = c.kind where metric_value is not null)
select ticker, series, report_date, metric_value as value, name as label from j where p = best
qualify row_number() over (partition by ticker, series, report_date order by name) = 1"""


@register("company_series", _label_sql(), [ST], ["value"], 10)
def company_series(m):
    """Annual series of every company under whatever label it reports them."""
    return fu.company_series(_relabelled(m))


def raw_profiles(m) -> DataFrame:
    """One raw profile per company from its latest snapshot: numbers as text, prices that are missing or 0, funds among
    the shares, empty logos."""
    s, k = mk.latest_snapshot(m.summary, m.dim.drop("logo_url").withColumn("logo_url", F.lit(None).cast("string"))), _k()
    text = lambda c: F.col(c).cast("string")
    rating = m.dim.select("ticker", F.col("credit_rating").alias("creditRating"))
    return s.join(rating, "ticker").select(
        "ticker", F.when(k % 10 == 0, "ETF").otherwise("EQUITY").alias("quoteType"), F.col("company_name").alias("longName"), "sector",
        F.when(k % 3 == 0, "new").otherwise("").alias("logo_url"), "creditRating",
        F.when(k % 3 == 1, "0").when(k % 3 == 2, text("price")).alias("currentPrice"),
        F.when(k % 2 == 0, F.lit(0.0)).otherwise(F.col("price") * 2).alias("regularMarketPrice"),
        (F.col("price") * 3).alias("previousClose"), text("market_cap").alias("marketCap"),
        F.when(k % 4 == 0, "NaN").otherwise(text("beta")).alias("beta"), F.col("pe_ratio").alias("trailingPE"),
        F.col("pb_ratio").alias("priceToBook"), F.when(k % 7 == 0, "n/a").otherwise(text("ev_ebitda")).alias("enterpriseToEbitda"),
        F.col("revenue_growth_yoy").alias("revenueGrowth"), F.col("net_income_growth_yoy").alias("earningsGrowth"),
        F.col("roe").alias("returnOnEquity"), (F.col("de_ratio") * 100).alias("debtToEquity"),
        F.col("operating_margin").alias("operatingMargins"), F.col("ebitda_margin").alias("ebitdaMargins"),
        F.col("trailing_eps").alias("trailingEps"), F.col("analyst_target_price").alias("targetMeanPrice"),
        (F.col("analyst_target_price") * 0.5).alias("targetLowPrice"), (F.col("analyst_target_price") * 1.5).alias("targetHighPrice"),
        F.when(k % 3 == 0, "strong_buy").when(k % 3 == 1, "hold").alias("recommendationKey"))


PROFILE_SQL = f"""pf as (select s.*, d.company_name, d.sector, d.credit_rating, cast(substr(s.ticker, 2) as bigint) as k
  from {LATEST_SUMMARY_SQL} s join {DIM} d on d.ticker = s.ticker)"""
PROFILE_PRICE = "case when k % 3 = 2 and price <> 0 then price when k % 2 = 1 and price <> 0 then price * 2 else price * 3 end"


@register("profile_dim", f"""with {PROFILE_SQL}
select ticker, company_name, case when k % 3 = 0 then 'new' else '' end as logo_url, sector, credit_rating from pf where k % 10 <> 0""",
          [SUM, DIM], [], 10)
def profile_dim(m):
    """Raw profiles to dimension rows; funds are skipped."""
    return pr.profile_dim(raw_profiles(m))


FACT_SQL = f"""{PROFILE_SQL}, {CAGR_SQL}, {CASH_SQL},
pfact as (select pf.ticker, {PROFILE_PRICE} as price, market_cap, case when k % 4 <> 0 then beta end as beta, pe_ratio, pb_ratio,
  case when k % 7 <> 0 then ev_ebitda end as ev_ebitda, revenue_growth_yoy, net_income_growth_yoy, roe, operating_margin,
  ebitda_margin, trailing_eps, analyst_target_price, de_ratio, cg.cagr as revenue_cagr_3y, cc.cash_conversion
  from (select * exclude (cash_conversion) from pf) pf left join cg on cg.ticker = pf.ticker left join cc on cc.ticker = pf.ticker where k % 10 <> 0)"""
FACT_DOUBLES = ["price", "market_cap", "beta", "pe_ratio", "pb_ratio", "ev_ebitda", "revenue_growth_yoy", "net_income_growth_yoy", "roe",
                "operating_margin", "ebitda_margin", "trailing_eps", "analyst_target_price", "de_ratio", "revenue_cagr_3y", "cash_conversion"]


@register("profile_fact", f"with {FACT_SQL} select * from pfact", [SUM, DIM, ST], FACT_DOUBLES, 10)
def profile_fact(m):
    """Raw profiles to fact rows, price by the fallback chain, growth and conversion from statements."""
    return pr.company_metrics(raw_profiles(m), m.statements, dt.date(2002, 1, 1)).select("ticker", *FACT_DOUBLES)


@register("market_cap_key", f"with {PROFILE_SQL} select ticker, market_cap from pf where k % 10 <> 0 and market_cap is not null",
          [SUM, DIM], ["market_cap"], 10)
def market_cap_key(m):
    """Market caps of shares; funds and companies without one drop out."""
    return pr.market_caps(raw_profiles(m))


@register("analyst_view", f"""with {PROFILE_SQL}, p2 as (select *, case when k % 3 = 2 and price <> 0 then price else price * 3 end as now from pf)
select ticker, case k % 3 when 0 then 'Strong Buy' when 1 then 'Hold' else 'None' end as consensus, analyst_target_price,
  analyst_target_price * 0.5 as target_low, analyst_target_price * 1.5 as target_high, now as current_price,
  case when analyst_target_price <> 0 and now <> 0 then (analyst_target_price / now - 1) * 100 end as upside_pct from p2""",
          [SUM, DIM], ["analyst_target_price", "target_low", "target_high", "current_price", "upside_pct"], 10)
def analyst_view(m):
    """Consensus, targets and upside from raw profiles."""
    return mk.analyst_from_profile(raw_profiles(m))


# ======================================================================================
# Loads: each returns the table after the load
# ======================================================================================
@register("load_prices", f"""
with e as (select max(date) as d, max(date) + 1 as today, max(date) - 364 as cutoff from {P}),
base as (select p.* from {P} p, e where date >= d - 430 and date < d - 100 and {K} % 7 <> 0),
h as (select ticker, max(date) as hwm from base group by ticker),
w as (select c.ticker, greatest(coalesce(hwm + 1, cutoff), cutoff) as start, today from {DIM} c left join h on h.ticker = c.ticker, e
      where hwm is null or today - hwm > case when isodow(today) = 1 then 3 else 1 end)
select * from base where date >= (select cutoff from e)
union all select p.* from {P} p join w on w.ticker = p.ticker
where p.date >= w.start and p.date < w.today and p.volume % 7 <> 0 and p.volume % 11 <> 0""", [P, DIM], ["open", "high", "low", "close"], 10)
def load_prices(m):
    """A price table that is 100 days behind (some tickers: empty) is brought up to date."""
    p = m.prices_by_month
    end = _scalar(p, "date")
    day = lambda n: end - dt.timedelta(days=n)
    old = plain(in_period(p, day(430), day(101))).where(_k() % 7 != 0)
    table = _fresh(m, "fact_daily_prices", old, by_month("date"))
    v, text = F.col("volume"), lambda c: F.col(c).cast("string").alias(c.capitalize())
    feed = plain(in_period(p, day(400))).select(
        "ticker", F.when(v % 11 == 0, "soon").otherwise(F.col("date").cast("string")).alias("Date"), text("open"), text("high"), text("low"),
        F.when(v % 7 == 0, "n/a").otherwise(F.col("close").cast("string")).alias("Close"), text("volume"))
    loads.load_prices(feed, table, m.dim, end + dt.timedelta(days=1))
    return plain(table.read())


@register("load_statements", f"""
with e as (select max(report_date) + 61 - 1825 as cutoff from {ST}),
base as (select * from {ST} where report_date < date '2000-01-01' and {K} % 5 <> 0),
h as (select ticker, max(report_date) as hwm from base group by ticker)
select ticker, report_date, statement_type, metric_name, metric_value from base, e where report_date >= cutoff
union all select s.ticker, s.report_date, s.statement_type, s.metric_name, s.metric_value from {ST} s left join h on h.ticker = s.ticker, e
where s.report_date >= cutoff and (hwm is null or s.report_date > hwm) and s.metric_value is not null
  and not (s.metric_name = 'Inventory' and cast(substr(s.ticker, 2) as bigint) % 3 = 0)""", [ST], ["metric_value"], 10)
def load_statements(m):
    """A statement table that ends in 1999 (some tickers: empty) is brought up to date from wide statements."""
    table = _fresh(m, "fact_financial_statements", m.statements.where((F.col("report_date") < F.lit("2000-01-01").cast("date")) & (_k() % 5 != 0)),
                   by_month("report_date"))
    dates, wide = wide_statements(m.statements)
    bad = (F.trim("metric_name") == "Inventory") & (_k() % 3 == 0)
    wide = wide.select("ticker", "statement_type", "metric_name",
                       *[F.when(bad & F.col(f"`{d}`").isNotNull(), "n.m.").otherwise(F.col(f"`{d}`")).alias(d) for d in dates])
    loads.load_statements(wide, table, m.dim, _scalar(m.statements, "report_date") + dt.timedelta(days=61))
    return plain(table.read())


def _summaries_loaded(m):
    types = {f.name: f.dataType for f in FACT_COMPANY_SUMMARY.fields}
    end = _scalar(m.summary, "date_updated")
    s = m.summary.where(F.col("date_updated") < F.lit("2001-06-01").cast("date"))
    table = _fresh(m, "fact_company_summary", s.select([(F.col(n) if n in s.columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()]),
                   by_month("date_updated"))
    stored = m.dim.where(_k() % 4 != 0).withColumn("logo_url", F.when(_k() % 2 == 0, "old"))
    dim = _fresh(m, "dim_company", stored, by_bucket("ticker"))
    loads.load_summaries(raw_profiles(m), m.statements, table, dim, m.dim, end)
    return plain(table.read()), plain(dim.read())


LOADED = ["price", "market_cap", "beta", "ev_ebitda", "de_ratio", "revenue_cagr_3y", "cash_conversion", "predicted_default_prob"]


@register("load_summaries", f"""
with {FACT_SQL},
e as (select max(date_updated) as today from {SUM}),
base as (select * from {SUM} where date_updated < date '2001-06-01'),
l as (select ticker, arg_max(predicted_default_prob, date_updated) filter (where predicted_default_prob is not null) as predicted_default_prob,
        arg_max(peer_cluster_id, date_updated) filter (where peer_cluster_id is not null) as peer_cluster_id from base group by ticker)
select ticker, date_updated, price, market_cap, beta, ev_ebitda, de_ratio, null::double as revenue_cagr_3y, cash_conversion,
  predicted_default_prob, peer_cluster_id::int as peer_cluster_id
from base, e where date_updated >= today - 1825
union all select pfact.ticker, today, price, market_cap, beta, ev_ebitda, de_ratio, revenue_cagr_3y, cash_conversion,
  l.predicted_default_prob, l.peer_cluster_id::int from pfact left join l on l.ticker = pfact.ticker, e""", [SUM, DIM, ST], LOADED, 10)
def load_summaries(m):
    """The snapshots of the day from raw profiles, model columns carried forward."""
    return _summaries_loaded(m)[0].select("ticker", "date_updated", *LOADED, "peer_cluster_id")


@register("load_companies", f"""
with {PROFILE_SQL},
n as (select ticker, company_name, case when k % 3 = 0 then 'new' else '' end as logo_url, sector, credit_rating, k from pf where k % 10 <> 0),
o as (select *, {K} as k, case when {K} % 2 = 0 then 'old' end as logo from {DIM} where {K} % 4 <> 0)
select coalesce(n.ticker, o.ticker) as ticker, coalesce(n.company_name, o.company_name) as company_name,
  case when n.ticker is not null and o.ticker is not null then coalesce(nullif(o.logo, ''), nullif(n.logo_url, ''))
       when n.ticker is not null then n.logo_url else o.logo end as logo_url,
  coalesce(n.sector, o.sector) as sector, case when n.ticker is not null then n.credit_rating else o.credit_rating end as credit_rating
from n full join o on o.ticker = n.ticker""", [SUM, DIM], [], 10)
def load_companies(m):
    """The dimension after the load of the summaries: stored logos stay, missing ones are filled."""
    return _summaries_loaded(m)[1]


@register("load_news", f"""
with e as (select max(published_at) as d, cast(max(published_at) as date) + 1 - 30 as cutoff from {N}),
base as (select * from {N}, e where published_at < d - interval 10 day
         qualify row_number() over (partition by article_url order by published_at, title) = 1),
bt as (select n.* from {N} n, e where published_at >= d - interval 20 day and published_at >= cutoff and doc_id % 7 <> 0 and title is not null
       qualify row_number() over (partition by article_url order by published_at, title) = 1),
nw as (select *, case when length(title) > 0 and length(description) > 0 then concat(title, '. ', description) end as txt from bt
       where article_url not in (select article_url from base)),
c as (select *, len([w for w in string_split_regex(lower(txt), '[^a-z]+') if w in {tuple(nw.POSITIVE_WORDS)}]) as p,
        len([w for w in string_split_regex(lower(txt), '[^a-z]+') if w in {tuple(nw.NEGATIVE_WORDS)}]) as n from nw)
select ticker, published_at, title, article_url, source_name, description, sentiment_label, null::double as sentiment_score
from base where published_at >= cutoff
union all select ticker, published_at, title, article_url, source_name, description,
  case when p > n then 'positive' when n > p then 'negative' when p = n then 'neutral' end,
  case when p + n > 0 then abs(p - n) / (p + n) when p = n then 0.0 end from c""", [N], ["sentiment_score"], 10)
def load_news(m):
    """Raw articles that overlap the stored ones; only unknown URLs are scored and added."""
    n, k = m.news, F.col("doc_id")
    end = _scalar(n, "published_at")
    old = n.where(F.col("published_at") < F.lit(end - dt.timedelta(days=10))).withColumn("sentiment_score", F.lit(None).cast("double"))
    old = snap.dedupe(old, ["article_url"], [F.col("published_at"), F.col("title")], "first").select(*FACT_NEWS_SENTIMENT.names)
    table = _fresh(m, "fact_news_sentiment", old, by_month("published_at"))
    when = F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    raw = n.where(F.col("published_at") >= F.lit(end - dt.timedelta(days=20))).select(
        "ticker", F.when(k % 7 == 0, "soon").otherwise(when).alias("publishedAt"), "title", F.col("article_url").alias("url"),
        F.struct(F.col("source_name").alias("name")).alias("source"), "description")
    loads.load_news(raw, table, end.date() + dt.timedelta(days=1), WordScorer())
    return plain(table.read())


# ======================================================================================
# Step functions (J7, M12), scenarios (V7, M9)
# ======================================================================================
def _eps_variants(m) -> DataFrame:
    """Statements in which a quarter of the companies each have quarterly Diluted EPS only, annual BasicEPS only, annual
    Diluted beside quarterly Basic EPS, and no EPS at all."""
    st, k = m.statements, _k()
    annual, quarterly = F.col("statement_type") == "income_a", F.col("statement_type") == "income_q"
    eps = st.where((F.col("metric_name") == "Basic EPS") & (annual | quarterly))
    name = (F.when((k % 4 == 0) & quarterly, "Diluted EPS").when((k % 4 == 1) & annual, "BasicEPS")
            .when((k % 4 == 2) & annual, "Diluted EPS").when((k % 4 == 2) & quarterly, "Basic EPS"))
    return st.where(F.col("metric_name") != "Basic EPS").unionByName(eps.withColumn("metric_name", name).where(F.col("metric_name").isNotNull()))


@register("historical_pe_sources", f"""
with e as (select max(date) as_of from {P}),
p as (select ticker, date, close from {P}, e where date >= as_of - 1825 and date <= as_of and close is not null),
x as (select *, {K} as k from {ST} where metric_name = 'Basic EPS' and metric_value is not null),
q as (select ticker, report_date, sum(metric_value) over {FR(4, "report_date")} as eps from x where k % 4 = 0 and statement_type = 'income_q'),
steps as (select * from q union all select ticker, report_date, metric_value from x where k % 4 in (1, 2) and statement_type = 'income_a'),
d as (select p.ticker, p.date, p.close, s.eps from p asof left join steps s on p.ticker = s.ticker and p.date >= s.report_date),
o as (select d.ticker, d.date, d.close, case when d.ticker in (select ticker from steps) then d.eps
        else nullif(t.trailing_eps, 0) end as eps from d left join {LATEST_SUMMARY_SQL} t on t.ticker = d.ticker)
select *, close / nullif(eps, 0) as pe,
  case when close / nullif(eps, 0) is null then null when close / nullif(eps, 0) < 15 then 'below 15'
       when close / nullif(eps, 0) < 20 then '15-20' when close / nullif(eps, 0) < 25 then '20-25' else 'above 25' end as pe_band
from o""", [P, ST, SUM], ["close", "eps", "pe"], 10)
def historical_pe_sources(m):
    """P/E of companies whose EPS comes from each of the sources."""
    return mk.historical_pe(m.prices_by_month, _eps_variants(m), m.summary)


@register("exit_multiple_scenarios", f"""
with sc as (select n_nationkey::int as scenario_id, 3 + n_nationkey % 5 as years, case when n_nationkey % 3 = 0 then {DEFAULT_SCENARIO['eps_growth']}
              else n_nationkey::double end as growth, 10.0 + n_nationkey as pe from nation),
sel as (select s_nationkey::int as scenario_id, concat('S', s_suppkey) as ticker from supplier
        union all select 0, concat('S', s_suppkey) from supplier where s_nationkey <> 0),
t as (select s.ticker, sc.*, s.price, s.trailing_eps, case when trailing_eps > 0 and price > 0
        then trailing_eps * pow(1 + growth / 100.0, years::double) * pe end as forecast_target
      from {LATEST_SUMMARY_SQL} s join sel on sel.ticker = s.ticker join sc on sc.scenario_id = sel.scenario_id)
select ticker, scenario_id, price, trailing_eps, forecast_target, forecast_target / price - 1 as forecast_upside,
  pow(forecast_target / price, 1.0 / years) - 1 as forecast_irr from t""", [SUM],
          ["price", "trailing_eps", "forecast_target", "forecast_upside", "forecast_irr"], 10)
def exit_multiple_scenarios(m):
    """V7/M9: a scenario per nation, for its own companies, and that of nation 0 for all of them."""
    key = F.col("n_nationkey")
    scenarios = m.table("nation").select(
        key.cast("int").alias("scenario_id"), (3 + key % 5).cast("int").alias("forecast_years"),
        F.when(key % 3 != 0, key.cast("double")).alias("eps_growth"), (10.0 + key).alias("terminal_pe"))
    s = m.table("supplier").select(F.col("s_nationkey").cast("int").alias("scenario_id"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    chosen = s.unionByName(s.where("scenario_id <> 0").withColumn("scenario_id", F.lit(0)))
    return mk.exit_multiple(mk.latest_snapshot(m.summary), scenarios, chosen)


# ======================================================================================
# News (N2, A14/N5), benchmarks (P16), series status (B5), orders (O3, O4), texts (FMT1-FMT4), ticker lists
# ======================================================================================
@register("score_batches", f"select *, null::varchar as failure from ({SCORE_SQL}) q", [N], ["sentiment_score"], 10)
def score_with_scorer(m):
    """Unlabelled articles in batches through a scorer object in the Python workers."""
    return score_batches(m.news, WordScorer())


def _day_sql(key: str, per_row: int) -> str:
    return f"""
with r as (select {key}, cast(published_at as date) as day, article_url, published_at,
  row_number() over (partition by {key}, cast(published_at as date) order by published_at desc, article_url, title) as n,
  count(*) over (partition by {key}, cast(published_at as date)) as n_day from {N})
select {key}, day, ((n - 1) // {per_row})::int as page, any_value(n_day)::int as n_day, count(*)::int as n_articles,
  string_agg(article_url, ' ' order by n) as urls, max(published_at) as newest from r group by {key}, day, page"""


def _days(key: str, per_row: int):
    def run(m):
        pages = nw.articles_by_day(m.news, per_row, key)
        return pages.select(key, "day", "page", F.col("n_day").cast("int"), "n_articles",
                            F.array_join(F.col("articles.article_url"), " ").alias("urls"),
                            F.array_max(F.col("articles.published_at")).alias("newest"))

    run.__doc__ = f"A14/N5: articles per {key} and day, newest first, in lists of at most {per_row}."
    return run


register("news_day_articles", _day_sql("ticker", 50), [N], [], 10)(_days("ticker", 50))
register("news_day_sources", _day_sql("source_name", 3), [N], [], 10)(_days("source_name", 3))

# Sectors of the derived companies: region -> sector (one without benchmarks).
REGION_SECTORS = {"AFRICA": "Energy", "AMERICA": "Technology", "ASIA": "Consumer Cyclical", "EUROPE": "Financials", "MIDDLE EAST": "Other"}
SECTOR_CASE = "case sector " + " ".join(f"when '{k}' then '{v}'" for k, v in REGION_SECTORS.items()) + " end"


@register("relevant_benchmarks", f"""
with sel as (select c_custkey % 100 as user_id, concat('S', c_custkey % (select count(*) from supplier)) as ticker from customer),
map as (select * from (values {", ".join(f"('{s}', '{i}')" for s, ii in SECTOR_BENCHMARKS.items() for i in ii)}) v(sector, value)),
u as (select distinct user_id, value from sel join (select ticker, {SECTOR_CASE} as sector from {DIM}) d on d.ticker = sel.ticker
        join map on map.sector = d.sector
      union select user_id, value from (select distinct user_id from sel), (values {", ".join(f"('{i}')" for i in COMMON_BENCHMARKS)}) c(value)),
names as (select * from (values {", ".join(f"('{k}', '{v}')" for k, v in BENCHMARK_NAMES.items())}) v(value, label))
select user_id, u.value, coalesce(label, u.value) as label from u left join names on names.value = u.value
where not (u.value = '^NDX' and user_id % 2 = 0) and not (u.value = 'XLE' and user_id % 5 = 0)""", [DIM], [], 10)
def relevant_benchmarks(m):
    """Benchmarks that each user's tickers suggest, without those chosen already."""
    n = m.table("supplier").select(F.count(F.lit(1))).scalar()
    user = F.col("c_custkey") % 100
    c = m.table("customer").select(user.alias("user_id"), F.concat(F.lit("S"), (F.col("c_custkey") % n).cast("string")).alias("ticker"))
    chosen = c.select("user_id", F.when(F.col("user_id") % 2 == 0, "^NDX").alias("symbol")).unionByName(
        c.select("user_id", F.when(F.col("user_id") % 5 == 0, "XLE").alias("symbol"))).where("symbol is not null")
    sector = F.create_map(*[x for k, v in REGION_SECTORS.items() for x in (F.lit(k), F.lit(v))])[F.col("sector")]
    return ing.relevant_benchmarks(c, m.dim.withColumn("sector", sector), chosen)


@register("rate_series", f"""select w.ticker, r.date, r.close, case when r.date is null then '{rt.NO_SERIES}' else 'ok' end as status
from (values ('^TNX'), ('^MOVE')) w(ticker) left join {R} r on r.ticker = w.ticker""", [R], ["close"], 10)
def rate_series(m):
    """Single series, and a status for one that the table does not have."""
    return rt.series(m.rates, ["^TNX", "^MOVE"])


def _ranked(tab: str, column: str, falling: bool):
    cols = TABS[tab]["columns"]
    order = f"{column} {'desc' if falling else 'asc'} nulls last, ticker"
    doubles = [c for c in cols if c not in ("ticker", "company_size", "consensus")]

    @register(f"ranked_{tab}", f"with {_base_sql_cmp()} select {', '.join(cols)}, row_number() over (order by {order}) as place from cmp",
              [ST, SUM, DIM, P], doubles, 10)
    def run(m):
        return mk.ranked_table(mk.comparison_base(m.summary, m.dim, m.statements, columns=cols), tab, column)

    run.__doc__ = f"O3: the {tab} table with each row's place by {column}."


_ranked("valuation", "ev_ebitda", False)
_ranked("growth", "revenue_growth_yoy", True)


@register("ranked_bonds", f"""select ticker, issuer, coupon, ytm, row_number() over (order by ytm desc nulls last, ticker) as place
from {B}""", [B], ["coupon", "ytm"], 10)
def ranked_bonds(m):
    """Bonds by yield, always descending, with each row's place."""
    return ranked_detail(rt.bond_detail(m.bonds, "credit").drop("par_status"), "ytm")


def _money(x: str, unit: str) -> str:
    return f"'$' || format('{{:,.2f}}', {x}) || '{unit}'"


@register("display_texts", f"""
with s as (select *, price - pe_ratio as change, (price - pe_ratio) / nullif(pe_ratio, 0) * 100 as pct from {LATEST_SUMMARY_SQL})
select ticker,
  case when market_cap is null then '-' when abs(market_cap) >= 1e9 then {_money("market_cap / 1e9", "B")}
       else {_money("market_cap / 1e6", "M")} end as cap_text,
  case when market_cap is null then null when abs(market_cap) >= 1e12 then {_money("market_cap / 1e12", "T")}
       when abs(market_cap) >= 1e9 then {_money("market_cap / 1e9", "B")} when abs(market_cap) >= 1e6 then {_money("market_cap / 1e6", "M")}
       else format('{{:,.2f}}', market_cap) end as cap_card,
  case when roe is null then null when abs(roe) >= 1e6 then 'large' else format('{{:.2f}}', roe * 100) || '%' end as roe_card,
  case when pe_ratio is null then null when abs(pe_ratio) >= 1e6 then 'large' else format('{{:,.2f}}', pe_ratio) end as pe_card,
  case when trailing_eps is null then '-' else format('{{:,.2f}}', trailing_eps / 1e6) || 'M' end as eps_millions,
  coalesce(case when change >= 0 then '+' else '' end || format('{{:,.2f}}', change) || ' (' || case when change >= 0 then '+' else '' end
    || format('{{:.2f}}', pct) || '%)', 'N/A') as change_text
from s""", [SUM], [], 10)
def display_texts(m):
    """FMT1-FMT4: market cap, metric cards, statement millions and signed change as text."""
    s = mk.latest_snapshot(m.summary)
    change = F.col("price") - F.col("pe_ratio")
    return s.select("ticker", S.fmt_market_cap("market_cap").alias("cap_text"), S.fmt_metric("market_cap", "Market Cap").alias("cap_card"),
                    S.fmt_metric("roe", "ROE").alias("roe_card"), S.fmt_metric("pe_ratio", "P/E").alias("pe_card"),
                    S.fmt_millions("trailing_eps").alias("eps_millions"),
                    S.fmt_change(change, change / F.nullif(F.col("pe_ratio"), F.lit(0.0)) * 100).alias("change_text"))


@register("listed_drawdown", f"""
with e as (select max(date) d from {P}),
p as (select ticker, date, close from {P}, e where date >= d - 365 and close is not null
      and ticker in (select ticker from {SUM} where pe_ratio < 20))
select ticker, max(close) as peak, min(close / m - 1) as worst from
  (select *, max(close) over (partition by ticker order by date rows between unbounded preceding and current row) as m from p)
group by ticker""", [P, SUM], ["peak", "worst"], 10)
def listed_drawdown(m):
    """The worst drawdown of the year of the tickers on a list, which is a relation of any size."""
    p = m.prices_by_month
    listed = m.summary.where("pe_ratio < 20").select("ticker")
    rows = in_period(p, F.date_sub(latest_date(p), 365)).where("close is not null").join(listed, "ticker", "left_semi")
    from ..operators import timeseries as ts

    return (rows.withColumn("_d", F.col("close") / ts.cummax("close") - 1).groupBy("ticker")
            .agg(F.max("close").alias("peak"), F.min("_d").alias("worst")))
