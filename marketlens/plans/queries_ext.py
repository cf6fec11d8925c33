"""Query registrations, part 3: Monte Carlo valuation, rates and bonds, news, incremental
loading, tick bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..schemas import MATURITY_YEARS
from ..sources import ingest as ing
from ..sources.storage import in_period, latest_date, plain
from ..streaming import streams as stx
from . import fundamentals as fu
from . import news as nw
from . import rates as rt
from . import valuation as va
from .queries import FR, LATEST_SUMMARY_SQL, P, ST, SUM, W
from .queries_more import CAGR_SQL, MONEY5, _dcf_sql
from .scenarios import scenario_rows

R = "fact_rates"
N = "fact_news_sentiment"
B = "bond_detail"
# Two scenarios: the default one and a cautious one with fewer draws.
SCENARIOS = [{}, {"scenario_id": 2, "sims": 2000, "growth_min": 0.0, "growth_mode": 2.0, "growth_max": 4.0}]


# ======================================================================================
# Monte Carlo DCF (V1-V7)
# ======================================================================================
def _d(x: float) -> str:
    return f"{float(x)!r}::double"


def _tri_sql(u: str, p: str) -> str:
    lo, mo, hi = (f"{p}_{s}" for s in ("min", "mode", "max"))
    span = f"({hi} - {lo})"
    fc = f"(case when {span} > 0 then ({mo} - {lo}) / {span} else 0.0 end)"
    return (f"case when {u} < {fc} then {lo} + sqrt({u} * {span} * ({mo} - {lo})) "
            f"else {hi} - sqrt((1 - {u}) * {span} * ({hi} - {mo})) end")


def _scenario_sql() -> str:
    names = [f"{p}_{x}" for p in ("growth", "perpetual", "wacc") for x in ("min", "mode", "max")]
    rows = ", ".join(f"({s['scenario_id']}, {s['sims']}, " + ", ".join(_d(s[n] / 100.0) for n in names) + ")"
                     for s in scenario_rows(SCENARIOS))
    return f"sc as (select * from (values {rows}) v(scenario_id, sims, {', '.join(names)}))"


def _u_sql(slot: int) -> str:
    return f"(cast(('0x' || substr(h, {1 + 13 * slot}, 13)) as bigint)::double / 4503599627370496.0)"


def _values_sql() -> str:
    terms, f, d = [], "base_fcff", "1.0"
    fs, ds = [], []
    for t in range(1, 6):
        f = f"f{t}"
        fs.append(f"{'base_fcff' if t == 1 else f'f{t - 1}'} * (1 + growth) as f{t}")
        ds.append(f"{'1.0' if t == 1 else f'd{t - 1}'} * (1 + wacc) as d{t}")
        terms.append(f"f{t} / d{t}")
    steps = []
    for t in range(5):
        steps.append(f"s{t + 1} as (select *, {fs[t]}, {ds[t]} from s{t})")
    return f"""dcf as ({_dcf_sql("ticker, base_fcff, net_debt, shares_outstanding, price")}),
b as (select * from dcf where status = 'ok'),
{_scenario_sql()},
dr as (select b.ticker, b.base_fcff, b.net_debt, b.shares_outstanding, b.price, sc.*, unnest(range(0, sc.sims)) as draw from b, sc),
dh as (select *, sha256(concat_ws('|', ticker, cast(scenario_id as varchar), cast(draw as varchar))) as h from dr),
tr as (select *, {_tri_sql(_u_sql(0), 'growth')} as growth, {_tri_sql(_u_sql(1), 'perpetual')} as perpetual,
         {_tri_sql(_u_sql(2), 'wacc')} as wacc from dh),
s0 as (select * from tr where wacc > perpetual),
{", ".join(steps)},
tv as (select *, f5 * (1 + perpetual) / (wacc - perpetual) as tv0 from s5),
iv as (select ticker, scenario_id, draw, price, growth, perpetual, wacc,
         (({" + ".join(terms)}) + (case when tv0 < 0 then 0.0 else tv0 end) / d5 - net_debt) / shares_outstanding
           as intrinsic_value from tv),
ivf as (select * from iv where intrinsic_value is not null and not isnan(intrinsic_value) and not isinf(intrinsic_value))"""


def _mc_base(m):
    return fu.dcf_base(m.statements, m.summary)


SUMMARY_SQL = f"""mcv as (select ticker, scenario_id, avg(intrinsic_value) as mean, quantile_cont(intrinsic_value, 0.5) as median,
  quantile_cont(intrinsic_value, 0.1) as p10, quantile_cont(intrinsic_value, 0.9) as p90, count(*) as n_valid
  from ivf group by ticker, scenario_id),
mcs as (select d.ticker, sc.scenario_id, case when d.status = 'ok' and n_valid is null then '{va.NO_VALUE}' else d.status end as status,
  mean, median, p10, p90, coalesce(n_valid, 0) as n_valid, d.price as current_price
  from dcf d cross join sc left join mcv on mcv.ticker = d.ticker and mcv.scenario_id = sc.scenario_id)"""


@register("mc_summary", f"with {_values_sql()}, {SUMMARY_SQL} select * from mcs", [ST, SUM],
          ["mean", "median", "p10", "p90", "current_price"], 10)
def mc_summary(m):
    """V1-V4, V7: mean, median, p10, p90 and count of finite simulated values per ticker and scenario,
    with a status row where there is none."""
    return va.monte_carlo_dcf(_mc_base(m), SCENARIOS)


@register("margin_of_safety", f"""with {_values_sql()}, {SUMMARY_SQL}
select ticker, scenario_id, status, current_price, mean as intrinsic_value, (mean - current_price) / nullif(mean, 0) as margin_of_safety,
  case when mean > current_price then 'undervalued' when mean <= current_price then 'overvalued' end as verdict from mcs""", [ST, SUM],
          ["current_price", "intrinsic_value", "margin_of_safety"], 10)
def margin_of_safety(m):
    """V5: mean intrinsic value against the current price, per scenario."""
    return va.margin_of_safety(va.monte_carlo_dcf(_mc_base(m), SCENARIOS))


@register("mc_histogram", f"""with {_values_sql()},
rg as (select ticker, scenario_id, min(intrinsic_value) lo, max(intrinsic_value) hi from ivf group by ticker, scenario_id),
x as (select ivf.ticker, ivf.scenario_id, lo, hi, cast(case when hi - lo > 0
        then least(floor((intrinsic_value - lo) / (hi - lo) * 100) + 1, 100) else 1 end as integer) as bin
      from ivf join rg on ivf.ticker = rg.ticker and ivf.scenario_id = rg.scenario_id)
select ticker, scenario_id, bin, count(*) as n, any_value(lo) + (bin - 1) * (any_value(hi) - any_value(lo)) / 100 as bin_start
from x group by ticker, scenario_id, bin""", [ST, SUM], ["bin_start"], 10)
def mc_histogram(m):
    """V6: 100-bin histogram of the simulated values per ticker and scenario."""
    return va.histogram(_mc_base(m), SCENARIOS)


# ======================================================================================
# Rates and bonds
# ======================================================================================
NAME_CASE = "case ticker " + " ".join(f"when '{k}' then '{v}'" for k, v in rt.RATE_NAMES.items()) + " else ticker end"


@register("rate_changes", f"""
select date, ticker, close, lag(close, 1) over ({W()}) as previous_close,
  (close - lag(close, 5) over ({W()})) * 10000.0 as weekly_change,
  close - first_value(close ignore nulls) over ({W()} rows between unbounded preceding and unbounded following) as ytd_change
from {R}""", [R], ["close", "previous_close", "weekly_change", "ytd_change"], 10, colplaces={"weekly_change": 3,
                                                                                             "ytd_change": 7})
def rate_changes(m):
    """B1: previous close, weekly (5-row) change x10000, change since the first value."""
    return rt.rate_changes(m.rates)


@register("cumulative_change", f"""
with d0 as (select min(date) d0 from {R}),
base as (select r.ticker, r.close as base from {R} r, d0 where r.date = d0.d0)
select r.date, r.ticker, r.close / b.base - 1 as cumulative_change, {NAME_CASE.replace("ticker", "r.ticker")} as display_name
from {R} r left join base b on b.ticker = r.ticker""", [R], ["cumulative_change"], 10)
def cumulative_change(m):
    """B2: cumulative change against the first date, with display names."""
    return rt.cumulative_change(m.rates)


@register("yield_curve", f"""
with e as (select max(date) d from {R}),
tg as (select 'Today' as period, d as target from e union all select 'Last Week', d - 7 from e
       union all select 'Last Month', d - 30 from e union all select 'Last Year', d - 365 from e),
x as (select tg.period, tg.target, r.ticker, r.date, r.close,
        row_number() over (partition by r.ticker, tg.period order by abs(r.date - tg.target), r.date) rn
      from {R} r, tg where r.ticker in ({", ".join(f"'{t}'" for t in MATURITY_YEARS)}))
select period, ticker, date, close,
  case ticker {" ".join(f"when '{k}' then {v!r}" for k, v in MATURITY_YEARS.items())} end as maturity_years
from x where rn = 1""", [R], ["close", "maturity_years"], 10)
def yield_curve(m):
    """Yield curve today, a week, a month and a year ago (nearest row per maturity)."""
    return rt.yield_curve(m.rates)


@register("yield_spread", f"""
select s.date, s.ticker, (s.close - b.close) * 100.0 as spread,
  {NAME_CASE.replace("ticker", "s.ticker")} || ' - ' || '{rt.RATE_NAMES["^TNX"]}' as spread_name
from {R} s join (select date, close from {R} where ticker = '^TNX' and close is not null) b on s.date = b.date
where s.ticker <> '^TNX' and s.close is not null""", [R], ["spread"], 10, colplaces={"spread": 4})
def yield_spread(m):
    """Spread of every series against the 10-year benchmark, in basis points."""
    return rt.spread(m.rates, "^TNX")


@register("bond_status", f"""
select ticker, issuer, dirty_price - accrued as clean_price, accrued, dirty_price, intrinsic_value,
  (intrinsic_value / dirty_price - 1) * 100 as valuation_spread_pct,
  case when dirty_price > 105 then 'Premium' when dirty_price < 95 then 'Discount' else 'Par' end as par_status
from {B}""", [B], ["clean_price", "accrued", "dirty_price", "intrinsic_value", "valuation_spread_pct"], 10, colplaces={"valuation_spread_pct": 8})
def bond_status(m):
    """PAR status, clean price and valuation spread (pricing view)."""
    return rt.bond_detail(m.bonds, "pricing")


# ======================================================================================
# News (N1-N6)
# ======================================================================================
NEWS_COLS = "ticker, doc_id, published_at, title, article_url, source_name, description, sentiment_label"


@register("news_recent", f"""
select {NEWS_COLS} from (select *, row_number() over (partition by ticker order by published_at desc, article_url) rn
  from {N} where published_at >= (select max(published_at) from {N}) - interval 7 day) where rn <= 20""", [N], [], 10)
def news_recent(m):
    """Last 7 days of news, newest 20 per ticker."""
    return nw.recent(m.news)


SENT_SQL = f"""
with g as (select ticker, count(*) as n_articles, count(lower(sentiment_label)) as n_labelled,
  count(*) filter (where lower(sentiment_label) = 'positive') as n_positive,
  count(*) filter (where lower(sentiment_label) = 'neutral') as n_neutral,
  count(*) filter (where lower(sentiment_label) = 'negative') as n_negative from {N} group by ticker)
select *, coalesce(100.0 * n_positive / nullif(n_labelled, 0), 0.0) as pct_positive,
  coalesce(100.0 * n_neutral / nullif(n_labelled, 0), 0.0) as pct_neutral,
  coalesce(100.0 * n_negative / nullif(n_labelled, 0), 0.0) as pct_negative from g"""


@register("sentiment_summary", SENT_SQL, [N], ["pct_positive", "pct_neutral", "pct_negative"], 10)
def sentiment_summary(m):
    """Sentiment counts and percentages of labelled articles per ticker."""
    return nw.sentiment_summary(m.news)


@register("news_by_day", f"""
select ticker, cast(published_at as date) as day, count(*) as n_articles,
  count(*) filter (where lower(sentiment_label) = 'positive') as n_positive,
  count(*) filter (where lower(sentiment_label) = 'neutral') as n_neutral,
  count(*) filter (where lower(sentiment_label) = 'negative') as n_negative, max(published_at) as latest_published
from {N} group by ticker, cast(published_at as date)""", [N], [], 10)
def news_by_day(m):
    """Articles per ticker and calendar day."""
    return nw.news_by_day(m.news)


def _word_list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


SCORE_SQL = f"""
with t as (select *, case when sentiment_label is null and length(title) > 0 and length(description) > 0
                     then concat(title, '. ', description) end as txt from {N}),
c as (select *, len([w for w in string_split_regex(lower(txt), '[^a-z]+') if w in {_word_list(nw.POSITIVE_WORDS)}]) as p,
        len([w for w in string_split_regex(lower(txt), '[^a-z]+') if w in {_word_list(nw.NEGATIVE_WORDS)}]) as n from t)
select {NEWS_COLS.replace("sentiment_label", "")}
  coalesce(sentiment_label, case when p > n then 'positive' when n > p then 'negative' when p = n then 'neutral' end) as sentiment_label,
  case when sentiment_label is null then case when p + n > 0 then abs(p - n) / (p + n) when p = n then 0.0 end end as sentiment_score,
  sentiment_label is null and txt is not null as scored
from c"""


@register("score_articles", SCORE_SQL, [N], ["sentiment_score"], 10)
def score_articles(m):
    """Whole model text and local lexicon scoring of the unlabelled articles; labels kept."""
    return nw.score_articles(m.news)


# ======================================================================================
# Incremental loading
# ======================================================================================
@register("upsert_prices", f"""
with e as (select max(date) d from {P})
select ticker, date, open, high, low, case when date >= (select d from e) - 30 then open else close end as close, volume
from {P}""", [P], ["open", "high", "low", "close"], 10)
def upsert_prices(m):
    """A restated feed for the last 30 days (close := open) merged on (ticker, date) into the table by month:
    the months of the feed are read and written, the others stay where they are."""
    p = m.prices_by_month
    feed = in_period(p, F.date_sub(latest_date(p), 30)).withColumn("close", F.col("open"))
    table = m.incremental("fact_daily_prices")
    table.merge(plain(feed), lambda old, new: ing.upsert(old, new, ["ticker", "date"]))
    return plain(table.read())


@register("upsert_protected", f"""
with e as (select max(date_updated) d from {SUM}),
u as (select * from {SUM} where date_updated >= (select d from e) - 200)
select t.ticker, t.date_updated, case when u.ticker is not null then u.analyst_target_price else t.price end as price,
  t.market_cap, t.peer_cluster_id, t.predicted_default_prob
from {SUM} t left join u on u.ticker = t.ticker and u.date_updated = t.date_updated""", [SUM],
          ["price", "market_cap", "predicted_default_prob"], 10)
def upsert_protected(m):
    """Re-fetched snapshots of the last 200 days (new price, no model columns) upserted;
    peer_cluster_id and predicted_default_prob keep the stored values."""
    cols = ["ticker", "date_updated", "price", "market_cap", "peer_cluster_id", "predicted_default_prob"]
    sm = m.summary_by_month
    feed = plain(in_period(sm, F.date_sub(latest_date(sm, "date_updated"), 200), on="date_updated"))
    feed = (feed.withColumn("price", F.col("analyst_target_price")).withColumn("peer_cluster_id", F.lit(None).cast("long"))
            .withColumn("predicted_default_prob", F.lit(None).cast("double")))
    table = m.incremental("fact_company_summary")
    table.merge(feed, lambda old, new: ing.upsert_protected(old, new, ["ticker", "date_updated"]))
    return table.read().select(*cols)


@register("insert_if_absent", f"""
with e as (select max(published_at) d from {N}),
tg as (select article_url, ticker, published_at, doc_id from (select *, row_number() over
         (partition by article_url order by published_at, doc_id) rn from {N} where published_at < (select d from e) - interval 10 day)
       where rn = 1),
bt as (select article_url, ticker, published_at, doc_id from (select *, row_number() over
         (partition by article_url order by published_at, doc_id) rn from {N} where published_at >= (select d from e) - interval 20 day)
       where rn = 1)
select * from tg union all select * from bt where article_url not in (select article_url from tg)""", [N], [], 10)
def insert_if_absent(m):
    """URL-unique store; a batch overlapping the stored articles inserts only new URLs."""
    n = m.news.select("article_url", "ticker", "published_at", "doc_id")
    end = n.select(F.max("published_at")).scalar()
    order = [F.col("published_at"), F.col("doc_id")]
    stored = ing.insert_if_absent(n.limit(0), n.where(F.col("published_at") < end - F.expr("INTERVAL 10 DAYS")),
                                  ["article_url"], order)
    batch = n.where(F.col("published_at") >= end - F.expr("INTERVAL 20 DAYS"))
    return ing.insert_if_absent(stored, batch, ["article_url"], order)


@register("retention_purge", f"""
select * from {P} where date >= (select max(date) from {P}) - 365""", [P], ["open", "high", "low", "close"], 10)
def retention_purge(m):
    """Keep 365 days of prices."""
    return plain(ing.retention(m.prices_by_month, "date", 365))


@register("high_water_mark", f"select ticker, max(date) as hwm from {P} group by ticker", [P], [], 10)
def high_water_mark(m):
    """Latest stored date per ticker."""
    return ing.high_water_mark(m.prices)


@register("gap_fill_worklist", f"""
with e as (select max(date) + 7 as today from {P}),
h as (select ticker, max(date) hwm from {P} group by ticker),
j as (select d.ticker, h.hwm, e.today from dim_company d left join h on h.ticker = d.ticker, e),
k as (select ticker, hwm, today, greatest(coalesce(hwm + 1, today - 365), today - 365) as start from j
      where hwm is null or (today - hwm) > case when isodow(today) = 1 then 3 else 1 end)
select ticker, start, today as "end", hwm from k where start < today""", [P, "dim_company"], [], 10)
def gap_fill_worklist(m):
    """(ticker, start, end) price fetch list for a run a week after the last stored day."""
    today = F.date_add(m.prices.select(F.max("date")).scalar(), 7)
    return ing.price_worklist(m.dim, ing.high_water_mark(m.prices), today)


CORE = ["S1", "S2", "S3", "S4", "S5"]


@register("universe_topn", f"""
with {CAGR_SQL},
top as (select ticker from cg where cagr is not null order by cagr desc, ticker limit 10)
select distinct ticker from (select ticker from top union all select * from (values {", ".join(f"('{t}')" for t in CORE)}) v(ticker))
""", [ST], [], 10)
def universe_topn(m):
    """The 10 tickers with the highest revenue CAGR plus the fixed core tickers."""
    return ing.universe_topn(fu.cagr(m.statements, "revenue", 3), 10, CORE)


@register("two_tier_prices", f"""
with e as (select max(date) d from {P}),
h as (select ticker, max(date) hwm from {P} group by ticker),
fresh as (select ticker from h, e where e.d - h.hwm <= 3)
select date, ticker, open, high, low, close, volume, 'primary' as source from {P} where ticker in (select ticker from fresh)
union all
select date, ticker, open, high, low, open as close, volume, 'secondary' as source from {P}
where ticker not in (select ticker from fresh)""", [P], ["open", "high", "low", "close"], 10)
def two_tier_prices(m):
    """Fresh tickers (last row within 3 days of the latest date) from the primary table,
    the rest from a secondary table (here: the open prints as closes)."""
    p = m.prices_by_month
    out = ing.two_tier_prices(p, p.withColumn("close", F.col("open")))
    return out.select("date", "ticker", "open", "high", "low", "close", "volume", "source")


@register("carry_forward", f"""
select ticker, date_updated,
  last_value(predicted_default_prob ignore nulls) over ({W("date_updated")} rows between unbounded preceding and current row)
    as predicted_default_prob,
  last_value(peer_cluster_id ignore nulls) over ({W("date_updated")} rows between unbounded preceding and current row)
    as peer_cluster_id
from {SUM}""", [SUM], ["predicted_default_prob"], 10)
def carry_forward(m):
    """Each snapshot carries the last non-null default probability and cluster id."""
    s = m.summary.select("ticker", "date_updated", "predicted_default_prob", "peer_cluster_id")
    return ing.carry_forward(s)


def _alias_case() -> str:
    from ..schemas import METRIC_ALIASES
    return "case metric_name " + " ".join(f"when '{n}' then '{c}'" for c, ns in METRIC_ALIASES.items() for n in ns) + " end"


@register("alias_normalise", f"""
select ticker, report_date, statement_type, metric_name, coalesce({_alias_case()}, metric_name) as canonical, metric_value
from {ST}""", [ST], ["metric_value"], 10)
def alias_normalise(m):
    """All statement rows with their canonical metric name (synonyms resolved, others as they are)."""
    return fu.normalise(m.statements).select("ticker", "report_date", "statement_type", "metric_name", "canonical",
                                             "metric_value")


# ======================================================================================
# Tick bars (ST3, batch form over the events table)
# ======================================================================================
@register("tick_bars", f"""
with t as (select concat('S', cast(user_id % (select count(*) from supplier) as varchar)) as ticker,
             cast(ts as date) as day, ts, event_id, value as price from events where value is not null)
select ticker, day, arg_min(price, (ts, event_id)) as open, max(price) as high, min(price) as low,
  arg_max(price, (ts, event_id)) as close, count(*) as n_ticks from t group by ticker, day""", [], ["open", "high", "low", "close"], 10)
def tick_bars(m):
    """ST3 (batch): daily OHLC bars per ticker from the event stream."""
    return stx.ticks_to_bars(stx.ticks(m.table("events"), m.table("supplier")))
