"""Query registrations, part 4: loaders, work lists, views and choices over the given tables.

Raw loader inputs are made from the given tables (numbers as text, some of them unreadable)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import snapshot as snap
from ..sources import ingest as ing
from . import fundamentals as fu
from . import rates as rt
from .queries import DIM, LATEST_SUMMARY_SQL, P, ST, SUM

N = "fact_news_sentiment"
B = "bond_detail"


@register("sort_key", f"select ticker, ev_ebitda, date_updated from {LATEST_SUMMARY_SQL} where ev_ebitda is not null", [SUM],
          ["ev_ebitda"], 10)
def sort_key(m):
    """The sort metric in each ticker's latest snapshot; tickers without it there drop out."""
    return snap.sort_key(m.summary.select("ticker", "ev_ebitda", "date_updated"), "ev_ebitda")


@register("price_normalise", f"""
select ticker, date, open, high, low, close, case when volume % 5 = 0 then 0 else volume end as volume
from {P} where volume % 7 <> 0""", [P], ["open", "high", "low", "close"], 10)
def price_normalise(m):
    """Price rows as text, with unreadable closes (dropped) and NaN volumes (0)."""
    v = F.col("volume")
    text = lambda c: F.col(c).cast("string").alias(c.capitalize())
    raw = m.prices.select("ticker", text("date"), text("open"), text("high"), text("low"),
                          F.when(v % 7 == 0, "n/a").otherwise(F.col("close").cast("string")).alias("Close"),
                          F.when(v % 5 == 0, "NaN").otherwise(v.cast("string")).alias("Volume"))
    return ing.normalise_prices(raw)


def wide_statements(statements):
    """Every statement as a wide row per metric, one text column per report date of the table (a bounded list),
    names with a blank in front: one pivot over one scan."""
    dates = sorted(str(r[0]) for r in statements.select("report_date").distinct().collect())
    name = F.concat(F.lit(" "), "metric_name").alias("metric_name")
    return dates, statements.groupBy("ticker", "statement_type", name).pivot("report_date", dates).agg(
        F.max(F.col("metric_value").cast("string")))


@register("statement_unpivot_all", f"""
select ticker, report_date, statement_type, metric_name, metric_value from {ST}
where report_date >= date '1995-06-01' and metric_value is not null""", [ST], ["metric_value"], 10)
def statement_unpivot_all(m):
    """S3: wide statements of every type, one text column per report date of the table, to long rows from a cutoff."""
    dates, wide = wide_statements(m.statements)
    return ing.unpivot_statements(wide, dates, None, cutoff="1995-06-01")


@register("article_load", f"""
select ticker, published_at, title, article_url, source_name, description from {N}
where doc_id % 5 <> 0 and doc_id % 7 <> 0 and title is not null and article_url is not null""", [N], [], 10)
def article_load(m):
    """Raw articles with ISO-8601 times; missing titles and unreadable times are dropped."""
    d = F.col("doc_id")
    when = F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    raw = m.news.select("ticker", F.when(d % 7 == 0, "soon").otherwise(when).alias("publishedAt"),
                        F.when(d % 5 != 0, F.col("title")).alias("title"), F.col("article_url").alias("url"),
                        F.struct(F.col("source_name").alias("name")).alias("source"), "description")
    return ing.normalise_articles(raw)


@register("keep_logo", f"""
with s as (select *, cast(substr(ticker, 2) as bigint) as k from {DIM})
select ticker, case when k % 3 = 0 then 'renamed' else company_name end as company_name,
  case when k % 6 = 0 and k % 3 = 0 then 'new' when k % 6 <> 0 then 'logo of ' || ticker end as logo_url from s""", [DIM], [], 10)
def keep_logo(m):
    """Every third company is fetched anew with another name and logo; half of those have a logo, which stays."""
    k = F.expr("cast(substr(ticker, 2) as bigint)")
    stored = m.dim.select("ticker", "company_name", F.when(k % 6 != 0, F.concat(F.lit("logo of "), "ticker")).alias("logo_url"))
    new = stored.where(k % 3 == 0).select("ticker", F.lit("renamed").alias("company_name"), F.lit("new").alias("logo_url"))
    return ing.upsert_keep_logo(stored, new)


@register("summary_worklist", f"""
with h as (select ticker, max(date_updated) hwm from {SUM} group by ticker)
select d.ticker, h.hwm from {DIM} d left join h on h.ticker = d.ticker
where h.hwm is null or h.hwm <> (select max(date_updated) from {SUM})""", [SUM, DIM], [], 10)
def summary_worklist(m):
    """Tickers whose summary is not of the latest day."""
    hwm = ing.high_water_mark(m.summary, "date_updated")
    return ing.summary_worklist(m.dim, hwm, m.summary.select(F.max("date_updated")).scalar())


@register("statement_worklist", f"""
with h as (select ticker, max(report_date) hwm from {ST} group by ticker),
e as (select max(report_date) + 61 as today from {ST})
select d.ticker, h.hwm from {DIM} d left join h on h.ticker = d.ticker, e where h.hwm is null or e.today - h.hwm > 60""",
          [ST, DIM], [], 10)
def statement_worklist(m):
    """Tickers whose latest report is more than 60 days old, 61 days after the last one."""
    hwm = ing.high_water_mark(m.statements, "report_date")
    return ing.statement_worklist(m.dim, hwm, F.date_add(m.statements.select(F.max("report_date")).scalar(), 61))


@register("two_tier_values", f"""
select ticker, coalesce(ev_ebitda, pe_ratio) as ev_ebitda from {LATEST_SUMMARY_SQL}
where coalesce(ev_ebitda, pe_ratio) is not null""", [SUM], ["ev_ebitda"], 10)
def two_tier_values(m):
    """A metric from the first source, else from the second (here: the P/E ratio)."""
    s = snap.latest(m.summary.select("ticker", "date_updated", "ev_ebitda", "pe_ratio"))
    return ing.two_tier_values(s.select("ticker", "ev_ebitda"), s.select("ticker", F.col("pe_ratio").alias("ev_ebitda")), "ev_ebitda")


# Columns of a wide price row.
WIDE = 100


@register("wide_to_long_all", f"select date, ticker, close from {P} where close is not null", [P], ["close"], 10)
def wide_to_long_all(m):
    """The price matrix of all tickers, in blocks of WIDE columns per date, to rows."""
    n = F.expr("cast(substr(ticker, 2) as bigint)")
    rows = m.prices.select("date", F.floor(n / WIDE).alias("block"), (n % WIDE).alias("slot"), "close")
    # one aggregate, before the shuffle as well: pivot() would first make a group of every single close
    wide = rows.groupBy("date", "block").agg(*[F.max(F.when(F.col("slot") == i, F.col("close"))).alias(str(i)) for i in range(WIDE)])
    wide = wide.select(F.struct("date", "block").alias("key"), *map(str, range(WIDE)))
    ticker = F.concat(F.lit("S"), F.col("key.block") * WIDE + F.col("ticker").cast("bigint"))
    return ing.wide_to_long(wide, "key").select("key.date", ticker.alias("ticker"), "close")


@register("rejects", f"""
select ticker, date, case when not coalesce(volume > 10, false) then 'thin' else 'wide range' end as reason
from {P} where not coalesce(volume > 10, false) or not coalesce(high <= low * 1.5, false)""", [P], [], 10)
def rejects(m):
    """Rows that break a rule, with the first rule they break."""
    rules = {"thin": F.col("volume") > 10, "wide range": F.col("high") <= F.col("low") * 1.5}
    return ing.split_rejects(m.prices, rules)[1].select("ticker", "date", "reason")


@register("price_history", f"""
with e as (select max(date) d from {P}), h as (select ticker, max(date) hwm from {P} group by ticker)
select p.ticker, p.date, case when e.d - h.hwm <= 3 then p.close else p.open end as close,
  case when e.d - h.hwm <= 3 then 'primary' else 'secondary' end as source
from {P} p join h on h.ticker = p.ticker, e where p.date >= date_trunc('year', e.d)""", [P], ["close"], 10)
def price_history(m):
    """Year-to-date closes of every ticker with the source of each."""
    p = m.prices_by_month
    return ing.price_history(p, p.withColumn("close", F.col("open")), period="ytd")


@register("freshness", f"""
with h as (select ticker, max(date) hwm from {P} group by ticker)
select count(*) as n_tickers, count(*) filter (where (select max(date) from {P}) - hwm <= 3) as n_fresh from h""", [P], [], 10)
def freshness(m):
    """Tickers, and those with prices of the last three days."""
    return ing.freshness(m.prices)


@register("symbol_options", f"""
select ticker, coalesce(nullif(company_name, '') || ' (' || ticker || ')', ticker) as label from {DIM}
where ticker not in ('S1', 'S2')""", [DIM], [], 10)
def symbol_options(m):
    """Symbols left to choose, with labels."""
    return ing.symbol_options(m.dim, None, ["S1", "S2"])


def _view_sql(kind: str) -> str:
    return f"""
with s as (select * from {ST} where statement_type = '{kind}_q'),
d as (select ticker, report_date from (select ticker, report_date, dense_rank() over (partition by ticker order by report_date desc) r
      from (select distinct ticker, report_date from s)) where r <= 16)
select s.ticker, s.metric_name, s.report_date, s.metric_value / 1e6 as value_m
from s join d on d.ticker = s.ticker and d.report_date = s.report_date"""


def _view(kind):
    def run(m):
        return fu.statement_view(m.statements, kind).drop("display")

    run.__doc__ = f"F9: the latest 16 quarters of the {kind} statement."
    return run


for _kind in ("balance", "cashflow"):
    register(f"statement_16q_{_kind}", _view_sql(_kind), [ST], ["value_m"], 10)(_view(_kind))

PAR_SQL = "case when dirty_price > 105 then 'Premium' when dirty_price < 95 then 'Discount' else 'Par' end"


@register("bond_credit", f"select ticker, issuer, coupon, ytm, {PAR_SQL} as par_status from {B}", [B], ["coupon", "ytm"], 10)
def bond_credit(m):
    """Credit view."""
    return rt.bond_detail(m.bonds, "credit")


@register("bond_risk", f"select ticker, issuer, duration, ytm from {B}", [B], ["duration", "ytm"], 10)
def bond_risk(m):
    """Risk view."""
    return rt.bond_detail(m.bonds, "risk")
