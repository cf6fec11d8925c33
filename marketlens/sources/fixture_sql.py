"""SQL text of the fixture views (FIXTURES.md section 2).

Used verbatim as CTEs by the DuckDB oracle statements.  The Spark side builds the same
tables with the DataFrame API in `fixtures.py` (an independent formulation).
"""

FIXTURE_SQL = {}

FIXTURE_SQL["fact_daily_prices"] = """
with t as (
  select concat('S', cast(l_suppkey as string)) ticker, cast(l_shipdate as date) date,
    l_extendedprice / l_quantity px, l_quantity q,
    row_number() over (partition by l_suppkey, l_shipdate order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) rn,
    count(*) over (partition by l_suppkey, l_shipdate) n
  from lineitem)
select ticker, date, max(case when rn = 1 then px end) open, max(px) high, min(px) low,
  max(case when rn = n then px end) close, cast(sum(q) as bigint) volume
from t group by ticker, date
"""

FIXTURE_SQL["fin_q"] = """
with t as (
  select concat('S', cast(l_suppkey as string)) ticker,
    last_day(date_trunc('quarter', l_shipdate) + interval 2 month) report_date,
    cast(l_extendedprice as decimal(18,4)) ext,
    cast(l_extendedprice * (1 - l_discount) as decimal(18,4)) net,
    cast(l_extendedprice * l_tax as decimal(18,4)) tax,
    cast(l_extendedprice * l_discount as decimal(18,4)) disc,
    l_returnflag rf, l_linestatus ls
  from lineitem)
select ticker, report_date, cast(substr(ticker, 2) as int) k,
  cast(sum(net) as double) revenue,
  cast(sum(case when rf = 'A' then net else 0 end) as double) cost_of_revenue,
  cast(sum(case when rf = 'A' then 0 else net end) - sum(case when rf = 'R' then net else 0 end) - sum(tax) as double) ebit,
  cast(sum(case when rf = 'N' then net else 0 end) - sum(case when rf = 'R' then net else 0 end) as double) net_income,
  cast(sum(tax) as double) interest_expense,
  cast(sum(case when ls = 'F' then net else -tax end) as double) ocf,
  cast(sum(disc) as double) d_and_a,
  cast(sum(case when rf = 'R' then tax else 0 end) as double) capex,
  cast(sum(case when rf = 'N' then tax else 0 end) as double) income_tax,
  cast(sum(case when rf = 'N' then net else 0 end) as double) pretax_income,
  cast(sum(ext) as double) total_assets,
  cast(sum(case when ls = 'O' then ext else 0 end) as double) current_assets,
  cast(sum(case when rf = 'R' then ext else 0 end) as double) current_liabilities,
  cast(sum(case when rf = 'R' or (rf = 'A' and ls = 'F') then ext else 0 end) as double) total_liabilities,
  cast(sum(case when rf = 'N' or (rf = 'A' and ls = 'O') then ext else 0 end) as double) equity,
  cast(sum(case when ls = 'O' and rf = 'A' then ext else 0 end) as double) inventory,
  cast(sum(case when ls = 'O' and rf = 'N' then ext else 0 end) as double) accounts_receivable,
  cast(sum(case when ls = 'F' and rf = 'A' then ext else 0 end) as double) accounts_payable,
  cast(sum(case when ls = 'F' and rf = 'N' then ext else 0 end) as double) cash,
  cast(sum(case when ls = 'F' and rf = 'R' then ext else 0 end) as double) total_debt
from t group by ticker, report_date
"""

FIXTURE_SQL["fact_financial_statements"] = """
with q as (
  select f.ticker, f.report_date, m.statement_type,
    case when m.metric_name = 'EBIT' and k % 2 = 1 then 'Operating Income' else m.metric_name end metric_name,
    case m.metric_name when 'Total Revenue' then revenue when 'Cost Of Revenue' then cost_of_revenue when 'EBIT' then ebit
      when 'Net Income' then net_income when 'Interest Expense' then interest_expense when 'Income Tax Expense' then income_tax
      when 'Income Before Tax' then pretax_income when 'Basic EPS' then net_income / 1000000.0
      when 'Total Assets' then total_assets when 'Current Assets' then current_assets when 'Current Liabilities' then current_liabilities
      when 'Total Liabilities' then total_liabilities when 'Stockholders Equity' then equity when 'Inventory' then inventory
      when 'Accounts Receivable' then accounts_receivable when 'Accounts Payable' then accounts_payable
      when 'Cash And Cash Equivalents' then cash when 'Total Debt' then total_debt
      when 'Operating Cash Flow' then ocf when 'Depreciation And Amortization' then d_and_a when 'Capital Expenditure' then capex end metric_value
  from fin_q f cross join (values
    ('income_q','Total Revenue'),('income_q','Cost Of Revenue'),('income_q','EBIT'),('income_q','Net Income'),('income_q','Interest Expense'),
    ('income_q','Income Tax Expense'),('income_q','Income Before Tax'),('income_q','Basic EPS'),
    ('balance_q','Total Assets'),('balance_q','Current Assets'),('balance_q','Current Liabilities'),('balance_q','Total Liabilities'),
    ('balance_q','Stockholders Equity'),('balance_q','Inventory'),('balance_q','Accounts Receivable'),('balance_q','Accounts Payable'),
    ('balance_q','Cash And Cash Equivalents'),('balance_q','Total Debt'),
    ('cashflow_q','Operating Cash Flow'),('cashflow_q','Depreciation And Amortization'),('cashflow_q','Capital Expenditure')
  ) m(statement_type, metric_name))
select ticker, report_date, statement_type, metric_name, metric_value from q
union all
select ticker, max(report_date), replace(statement_type, '_q', '_a'), metric_name,
  case when statement_type = 'balance_q' then max(case when month(report_date) = 12 then metric_value end) else cast(sum(cast(metric_value as decimal(20,4))) as double) end
from q group by ticker, year(report_date), statement_type, metric_name having count(*) = 4
"""

FIXTURE_SQL["dim_company"] = """
select concat('S', cast(s_suppkey as string)) ticker, s_name company_name, cast(null as string) logo_url, r_name sector,
  case when s_acctbal < 0 then null when s_acctbal < 3000 then 'BBB' when s_acctbal < 7000 then 'A' else 'AA' end credit_rating
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

FIXTURE_SQL["fact_company_summary"] = """
with p as (
  select ticker, last_day(date_trunc('quarter', date) + interval 2 month) report_date, close,
    row_number() over (partition by ticker, date_trunc('quarter', date) order by date desc) rn
  from fact_daily_prices),
b as (
  select f.*, p.close price, 1000000.0 * (1 + k % 7) * (1 + k % 7) * (1 + k % 7) * (1 + k % 7) shares,
    lag(revenue, 4) over (partition by f.ticker order by f.report_date) rev4,
    lag(net_income, 4) over (partition by f.ticker order by f.report_date) ni4
  from fin_q f left join p on p.ticker = f.ticker and p.report_date = f.report_date and p.rn = 1)
select ticker, report_date date_updated, price, price * shares market_cap,
  case when k % 12 = 11 then null else cast(0.25 * (k % 12) as double) end beta,
  case when net_income > 0 then price / (net_income / 10000.0) end pe_ratio,
  price * shares / nullif(equity * 1000.0, 0) pb_ratio,
  case when k % 13 = 0 then null else cast(2.0 + (k * 7) % 40 as double) end ev_ebitda,
  revenue / nullif(rev4, 0) - 1 revenue_growth_yoy, net_income / nullif(ni4, 0) - 1 net_income_growth_yoy,
  net_income / nullif(equity, 0) roe, total_debt / nullif(equity, 0) de_ratio,
  ebit / nullif(revenue, 0) operating_margin, ocf / nullif(net_income, 0) cash_conversion,
  (ebit + d_and_a) / nullif(revenue, 0) ebitda_margin, net_income / 10000.0 trailing_eps,
  price * (0.8 + 0.05 * (k % 9)) analyst_target_price,
  case when month(report_date) = 6 then k % 5 end peer_cluster_id,
  case when month(report_date) = 12 then cast((k % 100) / 100.0 as double) end predicted_default_prob
from b
"""

FIXTURE_SQL["fact_news_sentiment"] = """
select concat('S', cast(d.doc_id % (select count(*) from supplier) as string)) ticker, d.doc_id,
  timestamp '2024-01-01 00:00:00' + interval '1' hour * cast(d.doc_id as int) published_at,
  substr(d.text, 1, 80) title, concat('doc://', md5(d.text)) article_url, d.source source_name, substr(d.text, 81) description,
  case when toxic = 1 then 'negative' when quality = 1 then 'positive' when quality = 0 then 'neutral' end sentiment_label
from documents d left join labels l on d.doc_id = l.doc_id
"""

FIXTURE_SQL["fact_rates"] = """
select cast(l_shipdate as date) date,
  case l_linenumber when 1 then '^IRX' when 2 then '^STIX' when 3 then '^GTII' when 4 then '^TWS' when 5 then '^FVX' when 6 then '^TNX' else '^TYX' end ticker,
  round(1 + 100 * cast(sum(cast(l_tax as decimal(18,4))) as double) / count(*), 6) close
from lineitem group by 1, 2
"""

FIXTURE_SQL["bond_detail"] = """
with s as (
  select l_partkey, cast(sum(cast(l_tax as decimal(18,4))) as double) / count(l_tax) tax,
    cast(sum(cast(l_discount as decimal(18,4))) as double) / count(l_discount) disc,
    cast(sum(cast(l_quantity as decimal(18,4))) as double) / count(l_quantity) qty
  from lineitem group by l_partkey),
t as (select p_partkey, p_brand, p_size, p_retailprice / 7 - 36 dirty_price, tax, disc, qty from part left join s on l_partkey = p_partkey)
select concat('B', cast(p_partkey as string)) ticker, p_brand issuer, dirty_price, cast(p_size as double) / 25 accrued,
  cast(dirty_price * (1.0 + disc - tax) as double) intrinsic_value, cast(p_size as double) / 10 + 1 coupon,
  cast(100 * tax + 1 as double) ytm, qty / 4 duration
from t
"""


# dependency order of the views
ORDER = ["fact_daily_prices", "fin_q", "fact_financial_statements", "dim_company",
         "fact_company_summary", "fact_news_sentiment", "fact_rates", "bond_detail"]

DEPS = {
    "fact_daily_prices": [],
    "fin_q": [],
    "fact_financial_statements": ["fin_q"],
    "dim_company": [],
    "fact_company_summary": ["fact_daily_prices", "fin_q"],
    "fact_news_sentiment": [],
    "fact_rates": [],
    "bond_detail": [],
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for the named fixture views (and their dependencies)."""
    need = set()

    def add(n):
        for d in DEPS[n]:
            add(d)
        need.add(n)

    for n in names:
        add(n)
    ctes = [f"{n} as ({FIXTURE_SQL[n].strip()})" for n in ORDER if n in need]
    body = body.strip()
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body
