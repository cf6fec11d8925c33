"""Market tables derived from the driver's TPC-H-style test data (FIXTURES.md section 2).

Each builder is a DataFrame formulation of the matching SQL block in `fixture_sql.py`; the
two are independent statements of the same table and are checked against each other.  All
builders read only the columns they need (column pruning reaches the Parquet scan) and
aggregate with partial (map-side) aggregation before the single shuffle on their key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STATEMENT_METRICS
from ..session import checkpoint_dir
from .storage import Layout, PartitionTable, by_month, plain, write_table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ticker(key: Column) -> Column:
    return F.concat(F.lit("S"), key.cast("string"))


def quarter_end(d: Column) -> Column:
    """Last day of the calendar quarter holding date ``d``."""
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def _dec(c: Column, p: int = 18) -> Column:
    return c.cast(f"decimal({p},4)")


def daily_prices(lineitem: DataFrame) -> DataFrame:
    """fact_daily_prices: one OHLCV bar per (ticker, date).

    open/close are the price of the first/last line in (orderkey, linenumber, partkey,
    extendedprice, quantity) order, computed with min_by/max_by.  An order of five columns makes that an
    aggregate over sorted rows, and a supplier has about one line a day, so nothing would be saved by a first
    aggregate before the shuffle: that one would sort every scan task's whole share of the line items and spill
    it.  The lines are dealt out by (supplier, date) as they are read and sorted once, in shuffle partitions of
    the advised size.
    """
    li = lineitem.select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey",
                         "l_extendedprice", "l_quantity").repartition("l_suppkey", "date")
    li = li.select(
        "l_suppkey",
        "date",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("q"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("ord"),
    )
    bars = li.groupBy("l_suppkey", "date").agg(
        F.min_by("px", "ord").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"),
        F.sum("q").cast("bigint").alias("volume"),
    )
    return bars.select(_ticker(F.col("l_suppkey")).alias("ticker"), "date", "open", "high", "low", "close", "volume")


def _net(c_ext, c_disc):
    return _dec(c_ext * (1 - c_disc))


def quarterly_financials(lineitem: DataFrame) -> DataFrame:
    """fin_q: one row of 21 quarterly metrics per (ticker, quarter end).  Money sums are exact
    decimals, cast to double at the end, so the result does not depend on row order."""
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    ext = _dec(F.col("l_extendedprice"))
    net = _net(F.col("l_extendedprice"), F.col("l_discount"))
    tax = _dec(F.col("l_extendedprice") * F.col("l_tax"))
    disc = _dec(F.col("l_extendedprice") * F.col("l_discount"))
    t = lineitem.select(
        "l_suppkey",
        quarter_end(F.to_date("l_shipdate")).alias("report_date"),
        ext.alias("ext"), net.alias("net"), tax.alias("tax"), disc.alias("disc"),
        rf.alias("rf"), ls.alias("ls"))
    rf, ls = F.col("rf"), F.col("ls")
    ext, net, tax, disc = F.col("ext"), F.col("net"), F.col("tax"), F.col("disc")

    def s(cond, v, other=0):
        return F.sum(F.when(cond, v).otherwise(other))

    def d(c):
        return c.cast("double")

    agg = t.groupBy("l_suppkey", "report_date").agg(
        d(F.sum(net)).alias("revenue"),
        d(s(rf == "A", net)).alias("cost_of_revenue"),
        d(s(rf == "A", 0, net) - s(rf == "R", net) - F.sum(tax)).alias("ebit"),
        d(s(rf == "N", net) - s(rf == "R", net)).alias("net_income"),
        d(F.sum(tax)).alias("interest_expense"),
        d(F.sum(F.when(ls == "F", net).otherwise(-tax))).alias("ocf"),
        d(F.sum(disc)).alias("d_and_a"),
        d(s(rf == "R", tax)).alias("capex"),
        d(s(rf == "N", tax)).alias("income_tax"),
        d(s(rf == "N", net)).alias("pretax_income"),
        d(F.sum(ext)).alias("total_assets"),
        d(s(ls == "O", ext)).alias("current_assets"),
        d(s(rf == "R", ext)).alias("current_liabilities"),
        d(s((rf == "R") | ((rf == "A") & (ls == "F")), ext)).alias("total_liabilities"),
        d(s((rf == "N") | ((rf == "A") & (ls == "O")), ext)).alias("equity"),
        d(s((ls == "O") & (rf == "A"), ext)).alias("inventory"),
        d(s((ls == "O") & (rf == "N"), ext)).alias("accounts_receivable"),
        d(s((ls == "F") & (rf == "A"), ext)).alias("accounts_payable"),
        d(s((ls == "F") & (rf == "N"), ext)).alias("cash"),
        d(s((ls == "F") & (rf == "R"), ext)).alias("total_debt"),
    )
    cols = [c for c in agg.columns if c not in ("l_suppkey", "report_date")]
    return agg.select(_ticker(F.col("l_suppkey")).alias("ticker"), "report_date",
                      F.col("l_suppkey").cast("int").alias("k"), *cols)


def financial_statements(fin_q: DataFrame) -> DataFrame:
    """fact_financial_statements in long (EAV) form: quarterly rows, plus annual rows on the
    Q4 date for complete years.  Odd tickers report EBIT under the synonym 'Operating Income'.

    The wide quarterly row is unpivoted (no join).  The annual rows are one aggregate of the wide rows, which has a
    group per ticker and year, and are unpivoted after it: in long form there would be a group for each of the
    21 metrics, keyed by text.
    """
    src = fin_q.withColumn("basic_eps", F.expr("net_income / 1000000.0"))
    year = F.year("report_date")
    wide = src.groupBy("ticker", "k", year.alias("y")).agg(F.max("report_date").alias("report_date"), F.count(F.lit(1)).alias("n"), *[
        F.max(F.when(F.month("report_date") == 12, F.col(c))).alias(c) if st == "balance_q"
        else F.sum(F.col(c).cast("decimal(20,4)")).cast("double").alias(c) for st, _, c in STATEMENT_METRICS])
    annual = _long(wide.where(F.col("n") == 4).drop("n", "y"))
    annual = annual.withColumn("statement_type", F.regexp_replace("statement_type", "_q", "_a"))
    return _long(src).unionByName(annual)


def _long(wide: DataFrame) -> DataFrame:
    """(ticker, report_date, statement_type, metric_name, metric_value) of rows with a column per statement metric."""
    long = wide.unpivot(["ticker", "report_date", "k"], [c for _, _, c in STATEMENT_METRICS], "src_col", "metric_value")
    stype = F.create_map(*[x for st, _, c in STATEMENT_METRICS for x in (F.lit(c), F.lit(st))])
    mname = F.create_map(*[x for _, m, c in STATEMENT_METRICS for x in (F.lit(c), F.lit(m))])
    name = mname[F.col("src_col")]
    return long.select(
        "ticker", "report_date",
        stype[F.col("src_col")].alias("statement_type"),
        F.when((name == "EBIT") & (F.col("k") % 2 == 1), F.lit("Operating Income")).otherwise(name).alias("metric_name"),
        "metric_value")


def company_dim(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """dim_company.  nation (25 rows) and region (5 rows) are fixed-size TPC-H tables, so
    broadcasting them is bounded regardless of scale."""
    nr = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    acct = F.col("s_acctbal")
    return (supplier.join(F.broadcast(nr), supplier.s_nationkey == nr.n_nationkey)
            .select(_ticker(F.col("s_suppkey")).alias("ticker"),
                    F.col("s_name").alias("company_name"),
                    F.lit(None).cast("string").alias("logo_url"),
                    F.col("r_name").alias("sector"),
                    F.when(acct < 0, F.lit(None)).when(acct < 3000, "BBB").when(acct < 7000, "A")
                    .otherwise("AA").alias("credit_rating")))


def company_summary(fin_q: DataFrame, prices: DataFrame) -> DataFrame:
    """fact_company_summary: one snapshot per (ticker, quarter end)."""
    from pyspark.sql import Window as W

    last_close = (prices.groupBy("ticker", quarter_end(F.col("date")).alias("report_date"))
                  .agg(F.max_by("close", "date").alias("price")))
    w = W.partitionBy("ticker").orderBy("report_date")
    k = F.col("k")
    b = (fin_q.join(last_close, ["ticker", "report_date"], "left")
         .withColumn("shares", F.expr("1000000.0 * (1 + k % 7) * (1 + k % 7) * (1 + k % 7) * (1 + k % 7)"))
         .withColumn("rev4", F.lag("revenue", 4).over(w))
         .withColumn("ni4", F.lag("net_income", 4).over(w)))

    def div(a, b_):
        return a / F.nullif(b_, F.lit(0))

    price, ni = F.col("price"), F.col("net_income")
    return b.select(
        "ticker", F.col("report_date").alias("date_updated"), "price",
        (price * F.col("shares")).alias("market_cap"),
        F.expr("case when k % 12 = 11 then null else cast(0.25 * (k % 12) as double) end").alias("beta"),
        F.expr("case when net_income > 0 then price / (net_income / 10000.0) end").alias("pe_ratio"),
        F.expr("price * shares / nullif(equity * 1000.0, 0)").alias("pb_ratio"),
        F.expr("case when k % 13 = 0 then null else cast(2.0 + (k * 7) % 40 as double) end").alias("ev_ebitda"),
        (div(F.col("revenue"), F.col("rev4")) - 1).alias("revenue_growth_yoy"),
        (div(ni, F.col("ni4")) - 1).alias("net_income_growth_yoy"),
        div(ni, F.col("equity")).alias("roe"),
        div(F.col("total_debt"), F.col("equity")).alias("de_ratio"),
        div(F.col("ebit"), F.col("revenue")).alias("operating_margin"),
        div(F.col("ocf"), ni).alias("cash_conversion"),
        div(F.col("ebit") + F.col("d_and_a"), F.col("revenue")).alias("ebitda_margin"),
        F.expr("net_income / 10000.0").alias("trailing_eps"),
        (price * F.expr("0.8 + 0.05 * (k % 9)")).alias("analyst_target_price"),
        F.when(F.month("report_date") == 6, k % 5).alias("peer_cluster_id"),
        F.expr("case when month(report_date) = 12 then cast((k % 100) / 100.0 as double) end").alias("predicted_default_prob"),
    )


def news(documents: DataFrame, labels: DataFrame, supplier: DataFrame) -> DataFrame:
    """fact_news_sentiment; the article URL is the md5 of the text, so copies share it."""
    n_sup = supplier.select(F.count(F.lit(1))).scalar()
    lab = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive") \
        .when(F.col("quality") == 0, "neutral")
    d = documents.select("doc_id", "text", "source")
    return (d.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
            .select(_ticker(F.col("doc_id") % n_sup).alias("ticker"), "doc_id",
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("published_at"),
                    F.substring("text", 1, 80).alias("title"),
                    F.concat(F.lit("doc://"), F.md5("text")).alias("article_url"),
                    F.col("source").alias("source_name"),
                    F.expr("substr(text, 81)").alias("description"),
                    lab.alias("sentiment_label")))


# Line number -> rate instrument (seven maturities of the yield curve).
RATE_TICKERS = ["^IRX", "^STIX", "^GTII", "^TWS", "^FVX", "^TNX", "^TYX"]


def rates(lineitem: DataFrame) -> DataFrame:
    """fact_rates (date, ticker, close): one yield series per line number."""
    ln = F.col("l_linenumber")
    tk = F.when(ln == 1, RATE_TICKERS[0])
    for i in range(2, 7):
        tk = tk.when(ln == i, RATE_TICKERS[i - 1])
    tk = tk.otherwise(RATE_TICKERS[6])
    g = (lineitem.select(F.to_date("l_shipdate").alias("date"), tk.alias("ticker"),
                         F.col("l_tax").cast("decimal(18,4)").alias("tax"))
         .groupBy("date", "ticker")
         .agg(F.sum("tax").alias("s"), F.count(F.lit(1)).alias("n")))
    return g.select("date", "ticker", F.expr("round(1 + 100 * cast(s as double) / n, 6)").alias("close"))


def bonds(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """bond_detail: one bond per part, its figures from the part's price, size and sales (null without sales)."""
    def avg(c):
        return F.sum(F.col(c).cast("decimal(18,4)")).cast("double") / F.count(c)

    sold = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        avg("l_tax").alias("tax"), avg("l_discount").alias("disc"), avg("l_quantity").alias("qty"))
    t = part.select("p_partkey", "p_brand", (F.col("p_retailprice") / 7 - 36).alias("dirty_price"), "p_size").join(sold, "p_partkey", "left")
    return t.select(
        F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_brand").alias("issuer"), "dirty_price",
        F.expr("cast(p_size as double) / 25").alias("accrued"), F.expr("dirty_price * (1.0 + disc - tax)").cast("double").alias("intrinsic_value"),
        F.expr("cast(p_size as double) / 10 + 1").alias("coupon"), F.expr("100 * tax + 1").cast("double").alias("ytm"),
        F.expr("qty / 4").alias("duration"))


# Tables written by this process: (application, input directory, table) -> path.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def materialize(spark: SparkSession, build, sf_dir: str, name: str, layout: Layout | None = None) -> str:
    """Write a derived table once per application into the shared checkpoint folder; its path.

    Every application writes to a fresh folder, so neither changed inputs nor changed code can be
    answered from old tables, and no job reads a table that another is still writing."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = scratch(spark, f"warehouse/{name}")
        write_table(layout.add(build()) if layout else build(), path, layout.names if layout else ())
        _WRITTEN[key] = path
    return _WRITTEN[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}/{name}"


@dataclass
class Market:
    """Market tables derived from one test-data directory.

    With ``stored=True`` every derived table is written once per application to the shared checkpoint
    folder (``spark.checkpoint.dir``) and read back, as the warehouse would hold it: queries then scan
    Parquet with pushed filters and pruned columns instead of re-deriving from line items.
    """

    spark: SparkSession
    sf_dir: str
    stored: bool = False

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _t(self, name: str, build) -> DataFrame:
        return self.spark.read.parquet(materialize(self.spark, build, self.sf_dir, name)) if self.stored else build()

    def _monthly(self, name: str, build, layout: Layout) -> DataFrame:
        if not self.stored:
            return layout.add(build())
        return self.spark.read.parquet(materialize(self.spark, build, self.sf_dir, name, layout))

    def incremental(self, name: str) -> PartitionTable:
        """A table of its own for loads (a fresh root) whose first state is the stored table ``name``."""
        df, layout = {"fact_daily_prices": (self.prices_by_month, by_month("date")),
                      "fact_company_summary": (self.summary_by_month, by_month("date_updated"))}[name]
        base = materialize(self.spark, lambda: plain(df), self.sf_dir, name, layout)
        return PartitionTable(self.spark, scratch(self.spark, name), plain(df).schema, layout, base)

    @cached_property
    def prices_by_month(self) -> DataFrame:
        """Prices with their partition columns, for reads that cover a period."""
        return self._monthly("fact_daily_prices", lambda: daily_prices(self.table("lineitem")), by_month("date"))

    @cached_property
    def prices(self) -> DataFrame:
        return plain(self.prices_by_month)

    @cached_property
    def fin_q(self) -> DataFrame:
        return self._t("fin_q", lambda: quarterly_financials(self.table("lineitem")))

    @cached_property
    def statements(self) -> DataFrame:
        return self._t("fact_financial_statements", lambda: financial_statements(self.fin_q))

    @cached_property
    def dim(self) -> DataFrame:
        return self._t("dim_company", lambda: company_dim(self.table("supplier"), self.table("nation"),
                                                          self.table("region")))

    @cached_property
    def summary_by_month(self) -> DataFrame:
        return self._monthly("fact_company_summary", lambda: company_summary(self.fin_q, self.prices), by_month("date_updated"))

    @cached_property
    def summary(self) -> DataFrame:
        return plain(self.summary_by_month)

    @cached_property
    def news(self) -> DataFrame:
        return self._t("fact_news_sentiment", lambda: news(self.table("documents"), self.table("labels"),
                                                           self.table("supplier")))

    @cached_property
    def rates(self) -> DataFrame:
        return self._t("fact_rates", lambda: rates(self.table("lineitem")))

    @cached_property
    def bonds(self) -> DataFrame:
        return self._t("bond_detail", lambda: bonds(self.table("part"), self.table("lineitem")))


def market(spark: SparkSession, sf_dir: str, stored: bool = False) -> Market:
    return Market(spark, sf_dir, stored)
