"""Incremental loading (S2-S22): normalisers, keyed upserts, retention, high-water marks,
work lists, universe selection, two-tier reads and rejects.

The functions here return DataFrames; ``storage`` writes them by partition and ``loads`` puts them
together.  A per-ticker retry loop becomes Spark's task retries plus a rejects DataFrame (S22).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import snapshot as snap
from ..functions import scalar as S
from ..schemas import BENCHMARK_NAMES, COMMON_BENCHMARKS, SECTOR_BENCHMARKS
from .storage import MONTH, YEAR, in_period, latest_date, plain


# ---- normalisers ----------------------------------------------------------------------------
def normalise_prices(raw: DataFrame, ticker: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rename OHLCV, cast (bad values and NaN closes -> null), volume null -> 0, drop rows without
    close, ticker or date.  ``keep``: further columns to hand on."""
    cols = {c.lower(): c for c in raw.columns}
    tk = F.col(cols["ticker"]) if "ticker" in cols else F.lit(ticker)

    def num(name):
        return F.expr(f"try_cast(`{cols[name]}` as double)") if name in cols else F.lit(None).cast("double")

    vol = F.expr(f"try_cast(`{cols['volume']}` as double)") if "volume" in cols else F.lit(None)
    out = raw.withColumn("_v", vol.cast("double")).select(tk.cast("string").alias("ticker"),
                     F.expr(f"try_cast(`{cols['date']}` as date)").alias("date"),
                     num("open").alias("open"), num("high").alias("high"), num("low").alias("low"),
                     F.nanvl(num("close"), F.lit(None).cast("double")).alias("close"),
                     F.coalesce(F.expr("try_cast(nanvl(_v, null) as bigint)"), F.lit(0).cast("bigint")).alias("volume"), *keep)
    return out.na.drop(subset=["close", "ticker", "date"])


def unpivot_statements(wide: DataFrame, date_columns: Sequence[str], statement_type: str | None = None,
                       cutoff=None, hwm: DataFrame | None = None) -> DataFrame:
    """S3: wide statement (ticker, metric_name, one column per report date; a statement_type column unless one type
    is named) -> long rows; keep dates >= cutoff and > the ticker's high-water mark; trim names; drop null or
    non-numeric values."""
    keys = ["ticker", "metric_name"] + (["statement_type"] if statement_type is None else [])
    kind = F.col("statement_type") if statement_type is None else F.lit(statement_type)
    long = wide.unpivot(keys, list(date_columns), "report_date_s", "raw_value")
    x = long.select("ticker", F.trim("metric_name").alias("metric_name"),
                    F.expr("try_cast(report_date_s as date)").alias("report_date"),
                    F.expr("try_cast(cast(raw_value as string) as double)").alias("metric_value"), kind.alias("statement_type"))
    x = x.na.drop(subset=["report_date", "metric_value"])
    if cutoff is not None:
        x = x.where(F.col("report_date") >= S.as_date(cutoff))
    if hwm is not None:
        x = x.join(hwm.select("ticker", F.col("hwm")), "ticker", "left") \
             .where(F.col("hwm").isNull() | (F.col("report_date") > F.col("hwm"))).drop("hwm")
    return x.select("ticker", "report_date", "statement_type", "metric_name", "metric_value")


def article_time(column: str) -> Column:
    """An ISO-8601 time as a timestamp (a trailing Z is accepted), null if it cannot be read."""
    text = F.regexp_replace(F.col(column), "Z$", "")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text))


def normalise_articles(raw: DataFrame) -> DataFrame:
    """Require publishedAt, title and url; parse ISO-8601 (a trailing Z is accepted),
    skip unparseable timestamps; flatten source.name."""
    ts = article_time("publishedAt")
    src = F.col("source.name") if "source" in raw.columns else F.lit(None).cast("string")
    x = raw.na.drop(subset=["publishedAt", "title", "url"])
    return x.select(F.col("ticker"), ts.cast("timestamp_ntz").alias("published_at"), "title",
                    F.col("url").alias("article_url"), src.alias("source_name"), "description") \
        .where(F.col("published_at").isNotNull())


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """``df`` itself, or an error that names the columns it lacks (checked on the schema, before any job)."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks the column{'s' * (len(absent) > 1)} {', '.join(absent)}")
    return df


def renamed(df: DataFrame, names: dict[str, str], back: bool = False) -> DataFrame:
    """P10: columns under their display names (or ``back``); names that are not there are left out, and one that
    would meet a column of the same name is refused."""
    pairs = {(v if back else k): (k if back else v) for k, v in names.items()}
    pairs = {k: v for k, v in pairs.items() if k in df.columns and k != v}
    kept = [c for c in df.columns if c not in pairs]
    twice = sorted({v for v in pairs.values() if v in kept or list(pairs.values()).count(v) > 1})
    if twice:
        raise ValueError(f"two columns would be called {', '.join(twice)}")
    return df.withColumnsRenamed(pairs)


# ---- keyed writes -------------------------------------------------------------------------
def upsert(target: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Last write wins on the business key (updates after target).  Within the update batch the
    row with the greatest ``_load_seq`` wins; without that column a key may occur only once, and a
    repeated one fails the job rather than pick a row."""
    seq, order = "_load_seq", "_order"
    u = updates
    if seq not in u.columns:
        n = F.count(F.lit(1)).over(Window.partitionBy(*[F.col(k) for k in key]))
        one = F.when(n > 1, F.raise_error(F.lit("upsert: a key occurs twice and there is no _load_seq"))).otherwise(F.lit(0))
        u = u.withColumn(seq, one.cast("long"))
    # one number orders both sides: any update comes after the stored row
    u = u.withColumn(order, F.col(seq).cast("long")).drop(seq)
    t = target.drop(seq).withColumn(order, F.lit(-(1 << 63)).cast("long"))
    return snap.dedupe(t.unionByName(u, allowMissingColumns=True), list(key), [F.col(order)], keep="last").drop(order)


def upsert_protected(target: DataFrame, updates: DataFrame, key: Sequence[str],
                     protected: Sequence[str] = ("peer_cluster_id", "predicted_default_prob")) -> DataFrame:
    """On conflict every column takes the new value except the protected ones, which
    keep the stored value (even a stored null)."""
    keys = list(key)
    cols = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*cols).alias("_old"), F.lit(True).alias("_in_t"))
    u = updates.select(*keys, F.struct(*[F.col(c) if c in updates.columns else F.lit(None).alias(c) for c in cols])
                       .alias("_new"), F.lit(True).alias("_in_u"))
    j = t.join(u, keys, "full")
    sel = []
    for c in cols:
        if c in protected:
            sel.append(F.when(F.col("_in_t"), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c))
        else:
            sel.append(F.when(F.col("_in_u"), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c))
    return j.select(*keys, *sel)


def upsert_keep_logo(target: DataFrame, updates: DataFrame, key: str = "ticker", keep: str = "logo_url") -> DataFrame:
    """Dimension upsert; the logo is overwritten only when the stored one is empty and
    the fetched one is not; other columns take the new value."""
    cols = [c for c in target.columns if c != key]
    t = target.select(key, F.struct(*cols).alias("_old"), F.lit(True).alias("_in_t"))
    u = updates.select(key, F.struct(*cols).alias("_new"), F.lit(True).alias("_in_u"))
    j = t.join(u, key, "full")
    sel = []
    for c in cols:
        if c == keep:
            v = F.coalesce(F.nullif(F.col(f"_old.{c}"), F.lit("")), F.nullif(F.col(f"_new.{c}"), F.lit("")))
            sel.append(F.when(F.col("_in_t") & F.col("_in_u"), v)
                       .otherwise(F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}"))).alias(c))
        else:
            sel.append(F.when(F.col("_in_u"), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c))
    return j.select(key, *sel)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First write wins.  The batch is de-duplicated (first row in ``order`` per key),
    rows whose key is already stored are dropped (anti join), the rest appended."""
    keys = list(key)
    b = snap.dedupe(batch, keys, list(order), keep="first")
    new = b.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def retention(df: DataFrame, date_col: str, keep_days: int, as_of=None) -> DataFrame:
    """Drop rows older than as_of - keep_days.  Of a table partitioned by month only the months
    that are kept are read."""
    end = S.as_date(as_of) if as_of is not None else latest_date(df, date_col)
    return in_period(df, F.date_sub(end, keep_days), on=date_col)


def high_water_mark(df: DataFrame, date_col: str = "date", key: str = "ticker") -> DataFrame:
    """Latest stored date per ticker (partial aggregate)."""
    return df.groupBy(key).agg(F.max(date_col).alias("hwm"))


def price_worklist(universe: DataFrame, hwm: DataFrame, as_of, keep_days: int = 365) -> DataFrame:
    """(ticker, start, end) to fetch.  Skip when the stored data is at most 1 day old
    (3 days on a Monday); start = HWM + 1, or the retention cutoff for new tickers, clamped to
    the cutoff; skip when start >= today."""
    today = S.as_date(as_of)
    cutoff = F.date_sub(today, keep_days)
    j = universe.select("ticker").distinct().join(hwm, "ticker", "left")
    age = F.datediff(today, F.col("hwm"))
    fresh_limit = F.when(F.dayofweek(today) == 2, 3).otherwise(1)
    start = F.greatest(F.coalesce(F.date_add(F.col("hwm"), 1), cutoff), cutoff)
    return (j.where(F.col("hwm").isNull() | (age > fresh_limit))
            .select("ticker", start.alias("start"), today.alias("end"), "hwm")
            .where(F.col("start") < F.col("end")))


def summary_worklist(universe: DataFrame, hwm: DataFrame, as_of) -> DataFrame:
    """Tickers whose summary was not refreshed today."""
    today = S.as_date(as_of)
    return (universe.select("ticker").distinct().join(hwm, "ticker", "left")
            .where(F.col("hwm").isNull() | (F.col("hwm") != today)))


def statement_worklist(universe: DataFrame, hwm: DataFrame, as_of, buffer_days: int = 60) -> DataFrame:
    """Skip tickers whose latest report is at most ``buffer_days`` old."""
    today = S.as_date(as_of)
    return (universe.select("ticker").distinct().join(hwm, "ticker", "left")
            .where(F.col("hwm").isNull() | (F.datediff(today, F.col("hwm")) > buffer_days)))


def universe_topn(ranked: DataFrame, n: int, core: Sequence[str], rank_col: str = "cagr",
                  extra: DataFrame | None = None) -> DataFrame:
    """Top ``n`` of the ranked list (the limit is the feature) union the fixed core
    tickers (union indices for prices), distinct."""
    top = ranked.where(F.col(rank_col).isNotNull()).orderBy(F.col(rank_col).desc(), F.col("ticker")).limit(n) \
        .select("ticker")
    spark = ranked.sparkSession
    out = top.union(spark.createDataFrame([(t,) for t in core], "ticker string"))
    if extra is not None:
        out = out.union(extra.select("ticker"))
    return out.distinct()


def two_tier_prices(primary: DataFrame, secondary: DataFrame, symbols: DataFrame | None = None, start=None,
                    as_of=None, max_age_days: int = 3) -> DataFrame:
    """Primary rows for symbols whose primary data is fresh (latest date within
    ``max_age_days`` of as_of); the rest from the secondary table; one row per (date, ticker),
    the later source winning; a ``source`` tag says where each row came from."""
    p, s = primary, secondary
    if symbols is not None:
        p = p.join(symbols.select("ticker"), "ticker", "left_semi")
        s = s.join(symbols.select("ticker"), "ticker", "left_semi")
    today = S.as_date(as_of) if as_of is not None else latest_date(p)
    # only the last days tell who is fresh; only the period asked for is read of the rest
    recent = in_period(p, F.date_sub(today, max_age_days))
    fresh = recent.select("ticker").distinct()
    p, s = plain(in_period(p, start)), plain(in_period(s, start))
    prim = p.join(fresh, "ticker", "left_semi").withColumn("_o", F.lit(0))
    sec = s.join(fresh, "ticker", "left_anti").withColumn("_o", F.lit(1))
    # the source is told by a number until the rows are picked: a text would make the aggregate sort them
    one = snap.dedupe(prim.unionByName(sec), ["date", "ticker"], [F.col("_o")], keep="last")
    return one.withColumn("source", F.when(F.col("_o") == 0, "primary").otherwise("secondary")).drop("_o")


def price_history(primary: DataFrame, secondary: DataFrame, tickers: Sequence[str] | None = None, period: str = "5y",
                  as_of=None) -> DataFrame:
    """Closes of a period token ('1y', 'ytd', '5y') per ticker, each with its source."""
    today = S.as_date(as_of) if as_of is not None else latest_date(primary)
    if tickers:
        primary, secondary = (t.where(F.col("ticker").isin(list(tickers))) for t in (primary, secondary))
    cols = [c for c in primary.columns if c in ("ticker", "date", "close", YEAR, MONTH)]
    out = two_tier_prices(primary.select(*cols), secondary.select(*cols), start=S.period_start(period, today), as_of=today)
    return out.select("ticker", "date", "close", "source")


def freshness(df: DataFrame, date_col: str = "date", max_age_days: int = 3, as_of=None) -> DataFrame:
    """Number of tickers, and of those with a row at most ``max_age_days`` old."""
    today = S.as_date(as_of) if as_of is not None else df.select(F.max(date_col)).scalar()
    hwm = high_water_mark(df, date_col).where(F.col("hwm").isNotNull())
    return hwm.agg(F.count(F.lit(1)).alias("n_tickers"),
                   F.count_if(F.datediff(today, F.col("hwm")) <= max_age_days).alias("n_fresh"))


def symbol_options(dim: DataFrame, sector: str | None = None, selected: Sequence[str] = ()) -> DataFrame:
    """Symbols of a sector (None: all) that are not selected, labelled 'name (ticker)' or, without
    a name, by the ticker."""
    x = dim if sector is None else dim.where(F.col("sector") == sector)
    if selected:
        x = x.where(~F.col("ticker").isin(list(selected)))
    name = F.nullif(F.col("company_name"), F.lit(""))
    return x.select("ticker", F.coalesce(F.concat(name, F.lit(" ("), F.col("ticker"), F.lit(")")), F.col("ticker")).alias("label"))


def relevant_benchmarks(selection: DataFrame, dim: DataFrame, chosen: DataFrame | None = None,
                        by_sector: dict[str, list[str]] = SECTOR_BENCHMARKS, common: Sequence[str] = COMMON_BENCHMARKS,
                        names: dict[str, str] = BENCHMARK_NAMES, user: str = "user_id") -> DataFrame:
    """(user, value, label): the benchmarks that each user's tickers suggest.

    ``selection`` (user, ticker) may be of any size.  The sector of each ticker is mapped to its indices, the
    ``common`` ones are added for every user who selected anything, those in ``chosen`` (user, symbol) are taken out.
    Sectors without indices and tickers without a sector add nothing.  Sectors are made distinct per user
    before they become indices, so what is exploded is small."""
    indices = F.create_map(*[x for k, v in by_sector.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    sectors = (selection.select(user, "ticker").join(dim.select("ticker", "sector"), "ticker", "left")
               .groupBy(user).agg(F.collect_set("sector").alias("sectors")))
    every = F.flatten(F.transform("sectors", lambda s: F.coalesce(indices[s], F.array().cast("array<string>"))))
    out = sectors.select(user, F.explode(F.array_distinct(F.concat(every, F.array(*[F.lit(i) for i in common])))).alias("value"))
    if chosen is not None:
        out = out.join(chosen.select(user, F.col("symbol").alias("value")).distinct(), [user, "value"], "left_anti")
    label = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return out.select(user, "value", F.coalesce(label[F.col("value")], F.col("value")).alias("label")).orderBy(user, "value")


def two_tier_values(primary: DataFrame, secondary: DataFrame, value_col: str) -> DataFrame:
    """Primary non-null values; the secondary's for tickers missing there (first wins)."""
    p = primary.where(F.col(value_col).isNotNull()).select("ticker", value_col).withColumn("_o", F.lit(0))
    s = secondary.where(F.col(value_col).isNotNull()).select("ticker", value_col).withColumn("_o", F.lit(1))
    return snap.dedupe(p.unionByName(s), ["ticker"], [F.col("_o")], keep="first").drop("_o")


def wide_to_long(wide: DataFrame, date_col: str = "date", value_name: str = "close") -> DataFrame:
    """(date, one column per ticker) -> (date, ticker, close), null closes dropped."""
    cols = [c for c in wide.columns if c != date_col]
    return wide.unpivot([date_col], cols, "ticker", value_name).na.drop(subset=[value_name])


def carry_forward(summary: DataFrame, cols: Sequence[str] = ("predicted_default_prob", "peer_cluster_id"),
                  key: str = "ticker", order: str = "date_updated") -> DataFrame:
    """Each snapshot carries the last non-null value of each model column (separately)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = summary
    for c in cols:
        out = out.withColumn(c, F.last(F.col(c), ignorenulls=True).over(w))
    return out


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with the first failing rule as ``reason``)."""
    reason = None
    for name, ok in rules.items():
        cond = ~F.coalesce(ok, F.lit(False))
        reason = F.when(cond, F.lit(name)) if reason is None else reason.when(cond, F.lit(name))
    x = df.withColumn("_reason", reason)
    return x.where(F.col("_reason").isNull()).drop("_reason"), x.where(F.col("_reason").isNotNull()) \
        .withColumnRenamed("_reason", "reason")
