"""Per-series window operators (rolling, lag, fill, EWM), as-of and nearest joins, and
calendar alignment.

All operators partition by the series key (``ticker``) and order by the date column.  A
series here is one instrument's daily or quarterly rows, keyed by (ticker, date) after the
upsert: its length is bounded by the calendar (days or quarters in the retention window),
not by the size of the table, so a window partition never holds more than one calendar's
worth of rows even when one ticker dominates the table.

Rolling windows count rows, not calendar days, like the pandas originals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _cols(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def series_window(key="ticker", order="date") -> WindowSpec:
    return Window.partitionBy(*_cols(key)).orderBy(*_cols(order))


def trailing(n: int, key="ticker", order="date") -> WindowSpec:
    """The last ``n`` rows up to and including the current one."""
    return series_window(key, order).rowsBetween(-(n - 1), 0)


def running(key="ticker", order="date") -> WindowSpec:
    return series_window(key, order).rowsBetween(Window.unboundedPreceding, 0)


def whole(key="ticker", order="date") -> WindowSpec:
    return series_window(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(x, n: int, how: str = "mean", min_periods: int | None = None, key="ticker", order="date") -> Column:
    """pandas ``rolling(n, min_periods).<how>()``; ``min_periods`` counts non-null values
    (default: ``n``, a full window)."""
    x = _c(x)
    w = trailing(n, key, order)
    fn = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "max": F.max, "min": F.min}[how]
    mp = n if min_periods is None else min_periods
    val = fn(x).over(w)
    if how == "std":
        mp = max(mp, 2)  # a sample std of one value is undefined (null), as in pandas
    return F.when(F.count(x).over(w) >= mp, val)


def long_means(df: DataFrame, x: str, spans: dict[str, int], key="ticker", order="date") -> DataFrame:
    """Add rolling means over full windows (``rolling(x, n)``) for long spans: output column -> number of rows.

    A row frame adds up all its rows again for every row.  Here a short frame is summed that way and the sums of
    longer ones are put together from those of shorter ones that lie end to end (200 rows are four times 50, 50
    five times 10), so the work per row grows with the parts.  Values are only ever added, none is taken
    away again, so a great or non-finite value leaves nothing behind.  All steps use one order: one sort."""
    x, done = F.col(x), {}
    keep = [F.col(f"`{c}`") for c in df.columns]
    for n in sorted(set(spans.values())):
        part = max((d for d in done if n % d == 0), default=None)
        if part is None:
            part = max(d for d in range(1, n + 1) if n % d == 0 and (d * d <= 4 * n))
            w = trailing(part, key, order)
            df = df.withColumns({f"_sum{part}": F.sum(x).over(w), f"_count{part}": F.count(x).over(w)})
            done[part] = True
        if part != n:
            parts = {}
            for kind in ("sum", "count"):
                c = F.coalesce(F.col(f"_{kind}{part}"), F.lit(0))
                total = c
                for k in range(1, n // part):
                    total = total + F.coalesce(lag(f"_{kind}{part}", k * part, key, order), F.lit(0))
                parts[f"_{kind}{n}"] = total
            df = df.withColumns(parts)
            done[n] = True
    return df.select(*keep, *[F.when(F.col(f"_count{n}") >= n, F.col(f"_sum{n}") / F.col(f"_count{n}")).alias(out) for out, n in spans.items()])


def ttm_sum(x, key="ticker", order="report_date") -> Column:
    """Trailing four-period sum; null unless all four rows are present."""
    return rolling(x, 4, "sum", 4, key, order)


def rolling_count(cond: Column, n: int, key="ticker", order="date") -> Column:
    """Rolling count of a condition; a null comparison counts as 0."""
    return F.sum(F.coalesce(cond.cast("int"), F.lit(0))).over(trailing(n, key, order))


def lag(x, n: int = 1, key="ticker", order="date") -> Column:
    return F.lag(_c(x), n).over(series_window(key, order))


def diff(x, n: int = 1, key="ticker", order="date") -> Column:
    """x - x shifted by n rows."""
    return _c(x) - lag(x, n, key, order)


def pct_change(x, n: int = 1, key="ticker", order="date") -> Column:
    """x / x shifted by n rows - 1, null where the base is 0 or missing."""
    return _c(x) / F.nullif(lag(x, n, key, order), F.lit(0)) - 1


def cummax(x, key="ticker", order="date") -> Column:
    return F.max(_c(x)).over(running(key, order))


def ffill(x, key="ticker", order="date") -> Column:
    """Last non-null value up to the current row."""
    return F.last(_c(x), ignorenulls=True).over(running(key, order))


def first_value(x, key="ticker", order="date") -> Column:
    """First non-null value of the series."""
    return F.first(_c(x), ignorenulls=True).over(whole(key, order))


def safe_div(a, b) -> Column:
    """a / b with a zero or null denominator giving null."""
    return _c(a) / F.nullif(_c(b), F.lit(0))


# ---------------------------------------------------------------------------------------
# EWM (adjust=False):  y0 = x0;  yt = (1-a) y(t-1) + a xt.
#
# Closed form yn = sum_i w_i (1-a)^(n-i) x_i, w_0 = 1, w_i = a.  Rows are cut into blocks of
# B rows.  Inside a block the sum is a running window sum scaled to the block start, so every
# power stays finite: in_n = (1-a)^k * sum_{j<=k} w x (1-a)^-j, k = row within the block.
# The state entering block b is the last `in` of block b-1 (its own carry from block b-2 is
# damped by (1-a)^B < e^-EXP_BUDGET and dropped).  yn = in_n + (1-a)^(k+1) * carry.
# All steps are native window functions: one sort per series, no Python.
# ---------------------------------------------------------------------------------------
EXP_BUDGET = 500.0     # largest exponent of a scale factor: e^500 ~ 1e217, far from overflow
MIN_DECAY = 40.0       # dropped carry must be damped by at least e^-40 (< 1e-17, below double eps)


def _block_size(alphas: Sequence[float]) -> int:
    rates = [-math.log1p(-a) for a in alphas if a < 1.0]
    if not rates:
        return 1 << 20
    b = int(EXP_BUDGET / max(rates))
    if b * min(rates) < MIN_DECAY:
        raise ValueError("alphas too far apart to share one block size; compute them in separate calls")
    return max(b, 1)


EWM_COLUMNS = ["_ewm_i", "_ewm_b", "_ewm_k"]


def ewm_numbered(df: DataFrame, alphas: Sequence[float], key="ticker", order="date") -> DataFrame:
    """Row number, block and place in the block of every row, for one or several calls of ``ewm`` with these alphas.

    The blocks grow with the order, so (key, block, order) is the same order again; all windows of ``ewm`` ask for
    it in these words, and however many calls there are, the rows are sorted once for it."""
    bsz = _block_size(alphas)
    d = df.withColumn("_ewm_i", F.row_number().over(series_window(_cols(key), _cols(order))) - 1)
    return d.withColumns({"_ewm_b": F.floor(F.col("_ewm_i") / bsz), "_ewm_k": F.col("_ewm_i") % bsz})


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], key="ticker", order="date", numbered_for: Sequence[float] | None = None) -> DataFrame:
    """Add EWM (adjust=False) columns.  ``specs``: output column -> (input column, alpha).

    Inputs must be non-null (pandas would skip nulls with shifted weights).  All outputs
    share one row numbering and one block size, so they cost one extra sort together.
    ``numbered_for``: the rows were numbered by ``ewm_numbered`` with these alphas (all of them); the numbers stay."""
    keys, orders = _cols(key), _cols(order)
    alphas = [a for _, a in specs.values()]
    d = df if numbered_for is not None else ewm_numbered(df, alphas, keys, orders)
    bsz = _block_size(numbered_for if numbered_for is not None else alphas)
    wb = Window.partitionBy(*keys, "_ewm_b").orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    wprev = Window.partitionBy(*keys).orderBy("_ewm_b", *orders).rowsBetween(Window.unboundedPreceding, -1)
    k = F.col("_ewm_k")
    last_in_block = k == bsz - 1
    inner, outer = {}, {}
    for out, (src, a) in specs.items():
        beta = 1.0 - a
        wt = F.when(F.col("_ewm_i") == 0, F.lit(1.0)).otherwise(F.lit(a))
        inner[f"_in_{out}"] = F.pow(F.lit(beta), k) * F.sum(wt * F.col(src) * F.pow(F.lit(beta), -k)).over(wb)
        carry = F.last(F.when(last_in_block, F.col(f"_in_{out}")), ignorenulls=True).over(wprev)
        outer[out] = F.col(f"_in_{out}") + F.pow(F.lit(beta), k + 1) * F.coalesce(carry, F.lit(0.0))
    d = d.withColumns(inner).withColumns(outer).drop(*inner)
    return d if numbered_for is not None else d.drop(*EWM_COLUMNS)


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


# ---------------------------------------------------------------------------------------
# Joins on time.
# ---------------------------------------------------------------------------------------
def asof_backward(left: DataFrame, right: DataFrame, value_cols: Sequence[str], key="ticker",
                  left_on="date", right_on="date") -> DataFrame:
    """For each left row, the right values of the last right row with date <= left date, per
    key (J5).  Left rows without a match keep nulls.

    One shuffle on the key, one sort: both sides are unioned with a side flag (right first on
    equal dates) and the right values are carried forward with ``last(ignorenulls)``.
    """
    keys = _cols(key)
    vals = list(value_cols)
    r = right.select(*keys, F.col(right_on).alias("_t"),
                     F.struct(*[F.col(v) for v in vals]).alias("_v"), F.lit(0).alias("_side"))
    at = {c: F.col(c) for c in keys} | {left_on: F.col("_t")}
    lcols = [c for c in left.columns]
    rest = [c for c in lcols if c not in at]
    # what stands in the key and the date already is not carried a second time
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(1))
    l_ = left.select(*keys, F.col(left_on).alias("_t"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"),
                     F.lit(1).alias("_side"), row.alias("_row"))
    u = r.withColumn("_row", F.lit(None).cast(l_.schema["_row"].dataType)).unionByName(l_)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    m = u.withColumn("_m", F.last("_v", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    return m.select(*[(at[c] if c in at else F.col("_row")[c]).alias(c) for c in lcols], *[F.col("_m")[v].alias(v) for v in vals])


# Days since 1970 stay below this for any date, so distance * DAY_SPAN + day orders by distance, then date.
DAY_SPAN = 10_000_000


def nearest(df: DataFrame, targets: dict, value_cols: Sequence[str], key="ticker", on="date") -> DataFrame:
    """Per key and named target date, the row whose date is nearest the target; ties go to the
    earlier date (J9).  ``targets``: label -> date Column.

    One pass: every target is a set of aggregates over the same rows (a hash aggregate where the values have a
    fixed width), and the one row per key that is left becomes a row per target."""
    keys = _cols(key)
    day = F.unix_date(F.col(on)).cast("long")
    marked = df.where(F.col(on).isNotNull()).select(*keys, on, *value_cols, *[
        (F.abs(F.datediff(F.col(on), c)).cast("long") * DAY_SPAN + day).alias(f"_rank{i}") for i, c in enumerate(targets.values())])
    cols = [on, *value_cols]
    picked = marked.groupBy(*keys).agg(*[F.min_by(F.col(c), F.col(f"_rank{i}")).alias(f"_{i}_{c}")
                                         for i in range(len(targets)) for c in cols])
    rows = F.array(*[F.struct(F.lit(label).alias("period"), target.alias("target"), *[F.col(f"_{i}_{c}").alias(c) for c in cols])
                     for i, (label, target) in enumerate(targets.items())])
    return picked.select(*keys, F.inline(rows)).select(*keys, "period", "target", *cols)


def align_calendar(df: DataFrame, value_cols: Sequence[str], calendar: DataFrame, key="ticker",
                   on="date", end=None) -> DataFrame:
    """Forward-filled reindex of every series onto a shared calendar.

    Each observed row stands for the calendar dates from its own date up to the day before
    the series' next observation (or ``end``).  Those days are generated with ``sequence``
    (bounded by the gap, in days) and kept when they are calendar dates: an equi-join with the
    calendar, whose size is bounded by the days in the period (Spark broadcasts it only if its
    runtime size passes the broadcast threshold).  Dates before a series' first observation
    stay absent, as pandas leaves them NaN.
    """
    keys = _cols(key)
    w = series_window(keys, on)
    nxt = F.lead(F.col(on)).over(w)
    stop = F.date_sub(nxt, 1)
    if end is not None:
        stop = F.coalesce(stop, end)
    else:
        stop = F.coalesce(stop, F.col(on))
    x = df.select(*keys, F.col(on).alias("_obs"), *value_cols, stop.alias("_stop"))
    x = x.select(*keys, "_obs", *value_cols, F.explode(F.sequence(F.col("_obs"), F.col("_stop"))).alias(on))
    cal = calendar.select(F.col(on)).distinct()
    return x.join(cal, on, "inner").select(*keys, on, "_obs", *value_cols)
