"""Scalar column functions: labels, buckets, formats, reproducible random draws."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b) -> Column:
    return _c(a) / F.nullif(_c(b), F.lit(0))


# Company size bins (lower bound inclusive), volatility and valuation cut-offs.
SIZE_BINS = [(0.0, "Small Cap"), (10e9, "Mid Cap"), (100e9, "Large Cap"), (1000e9, "Mega Cap")]


def company_size(market_cap="market_cap") -> Column:
    """[0,10e9) Small, [10e9,100e9) Mid, [100e9,1e12) Large, >=1e12 Mega; negative/null -> null (M4)."""
    m = _c(market_cap)
    out = F.when(m.isNull() | (m < 0) | F.isnan(m), F.lit(None).cast("string"))
    for lo, lbl in reversed(SIZE_BINS):
        out = out.when(m >= lo, lbl)
    return out


def volatility_level(beta="beta") -> Column:
    """null N/A; <0.5 Core; <=2 Growth; >2 Hyper Growth (M5)."""
    b = _c(beta)
    return (F.when(b.isNull(), "N/A").when(b < 0.5, "Core").when(b <= 2, "Growth")
            .when(b > 2, "Hyper Growth").otherwise("N/A"))


def valuation_model(ev_ebitda="ev_ebitda") -> Column:
    """null N/A; <10 Cheap (negative included); <=25 Fair Value; >25 Expensive (M6)."""
    v = _c(ev_ebitda)
    return (F.when(v.isNull(), "N/A").when(v < 10, "Cheap").when(v <= 25, "Fair Value")
            .when(v > 25, "Expensive").otherwise("N/A"))


# Fixed values: (volatility level, valuation label) -> stock profile; anything else "Needs Review".
PROFILE_MATRIX = [
    ("Hyper Growth", "Fair Value", "Promising Growth"),
    ("Core", "Cheap", "Hidden Value Gem"),
    ("Hyper Growth", "Expensive", "High-Flyer"),
    ("Core", "Fair Value", "Stable Compounder"),
    ("Growth", "Fair Value", "Core Holding"),
    ("Growth", "Cheap", "Value Opportunity"),
]


def stock_profile(vol="volatility_level", val="valuation_model") -> Column:
    vol, val = _c(vol), _c(val)
    out = None
    for a, b, lbl in PROFILE_MATRIX:
        cond = (vol == a) & (val == b)
        out = F.when(cond, lbl) if out is None else out.when(cond, lbl)
    return out.otherwise("Needs Review")


def risk_bucket(prob="predicted_default_prob") -> Column:
    """Default probability as percent: <=10 Low, <=40 Medium, else High; null -> null."""
    p = _c(prob) * 100
    return F.when(p.isNull(), F.lit(None).cast("string")).when(p <= 10, "Low").when(p <= 40, "Medium").otherwise("High")


def par_status(price="dirty_price") -> Column:
    """>105 Premium, <95 Discount, else Par."""
    p = _c(price)
    return F.when(p > 105, "Premium").when(p < 95, "Discount").otherwise("Par")


def rsi_zone(rsi="rsi") -> Column:
    r = _c(rsi)
    return F.when(r >= 70, "overbought").when(r <= 30, "oversold").otherwise("neutral")


def pe_band(pe="pe") -> Column:
    """Position of a P/E against the 15/20/25 reference lines."""
    p = _c(pe)
    return (F.when(p.isNull(), F.lit(None).cast("string")).when(p < 15, "below 15").when(p < 20, "15-20")
            .when(p < 25, "20-25").otherwise("above 25"))


# ---- formats (FMT1-FMT4) -----------------------------------------------------------------
def fmt_market_cap(x="market_cap") -> Column:
    """$1,234.00B / $7.89M (FMT1): billions from 1e9 on, with thousands separators."""
    v = _c(x)
    a = F.abs(v)
    return (F.when(v.isNull(), "-")
            .when(a >= 1e9, F.concat(F.lit("$"), F.format_number(v / 1e9, 2), F.lit("B")))
            .otherwise(F.concat(F.lit("$"), F.format_number(v / 1e6, 2), F.lit("M"))))


# Titles (lower case) whose values are shown as percent, besides those with a percent sign.
PERCENT_TITLES = ["roe", "operating margin", "ebitda margin", "revenue growth (yoy)", "net income growth (yoy)", "revenue cagr (3y)"]


def fmt_metric(x, title: str) -> Column:
    """Metric card text (FMT2): $ with T, B or M from a million on, else percent for percent titles, else two
    decimals; null without a value (no card)."""
    v = _c(x)
    a = F.abs(v)
    small = F.concat(_plain(v * 100), F.lit("%")) if "%" in title or title.lower() in PERCENT_TITLES else F.format_number(v, 2)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for low, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M")):
        out = out.when(a >= low, F.concat(F.lit("$"), F.format_number(v / low, 2), F.lit(unit)))
    return out.otherwise(small)


def _plain(v: Column) -> Column:
    """Two decimals without thousands separators."""
    return F.replace(F.format_number(v, 2), F.lit(","), F.lit(""))


def fmt_millions(x) -> Column:
    """Statement values in millions (FMT3)."""
    v = _c(x)
    return F.when(v.isNull(), "-").otherwise(F.concat(F.format_number(v / 1e6, 2), F.lit("M")))


def fmt_change(change, pct) -> Column:
    """Signed change text, e.g. "+1.23 (+0.45%)" (FMT4); N/A where either is missing."""
    c, p = _c(change), _c(pct)
    sign = F.when(c >= 0, "+").otherwise("")
    text = F.concat(sign, F.format_number(c, 2), F.lit(" ("), sign, _plain(p), F.lit("%)"))
    return F.coalesce(text, F.lit("N/A"))


# ---- period token (P5) ---------------------------------------------------------------------
def period_start(period: str, as_of: Column) -> Column:
    """'5y' = as_of - 5*365 d, '1y' = as_of - 365 d, 'ytd' = Jan 1 of as_of; otherwise 5y."""
    p = (period or "").lower()
    if p == "1y":
        return F.date_sub(as_of, 365)
    if p == "ytd":
        return F.trunc(as_of, "year")
    return F.date_sub(as_of, 5 * 365)


# ---- reproducible uniforms and triangular draws (V1) -----------------------------------------
def hex_uniform(hexstr: Column, slot: int) -> Column:
    """A uniform in [0, 1) from the ``slot``-th 13-hex-digit (52-bit) slice of a hex digest."""
    return F.conv(F.substring(hexstr, 1 + 13 * slot, 13), 16, 10).cast("double") / float(2 ** 52)


def triangular(u: Column, lo, mode, hi) -> Column:
    """Inverse CDF of the triangular distribution (lo, mode, hi) at uniform u."""
    lo, mode, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, mode, hi))
    span = hi - lo
    fc = F.when(span > 0, (mode - lo) / F.nullif(span, F.lit(0.0))).otherwise(F.lit(0.0))
    left = lo + F.sqrt(u * span * (mode - lo))
    right = hi - F.sqrt((1 - u) * span * (hi - mode))
    return F.when(u < fc, left).otherwise(right)


def as_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, (_dt.date, _dt.datetime)):
        return F.lit(d.isoformat()[:10]).cast("date")
    return F.lit(str(d)).cast("date")
