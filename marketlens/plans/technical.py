"""Technical indicators (T1-T12) for every ticker's daily closes.

SMA and Bollinger bands are row-framed window aggregates; EMA, RSI and MACD use the native
block-scaled EWM (`operators.timeseries.ewm`).  Indicators sharing an input are computed in
one pass: the first pass holds EMA12/20/26 and both RSI averages, the second the MACD signal
(an EWM of an EWM).  No Python UDF runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import snapshot as snap
from ..operators import timeseries as ts

INDICATORS = ["sma50", "sma200", "ema20", "bb_upper", "bb_lower", "rsi", "macd", "macd_signal", "macd_hist"]


def technical_indicators(prices: DataFrame, tickers=None, drop_warmup: bool = True,
                         last_rows: int | None = None) -> DataFrame:
    p = prices if not tickers else prices.where(F.col("ticker").isin(list(tickers)))
    p = p.select("ticker", "date", "open", "high", "low", "close", "volume").where(F.col("close").isNotNull())
    delta = ts.diff("close", 1)
    x = ts.long_means(p, "close", {"sma50": 50, "sma200": 200})
    x = x.select("*",
                 ts.rolling("close", 20, "mean").alias("bb_mid"),
                 ts.rolling("close", 20, "std").alias("bb_std"),
                 F.coalesce(F.when(delta > 0, delta), F.lit(0.0)).alias("_gain"),
                 F.coalesce(F.when(delta < 0, -delta), F.lit(0.0)).alias("_loss"))
    alphas = [*map(ts.span_alpha, (20, 12, 26, 9)), 1 / 14]
    x = ts.ewm_numbered(x, alphas)
    x = ts.ewm(x, {"ema20": ("close", ts.span_alpha(20)), "ema12": ("close", ts.span_alpha(12)),
                   "ema26": ("close", ts.span_alpha(26)), "_avg_gain": ("_gain", 1 / 14),
                   "_avg_loss": ("_loss", 1 / 14)}, numbered_for=alphas)
    x = x.withColumn("macd", F.col("ema12") - F.col("ema26"))
    x = ts.ewm(x, {"macd_signal": ("macd", ts.span_alpha(9))}, numbered_for=alphas)
    rs = F.col("_avg_gain") / F.nullif(F.col("_avg_loss"), F.lit(0.0))
    out = x.select(
        "ticker", "date", "open", "high", "low", "close", "volume", "sma50", "sma200", "ema20", "bb_mid",
        (F.col("bb_mid") + 2 * F.col("bb_std")).alias("bb_upper"),
        (F.col("bb_mid") - 2 * F.col("bb_std")).alias("bb_lower"),
        F.coalesce(100 - 100 / (1 + rs), F.lit(50.0)).alias("rsi"),
        "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist"))
    out = out.withColumn("rsi_zone", S.rsi_zone("rsi")) \
             .withColumn("hist_sign", F.when(F.col("macd_hist") >= 0, "positive").otherwise("negative"))
    if drop_warmup:
        out = out.na.drop(subset=INDICATORS)
    if last_rows:
        out = snap.top_n(out, last_rows, "ticker", [F.col("date").desc()])
    return out


def sma(prices: DataFrame) -> DataFrame:
    p = prices.select("ticker", "date", "close")
    return ts.long_means(p, "close", {"sma50": 50, "sma200": 200})


def bollinger(prices: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    p = prices.select("ticker", "date", "close")
    m, s = ts.rolling("close", n, "mean"), ts.rolling("close", n, "std")
    return p.select("*", m.alias("bb_mid"), (m + k * s).alias("bb_upper"), (m - k * s).alias("bb_lower"))


def ema(prices: DataFrame, span: int = 20) -> DataFrame:
    p = prices.select("ticker", "date", "close")
    return ts.ewm(p, {f"ema{span}": ("close", ts.span_alpha(span))})


def rsi(prices: DataFrame, n: int = 14) -> DataFrame:
    p = prices.select("ticker", "date", "close")
    delta = ts.diff("close", 1)
    x = p.select("*", F.coalesce(F.when(delta > 0, delta), F.lit(0.0)).alias("_gain"),
                 F.coalesce(F.when(delta < 0, -delta), F.lit(0.0)).alias("_loss"))
    x = ts.ewm(x, {"_g": ("_gain", 1 / n), "_l": ("_loss", 1 / n)})
    rs = F.col("_g") / F.nullif(F.col("_l"), F.lit(0.0))
    return x.select("ticker", "date", "close", F.coalesce(100 - 100 / (1 + rs), F.lit(50.0)).alias("rsi"))


def macd(prices: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    p = prices.select("ticker", "date", "close")
    alphas = [ts.span_alpha(n) for n in (fast, slow, signal)]
    x = ts.ewm(ts.ewm_numbered(p, alphas), {"_f": ("close", alphas[0]), "_s": ("close", alphas[1])}, numbered_for=alphas)
    x = x.withColumn("macd", F.col("_f") - F.col("_s"))
    x = ts.ewm(x, {"macd_signal": ("macd", alphas[2])}, numbered_for=alphas)
    return x.select("ticker", "date", "close", "macd", "macd_signal",
                    (F.col("macd") - F.col("macd_signal")).alias("macd_hist"))
