"""News and sentiment.

Scoring (N2) is a small word lexicon in Spark expressions over the whole text: no Python worker,
no prefix.  Rows that already carry a label keep it and are not scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import snapshot as snap

LABELS = ["positive", "neutral", "negative"]
# The words that the local scorer counts.
POSITIVE_WORDS = ["beat", "beats", "best", "excellent", "gain", "gains", "good", "great", "growth", "profit", "profits",
                  "record", "strong", "success", "surge", "upgrade", "win", "wins"]
NEGATIVE_WORDS = ["bad", "clown", "crash", "decline", "disgusting", "downgrade", "fall", "falls", "fraud", "idiot", "lawsuit",
                  "loser", "loss", "losses", "miss", "moron", "pathetic", "scum", "stupid", "trash", "weak", "worst", "worthless"]


def model_text(title="title", description="description", max_chars: int | None = None) -> Column:
    """Title + '. ' + description; null when either is empty.  ``max_chars`` cuts it for a
    scorer that needs a limit; the default is the whole text."""
    t, d = F.col(title), F.col(description)
    ok = t.isNotNull() & d.isNotNull() & (F.length(t) > 0) & (F.length(d) > 0)
    whole = F.concat(t, F.lit(". "), d)
    return F.when(ok, whole if max_chars is None else F.substring(whole, 1, max_chars))


def lexicon_counts(text: Column) -> tuple[Column, Column]:
    """Positive and negative lexicon words in the text (words: runs of a-z after lower-casing)."""
    words = F.split(F.lower(text), "[^a-z]+")
    return (F.size(F.filter(words, lambda w: w.isin(POSITIVE_WORDS))), F.size(F.filter(words, lambda w: w.isin(NEGATIVE_WORDS))))


def score_articles(news: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Label and score every article without a label; existing labels and scores pass through.

    The label follows the larger count; the score is the share by which it leads (0: none leads).
    ``scored`` tells the rows that the scorer labelled from those without a usable text."""
    has_score = "sentiment_score" in news.columns
    todo = F.col("sentiment_label").isNull()
    x = news.withColumn("_txt", F.when(todo, model_text(max_chars=max_chars)))
    pos, neg = lexicon_counts(F.col("_txt"))
    x = x.withColumn("_pos", F.when(F.col("_txt").isNotNull(), pos)).withColumn("_neg", F.when(F.col("_txt").isNotNull(), neg))
    p, n = F.col("_pos"), F.col("_neg")
    label = F.when(p > n, "positive").when(n > p, "negative").when(p == n, "neutral")
    score = F.coalesce(F.abs(p - n) / F.nullif(p + n, F.lit(0)), F.when(p == n, F.lit(0.0)))
    rest = [c for c in news.columns if c not in ("sentiment_label", "sentiment_score")]
    kept = F.col("sentiment_score") if has_score else F.lit(None).cast("double")
    return x.select(*rest, F.coalesce("sentiment_label", label).alias("sentiment_label"),
                    F.when(todo, score).otherwise(kept).alias("sentiment_score"),
                    (todo & F.col("_txt").isNotNull()).alias("scored"))


def recent(news: DataFrame, days: int = 7, per_ticker: int = 20, as_of=None) -> DataFrame:
    """Articles of the last ``days`` days, newest ``per_ticker`` per ticker (the limit is
    the feature; Spark applies it per task before the shuffle)."""
    end = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else news.select(F.max("published_at")).scalar()
    x = news.where(F.col("published_at") >= end - F.expr(f"INTERVAL {days} DAYS"))
    return snap.top_n(x, per_ticker, "ticker", [F.col("published_at").desc(), F.col("article_url")])


def sentiment_summary(news: DataFrame) -> DataFrame:
    """Positive / neutral / negative counts per ticker and their percentage of the
    labelled articles (0 when none is labelled)."""
    lab = F.lower(F.col("sentiment_label"))
    g = news.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count(lab).alias("n_labelled"),
        *[F.count_if(lab == x).alias(f"n_{x}") for x in LABELS])
    pct = [F.coalesce(100.0 * F.col(f"n_{x}") / F.nullif(F.col("n_labelled"), F.lit(0)), F.lit(0.0)).alias(f"pct_{x}")
           for x in LABELS]
    return g.select("*", *pct)


def news_by_day(news: DataFrame) -> DataFrame:
    """Articles grouped by calendar day per ticker, newest day first.  Aggregated (no
    per-day article lists), so a busy day never becomes one oversized row."""
    lab = F.lower(F.col("sentiment_label"))
    return (news.groupBy("ticker", F.to_date("published_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("n_articles"), *[F.count_if(lab == x).alias(f"n_{x}") for x in LABELS],
                 F.max("published_at").alias("latest_published"))
            .orderBy("ticker", F.col("day").desc()))


def articles_by_day(news: DataFrame, per_row: int = 50, key: str = "ticker") -> DataFrame:
    """The articles of each ticker (or other ``key``) and calendar day, newest first, in lists of at most ``per_row``.

    A busy day continues in further rows (``page`` 0, 1, ...), so no list grows with the day and no article is
    left out; ``n_day`` counts the whole day.  One shuffle by ticker and day: the numbering streams over the sorted
    rows, and the lists are gathered where the rows are."""
    day = F.to_date("published_at")
    w = Window.partitionBy(key, "day").orderBy(F.col("published_at").desc(), "article_url", "title")
    rows = news.select(key, day.alias("day"), "published_at", "article_url", "title", "sentiment_label").withColumn("_n", F.row_number().over(w))
    article = F.struct("_n", "published_at", "article_url", "title", "sentiment_label")
    pages = rows.groupBy(key, "day", F.floor((F.col("_n") - 1) / per_row).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(article)).alias("articles"), F.max("_n").alias("_last"))
    whole = F.max("_last").over(Window.partitionBy(key, "day"))
    return pages.select(key, "day", "page", whole.alias("n_day"), F.size("articles").alias("n_articles"),
                        F.transform("articles", lambda a: a.dropFields("_n")).alias("articles"))
