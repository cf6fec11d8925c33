"""Article scoring in batches by a scorer of the user's choice.

A scorer is an object with ``score(texts) -> list of (label, score)``, shipped to the Python workers with the
task (``open()``, if it has one, is called there before the first batch: the place to load a model).  This package
is sent along; the module of a scorer of one's own goes there as usual (--py-files).
Texts are handed over in batches; a batch that fails, or whose answer has another length, gets the
neutral label, the score 0.0 and the reason, and the job goes on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .news import NEGATIVE_WORDS, POSITIVE_WORDS, model_text

NEUTRAL, NO_SCORE = "neutral", 0.0
BATCH = 20


class Scorer(Protocol):
    def score(self, texts: Sequence[str]) -> Sequence[tuple[str, float]]: ...


class WordScorer:
    """The lexicon of ``news`` as a scorer: the label that leads, and by which share."""

    def open(self) -> None:
        import re

        self.words = re.compile("[a-z]+")
        self.good, self.bad = set(POSITIVE_WORDS), set(NEGATIVE_WORDS)

    def score(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            words = self.words.findall(t.lower())
            p, n = sum(w in self.good for w in words), sum(w in self.bad for w in words)
            out.append(("Positive" if p > n else "Negative" if n > p else "Neutral", abs(p - n) / (p + n) if p + n else 0.0))
        return out


def _answers(scorer: Scorer, texts: list[str]) -> list[tuple[str, float, str | None]]:
    try:
        got = [(str(label).lower(), float(score)) for label, score in scorer.score(texts)]
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} answers to {len(texts)} texts")
    except Exception as e:  # whatever a scorer does, its batch is neutral and says why
        return [(NEUTRAL, NO_SCORE, f"{type(e).__name__}: {e}")] * len(texts)
    return [(label, score, None) for label, score in got]


def score_batches(news: DataFrame, scorer: Scorer, batch: int = BATCH, max_chars: int | None = None) -> DataFrame:
    """Label and score every article without a label; existing labels and scores pass through.

    Rows without a usable text (title and description) stay unlabelled and are not handed to the scorer.  Adds
    ``failure`` (why the batch of a row failed) and ``scored``.  Narrow: rows stay in their partitions, so a batch
    never waits for a shuffle; a partition's last batch may be shorter."""
    ship_package(news.sparkSession)
    has_score = "sentiment_score" in news.columns
    rest = [c for c in news.columns if c not in ("sentiment_label", "sentiment_score")]
    todo = F.col("sentiment_label").isNull()
    rows = news.select(F.struct(*rest).alias("row"), F.col("sentiment_label").alias("label"),
                       (F.col("sentiment_score").cast("double") if has_score else F.lit(None).cast("double")).alias("score"),
                       F.when(todo, model_text(max_chars=max_chars)).alias("text"))
    schema = rows.drop("text").schema.add("failure", "string").add("scored", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hasattr(scorer, "open"):
            scorer.open()
        for b in batches:
            labels, scores, texts = (b.column(k).to_pylist() for k in (1, 2, 3))
            at = [k for k, t in enumerate(texts) if t is not None]
            failures: list[str | None] = [None] * len(texts)
            for low in range(0, len(at), batch):
                some = at[low:low + batch]
                for k, (label, score, failure) in zip(some, _answers(scorer, [texts[k] for k in some])):
                    labels[k], scores[k], failures[k] = label, score, failure
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(failures, pa.string()),
                 pa.array([t is not None for t in texts], pa.bool_())], ["row", "label", "score", "failure", "scored"])

    return rows.mapInArrow(run, schema).select(
        "row.*", F.col("label").alias("sentiment_label"), F.col("score").alias("sentiment_score"), "failure", "scored")
