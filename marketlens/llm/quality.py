"""Quality classifier by co-training.

Two views of a document: its text content (words, word beginnings and shape measures, hashed) and
its page metadata (source, language, declared length, layout).  A logistic classifier per view is
fitted on a bounded sample of labelled rows; every other row of the table is the pool.  Each round
scores the whole pool: of all rows that a view is sure of, Spark sums what they teach the other view
(gradient and curvature of its loss, per feature and class), and the other view is fitted anew on
the labelled rows and those sums.  No row is passed over and nothing but sums of fixed size leaves
the tasks; they are integers, so the order of rows and tasks doesn't matter.  Each view is calibrated on
labelled rows that it did not learn from, and the two calibrated views are combined by a logistic
model.  All documents are then scored; scoring is narrow.

A document is good if its label says quality 1 and not toxic.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

# Labelled rows that the classifiers are fitted on, at most; all other rows are the pool.
FIT_ROWS = 8192
ROUNDS = 3
# A view is sure of a row if its calibrated odds are this many times those of the class among the labelled rows
# (a Bayes factor: a view of few values, as metadata is, never comes near a fixed probability).
SURE = 10.0
# Weight of the lessons of the other view in a class's loss, whatever their number; labelled rows have the rest.
LESSON_SHARE = 0.5
# Gradients are summed as integers of this unit.
UNIT = 1 << 24
# A feature is used if this many rows have it and its shares differ by this many standard errors.
LEAST_SEEN = 5
LEAST_SIGMAS = 4.0
TEXT_BITS = 17
META_BITS = 12
KEEP_FROM = 0.35
# Characters stripped from the ends of words; how many letters begin a word.
EDGES = ".,;:!?|%$#*&()[]{}\"'<>-_=+/\\"
BEGIN = 5


def _bucket(kind: str, value: object, bits: int) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "replace")) & ((1 << bits) - 1)


def _step(x: float) -> int:
    """A share or count as one of a few logarithmic steps."""
    return -99 if x <= 0 else int(math.floor(2 * math.log2(x)))


def text_features(text: str) -> np.ndarray:
    """Distinct hashed features of the whole text: words, word beginnings, shape measures."""
    mask = (1 << TEXT_BITS) - 1
    raw = text.split()
    words = {w.strip(EDGES) for w in {w.lower() for w in set(raw)}} - {""}
    crc = zlib.crc32
    found = {crc(w.encode("utf-8", "replace")) & mask for w in words}
    found |= {crc(b"^" + w.encode("utf-8", "replace")) & mask for w in {w[:BEGIN] for w in words}}
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, total = max(1, len(raw)), max(1, int(octets.sum()))
    letters = max(1, int(octets[65:91].sum() + octets[97:123].sum()))
    marks = total - letters - int(octets[32] + octets[10] + octets[9] + octets[128:].sum())
    for kind, x in (("upper", octets[65:91].sum() / letters), ("marks", marks / total), ("digits", octets[48:58].sum() / total),
                    ("distinct", len(words) / n), ("shout", octets[33] / n), ("bars", octets[124] / n),
                    ("long", letters / n / 32), ("words", len(raw))):
        found.add(_bucket(kind, _step(float(x)), TEXT_BITS))
    return np.fromiter(found, np.int32, len(found))


def meta_features(source: str | None, lang: str | None, n_chars: int | None, lines: int, longest: int) -> np.ndarray:
    found = {_bucket("source", source, META_BITS), _bucket("lang", lang, META_BITS),
             _bucket("n_chars", None if n_chars is None else _step(n_chars), META_BITS),
             _bucket("lines", _step(lines), META_BITS), _bucket("longest", _step(longest), META_BITS),
             _bucket("layout", (min(lines, 3), _step(longest) // 2), META_BITS)}
    return np.fromiter(found, np.int32, len(found))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Lessons:
    """What sure rows of the other view teach: per class, sums over them for each feature (bias last).

    ``slope`` is the gradient of the log loss at the weights ``at``; ``bend`` bounds its curvature from
    above (a quarter of a row's number of features, the bias included), so that the loss of all these rows
    lies under slope * d + bend * d * d / 2 for every step d; ``seen`` counts rows."""

    def __init__(self, sums: dict[str, np.ndarray], weights: np.ndarray, bias: float):
        self.slope, self.bend, self.seen = sums["slope"] / UNIT, sums["bend"] / 4, sums["seen"]
        self.at = np.append(weights, bias)

    def count(self, label: int) -> int:
        return int(self.seen[label, -1])


class View:
    """Sparse logistic classifier with Platt calibration."""

    def __init__(self, rows: list[np.ndarray], bits: int, decay: float):
        self.size = np.array([len(r) for r in rows])
        self.index = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(rows)), self.size)
        self.bits, self.decay, self.n = bits, decay, len(rows)
        self.weights, self.bias, self.scale, self.shift = np.zeros(1 << bits), 0.0, 1.0, 0.0

    def logits(self) -> np.ndarray:
        return np.bincount(self.row, self.weights[self.index], self.n) + self.bias

    def fit(self, rows: np.ndarray, y: np.ndarray, lessons: Lessons | None = None, steps: int = 120, rate: float = 0.05) -> None:
        """Adam on the mean log loss of ``rows`` and ``lessons`` with classes weighted evenly."""
        cost, target = np.zeros(self.n), np.zeros(self.n)
        n_rows = [max(1, int((y == c).sum())) for c in (0, 1)]
        part = [LESSON_SHARE if lessons is not None and lessons.count(c) else 0.0 for c in (0, 1)]
        cost[rows] = np.where(y == 1, (1 - part[1]) * 0.5 / n_rows[1], (1 - part[0]) * 0.5 / n_rows[0])
        target[rows] = y
        taught = cost[self.row] > 0
        row, index = self.row[taught], self.index[taught]
        size = 1 << self.bits
        in_good, in_all = np.bincount(index, target[row], size), np.bincount(index, minlength=size)
        telling = _telling(in_good, in_all - in_good, n_rows[1], n_rows[0])
        w, slope, bend = np.zeros(size + 1), 0.0, 0.0
        if any(part):
            w = lessons.at.copy()
            slope = sum(0.5 * part[c] / lessons.count(c) * lessons.slope[c] for c in (0, 1) if part[c])
            bend = sum(0.5 * part[c] / lessons.count(c) * lessons.bend[c] for c in (0, 1) if part[c])
            rows_of = [(lessons.seen[c, :-1], lessons.count(c)) if part[c] else ((in_all - in_good, in_good)[c], n_rows[c]) for c in (0, 1)]
            telling |= _telling(rows_of[1][0], rows_of[0][0], rows_of[1][1], rows_of[0][1])
        free = np.append(telling, True)
        w[~free] = 0
        begin = w.copy()
        use = telling[index]
        row, index = row[use], index[use]
        decay = np.append(np.full(size, self.decay), 0.0)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = np.bincount(row, w[index], self.n) + w[-1]
            g_row = cost * (_sigmoid(z) - target)
            g = np.append(np.bincount(index, g_row[row], size), g_row.sum()) + decay * w + (slope + bend * (w - begin)) * free
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            fix = math.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
            w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        self.weights, self.bias = w[:-1], float(w[-1])

    def calibrate(self, rows: np.ndarray, y: np.ndarray) -> None:
        self.scale, self.shift = _logistic(self.logits()[rows][:, None], y)

    def calibrated(self) -> np.ndarray:
        return self.logits() * self.scale + self.shift


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (one per column, then the constant) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _telling(in_good: np.ndarray, in_bad: np.ndarray, good: int, bad: int) -> np.ndarray:
    """Features seen often enough whose shares among good and bad rows differ beyond chance."""
    seen = in_good + in_bad
    share = seen / (good + bad)
    gap = in_good / good - in_bad / bad
    return (seen >= LEAST_SEEN) & (np.abs(gap) >= LEAST_SIGMAS * np.sqrt(share * (1 - share) * (1 / good + 1 / bad) + 1e-12))


def learn(sample: pd.DataFrame, lessons: dict[str, Lessons]) -> pd.DataFrame:
    """Fit both views on the bounded labelled sample (text, meta, label, fold) and on what each was taught.
    One row: text and meta (weights, bias, scale, shift, log odds of good among the rows checked), both."""
    y, fold = sample["label"].to_numpy(), sample["fold"].to_numpy()
    check, rest = np.flatnonzero(fold == 0), np.flatnonzero(fold != 0)
    out, told = {}, []
    prior = math.log((int(y[check].sum()) + 0.5) / (int((1 - y[check]).sum()) + 0.5))
    for name, bits, decay in (("text", TEXT_BITS, 1e-4), ("meta", META_BITS, 1e-3)):
        view = View(list(sample[name]), bits, decay)
        view.fit(rest, y[rest], lessons.get(name))
        view.calibrate(check, y[check])
        out[name] = [np.concatenate([view.weights, [view.bias, view.scale, view.shift, prior]]).tolist()]
        told.append(view.calibrated()[check])
    return pd.DataFrame(out | {"both": [_logistic(np.column_stack(told), y[check]).tolist()]})


def hand_over(rows: DataFrame, views: dict[str, np.ndarray]) -> dict[str, Lessons]:
    """What every row of ``rows`` that a view is sure of teaches the other view.

    One narrow pass and one aggregate; what is collected has at most two rows per feature slot of the views."""
    shared = rows.sparkSession.sparkContext.broadcast(views)            # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        sums = {v: {k: np.zeros((2, len(w) - 3), np.int64) for k in ("slope", "bend", "seen")} for v, w in now.items()}
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("body", "source", "lang", "n_chars")}
            found = {"text": [text_features(t) for t in c["body"]],
                     "meta": [meta_features(s, g, n, *_layout(t)) for s, g, n, t in zip(c["source"], c["lang"], c["n_chars"], c["body"])]}
            z = {v: np.array([now[v][f].sum() + now[v][-4] for f in found[v]]) for v in now}
            for teacher, student in (("text", "meta"), ("meta", "text")):
                scale, shift, prior = now[teacher][-3:]
                factor = z[teacher] * scale + shift - prior
                own = _sigmoid(z[student])
                for label, sure in ((0, factor <= -math.log(SURE)), (1, factor >= math.log(SURE))):
                    for i in np.flatnonzero(sure).tolist():
                        at, to = np.append(found[student][i], -1), sums[student]
                        to["slope"][label, at] += int(round((own[i] - label) * UNIT))
                        to["bend"][label, at] += len(at)
                        to["seen"][label, at] += 1
        for view, to in sums.items():
            label, slot = np.nonzero(to["seen"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([view] * len(slot), pa.string()), pa.array(label.astype(np.int32)), pa.array(slot.astype(np.int32)),
                 *(pa.array(to[k][label, slot]) for k in ("slope", "bend", "seen"))],
                ["view", "label", "slot", "slope", "bend", "seen"])

    got = (rows.mapInArrow(run, "view string, label int, slot int, slope long, bend long, seen long")
           .groupBy("view", "label", "slot").agg(*(F.sum(k).alias(k) for k in ("slope", "bend", "seen"))).toPandas())
    out = {}
    for view, w in views.items():
        mine, sums = got[got["view"] == view], {}
        for k in ("slope", "bend", "seen"):
            sums[k] = np.zeros((2, len(w) - 3), np.int64)
            sums[k][mine["label"], mine["slot"]] = mine[k]
        out[view] = Lessons(sums, w[:-4], w[-4])
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def column(name: str, kind: str):
        return (F.col(f"`{name}`").cast(kind) if name in docs.columns else F.lit(None).cast(kind)).alias(name)

    return docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("body"), column("source", "string"),
                       column("lang", "string"), column("n_chars", "long"))


def _layout(text: str) -> tuple[int, int]:
    lines = text.split("\n")
    return len(lines), max(map(len, lines))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Weights (text, meta, both), or None where the labels lack a class.

    At most FIT_ROWS labelled rows, taken by a hash of the id, are gathered in one task.  All rows of other
    ids, labelled or not, are the pool, which every round reads whole.  Labels with nulls are left out;
    of repeated labels the worst holds.  Rows with a null id are part of the pool."""
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), "quality", "toxic").dropna()
             .groupBy("id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
             .select("id", ((F.col("q") == 1) & (F.col("t") == 0)).cast("int").alias("label")))
    ids = stored(known.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS), "quality-labelled")
    rows = _rows(docs, id_col, text_col)
    # at most FIT_ROWS ids, so they are broadcast
    sample = rows.join(F.broadcast(ids), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("body")).limit(FIT_ROWS)
    pool = rows.join(F.broadcast(ids.select("id")), "id", "left_anti")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            text = [text_features(t) for t in c["body"]]
            meta = [meta_features(s, g, n, *_layout(t)) for s, g, n, t in zip(c["source"], c["lang"], c["n_chars"], c["body"])]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(text, pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.int32())), b.column("label"), b.column("fold")],
                ["id", "text", "meta", "label", "fold"])

    spread = stored(sample, "quality-sample").repartition(16, F.xxhash64("id"))
    id_type = spread.schema["id"].dataType.simpleString()
    table = stored(spread.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)).cast("int"))
                   .mapInArrow(features, f"id {id_type}, text array<int>, meta array<int>, label int, fold int"), "quality-features")
    if table.select("label", (F.col("fold") == 0)).distinct().count() < 4:
        return None
    lessons: dict[str, Lessons] = {}
    for r in range(ROUNDS):
        taught = docs.sparkSession.sparkContext.broadcast(lessons)      # fixed size

        def fitted(t: pd.DataFrame) -> pd.DataFrame:
            return learn(t.sort_values(["id", "label"], kind="stable"), taught.value)

        row = table.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
            fitted, "text array<double>, meta array<double>, both array<double>").first()
        views = {c: np.array(row[c]) for c in ("text", "meta")}
        if r < ROUNDS - 1:
            lessons = hand_over(pool, views)
            if not any(x.count(c) for x in lessons.values() for c in (0, 1)):
                break
    return *(np.append(w[:-4] * w[-3], w[-4] * w[-3] + w[-2]) for w in views.values()), np.array(row["both"])


def score(docs: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """(id, score, text_score, meta_score, keep) for every row, or every column of ``docs`` of the rows
    to keep (``with_row``).  Without weights nothing is known: score 1, kept.  Null text is empty."""
    names = docs.columns
    out = "score double, text_score double, meta_score double"
    rows = _rows(docs, id_col, text_col)
    if weights is None:
        one = [F.lit(1.0).alias(n) for n in ("score", "text_score", "meta_score")]
        return docs if with_row else rows.select(F.col("id").alias(id_col), *one, F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)          # fixed size

    def grade(body, source, lang, n_chars):
        w_text, w_meta, both = shared.value
        zs = []
        for t, s, g, n in zip(body, source, lang, n_chars):
            zs.append((w_text[text_features(t)].sum() + w_text[-1], w_meta[meta_features(s, g, n, *_layout(t))].sum() + w_meta[-1]))
        z = np.array(zs, np.float64).reshape(-1, 2)
        return _sigmoid(z @ both[:2] + both[2]), _sigmoid(z[:, 0]), _sigmoid(z[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = grade(*(b.column(n).to_pylist() for n in ("body", "source", "lang", "n_chars")))
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, got)], ["id", "score", "text_score", "meta_score"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(names)
            got = grade(*(b.column(n + k).to_pylist() for k in range(4)))
            keep = pa.array(got[0] >= KEEP_FROM)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:n]], [f"c{i}" for i in range(n)])

    if with_row:
        extra = [text_of(text_col).alias("__body"), *(
            (F.col(f"`{n}`").cast(k) if n in names else F.lit(None).cast(k)).alias(f"__{n}")
            for n, k in (("source", "string"), ("lang", "string"), ("n_chars", "long")))]
        schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
        return docs.select(*(F.col(f"`{n}`") for n in names), *extra).mapInArrow(sift, schema).toDF(*names)
    id_type = docs.schema[id_col].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {id_type}, {out}").withColumnRenamed("id", id_col)
            .withColumn("keep", F.col("score") >= KEEP_FROM))
