"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 entries drawn from a seeded generator keyed by its code point.  An n-gram's
vector binds (multiplies) the vectors of its letters, each permuted by its place in the n-gram;
a document's vector bundles (adds) those of its n-grams, and a language prototype bundles the
documents of that language.  A document gets the language whose prototype has the largest cosine.

Bundling is linear, so training adds up n-gram weights per language inside the tasks and only
one partial vector per language and task is shuffled.  Prediction is narrow.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

DIM = 1024
NGRAM = 3
SEED = 7
# Documents whose n-gram counts are multiplied at once, and the widest direct count table.
BATCH = 32
DIRECT = 1 << 17
UNKNOWN = "und"

_WORKER: dict[tuple, object] = {}


def letter_table() -> np.ndarray:
    """Code point -> lower-case letter, 0 for what is no letter; made once per worker."""
    if "letters" not in _WORKER:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _WORKER["letters"] = table
    return _WORKER["letters"]


def letter_vector(letter: int, place: int, dim: int, seed: int) -> np.ndarray:
    """The vector of a letter (0: the gap between words), rolled by its place in the n-gram."""
    key = (letter, place, dim, seed)
    if key not in _WORKER:
        bits = np.random.default_rng([seed, letter]).integers(0, 2, dim, dtype=np.int8)
        _WORKER[key] = np.roll(bits * 2 - 1, place).astype(np.float32)
    return _WORKER[key]


def gram_codes(text: str) -> np.ndarray:
    """Lower-case letters of ``text`` with runs of anything else as one gap, a gap at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = np.concatenate([[0], letter_table()[points], [0]])
    gap = letters == 0
    keep = np.ones(len(letters), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return letters[keep]


class Counts:
    """n-gram counts of a block of documents: (documents x n-grams) and the n-grams' letters."""

    def __init__(self, texts: list[str], ngram: int = NGRAM):
        docs = [gram_codes(t) for t in texts]
        self.has_letter = np.array([len(d) > 1 for d in docs], bool)
        alphabet, index = np.unique(np.concatenate(docs), return_inverse=True)
        base = len(alphabet)
        codes, at = [], 0
        for d in docs:
            x = index[at:at + len(d)].astype(np.int64)
            at += len(d)
            n = len(d) - ngram + 1
            c = np.zeros(max(0, n), np.int64)
            for k in range(ngram):
                c = c * base + x[k:k + len(c)]
            codes.append(c)
        if base ** ngram <= DIRECT:
            seen = np.unique(np.concatenate([np.flatnonzero(np.bincount(c, minlength=1)) for c in codes]))
            place = np.zeros(base ** ngram, np.int64)
            place[seen] = np.arange(len(seen))
            table = np.zeros((len(docs), len(seen)), np.float32)
            for i, c in enumerate(codes):
                table[i] = np.bincount(place[c], minlength=len(seen))
        else:
            seen, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            table, at = np.zeros((len(docs), len(seen)), np.float32), 0
            for i, c in enumerate(codes):
                table[i] = np.bincount(inverse[at:at + len(c)], minlength=len(seen))
                at += len(c)
        self.table = table
        self.grams = np.stack([alphabet[seen // base ** (ngram - 1 - k) % base] for k in range(ngram)]) if len(seen) else np.zeros((ngram, 0), np.int64)

    def vectors(self, dim: int, seed: int) -> np.ndarray:
        """(n-grams x dim): bound letter vectors."""
        out = np.ones((self.grams.shape[1], dim), np.float32)
        for k, letters in enumerate(self.grams):
            own, index = np.unique(letters, return_inverse=True)
            if len(own):
                out *= np.stack([letter_vector(int(x), k, dim, seed) for x in own])[index]
        return out


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM,
               seed: int = SEED) -> dict[str, np.ndarray]:
    """Language -> prototype vector; rows with a null language or no letter teach nothing.

    Each document weighs the same whatever its length.  The result has languages x dim numbers;
    nothing larger is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[str, dict[tuple, float]] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(texts), BATCH):
                counts = Counts(texts[i:i + BATCH])
                share = counts.table / np.maximum(counts.table.sum(axis=1, keepdims=True), 1)
                own = np.array(langs[i:i + BATCH])
                for lang in set(own[counts.has_letter].tolist()):
                    total = share[(own == lang) & counts.has_letter].sum(axis=0)
                    kept = weights.setdefault(lang, {})
                    for g in np.flatnonzero(total):
                        gram = tuple(counts.grams[:, g].tolist())
                        kept[gram] = kept.get(gram, 0.0) + float(total[g])
        for lang, kept in weights.items():
            vec = np.zeros(dim)
            grams = list(kept)
            for i in range(0, len(grams), 4096):
                part = grams[i:i + 4096]
                block = np.ones((len(part), dim), np.float32)
                for k in range(NGRAM):
                    block *= np.stack([letter_vector(g[k], k, dim, seed) for g in part])
                vec += np.array([kept[g] for g in part]) @ block
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(vec)], ["lang", "pos", "x"])

    partial = (docs.filter(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
               .select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text_of(text_col).alias("text"))
               .mapInArrow(run, "lang string, pos int, x double"))
    rows = stored(partial.groupBy("lang", "pos").agg(F.sum("x").alias("x")), "language-prototypes").collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(dim))[r["pos"]] = r["x"]
    return out


def predict(docs: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
            dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(id, lang_pred, score) for every row; only the text decides.  ``und`` with score 0 where the
    text is null or has no letter, or nothing was learned.  The score is the cosine, at least 0."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = sorted(learned)
    unit = np.stack([learned[n] / max(np.linalg.norm(learned[n]), 1e-12) for n in names]).astype(np.float32) if names else np.zeros((0, dim), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score = [], []
            for i in range(0, len(texts), BATCH):
                counts = Counts(texts[i:i + BATCH])
                vec = counts.table @ counts.vectors(dim, seed)
                cos = vec @ unit.T / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
                for has, c in zip(counts.has_letter, cos):
                    ok = bool(has) and len(names) > 0
                    best = int(np.argmax(c)) if ok else 0
                    lang.append(names[best] if ok else UNKNOWN)
                    score.append(min(1.0, max(0.0, float(c[best]))) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["id", "lang_pred", "score"])

    return (docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
            .mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col))


def held_out(id_col: str = "doc_id"):
    """Rows that teach nothing: crc32 of the id as text leaves 2 when divided by 4 (a null id teaches)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))
