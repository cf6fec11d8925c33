"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q and at least max(SHORTEST, REPEATS * q)
words that no neighbouring word extends.  At each dyadic scale L the words are cut into blocks of L.
The sums of squared differences between a block and the window that follows it, at distances
L .. 2L - 1 (from 1 on at the lowest scale), come from number-theoretic transforms modulo as many
primes as the largest possible sum needs, so they are exact integers: a sum is zero if and only if
the block occurs there without mismatch.  The distances found are candidate periods; each seeds one
extension to both sides, and a stretch counts if no proper divisor of its distance is a period too.

Why nothing is missed: a run of period q with L <= q < 2L has at least 2q >= 2L - 1 starting points
whose words come again q later, so an aligned block of L lies among them.

Two exact screens spare transforms: a block with a word that does not come again within 2L - 1 words
occurs nowhere in its window, and a block that lies with its whole window inside a run of smaller
period gives multiples of that period only.

Scale: narrow, no shuffle; a task holds one group of documents (at most GROUP_BYTES of text, or one
longer document) and transforms of at most CELLS values at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SHORTEST = 24
REPEATS = 3
#: Length of the blocks of the lowest scale; their distances start at 1.
LOWEST = 8
GROUP_BYTES = 4 << 20
CELLS = 1 << 19
# Primes of the form c * 2^k + 1 and a generator of their multiplicative groups.
PRIMES = ((998244353, 3), (469762049, 3), (167772161, 3))


@lru_cache(maxsize=64)
def _powers(prime: int, generator: int, size: int, inverse: bool) -> np.ndarray:
    """The first size / 2 powers of a root of unity of order ``size`` (or of its inverse)."""
    root = pow(generator, (prime - 1) // size, prime)
    if inverse:
        root = pow(root, prime - 2, prime)
    out = np.ones(1, np.uint64)
    step = root
    while len(out) < size // 2:
        out = np.concatenate([out, out * np.uint64(pow(step, len(out), prime)) % np.uint64(prime)])
    return out


def _transform(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transform of each column, in bit-reversed order of the frequencies."""
    n, rows = x.shape
    p = np.uint64(prime)
    half = n // 2
    while half:
        x = x.reshape(n // (2 * half), 2, half, rows)
        u, v = x[:, 0], x[:, 1]
        w = _powers(prime, generator, 2 * half, False)[:, None]
        x = np.stack([(u + v) % p, (u + p - v) * w % p], 1)
        half //= 2
    return x.reshape(n, rows)


def _back(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Inverse of ``_transform``, from bit-reversed to natural order."""
    n, rows = x.shape
    p = np.uint64(prime)
    half = 1
    while half < n:
        x = x.reshape(n // (2 * half), 2, half, rows)
        u, v = x[:, 0], x[:, 1] * _powers(prime, generator, 2 * half, True)[:, None] % p
        x = np.stack([(u + v) % p, (u + p - v) % p], 1)
        half *= 2
    return x.reshape(n, rows) * np.uint64(pow(n, prime - 2, prime)) % p


def mismatches_zero(block: np.ndarray, window: np.ndarray, highest: int) -> np.ndarray:
    """(lags, rows) flags: the block (a column of length L) equals the window at this lag.

    ``window`` has L - 1 more rows than there are lags; values are integers from 0 to ``highest``.
    The sum of squared differences, sum b^2 + sum w^2 - 2 sum b w, is taken modulo enough primes
    that only zero is zero in all of them."""
    length, rows = block.shape
    lags = len(window) - length + 1
    size = 1 << max(1, (len(window) - 1).bit_length())
    found, left = np.ones((lags, rows), bool), length * highest * highest
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        b, w = block.astype(np.uint64) % p, window.astype(np.uint64) % p
        a = np.zeros((size, rows), np.uint64)
        a[(-np.arange(length)) % size] = b
        c = np.zeros((size, rows), np.uint64)
        c[:len(window)] = w
        product = _back(_transform(a, prime, generator) * _transform(c, prime, generator) % p, prime, generator)[:lags]
        run = np.concatenate([np.zeros((1, rows), np.uint64), np.cumsum(w * w % p, 0, dtype=np.uint64)])
        squares = (run[length:] - run[:lags]) % p + (b * b % p).sum(0, dtype=np.uint64) % p
        found &= (squares + np.uint64(2) * (p - product)) % p == 0
        left //= prime
        if not left:
            return found
    raise ValueError("too many different words for the primes")


def occurrences(t: np.ndarray, starts: np.ndarray, length: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(start of the block, distance) for distances low .. high - 1 at which the block occurs."""
    step = max(1, CELLS // (2 * (high - low + length)))
    reach = np.arange(high - low + length - 1)[:, None]
    top = int(t.max(initial=0))
    for k in range(0, len(starts), step):
        s = starts[None, k:k + step]
        lag, row = np.nonzero(mismatches_zero(t[s + np.arange(length)[:, None]], t[s + low + reach], top))
        at = s[0][row]
        order = np.lexsort((lag, at))
        yield from zip(at[order].tolist(), (lag[order] + low).tolist())


def _same_forward(t: np.ndarray, i: int, d: int) -> int:
    """First position from i on whose word differs from the word d later (a separator always does)."""
    step = 64
    while True:
        later = t[i + d:i + d + step]
        differ = t[i:i + len(later)] != later
        if differ.any():
            return i + int(differ.argmax())
        i, step = i + step, step * 2


def _same_backward(t: np.ndarray, i: int, d: int) -> int:
    """Least position such that all words from there to i equal the words d later."""
    step = 64
    while i:
        low = max(0, i - step)
        differ = t[low:i] != t[low + d:i + d]
        if differ.any():
            return i - int(differ[::-1].argmax())
        i, step = low, step * 2
    return 0


@lru_cache(maxsize=4096)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return (*out, n) if n > 1 else tuple(out)


def _smallest(t: np.ndarray, start: int, end: int, d: int) -> bool:
    """No proper divisor of d is a period of the stretch (which has d as a period and 2d words)."""
    return not any(np.array_equal(t[start:end - d // f], t[start + d // f:end]) for f in _prime_factors(d))


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers from 1 on; 0 separates documents.

    Sorted by start, then period."""
    n = len(ids)
    if n < SHORTEST:
        return []
    # distance to the next occurrence of the same word; none, or a separator: out of reach
    order = np.argsort(ids, kind="stable")
    far = np.iinfo(np.int64).max // 2
    gap = np.full(n, far)
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    gap[ids == 0] = far
    runs: dict[tuple[int, int], int] = {}
    reach = np.zeros(n + 1, np.int64)
    # 0 stands for "no word" after the end, as between documents
    t = np.concatenate([[0], ids, np.zeros(1, ids.dtype)])
    length = LOWEST
    widest = gap[:n // length * length].reshape(-1, length).max(1)
    while len(widest) and length * REPEATS <= max(n, LOWEST * REPEATS):
        starts = np.nonzero(widest < 2 * length)[0] * length
        within = np.maximum.accumulate(reach)
        starts = starts[within[starts] < np.minimum(starts + 3 * length, n)]
        if len(starts):
            low = 1 if length == LOWEST else length
            need = int(starts[-1]) + 1 + 3 * length + 1
            t_wide = np.concatenate([t, np.zeros(max(0, need - len(t)), t.dtype)])
            seen: dict[int, int] = {}
            for at, d in occurrences(t_wide, starts + 1, length, low, 2 * length):
                if at + length + d <= seen.get(d, 0):
                    continue
                end = _same_forward(t_wide, at, d)
                if end < at + length:
                    continue
                start, end = _same_backward(t_wide, at, d), end + d
                seen[d] = end
                if end - start >= max(SHORTEST, REPEATS * d) and _smallest(t_wide, start, end, d):
                    runs[start - 1, d] = end - start
                    reach[start - 1] = max(reach[start - 1], end - 1)
        length *= 2
        even = widest[:len(widest) // 2 * 2].reshape(-1, 2)
        widest = even.max(1)
    return sorted((s, m, q) for (s, q), m in runs.items())


def _document_runs(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs, collapsed text) of each text of one group."""
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    split = [t.split() for t in texts]  # of bytes: at 0x20 and 0x09-0x0D only
    total = sum(map(len, split)) + len(split)
    ids = np.zeros(total, np.int64)
    offsets, at = [], 0
    for words in split:
        offsets.append(at)
        ids[at:at + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        at += len(words) + 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in split]
    runs = find_runs(ids)
    for (s, m, q), k in zip(runs, np.searchsorted(offsets, [r[0] for r in runs], "right") - 1):
        found[k].append((s - offsets[k], m, q))
    for words, mine in zip(split, found):
        if mine:
            gone = np.zeros(len(words), bool)
            for s, m, q in mine:
                gone[s + q:s + m] = True
            kept = [words[i] for i in np.nonzero(~gone)[0]]
        else:
            kept = words
        yield len(words), mine, b" ".join(kept)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, runs (array of start, length, period in words from 0,
    sorted by start, then period) and collapsed (the words joined by one space without those that
    a run holds after its first period).

    Words are separated by 0x20 and 0x09-0x0D.  Null and blank texts have no words, no runs and an empty
    collapsed text; repeated rows and null or repeated ids are rows of their own; an empty table
    gives no rows; other columns are ignored, whatever their names."""
    id_type = docs.schema[id_col].dataType
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            first, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= GROUP_BYTES or k == len(texts) - 1:
                    n, runs, rest = zip(*_document_runs(texts[first:k + 1]))
                    runs = [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(first, k + 1 - first), pa.array(n, pa.int64()), pa.array(runs, run_type),
                         pa.array(rest, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])
                    first, size = k + 1, 0

    schema = (f"id {id_type.simpleString()}, n_words long, "
              "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return (docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
            .mapInArrow(run, schema).withColumnRenamed("id", id_col))


def with_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with a periodic tail in a tenth of the documents, chosen by the id's checksum.

    h = crc32(decimal id), g = h div 10.  Where h mod 10 is 0 and there are n > 0 words, each word
    i >= a becomes word a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    Other texts, and those of null ids, stay as they are.  Native expressions."""
    h = F.crc32(F.col("id").cast("string").cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).select(
        "id", "text", F.expr("0").alias("zero"), F.floor(h / 10).cast("long").alias("g"),
        F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.expr("(size(words) - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(sequence(0, size(words) - 1), "
                     "i -> words[cast(if(i >= a, a + (i - a) % p, i) as int)]), ' ')")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias(text_col))


def digests(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the op11 query from the rows of ``periodic_runs``: the run with the greatest
    length / period (compared exactly; ties: smallest start, then period) and digests of all runs
    and of the collapsed text."""
    best = F.expr("""aggregate(runs, runs[0], (b, x) ->
        if(x.length * b.period > b.length * x.period, x, b))""")
    listed = F.expr(r"array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), '\n')), '')")
    rows = runs.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start"), F.col("best.length"), F.col("best.period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode(F.col("collapsed"), "UTF-8"), 256).alias("collapsed_sha256"))
