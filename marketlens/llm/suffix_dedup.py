"""Suffix-array dedup: remove bytes of strings that occur again.

Which suffixes can share `SPAN` bytes with another is found by content: every SPAN-byte window
selects the GRAM-byte strings in it with the least hash (its anchors), so equal windows select equal
anchors at equal offsets.  Only anchors that occur again matter.  Around each, the bytes that its
windows can reach (its context) are gathered; equal contexts collapse before the shuffle, and those
that occur twice are repeated throughout.

Distinct contexts of an anchor go to one suffix sort, the bytes from the anchor on and the reversed
bytes before it: suffixes are compared by their longest common extension, found by binary search
over prefix polynomial hashes, so a comparison takes a logarithmic number of steps; a mergesort of
a whole batch runs vectorised, and the extensions of neighbours are verified byte by byte.  Anchors
with more than `GROUP` distinct contexts are sorted in chunks; what a chunk leaves open is settled
between the chunks by aggregates over digests, so no anchor has to fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored, text_of

SPAN = 200
GRAM = 100
GROUP = 2048
# Contexts that are sorted together, and offsets per block of windows between chunks.
BATCH = 8192
OFFSETS = 8
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_BLOCKS = pa.struct([("block", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("windows", pa.list_(pa.struct(
    [("offset", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("open", pa.bool_())])))])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n, kept by the worker."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64)])
                         for b in (base, inverse))
        _POWERS[base] = have
    return have


def prefix_hashes(data: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of every prefix of ``data`` modulo 2^64."""
    up, _ = powers(len(data), base)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, length, base: int = _BASE) -> np.ndarray:
    """Hash of data[start:start + length], the same wherever the bytes stand."""
    _, down = powers(len(prefix), base)
    return (prefix[start + length] - prefix[start]) * down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return x if have == width else pick(x[:len(x) - (width - have)], x[width - have:])


def anchors(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: grams that are least in some window of ``span`` bytes."""
    n = len(data) - gram + 1
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hashes(data)
    key = mixed(range_hashes(prefix, np.arange(n), gram))
    width = span - gram + 1
    least = sliding(key, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate([edge, least, edge]), width, np.maximum)[:n]
    at = np.flatnonzero(best == key)
    return at, key[at]


def reach(at: np.ndarray, size: int, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and from each anchor that windows over it can cover."""
    return np.minimum(at, span - gram), np.minimum(size - at, span)


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Longest common extension of the suffixes at a and b, up to ``limit`` each, by binary search."""
    low = np.zeros(len(a), np.int64)
    step = 1 << (int(limit.max(initial=1)).bit_length() - 1)
    while step:
        to = low + step
        probe = np.where(to <= limit, to, 0)
        same = range_hashes(prefix, a, probe) == range_hashes(prefix, b, probe)
        low = np.where((to <= limit) & same, to, low)
        step >>= 1
    return low


def before(data: np.ndarray, prefix: np.ndarray, a, b, size_a, size_b, ties: bool) -> np.ndarray:
    """Whether the suffix at a (of size_a bytes) sorts before that at b (``ties``: or is equal)."""
    least = np.minimum(size_a, size_b)
    shared = common_extension(prefix, a, b, least)
    end = shared >= least
    at = np.where(end, 0, shared)
    tail = size_a <= size_b if ties else size_a < size_b
    last = len(data) - 1                                       # an empty suffix may stand at the end
    return np.where(end, tail, data[np.minimum(a + at, last)] < data[np.minimum(b + at, last)])


def suffix_sort(data: np.ndarray, prefix: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``start`` (``size`` bytes each) by key, then bytes: a mergesort in which all
    merges of a level run at once.  Each suffix finds its rank in the run beside its own by binary
    search."""
    order = np.argsort(key, kind="stable")
    group = key[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    members = np.diff(np.append(first, len(group)))
    base, total = np.repeat(first, members), np.repeat(members, members)
    here = np.arange(len(group)) - base
    width = 1
    while width < members.max(initial=0):
        run = here // width
        mate = (run ^ 1) * width                               # the neighbouring run of the same key
        rows = np.flatnonzero(total > mate)
        low, high = np.zeros(len(rows), np.int64), np.minimum(total - mate, width)[rows]
        left = ((run & 1) == 0)[rows]
        go = np.arange(len(rows))
        while len(go):
            mid = (low[go] + high[go]) // 2
            mine = order[rows[go]]
            other = order[base[rows[go]] + mate[rows[go]] + mid]
            # of equal suffixes the left run's come first
            later = np.where(left[go],
                             before(data, prefix, start[other], start[mine], size[other], size[mine], False),
                             before(data, prefix, start[other], start[mine], size[other], size[mine], True))
            low[go] = np.where(later, mid + 1, low[go])
            high[go] = np.where(later, high[go], mid)
            go = go[low[go] < high[go]]
        place = base + here
        place[rows] = base[rows] + np.minimum(run[rows] * width, mate[rows]) + here[rows] % width + low
        moved = np.empty_like(order)
        moved[place] = order
        order = moved
        width *= 2
    return order


def neighbours(data: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of (key, suffix) and the longest common extension of each entry with the one before
    it (0 where the key changes).  What the hashes call common is verified byte by byte."""
    prefix = prefix_hashes(data)
    order = suffix_sort(data, prefix, key, start, size)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        most = np.where(key[a] == key[b], np.minimum(size[a], size[b]), 0)
        lcp[1:] = common_extension(prefix, start[a], start[b], most)
        for i in range(1, len(order), 8192):
            k = np.arange(i, min(i + 8192, len(order)))
            ahead = np.arange(int(lcp[k].max(initial=0)))
            x = np.minimum(start[order[k - 1]][:, None] + ahead, len(data) - 1)
            y = np.minimum(start[order[k]][:, None] + ahead, len(data) - 1)
            wrong = (data[x] != data[y]) & (ahead < lcp[k][:, None])
            bad = np.flatnonzero(wrong.any(axis=1))
            if len(bad):
                lcp[k[bad]] = wrong[bad].argmax(axis=1)
    return order, lcp


def equal_windows(data: np.ndarray, key: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray,
                  span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every offset before the anchors: (offset, contexts whose window starts there and fits, whether
    another context of the same key has the same window, the first of its equals).

    Two windows are equal if the contexts agree far enough to the right and to the left of the anchor.
    The suffix array of the right sides and that of the reversed left sides are cut into classes
    where a common extension falls short; a pair of class numbers names a window."""
    n = len(anchor)
    r_order, r_lcp = neighbours(data, key, anchor, right)
    l_order, l_lcp = neighbours(data[::-1].copy(), key, len(data) - anchor, left)
    new_key = np.zeros(n, bool)
    new_key[1:] = key[l_order[1:]] != key[l_order[:-1]]
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(span - gram + 1):
        right_class[r_order] = np.cumsum(r_lcp < span - offset)
        left_class[l_order] = np.cumsum((l_lcp < offset) | new_key)
        fits = np.flatnonzero((left >= offset) & (right >= span - offset))
        if not len(fits):
            continue
        _, first, inverse, count = np.unique(right_class[fits] * (n + 1) + left_class[fits], return_index=True,
                                             return_inverse=True, return_counts=True)
        yield offset, fits, count[inverse] > 1, fits[first[inverse]]


def runs(row: np.ndarray, offset: np.ndarray, n: int, span: int = SPAN) -> list[list[int]]:
    """Per context: covered bytes relative to the anchor as flat from, to pairs."""
    out: list[list[int]] = [[] for _ in range(n)]
    order = np.lexsort((-offset, row))
    r, at = row[order], -offset[order]
    if len(r):
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (at[1:] > at[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(r)) - 1
        for i, x, y in zip(r[first].tolist(), at[first].tolist(), (at[last] + span).tolist()):
            out[i] += [x, y]
    return out


def _digest(prefix: np.ndarray, second: np.ndarray, start: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
    return (mixed(range_hashes(prefix, start, length)).view(np.int64),
            mixed(range_hashes(second, start, length, _BASE2)).view(np.int64))


def _doc_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, at, key = [], [], []
        for i, t in enumerate(b.column(2).to_pylist()):
            p, k = anchors(np.frombuffer(t.encode("utf-8", "replace"), np.uint8))
            rows.append(np.full(len(p), i))
            at.append(p)
            key.append(k)
        take = pa.array(np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(at).astype(np.int64)),
             pa.array(np.concatenate(key).view(np.int64))], ["id", "th", "at", "anchor"])


def _doc_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the anchors of each text, at most BATCH of one text at a time: a long text whose every
    byte recurs has about as many contexts as bytes."""
    for b in batches:
        parts, raws, rows = [], [], 0
        for i in range(b.num_rows):
            raw = b.column(2)[i].as_py().encode("utf-8", "replace")
            data = np.frombuffer(raw, np.uint8)
            spots = np.unique(b.column(3)[i].values.to_numpy(zero_copy_only=False).astype(np.int64))
            prefix, second = prefix_hashes(data), prefix_hashes(data, _BASE2)
            for from_ in range(0, len(spots), BATCH):
                at = spots[from_:from_ + BATCH]
                left, right = reach(at, len(data))
                c1, c2 = _digest(prefix, second, at - left, left + right)
                c1 ^= mixed(left.astype(np.uint64) + np.uint64(1)).view(np.int64)  # where the anchor stands is part of it
                key = mixed(range_hashes(prefix, at, GRAM)).view(np.int64)
                parts.append((np.full(len(at), i, np.int64), at, key, c1, c2, left))
                raws += [raw[p:q] for p, q in zip((at - left).tolist(), (at + right).tolist())]
                rows += len(at)
                if rows >= BATCH:
                    yield _context_batch(b, parts, raws)
                    parts, raws, rows = [], [], 0
        if parts:
            yield _context_batch(b, parts, raws)


def _context_batch(b: pa.RecordBatch, parts: list[tuple], raws: list[bytes]) -> pa.RecordBatch:
    row, *columns = (np.concatenate(x) for x in zip(*parts))
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [b.column(0).take(take), b.column(1).take(take), *map(pa.array, columns), pa.array(raws, pa.binary())],
        ["id", "th", "at", "anchor", "c1", "c2", "before", "context"])


def _whole_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows ordered by (anchor, chunk), cut between groups into tables of about ``limit`` rows."""
    kept = None
    for b in batches:
        t = pa.Table.from_batches([b])
        kept = t if kept is None else pa.concat_tables([kept, t])
        if kept.num_rows < limit:
            continue
        a, c = kept["anchor"].to_numpy(), kept["chunk"].to_numpy()
        new = np.flatnonzero((a[1:] != a[:-1]) | (c[1:] != c[:-1]))
        if len(new):
            cut = int(new[-1]) + 1
            yield kept.slice(0, cut)
            kept = kept.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort the contexts of each (anchor, chunk): covered runs, and what chunks leave open.

    `rest` holds, of anchors with several chunks, the windows that are alone in their chunk and one of
    each class that is not, in blocks of offsets; a block carries the digest of the bytes that all
    its windows share, so that only blocks with a partner are ever opened."""
    for t in _whole_groups(batches, BATCH):
        contexts = t["context"].to_pylist()
        left = t["before"].to_numpy()
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(contexts), np.uint8)
        a, c = t["anchor"].to_numpy(), t["chunk"].to_numpy()
        key = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (c[1:] != c[:-1]))])
        twice = t["n"].to_numpy() > 1
        split = t["chunks"].to_numpy() > 1
        at = begin + left
        rows, offsets, open_row, open_offset, is_open = [], [], [], [], []
        for offset, fits, again, first in equal_windows(data, key, at, left, size - left):
            again |= twice[fits]
            rows.append(fits[again])
            offsets.append(np.full(int(again.sum()), offset))
            lone = split[fits] & (~again | (first == fits))
            if lone.any():
                open_row.append(fits[lone])
                open_offset.append(np.full(int(lone.sum()), offset))
                is_open.append(~again[lone])
        none = np.zeros(0, np.int64)
        found = runs(np.concatenate([none, *rows]), np.concatenate([none, *offsets]), len(contexts))
        rest: list[list[dict]] = [[] for _ in contexts]
        if open_row:
            row, offset, free = (np.concatenate(x) for x in (open_row, open_offset, is_open))
            order = np.lexsort((offset, row))
            row, offset, free = row[order], offset[order], free[order]
            prefix, second = prefix_hashes(data), prefix_hashes(data, _BASE2)
            w1, w2 = _digest(prefix, second, at[row] - offset, SPAN)
            block = offset // OFFSETS
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
            k1, k2 = _digest(prefix, second, at[row[cut]] - block[cut] * OFFSETS, SPAN - OFFSETS + 1)
            for i, (x, y) in enumerate(zip(cut.tolist(), np.append(cut[1:], len(row)).tolist())):
                rest[row[x]].append({"block": int(block[x]), "k1": int(k1[i]), "k2": int(k2[i]), "windows": [
                    {"offset": o, "w1": p, "w2": q, "open": f} for o, p, q, f in
                    zip(offset[x:y].tolist(), w1[x:y].tolist(), w2[x:y].tolist(), free[x:y].tolist())]})
        yield pa.RecordBatch.from_arrays(
            [t[k].combine_chunks() for k in ("anchor", "c1", "c2")] +
            [pa.array(found, pa.list_(pa.int32())), pa.array(rest, pa.list_(_BLOCKS))],
            ["anchor", "c1", "c2", "spans", "rest"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): per document with repeated strings, the flat from, to pairs of covered bytes
    (they may overlap); th is the XXH64 of the text, which tells rows that repeat an id apart."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).select(
        "id", F.xxhash64("text").alias("th"), "text")
    id_type = base.schema["id"].dataType.simpleString()
    found = stored(base.filter(F.octet_length("text") >= SPAN).mapInArrow(
        _doc_anchors, f"id {id_type}, th long, at long, anchor long"), "suffix-anchors")
    again = stored(found.groupBy("anchor").count().filter("count > 1").select("anchor"), "suffix-again")
    spots = (found.join(again, "anchor").groupBy("id", "th").agg(F.collect_list("at").alias("spots")))
    spots = stored(spots, "suffix-spots")
    release(found, again)
    schema = f"id {id_type}, th long, at long, anchor long, c1 long, c2 long, before long, context binary"
    near = stored(base.join(spots, base["id"].eqNullSafe(spots["id"]) & (base["th"] == spots["th"]))
                  .select(base["id"], base["th"], base["text"], "spots").mapInArrow(_doc_contexts, schema), "suffix-contexts")

    distinct = stored(near.groupBy("anchor", "c1", "c2", "before", "context").agg(F.count("*").alias("n")), "suffix-distinct")
    several = stored(distinct.groupBy("anchor").agg(F.count("*").alias("m"), F.max("n").alias("most"))
                     .filter("m > 1 or most > 1"), "suffix-several")
    release(spots)
    chunks = F.ceil(F.col("m") / GROUP)
    dealt = (distinct.join(several.select("anchor", chunks.alias("chunks")), "anchor")
             .withColumn("chunk", F.pmod(F.xxhash64("c1", "c2"), F.col("chunks"))))
    sorted_ = stored(
        dealt.select("anchor", "chunk", "chunks", "c1", "c2", "before", "context", "n")
        .repartition(F.col("anchor"), F.col("chunk")).sortWithinPartitions("anchor", "chunk", "c1", "c2")
        .mapInArrow(_sort_contexts, "anchor long, c1 long, c2 long, spans array<int>, rest array<struct<block: int, k1: long, "
                                    "k2: long, windows: array<struct<offset: int, w1: long, w2: long, open: boolean>>>>"),
        "suffix-sorted")
    release(distinct, several)
    blocks = stored(sorted_.filter(F.size("rest") > 0).select("anchor", "c1", "c2", F.inline("rest")), "suffix-blocks")
    paired = stored(blocks.groupBy("anchor", "block", "k1", "k2").count().filter("count > 1").drop("count"), "suffix-paired")
    rest = stored(blocks.join(paired, ["anchor", "block", "k1", "k2"]).select("anchor", "c1", "c2", F.inline("windows")), "suffix-rest")
    shared = stored(rest.groupBy("anchor", "offset", "w1", "w2").count().filter("count > 1").drop("count"), "suffix-between")
    more = (rest.filter("open").join(shared, ["anchor", "offset", "w1", "w2"])
            .select("anchor", "c1", "c2", F.array(-F.col("offset"), SPAN - F.col("offset")).alias("spans")))
    verdicts = stored(sorted_.filter(F.size("spans") > 0).select("anchor", "c1", "c2", "spans").unionAll(more)
                      .groupBy("anchor", "c1", "c2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "suffix-verdicts")
    release(sorted_, blocks, paired, rest, shared)
    spans = stored(near.select("id", "th", "at", "anchor", "c1", "c2").join(verdicts, ["anchor", "c1", "c2"])
                   .select("id", "th", F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
                   .groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")), "suffix-spans")
    release(near, verdicts)
    return spans


def cut_out(text: str, spans: list[int] | None) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, removed runs, kept bytes)."""
    raw = text.encode("utf-8", "replace")
    if not spans:
        return len(raw), 0, 0, raw
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), begins, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    spans = repeats(docs, id_col, text_col).toDF("__id", "__th", "__spans")
    own = docs.withColumn("__text", text_of(text_col)).withColumn("__hash", F.xxhash64("__text"))
    return own.join(spans, own[f"`{id_col}`"].eqNullSafe(spans["__id"]) & (own["__hash"] == spans["__th"]), "left"), spans


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty; texts under SPAN bytes are kept whole.  Matches never cross rows; rows
    that repeat an id are texts of their own."""
    joined, _ = _with_spans(docs.select(id_col, text_col), id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [cut_out(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in range(3)),
                 pa.array([hashlib.sha256(g[3]).hexdigest() for g in got], pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (joined.select(F.col(f"`{id_col}`").alias("id"), "__text", "__spans")
            .mapInArrow(run, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
            .withColumnRenamed("id", id_col))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; a character that loses a byte goes whole.
    Rows whose text has no repeats, null texts included, stay as they are."""
    joined, _ = _with_spans(docs, id_col, text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if not s else cut_out(t, s)[3].decode("utf-8", "ignore")
                   for t, s in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())]
            cols = [pa.array(out, pa.string()) if n == text_col else c for n, c in zip(names, b.columns)]
            yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(names))])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return (joined.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text_col}`").alias("__kept"), "__spans")
            .mapInArrow(run, schema).toDF(*names))
