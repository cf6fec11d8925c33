"""Packing by shortest-pack-first over the length histogram.

Documents become token ids, longer ones than a sequence are cut, and only the histogram of piece
lengths reaches the driver (at most `size` counts, whatever the data).  There, lengths are placed
longest first, each into the pack that is shortest so far, as counts of identical packing
patterns.  The patterns are joined back to the pieces by the rank of a piece among those of its
length.  Ranks are dealt per (length, salt) group with offsets, so a length that a third of all
documents share is numbered by many tasks.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import stored, text_of

SIZE = 4096
# Distinct pieces whose ids a Python worker keeps (memory bound).
CACHE = 400_000
# Rank groups per length.
SALTS = 64

# What a text is plain without: characters above U+017F and control characters other than white space, whose normal
# form, lower case or kind may need the vocabulary's own tables, and special tokens.
_ODD = re.compile("[^\t-\r -~\xa0-\xac\xae-\u012f\u0131-\u017f]|<[|]")
_LETTERS, _NUMBERS = ("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == kind) for kind in "LN")
# Fixed value: the pattern by which the vocabulary splits plain lower-case text.
_SPLIT = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_SHOWN = {b: c for c, b in byte_alphabet().items()}

_WORKER: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The tokenizer, its model alone, which of its ids end a piece, and the ids of known pieces."""
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        model = Tokenizer(tok.model)
        model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = tok.get_vocab(with_added_tokens=False)
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for t, i in vocab.items() if t.endswith(tok.model.end_of_word_suffix)]] = True
        _WORKER[path] = (tok, model, ends, {})
    return _WORKER[path]


def _cut(text: str) -> tuple[list[str], set[str]]:
    """``text`` in pieces that the vocabulary never merges across, and those of them that are not plain."""
    if not _ODD.search(text):
        return _SPLIT.findall(text.lower()), set()
    out, other = [], set()
    for chunk in text.encode("utf-8", "replace").split():       # ASCII white space
        chunk = chunk.decode()
        if not _ODD.search(chunk):
            out += _SPLIT.findall(chunk.lower())
        else:
            out.append(chunk)
            other.add(chunk)
    return out, other


def token_bytes(path: str, text: str) -> bytes:
    """Ids of ``text`` as little-endian unsigned 32-bit integers.

    The vocabulary lowers letters, drops white space and splits letters from numbers and marks, and never
    merges across; so the ids of a text are those of its pieces.  A worker encodes each distinct piece
    once.  The new pieces of a text go through the tokenizer's model together, without its normaliser and
    splitter, which would leave them as they are; the last id of each tells where it ends.  Chunks between
    white space that are not plain go through the whole tokenizer."""
    tok, model, ends, known = _tokenizer(path)
    if len(known) > CACHE:
        known.clear()
    parts, other = _cut(text)
    ids = list(map(known.get, parts))
    if None in ids:
        new = {c for c, x in zip(parts, ids) if x is None}
        if other:
            whole = list(new & other)
            for chunk, enc in zip(whole, tok.encode_batch_fast(whole, add_special_tokens=False)):
                known[chunk] = array("I", enc.ids).tobytes()
            new -= other
        if new:
            shown = " ".join([x if x.isascii() else x.encode().decode("latin-1").translate(_SHOWN) for x in new])
            found = np.array(model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            cut = ((np.flatnonzero(ends[found]) + 1) * 4).tolist()
            if len(cut) != len(new):
                raise ValueError("the vocabulary does not end every piece")
            code = found.tobytes()
            known.update(zip(new, map(code.__getitem__, map(slice, [0, *cut], cut))))
        ids = [known[c] if x is None else x for c, x in zip(parts, ids)]
    return b"".join(ids)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int = SIZE, id_col: str = "doc_id",
           text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, *keep): documents of more than ``size`` tokens
    are cut at multiples of it.  Null text counts as empty: one piece with the end id alone."""
    cols = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep)]
    cols[0] = f"id {docs.schema[id_col].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column(0).to_pylist()):
                ids = token_bytes(vocabulary, text) + end
                n = len(ids) // 4
                for s in range(0, n, size):
                    part = ids[4 * s:4 * (s + size)]
                    row.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            at = pa.array(row, pa.int64())
            rest = [c.take(at) for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays(
                [rest[0], *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), *rest[1:]],
                ["id", "start", "length", "ids_crc32", "doc_tokens", *keep])

    schema = f"{cols[0]}, start long, length long, ids_crc32 long, doc_tokens long" + "".join(f", {c}" for c in cols[1:])
    return docs.select(text_of(text_col).alias("__text"), F.col(f"`{id_col}`").alias("id"),
                       *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: (count, lengths longest first) per packing pattern.

    ``room`` maps free space to patterns with that much room; the shortest pack is the one with
    the most.  Work and result are bounded by ``size``, not by the counts."""
    room: dict[int, list[tuple[int, list[int]]]] = {}
    most = 0

    def put(count: int, pack: list[int], free: int) -> int:
        room.setdefault(free, []).append((count, pack))
        return max(most, free)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not room.get(most):
                most -= 1
            if most >= length:              # the shortest pack takes one
                n, pack = room[most].pop()
                if n > left:
                    most = put(n - left, pack, most)
                    n = left
                most = put(n, [*pack, length], most - length)
                left -= n
            else:                           # none has room: copies fill packs of their own
                per = min(left, size // length)
                most = put(left // per, [length] * per, size - per * length)
                left %= per
    return [(n, pack) for packs in room.values() for n, pack in packs]


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to ``cut`` (id, start, length and other columns).

    Which of the pieces of equal length takes which slot is settled by id and start.  An empty
    table stays empty; rows that repeat an id are pieces of their own."""
    spark = cut.sparkSession
    salted = stored(cut.withColumn("__salt", F.pmod(F.xxhash64("id", "start"), F.lit(SALTS))), "pack-pieces")
    groups = salted.groupBy("length", "__salt").count().collect()      # at most size x SALTS rows
    histogram: dict[int, int] = {}
    base = []
    for r in sorted(groups, key=lambda r: (r["length"], r["__salt"])):
        base.append((r["length"], r["__salt"], histogram.get(r["length"], 0)))
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["count"]

    # For each length, runs of ranks that share a pattern and a place in it.
    first, runs = 0, {}
    for n, lens in sorted(patterns(histogram, size), key=lambda x: (-sum(x[1]), x[1])):
        offset = 0
        for length in lens:
            runs.setdefault(length, []).append((n, first, offset))
            offset += length
        first += n
    lookup = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}
    lookup = {k: (np.cumsum(n) - n, s, o) for k, (n, s, o) in lookup.items()}
    shared = spark.sparkContext.broadcast(lookup)                      # bounded by size x size

    bases = F.broadcast(spark.createDataFrame(base, "length long, __salt long, __base long"))
    ranked = salted.join(bases, ["length", "__salt"]).withColumn(
        "__rank", F.col("__base") + F.row_number().over(
            Window.partitionBy("length", "__salt").orderBy("id", "start", "ids_crc32")) - 1)
    names = [c for c in cut.columns]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(len(names)).to_numpy()
            rank = b.column(len(names) + 1).to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                starts, firsts, offsets = shared.value[int(x)]
                of = np.flatnonzero(length == x)
                k = np.searchsorted(starts, rank[of], "right") - 1
                seq[of] = firsts[k] + rank[of] - starts[k]
                off[of] = offsets[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(seq), pa.array(off)],
                                             [*names, "sequence_id", "offset"])

    return (ranked.select(*names, F.col("length").alias("__length"), "__rank")
            .mapInArrow(run, f"{out}, sequence_id long, offset long"))
