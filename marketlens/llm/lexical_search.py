"""Ranked lexical search with bag deduplication.

Documents are reduced to bags: the occurrences of the terms that some item holds, and the length norm
m.  Rows with the same (m, term, occurrence) vector score alike for every item, so they form one
class: classes are found by a hash of the vector and verified by the vector itself, each class is
scored once, and its members are put back by ascending id.

Scores are 64-bit integers (see ``search``).  A document of rank k or better lies in one of the first
k classes (by score, then by the class's smallest id), and is one of the first k members of its class, so
both are cut there: the cut drops nothing that could be returned.

Scale: the item vocabulary and the items go to the workers in blocks of at most VOCABULARY_BLOCK
terms and ITEM_BLOCK (item, term) pairs, so what is broadcast is bounded however many items there
are; each further block is a further pass.  Texts are read once per vocabulary block and never
shuffled; bags are shuffled once (all copies of a text that one task holds leave it as at most k
rows).  A scoring task keeps the best k classes of each item of its block and hands on nothing else.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored, text_of

#: Terms of the item vocabulary that one pass over the texts looks for, at most.
VOCABULARY_BLOCK = 1 << 19
#: (item, term) pairs that one scoring pass takes, on average at most.
ITEM_BLOCK = 1 << 20
#: Scores held at once while scoring.
CELLS = 1 << 21
#: Candidates that a scoring task holds before it keeps the best of each item.
HELD = 1 << 18
#: Order of classes without an id: after all others.
LAST = (1 << 63) - 1
# A term is a longest stretch of digits, letters and code points above 0x7F; A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The same for UTF-8 bytes: term bytes stay (lowered), all others become a space.
BYTES = bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20
              for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, repeats) of every item row; items without a term have no rows."""
    words = F.regexp_extract_all(F.translate(text_of(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"), words.alias("w"))
    return (rows.select("item", "item_id", F.explode("w").alias("term"))
            .groupBy("item", "item_id", "term").agg(F.count("*").alias("repeats")))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bags_of_block(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts): all terms counted in n, those of the vocabulary listed by number."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    shipped = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value
        known = number.keys()
        for b in batches:
            lengths, offsets, terms, counts = [], [0], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                lengths.append(len(words))
                seen = Counter(words)
                mine = sorted((number[w], seen[w]) for w in seen.keys() & known)
                terms += [m[0] for m in mine]
                counts += [m[1] for m in mine]
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], ["id", "n", "terms", "counts"])

    return (docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
            .mapInArrow(run, f"id {id_type}, n long, terms array<int>, counts array<long>"))


def bags(docs: DataFrame, vocabulary: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (rid, id, n, terms, counts), one row per row of ``docs``; ``vocabulary`` has (term, number).

    Beyond VOCABULARY_BLOCK terms, texts are read once per block and the parts of a row put together
    by its row number; each block numbers its rows alike, as it reads one written table."""
    blocks = max(1, math.ceil(n_terms / VOCABULARY_BLOCK))
    if blocks == 1:
        number = {r["term"].encode(): r["number"] for r in vocabulary.select("term", "number").collect()}
        return stored(_bags_of_block(docs, number, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "*"),
                      "search-bags")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"),
                              text_of(text_col).alias("text")), "search-rows")
    parts = None
    for k in range(blocks):
        mine = vocabulary.filter(_block("term", blocks) == k)
        number = {r["term"].encode(): r["number"] for r in mine.select("term", "number").collect()}
        part = stored(_bags_of_block(rows, number, "rid", "text"), "search-part")
        parts = part if parts is None else parts.unionAll(part)
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("terms", "counts"))))
    whole = (parts.groupBy(F.col("id").alias("rid")).agg(F.max("n").alias("n"), pairs.alias("pairs"))
             .select("rid", "n", F.col("pairs.terms").alias("terms"), F.col("pairs.counts").alias("counts")))
    out = stored(whole.join(rows.select("rid", "id"), "rid")
                 .select("rid", "id", "n", "terms", "counts"), "search-bags")
    release(rows)
    return out


class _Best:
    """The best k classes of each item of a block, as one task meets them."""

    def __init__(self, k: int, items: int):
        self.k, self.held = k, 0
        self.floor = np.ones(items)  # scores below cannot be among the best k of the item any more
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > HELD:
            self.parts = [self.cut()]
            item, score = self.parts[0][:2]
            self.held = len(item)
            full = np.nonzero(item[self.k - 1:] == item[:len(item) - self.k + 1])[0]
            self.floor[item[full]] = score[full + self.k - 1]

    def cut(self) -> tuple[np.ndarray, ...]:
        """(item, score, order, class), best first; ``order`` ranks classes by their smallest id."""
        item, score, order, cls = (np.concatenate(c) for c in zip(*self.parts))
        at = np.lexsort((cls, order, -score, item))
        item = item[at]
        first = np.concatenate([[True], item[1:] != item[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))
        at = at[np.arange(len(item)) - start < self.k]
        return tuple(np.concatenate(c)[at] for c in zip(*self.parts))


def _scored(classes: DataFrame, item: np.ndarray, term: np.ndarray, gain: np.ndarray, k: int) -> DataFrame:
    """(item, score, ordinal, cid): the best k classes that each task has for each item.

    ``item``, ``term`` and ``gain`` (weight times repeats) list the pairs of one block of items."""
    kinds, column = np.unique(item, return_inverse=True)
    order = np.argsort(term, kind="stable")
    known, first = np.unique(term[order], return_index=True)
    ends = np.append(first[1:], len(order))
    shipped = classes.sparkSession.sparkContext.broadcast((kinds, known, first, ends, column[order], gain[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, known, first, ends, column, gain = shipped.value
        best = _Best(k, len(kinds))
        step = max(1, CELLS // max(1, len(kinds)))
        for b in batches:
            m = b.column(2).to_numpy().astype(np.int64)
            order, cls = b.column(1).to_numpy(), b.column(0).to_numpy()
            lists = b.column(3)
            offsets = lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            words, tf = lists.flatten().to_numpy(), b.column(4).flatten().to_numpy().astype(np.int64)
            for low in range(0, len(m), step):
                high = min(len(m), low + step)
                cut = slice(offsets[low], offsets[high])
                row = np.repeat(np.arange(high - low), np.diff(offsets[low:high + 1]))
                at = np.searchsorted(known, words[cut])
                at[at == len(known)] = 0
                hit = known[at] == words[cut] if len(known) else np.zeros(0, bool)
                at, row, f = at[hit], row[hit], tf[cut][hit]
                part = 1000000000 * f // (1000 * f + 12 * m[low:high][row])
                total = np.zeros((high - low) * len(kinds))
                # a few postings at a time: a common term may stand in every item
                wide = ends[at] - first[at]
                cuts = np.searchsorted(np.cumsum(wide), np.arange(CELLS, int(wide.sum()) + CELLS, CELLS))
                for p, q in zip([0, *(cuts[:-1] + 1)], cuts + 1):
                    n = wide[p:q]
                    pair = np.repeat(first[at[p:q]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    total += np.bincount(np.repeat(row[p:q], n) * len(kinds) + column[pair],
                                         np.repeat(part[p:q], n) * gain[pair], len(total))
                at, which = np.nonzero(total.reshape(high - low, -1) >= best.floor)
                if len(at):
                    best.add(which, total.reshape(high - low, -1)[at, which].astype(np.int64), order[low + at], cls[low + at])
        if best.parts:
            out = best.cut()
            out = (kinds[out[0]], *out[1:])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["item", "score", "ordinal", "cid"])

    return classes.select("cid", "ordinal", "m", "terms", "counts").mapInArrow(run, "item long, score long, ordinal long, cid long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_col: str = "doc_id", item_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score, class_id, class_m.

    N counts the documents with a term, L all their terms, n a document's terms, df the documents that hold
    a term, tf its occurrences.  A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), in doubles.  A document's
    m is 75 + (25 n N) div L; its score sums w * ((10^9 tf) div (1000 tf + 12 m)) over the item's
    terms, repeats included.  Only scores above 0 are returned; equal scores by ascending id (null ids last, equal ids
    by row).  Null and empty texts have no terms; items without terms, and items of an empty table, have no
    rows; repeated items are ranked each on its own.  Other columns are ignored."""
    spark = docs.sparkSession
    wanted = stored(item_terms(items, item_col, text_col), "search-items")
    words = stored(wanted.groupBy("term").agg(F.count("*").alias("pairs")), "search-words")
    n_terms = words.count()
    # consecutive numbers: counted per partition of the written table, so no task sees all terms
    vocabulary = stored(_numbered(words), "search-vocabulary")
    table = bags(docs, vocabulary, n_terms, doc_col, text_col)

    held = table.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    n_docs, n_words = held["docs"], held["words"] or 1
    df = table.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weights = vocabulary.join(df, "number").select("term", "number", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
    pairs = stored(wanted.join(weights, "term").select("item", "number", (F.col("w") * F.col("repeats")).alias("gain")),
                   "search-pairs")

    members, classes = _classes(table.filter("size(terms) > 0"), n_docs, n_words, k)
    blocks = max(1, math.ceil(pairs.count() / ITEM_BLOCK))
    found = None
    for b in range(blocks):
        block = pairs.filter(_block("item", blocks) == b).toPandas()
        part = stored(_scored(classes, block["item"].to_numpy(np.int64), block["number"].to_numpy(np.int32),
                              block["gain"].to_numpy(np.int64), k), "search-found")
        found = part if found is None else found.unionAll(part)

    per_item = Window.partitionBy("item")
    top = (found.withColumn("r", F.row_number().over(per_item.orderBy(F.desc("score"), "ordinal", "cid")))
           .filter(F.col("r") <= k).select("item", "score", "cid"))
    last = F.col("doc_id").isNull()
    ranked = (top.join(members, "cid")
              .withColumn("rank", F.row_number().over(per_item.orderBy(F.desc("score"), last, "doc_id", "rid")))
              .filter(F.col("rank") <= k))
    names = wanted.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score", F.col("cid").alias("class_id"),
                                             F.col("m").alias("class_m"))


def _numbered(words: DataFrame) -> DataFrame:
    """(term, number) with numbers from 0 on without gaps: the offset of each partition by its size."""
    parts = words.select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid"))
    parts = stored(parts, "search-parts")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("mid").alias("low"))
    offset = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", "low", F.coalesce(offset, F.lit(0)).alias("at"))
    return parts.join(starts, "part").select("term", (F.col("at") + F.col("mid") - F.col("low")).cast("int").alias("number"))


def _classes(table: DataFrame, n_docs: int, n_words: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes): the first k members of each class of equal (m, terms, counts), and each class once.

    The hash deals the rows out and orders them; the vector in the key verifies that they are equal.  The limit
    per class is applied before the shuffle too, so a class that holds a third of all rows is
    at most k rows of each task.  ``ordinal`` ranks classes by smallest id where ids are integers; for
    other ids it is the rank of that id."""
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {n_words}L")
    rows = table.withColumn("m", m).withColumn("h", F.xxhash64("m", "terms", "counts"))
    same = Window.partitionBy("h", "m", "terms", "counts").orderBy(F.col("id").isNull(), "id", "rid")
    rows = rows.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k)
    rows = stored(rows.withColumn("cid", F.first("rid").over(same.rowsBetween(Window.unboundedPreceding, 0))), "search-classes")
    members = rows.select("cid", "m", "rid", F.col("id").alias("doc_id"))
    classes = rows.filter("r = 1")
    if dict(rows.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint"):
        ordinal = F.coalesce(F.col("id").cast("long"), F.lit(LAST))
        return members, classes.withColumn("ordinal", ordinal)
    ids = stored(classes.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
                 .select("id", F.monotonically_increasing_id().alias("ordinal")), "search-ids")
    return members, classes.join(ids, classes["id"].eqNullSafe(ids["id"]), "left").select(
        classes["cid"], "m", "terms", "counts", F.when(classes["id"].isNull(), LAST)
        .otherwise(F.col("ordinal")).alias("ordinal"))
