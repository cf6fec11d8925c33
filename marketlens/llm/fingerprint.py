"""Document fingerprints: SimHash in DataFrame expressions.

Terms are word pairs (and the last word).  Every occurrence of a term votes with weight one, so
a term weighs as often as it occurs; bit j of the fingerprint is set where more than half the
weight voted for it.  The 64 votes of a term are counted two to a long: sum((hash >> j) & M),
M having bits 0 and 32, holds the votes of bits j and j + 32 side by side.  A text has fewer than
2^31 terms, so the halves never meet.

`near_pairs` finds all fingerprints within a Hamming radius by permuted block tables: the bits are
cut into blocks, and for every choice of blocks that may stay untouched by `radius` flips there is
one table keyed by those blocks' bits; candidates that share a key are verified by bit count, and a
pair counts only in the first table that holds it.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_of

BITS = 64
HALF = (1 << 32) | 1
RADIUS = 3
BLOCKS = 5
LOWEST = -(2 ** 63)


def term_hashes(text: Column) -> Column:
    """Hashes of the lower-case word pairs and of the last word; null where there is no word."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[\s]+", " ")), " ")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.when(F.trim(F.regexp_replace(text, r"[\s]+", " ")) != "", pairs)


def votes() -> list[Column]:
    """Aggregates over exploded hashes `h`: 32 sums, and the number of terms."""
    return [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(HALF))).alias(f"v{j}") for j in range(32)] + [
        F.count("h").alias("terms")]


def majority() -> Column:
    """The fingerprint as a signed 64-bit integer; 0 without terms."""
    fp = F.lit(0).cast("long")
    for j in range(32):
        for bit, half in ((j, F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(f"v{j}", 32))):
            fp = fp.bitwiseOR(F.when(half * 2 > F.col("terms"), F.lit(1 << bit if bit < 63 else LOWEST).cast("long"))
                              .otherwise(F.lit(0).cast("long")))
    return fp


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, fp): the fingerprint of every row.  Null text counts as empty (fingerprint 0)."""
    return (docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                        term_hashes(text_of(text_col)).alias("hs"))
            .select("row", "id", F.explode_outer("hs").alias("h")).groupBy("row", "id").agg(*votes()).select("row", "id", majority().alias("fp")))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key: a coarse look-up, then one in the slice it names."""
    step = max(1, int(len(bounds) ** 0.5))
    if not bounds:
        return F.lit(0)
    whole = F.array(*map(F.lit, bounds))
    coarse = F.array(*map(F.lit, bounds[::step]))
    skip = F.size(F.filter(coarse, lambda x: x <= key))
    start = F.greatest(skip - 1, F.lit(0)) * step
    return (start + F.size(F.filter(F.slice(whole, start + 1, F.lit(step)), lambda x: x <= key))).cast("int")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text: its last floor(n / 2) code points replaced by as
    many of the start of the next text, in descending id (after the last: the first).

    One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  Null text counts as empty; rows that repeat an id follow each other by text, null
    ids come last; a single row is its own next.

    Scale: rows are dealt to ranges of the id between quantiles (one per shuffle partition), and
    the next text comes from a window inside a range; the first row of each range is also sent to
    the range before it.  That is the one shuffle of the texts; votes are counted where they lie."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST))
    n = shuffle_partitions(spark)
    cuts = docs.select(key.alias("k")).agg(
        F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    bounds = sorted(set(cuts))                                   # at most one per shuffle partition
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("k"), text_of(text_col).alias("text")).withColumn(
        "range", _bucket(F.col("k"), bounds))
    firsts = {r["range"]: r["k"] for r in rows.groupBy("range").agg(F.max("k").alias("k")).collect()}
    order = sorted(firsts, reverse=True)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}   # first key of a range -> the range before
    ghosts = rows.filter(F.col("k").isin(list(before))) if before else rows.filter("false")
    if before:
        ghosts = ghosts.withColumn("range", F.element_at(
            F.create_map(*[x for k, r in before.items() for x in (F.lit(k), F.lit(r).cast("int"))]), F.col("k")))
    both = rows.withColumn("ghost", F.lit(False)).unionAll(ghosts.withColumn("ghost", F.lit(True)))
    line = Window.partitionBy("range").orderBy("ghost", F.col("k").desc(), "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half),
                      F.substring(F.coalesce(F.col("next"), F.lit("")), F.lit(1), half))
    base = (both.withColumn("place", F.row_number().over(line)).withColumn("next", F.lead("text").over(line))
            .withColumn("edited", edited))
    versions = base.select(
        "range", "place", "id", "ghost", F.char_length("text").cast("long").alias("n_chars"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("version"), F.lit(None).cast("binary").alias("sha"), term_hashes(F.col("text")).alias("hs")),
            F.struct(F.lit(1).alias("version"), F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)).alias("sha"),
                     F.when(~F.col("ghost"), term_hashes(F.col("edited"))).alias("hs")))).alias("v"))
    keys = ["range", "place", "id", "ghost", "n_chars"]
    fps = (versions.select(*keys, "v.version", "v.sha", F.explode_outer("v.hs").alias("h"))
           .groupBy(*keys, "version", "sha").agg(*votes()).select(*keys, "version", "sha", majority().alias("fp")))
    after = Window.partitionBy("range").orderBy("place", "version")
    out = fps.select(*keys, "version", F.col("fp"),
                     F.lead("fp", 1).over(after).alias("edited_fp"), F.lead("sha", 1).over(after).alias("edited_sha"),
                     F.lead("fp", 2).over(after).alias("next_fp")).filter("version = 0 and not ghost")
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """One mask per table: the bits of the ``blocks - radius`` blocks that make its key."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(single, blocks - radius)]


def near_pairs(queries: DataFrame, table: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS,
               fp_col: str = "fp") -> DataFrame:
    """(query, found): all distinct fingerprints of ``table`` within ``radius`` bits of those of
    ``queries``, itself excluded.  Distinct fingerprints first, so copies cost nothing."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, radius)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key"))
                         for i, m in enumerate(signed)])
        return df.select(F.col(f"`{fp_col}`").alias(name)).dropna().distinct().select(name, F.inline(keys))

    differ = F.col("query").bitwiseXOR(F.col("found"))
    earlier = F.lit(False)
    for i, m in enumerate(signed[:-1]):
        earlier = earlier | ((F.col("t") > i) & (differ.bitwiseAND(F.lit(m)) == 0))
    return (tables(queries, "query").join(tables(table, "found"), ["t", "key"])
            .filter((F.bit_count(differ) <= radius) & (differ != 0) & ~earlier).select("query", "found"))
