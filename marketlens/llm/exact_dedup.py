"""Exact dedup by distributed MSD radix partitioning.

Texts are keyed by their normalised bytes with the byte length in front, and groups are split
by successive byte strings (digits) of that key: first the length and the leading bytes, then
slices of geometrically growing width.  A group stops when it is a singleton or its bytes have
ended; what has ended together is equal.  No digest decides equality.

Scale: every level is a partial aggregate (copies collapse before the shuffle) and an equi-join
of two exchanged tables, so a text held by a third of all rows is split by adaptive execution;
only texts in groups of two and more are carried to the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

# The white space that normalisation deletes, 0x20 and 0x09-0x0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
FIRST_DIGIT = 32
WIDEN = 8


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space.  Of equal texts the row with the
    most code points in the original stays, then the smallest id (null ids last), then one of
    the rows that repeat the id.  Null text counts as empty; empty texts form one group.  Other
    columns are ignored."""
    norm = F.translate(text_of(text_col), WHITE_SPACE, "")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.char_length(text_of(text_col)).alias("points"),
                       F.encode(norm, "UTF-8").alias("bytes"))
    rows = rows.withColumn("size", F.octet_length("bytes")).withColumn(
        "digit", F.substring("bytes", 1, FIRST_DIGIT))
    counts = stored(rows.groupBy("size", "digit").count().filter("count > 1"), "radix-heads")
    first = stored(
        rows.join(counts, ["size", "digit"], "left")
        .select(F.monotonically_increasing_id().alias("rid"), "id", "points", "size",
                F.sha2("bytes", 256).alias("sha"),
                F.when(F.col("count") > 1, F.col("bytes")).alias("bytes")), "radix-rows")

    open_rows = first.filter("bytes is not null").select(
        "rid", F.lit(0).cast("long").alias("grp"), "size", "bytes")
    done, start, width = [], 0, FIRST_DIGIT
    while not open_rows.isEmpty():
        cut = open_rows.withColumn("digit", F.substring("bytes", start + 1, width))
        groups = stored(cut.groupBy("grp", "size", "digit").agg(F.count("*").alias("n"), F.min("rid").alias("next"))
                        .filter("n > 1").drop("n"), "radix-groups")
        start, width = start + width, width * WIDEN
        ended = F.col("size") <= start
        level = stored(cut.join(groups, ["grp", "size", "digit"])
                       .select("rid", F.col("next").alias("grp"), "size",
                               F.when(~ended, F.col("bytes")).alias("bytes")), "radix-level")
        done.append(level.filter(ended).select("rid", "grp"))
        open_rows = level.filter(~ended)

    slim = first.drop("bytes", "size")
    if not done:
        return _shaped(slim.select("*", F.col("rid").alias("keep_rid"), F.col("id").alias("keep_id"),
                                   F.lit(1).cast("long").alias("group_size")), id_col)
    members = done[0]
    for d in done[1:]:
        members = members.unionAll(d)
    members = stored(members.join(slim, "rid").select("grp", "rid", "id", "points"), "radix-members")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), "id", "rid"))
    keepers = stored(members.groupBy("grp").agg(best.alias("k"), F.count("*").alias("group_size"))
                     .select("grp", F.col("k.id").alias("keep_id"), F.col("k.rid").alias("keep_rid"), "group_size"),
                     "radix-keepers")
    found = stored(members.join(keepers, "grp").select("rid", "keep_id", "keep_rid", "group_size"), "radix-found")
    single = F.col("keep_rid").isNull()
    return _shaped(
        slim.join(found, "rid", "left").select(
            "rid", "id", "sha", F.coalesce("keep_rid", "rid").alias("keep_rid"),
            F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")), id_col)


def _shaped(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col("id").alias(id_col), "keep_id", "group_size",
                     (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))
