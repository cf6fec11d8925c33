"""SimHash near-dedup with vantage-point trees.

Fingerprints take the majority bit of the XXH64 hashes of a text's word shingles.  A routing
tree, fitted on a bounded sample of distinct fingerprints, splits the Hamming space: each node
holds a vantage point and a distance limit; triangle bounds tell which sides a ball of the search
radius reaches.  Every distinct fingerprint lives in the shard of its own leaf and visits the
shards that its ball overlaps; across a limit only the near side travels, so a pair meets once.
Inside a shard a vantage-point tree over the members answers all queries exactly, and a local
union-find hands on spanning edges, never all pairs.  Shards of more than ``BLOCK`` members are
dealt as blocks.  A distributed union-find joins the edges to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of
from .components import connected_components, local_components

SEED = 42
SHINGLE = 3
RADIUS = 2
# The routing tree is fitted on at most this many distinct fingerprints.
SAMPLE = 16_384
# Wanted members per shard; the tree has at most SAMPLE / MIN_LEAF leaves.
SHARD = 512
MIN_LEAF = 8
# Members per block of an oversized shard, and per leaf of the tree inside a shard.
BLOCK = 4096
LEAF = 256
_ONE = np.uint64(1)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit majority fingerprint of ``text``: A-Z lowered, words between ASCII white space,
    shingles of ``shingle`` words joined by a space (fewer words: all of them; none: 0)."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(line[a:b], seed) for a, b in
                       zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], "<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp): XXH64 of the text and fingerprint of every row, as signed 64-bit integers.  Null
    text is empty."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "th", "fp"])

    text = text_of(text_col)
    return (docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
            .mapInArrow(run, f"id {id_type}, th long, fp long"))


def distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


def choose_limit(d: np.ndarray, radius: int, least: int) -> int | None:
    """Distance limit that leaves ``least`` points on either side and the fewest near it."""
    below = np.cumsum(np.bincount(d, minlength=65))
    best, chosen = None, None
    for t in range(64):
        inside, outside = int(below[t]), int(below[-1] - below[t])
        if min(inside, outside) < max(least, len(d) // 8):
            continue
        near = int(below[min(t + radius, 64)] - (below[t - radius] if t >= radius else 0))
        cost = near / len(d) + abs(inside - outside) / len(d) / 4
        if best is None or cost < best:
            best, chosen = cost, t
    return chosen


def routing_tree(sample: np.ndarray, leaves: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, limit, inner, outer) of a tree over ``sample``; a child under 0 is the
    leaf -child - 1.  Vantage points come from the points that they split."""
    nodes: list[tuple[int, int, int, int]] = []
    made = 0
    want = max(MIN_LEAF, len(sample) // max(1, leaves))

    def leaf() -> int:
        nonlocal made
        made += 1
        return -made

    def grow(points: np.ndarray) -> int:
        if len(points) < 2 * want:
            return leaf()
        vantage = points[0]
        d = distance(points, vantage)
        t = choose_limit(d, radius, want // 2)
        if t is None:
            return leaf()
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        nodes[at] = (int(vantage), t, grow(points[d <= t]), grow(points[d > t]))
        return at

    grow(sample)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray, radius: int):
    """(row, leaf, home) of every shard that each point lives in or visits."""
    if not nodes:
        n = len(points)
        return np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    out, todo = [], [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((rows, np.full(len(rows), -at - 1, np.int64), home))
            continue
        vantage, t, inner, outer = nodes[at]
        d = distance(points[rows], np.uint64(vantage))
        inside = d <= t
        # a home point goes to its side; the near part of the inner side also visits the outer one
        to_in = np.where(home, inside, d - radius <= t)
        to_out = np.where(home, ~inside | (d + radius > t), d + radius > t)
        todo.append((inner, rows[to_in], home[to_in]))
        todo.append((outer, rows[to_out], home[to_out] & ~inside[to_out]))
    rows, leaves, home = (np.concatenate(x) for x in zip(*out))
    return rows, leaves, home


def pairs_within(members: np.ndarray, queries: np.ndarray, radius: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (member, query) within ``radius``: a vantage-point tree over ``members`` with
    all queries going down together.  ``own``: the queries are the members; each pair once."""
    todo = [(np.arange(len(members)), np.arange(len(queries)))]
    while todo:
        m, q = todo.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > LEAF:
            vantage = members[m[len(m) // 2]]
            dm = distance(members[m], vantage)
            t = choose_limit(dm, radius, 1)
            if t is not None:
                dq = distance(queries[q], vantage)
                todo.append((m[dm <= t], q[dq - radius <= t]))
                todo.append((m[dm > t], q[dq + radius > t]))
                continue
        for i in range(0, len(q), 2048):
            block = q[i:i + 2048]
            for j in range(0, len(m), LEAF):
                rows = m[j:j + LEAF]
                a, b = np.nonzero(np.bitwise_count(members[rows][:, None] ^ queries[block][None, :]) <= radius)
                a, b = rows[a], block[b]
                if own:
                    once = a < b
                    a, b = a[once], b[once]
                yield a, b


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges that connect fingerprints (column fp, distinct) within ``radius`` bits exactly as all
    pairs within it would.  Only a bounded sample and one count per shard reach the driver."""
    spark = distinct.sparkSession
    total = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    leaves = min(SAMPLE // MIN_LEAF, -(-total // SHARD))
    nodes = routing_tree(sample.view(np.uint64), leaves, radius)

    def deal(blocks: dict[int, int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
                rows, leaf, home = route(nodes, fp, radius)
                if blocks is None:
                    rows, leaf, home = rows[home], leaf[home], home[home]
                part = np.zeros(len(rows), np.int64)
                for x, n in (blocks or {}).items():
                    of = np.flatnonzero(leaf == x)
                    if not len(of):
                        continue
                    keep = np.ones(len(rows), bool)
                    keep[of] = False
                    own = (fp[rows[of]] % np.uint64(n)).astype(np.int64)
                    r, k = np.repeat(rows[of], n), np.tile(np.arange(n), len(of))
                    own, h = np.repeat(own, n), np.repeat(home[of], n)
                    go = ~h | (k >= own)            # a member lives in its block and visits the later ones
                    rows = np.concatenate([rows[keep], r[go]])
                    leaf = np.concatenate([leaf[keep], np.full(int(go.sum()), x, np.int64)])
                    part = np.concatenate([part[keep], k[go]])
                    home = np.concatenate([home[keep], (h & (k == own))[go]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array(part), pa.array(home), pa.array(fp[rows].view(np.int64))],
                    ["leaf", "part", "home", "fp"])
        return run

    schema = "leaf long, part long, home boolean, fp long"
    sizes = distinct.select("fp").mapInArrow(deal(None), schema).groupBy("leaf").count().filter(f"count > {BLOCK}").collect()
    blocks = {r["leaf"]: -(-r["count"] // BLOCK) for r in sizes}         # at most one entry per leaf

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        fp = shard["fp"].to_numpy().view(np.uint64)
        order = np.argsort(~shard["home"].to_numpy(), kind="stable")
        fp, n = fp[order], int(shard["home"].sum())
        label = np.arange(len(fp))
        for own, queries, base in ((True, fp[:n], 0), (False, fp[n:], n)):
            for a, b in pairs_within(fp[:n], queries, radius, own):
                if len(a):
                    label = merged(label, a, b + base)
        far = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[far].view(np.int64), "b": fp[label[far]].view(np.int64)})

    return (distinct.select("fp").mapInArrow(deal(blocks), schema)
            .groupBy("leaf", "part").applyInPandas(search, "a long, b long"))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a and b."""
    apart = label[a] != label[b]
    if not apart.any():
        return label
    return local_components(len(label), label[a[apart]], label[b[apart]])[label]


def _grouped(docs: DataFrame, shingle: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, fp, component, component_id): component is a fingerprint, component_id an id."""
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    edges = stored(links(distinct, radius), "simhash-edges")
    comps = connected_components(edges)
    nodes = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    names = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(nodes.join(names, "component").select("fp", "component", "component_id"), "simhash-named")
    return fps.join(named, "fp")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other.  Rows of equal
    fingerprint are one node; null ids take their component's id but never name one.  Other
    columns are ignored; an empty table gives an empty one."""
    return _grouped(docs, shingle, radius, id_col, text_col).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one of each component does: the smallest id
    (null ids last), of rows that repeat it the smallest text hash, of equal rows one."""
    order = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "th"))
    keepers = stored(_grouped(docs, shingle, radius, id_col, text_col).groupBy("component").agg(order.alias("k"))
                     .select(F.col("k.id").alias("__k_id"), F.col("k.th").alias("__k_th")), "simhash-keepers")
    own = docs.withColumn("__th", F.xxhash64(text_of(text_col)))
    one = F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`"), "__th").orderBy("__th"))
    return (own.join(keepers, own[f"`{id_col}`"].eqNullSafe(keepers["__k_id"]) & (own["__th"] == keepers["__k_th"]))
            .withColumn("__one", one).filter("__one = 1").select(*(F.col(f"`{c}`") for c in docs.columns)))
