"""Line dedup: fuzzy lines by MinHash.

Equal lines collapse first.  A distinct line's character shingles give a MinHash signature; bands of
it name buckets, and lines that share a bucket are candidates.  Buckets of up to `LIST` lines are
lists, and equal lists are verified once.  Exact Jaccard similarity of the shingle sets decides inside
a list: products of a 0/1 matrix count what lines share.  The lists that begin with the same line share a
verifier with one union-find, which hands on one edge per line to the least line of its component.

Larger buckets are settled in rounds that lose no pair.  Representatives of their components meet in
lists of about `LIST` until that joins no more; a bucket that is one component is done.  The lines of the
others are split by their rarest shingles (prefix filter: of two similar lines the shorter has one of its
first 1/9 and the longer one of its first 1/5 in common), small groups first, then again by
representatives.  Only what is large and in several components after that meets part by part: the
lines outside the largest component, or those that have the shingle in the shorter prefix, with all.

A distributed union-find makes components, and of all occurrences in a component the first stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, shuffle_partitions, stored, text_of
from .components import connected_components

SHINGLE = 8
SIMILARITY = 0.8
# Bands x rows of the signature: at similarity 0.8 a pair shares a bucket with probability 0.998.
BANDS = 12
ROWS = 4
SEED = 11
# Most lines of a bucket that are verified as one list; parts of larger groups have this many on average.
LIST = 1024
# Lists of so few lines are compared pair by pair, as sets.
FEW = 8
# Shingles, and cells of a matrix, that a verifier holds at once.
ENTRIES = 1 << 19
# Characters whose signatures are computed at once.
BLOCK = 1 << 16


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    """Distinct character shingles; a shorter line is one shingle."""
    return {line[i:i + size] for i in range(max(1, len(line) - size + 1))}


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return (rng.integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 1 << 32, n, dtype=np.uint32))


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, line after line, and where each line begins."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.cumsum(size) - size
    # hash of the SHINGLE code points from each position; where a line is shorter, of its own code points
    x = points.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(x), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for k in range(SHINGLE):
        m = max(0, len(x) - k)
        h[:m] = h[:m] * base + x[k:]
    for i in np.flatnonzero(size < SHINGLE):
        v = np.uint64(0)
        for c in x[begin[i]:begin[i] + size[i]]:
            v = v * base + c
        h[begin[i]] = v
    n = np.maximum(size - SHINGLE + 1, 1)
    # gather only shingles that lie within their line
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(begin - first, n)
    h = h[at]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h, first


def band_hashes(lines: list[str]) -> np.ndarray:
    """(lines x BANDS): bucket names, different for every band."""
    h, first = _shingle_hashes(lines)
    x32 = (h >> np.uint64(32)).astype(np.uint32)
    a, b = _coefficients()
    out = np.zeros((len(lines), BANDS), np.uint64)
    buf = np.empty_like(x32)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for row in range(ROWS):
            i = band * ROWS + row
            np.bitwise_xor(x32, b[i], out=buf)
            np.multiply(buf, a[i], out=buf)
            key = (key ^ np.minimum.reduceat(buf, first)) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for b in batches:
        ids, lines = b.column(0).to_numpy(), b.column(1).to_pylist()
        at = 0
        while at < len(lines):
            end, chars = at, 0
            while end < len(lines) and (end == at or chars + len(lines[end]) <= BLOCK):
                chars += len(lines[end])
                end += 1
            yield ids[at:end], lines[at:end]
            at = end


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, lines in _blocks(batches):
        bands = band_hashes(lines)
        yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(np.repeat(ids, BANDS))], ["band", "id"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each line, by hash, and how many they are."""
    for ids, lines in _blocks(batches):
        h, first = _shingle_hashes(lines)
        sets = [np.unique(x) for x in np.split(h, first[1:])]
        size = np.array([len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(np.repeat(size, size)),
                                          pa.array(np.concatenate(sets).view(np.int64))], ["id", "size", "token"])


def alike(a: set[str] | np.ndarray, b: set[str] | np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two shingle sets are similar: both as strings, or both as the integers of one `_codes`."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < similarity * len(large):
        return False
    if isinstance(a, set):
        both = len(small & large)
    else:
        every = np.concatenate((a, b))
        every.sort()
        both = int(np.count_nonzero(every[1:] == every[:-1]))
    return both >= similarity * (len(a) + len(b) - both)


def _codes(lines: list[str]) -> list[np.ndarray] | None:
    """Distinct shingles of each line in ascending order, exact: eight code points of at most 256 kinds are one 64-bit
    integer.  None for lines of more kinds and for lines shorter than a shingle."""
    if SHINGLE != 8 or min(map(len, lines)) < SHINGLE:
        return None
    text = "".join(lines)
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        kinds, at = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        if len(kinds) > 256:
            return None
        raw = at.astype(np.uint8).tobytes()
    windows = np.ndarray((len(raw) - SHINGLE + 1,), "<u8", raw, 0, (1,))
    out, at = [], 0
    for line in lines:
        x = np.sort(windows[at:at + len(line) - SHINGLE + 1])
        fresh = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=fresh[1:])
        out.append(x[fresh])
        at += len(line)
    return out


def _packed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, row) of every shingle, row after row: the hash, and the SHINGLE code points in three words."""
    h, first = _shingle_hashes(lines)
    n = np.diff(np.append(first, len(h)))
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.cumsum(size) - size
    points = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    total = len(points)
    points = np.append(points, np.zeros(SHINGLE, np.uint64))
    words = [np.zeros(total, np.uint64) for _ in range(3)]
    for k in range(SHINGLE):
        words[k // 3] = words[k // 3] << np.uint64(21) | points[k:k + total]
    for i in np.flatnonzero(size < SHINGLE):
        # a line that is shorter than a shingle ends with zeros
        mine = np.append(points[begin[i]:begin[i] + size[i]], np.zeros(SHINGLE - size[i], np.uint64))
        for w in range(3):
            x = np.uint64(0)
            for c in mine[3 * w:3 * w + 3]:
                x = x << np.uint64(21) | c
            words[w][begin[i]] = x
    at = np.arange(len(h)) + np.repeat(begin - first, n)
    return h, np.stack([w[at] for w in words], 1), np.repeat(np.arange(len(lines)), n)


def shared_shingles(lines: list[str], some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each line, shingles that each of the lines ``some`` shares with each line), exact.

    Shingles are told apart by their code points as integers where those hold them; elsewhere by hash, and equal
    hashes are checked against the text.  Shingles of two and more lines are columns of a 0/1 matrix, whose products
    count; hashes and columns are taken in parts of bounded size."""
    n = len(lines)
    parts = 1 + sum(map(len, lines)) // ENTRIES
    size, both = np.zeros(n, np.int64), np.zeros((len(some), n), np.float32)
    if parts == 1 and (codes := _codes(lines)) is not None:
        size += np.fromiter(map(len, codes), np.int64, n)
        h = np.concatenate(codes)
        order = np.argsort(h)
        h = h[order]
        _count(np.cumsum(np.append(True, h[1:] != h[:-1])) - 1, np.repeat(np.arange(n), size)[order], some, both)
        return size, both
    for part in range(parts):
        found = []
        for low, high in _slices(lines):
            h, text, row = _packed(lines[low:high])
            if parts > 1:
                mine = (h >> np.uint64(17)) % np.uint64(parts) == part
                h, text, row = h[mine], text[mine], row[mine]
            found.append((h, text, row + low))
        h, text, row = (np.concatenate(x) for x in zip(*found))
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")  # rows ascend within a hash
        h, text, row = h[order], text[order], row[order]
        same = h[1:] == h[:-1]
        if (text[1:][same] != text[:-1][same]).any():
            # two shingles of one hash: tell them apart by their text
            order = np.lexsort((row, *text.T))
            h, text, row = h[order], text[order], row[order]
            same = (text[1:] == text[:-1]).all(1)
        fresh = np.append(True, ~(same & (row[1:] == row[:-1])))
        column = np.cumsum(np.append(True, ~same))[fresh] - 1
        row = row[fresh]
        size += np.bincount(row, minlength=n)
        _count(column, row, some, both)
    return size, both


def _count(column: np.ndarray, row: np.ndarray, some: np.ndarray, both: np.ndarray) -> None:
    """Add to ``both`` how many of the ascending columns (shingles) each of the rows ``some`` shares with each row."""
    n = both.shape[1]
    shared = np.bincount(column)[column] > 1
    column = np.cumsum(np.append(True, np.diff(column[shared]) > 0)) - 1 if shared.any() else column[:0]
    row = row[shared]
    width = max(64, ENTRIES // n)
    cut = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + width, width))
    for low, high in zip(cut[:-1], cut[1:]):
        if high > low:
            dense = np.zeros((n, int(column[high - 1] - column[low]) + 1), np.float32)
            dense[row[low:high], column[low:high] - column[low]] = 1
            both += dense[some] @ dense.T


def _slices(lines: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and (end == at or chars + len(lines[end]) <= ENTRIES):
            chars += len(lines[end])
            end += 1
        yield at, end
        at = end


class Verifier:
    """Exact similarity of the lines of lists that begin with the same line: one union-find over all of them, so
    what an earlier list has joined is not compared again, and a line leaves with one edge at most."""

    def __init__(self, similarity: float = SIMILARITY):
        self.similarity = similarity
        self.up: dict[int, int] = {}

    def top(self, i: int) -> int:
        while (u := self.up.get(i, i)) != i:
            self.up[i] = i = self.up.get(u, u)
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def add(self, ids: list[int], lines: list[str], known: list[int]) -> None:
        """Join the lines of a list as all similar pairs would; lines of one ``known`` component are joined already."""
        tops = [self.top(c) for c in known]
        if len(set(tops)) == 1:
            return
        if len(ids) <= FEW:
            sets = _codes(lines) or [shingles(x) for x in lines]
            for j in range(1, len(ids)):
                for i in range(j):
                    if self.top(known[i]) != self.top(known[j]) and alike(sets[i], sets[j], self.similarity):
                        self.join(known[i], known[j])
            return
        # only pairs of different components matter: the largest one's lines need no comparison with each other
        kinds, label, count = np.unique(np.array(tops), return_inverse=True, return_counts=True)
        some = np.flatnonzero(label != count.argmax())
        for low in range(0, len(some), LIST):
            rows = some[low:low + LIST]
            size, both = shared_shingles(lines, rows)
            both = both.astype(np.float64)
            near = both >= self.similarity * (size[rows][:, None] + size[None, :] - both)
            i, j = np.nonzero(near & (label[rows][:, None] != label[None, :]))
            for x, y in set(zip(label[rows[i]].tolist(), label[j].tolist())):
                self.join(int(kinds[x]), int(kinds[y]))

    def edges(self) -> list[tuple[int, int]]:
        """(least line of its component, line) of every line that was joined to another."""
        return [(t, i) for i in sorted(self.up) if (t := self.top(i)) != i]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by verifier and list: edges of each verifier, between components."""
    now, first, ids, lines, known, verifier = None, None, [], [], [], Verifier()
    out: list[tuple[int, int]] = []
    for b in batches:
        for f, lid, i, line, c in zip(*(x.to_pylist() for x in b.columns)):
            if lid != now:
                if ids:
                    verifier.add(ids, lines, known)
                if f != first:
                    out += verifier.edges()
                    first, verifier = f, Verifier()
                now, ids, lines, known = lid, [], [], []
            ids.append(i)
            lines.append(line)
            known.append(c)
        yield _edge_batch(out)
        out = []
    if ids:
        verifier.add(ids, lines, known)
    yield _edge_batch(verifier.edges())


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _verified(lists: DataFrame, lines: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Edges of the lists (ids) between components.  Without labels the lists are whole buckets, of which a line
    has at most BANDS, and those that begin with the same line share a verifier."""
    lists = stored(lists.distinct().select(F.monotonically_increasing_id().alias("lid"), "ids"), "line-distinct-lists")
    first = F.col("ids")[0] if labels is None else F.col("lid")
    rows = stored(lists.select(first.alias("first"), "lid", F.explode("ids").alias("id")), "line-members")
    # the texts are not sorted for the few ids that are wanted
    texts = lines.select("id", "line").join(rows.select("id").distinct().hint("shuffle_hash"), "id")
    texts = stored(texts.withColumn("component", F.col("id")) if labels is None else _in_components(texts, labels), "line-candidates")
    # few bytes, much work: a given number of tasks is not coalesced
    edges = stored(rows.join(texts, "id").select("first", "lid", "id", "line", "component")
                   .repartition(shuffle_partitions(lines.sparkSession), "first").sortWithinPartitions("first", "lid", "id")
                   .mapInArrow(_verify, "a long, b long"), "line-edges")
    release(lists, rows, texts)
    return edges


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after further edges: union-find over the components they join only."""
    if edges.isEmpty():
        return labels
    a, b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    joins = stored(edges.join(a, "a", "left").join(b, "b", "left")
                   .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct(), "line-joins")
    up = connected_components(joins).toDF("component", "up")
    # a line without a label is its own component: where it is joined, it is a node of `joins`
    alone = up.select(F.col("component").alias("node")).join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    out = stored(labels.unionAll(alone).join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")),
                 "line-labels")
    release(joins)
    return out


def _in_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their component; a line without edges is its own."""
    return (members.join(labels.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("component", F.coalesce("component", "id")))


def _part(n: Column, *salt: Column) -> Column:
    return F.pmod(F.xxhash64("id", *salt), F.ceil(n / LIST))


def _linked(members: DataFrame, labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Labels after the representatives of components have met in each group (key, id), a part at a time and
    every part with the least of them, for as long as that halves their number."""
    before, salt = None, 0
    while True:
        reps = stored(_in_components(members, labels).groupBy("key", "component").agg(F.min("id").alias("id")), "line-reps")
        sizes = stored(reps.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("n > 1"), "line-sizes")
        total = sizes.agg(F.sum("n")).first()[0]
        if total is None or (before is not None and total > 0.5 * before):
            release(reps, sizes)
            return labels
        lists = (reps.join(sizes, "key").withColumn("part", _part(F.col("n"), F.lit(salt)))
                 .groupBy("key", "part").agg(F.min("low").alias("low"), F.collect_list("id").alias("ids"))
                 .select(F.array_sort(F.array_union("ids", F.array("low"))).alias("ids")).filter("size(ids) > 1"))
        edges = _verified(lists, lines, labels)
        labels = _merged(labels, edges)
        release(reps, sizes, edges)
        before, salt = total, salt + 1


def _open(members: DataFrame) -> DataFrame:
    """Groups (key, component) that lie in several components."""
    return (members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .filter("low <> high").select("key"))


def _prefixes(lines: DataFrame) -> DataFrame:
    """(key, id, short): lines by the shingles of their prefix, rarest first; ``short`` if the shingle is in the
    prefix that counts for the shorter of two lines."""
    tokens = stored(lines.select("id", "line").mapInArrow(_tokens, "id long, size long, token long"), "line-tokens")
    twice = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(1)), "token"))

    def within(share: float) -> Column:
        # a little less than the share, so that rounding keeps a pair rather than loses it
        return F.col("rank") <= F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1

    out = stored(tokens.join(twice, "token", "left").withColumn("rank", rank)
                 .filter(F.col("n").isNotNull() & within(SIMILARITY))
                 .select(F.col("token").alias("key"), "id", within(2 * SIMILARITY / (1 + SIMILARITY)).alias("short")), "line-prefixes")
    release(tokens)
    return out


def _met(members: DataFrame) -> DataFrame:
    """Lists in which every two lines of a group (key, id, short, component) meet that may be similar and
    are in different components."""
    largest = (members.groupBy("key", "component").agg(F.count("*").alias("k"))
               .groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.sum("k").alias("n"),
                                   (F.sum("k") - F.max("k")).alias("n_rest")))
    shorts = members.groupBy("key").agg(F.sum(F.col("short").cast("long")).alias("n_short"))
    few = F.col("n_short") <= F.col("n_rest")
    all_of = stored(members.join(largest.join(shorts, "key"), "key")
                    .withColumn("left", F.when(few, F.col("short")).otherwise(F.col("component") != F.col("largest")))
                    .withColumn("part", _part(F.col("n"))).withColumn("lpart", _part(F.least("n_short", "n_rest"))), "line-met")
    right = all_of.groupBy("key", "part").agg(F.collect_list("id").alias("r_ids"))
    left = all_of.filter("left").groupBy("key", "lpart").agg(F.collect_list("id").alias("l_ids"))
    return left.join(right, "key").select(F.array_sort(F.array_union("l_ids", "r_ids")).alias("ids")).filter("size(ids) > 1")


def _settled(members: DataFrame, labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Labels after all similar lines of large buckets (key, id) are connected."""
    labels = _linked(members, labels, lines)
    placed = stored(_in_components(members, labels), "line-placed")
    rest = stored(placed.join(_open(placed), "key").select("id").distinct(), "line-open")
    release(placed)
    if rest.isEmpty():
        return labels
    keys = _prefixes(lines.join(rest, "id"))
    groups = stored(_in_components(keys, labels), "line-groups")
    sizes = stored(groups.groupBy("key").agg(F.count("*").alias("n"), F.max("short").alias("any"), F.min("component").alias("low"),
                                             F.max("component").alias("high"))
                   .filter("n > 1 and any and low <> high").select("key", "n"), "line-sizes")
    small = (groups.join(sizes.filter(F.col("n") <= max(LIST, 2)), "key").groupBy("key")
             .agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids"))
    edges = _verified(small, lines, labels)
    large = stored(groups.join(sizes.filter(F.col("n") > max(LIST, 2)), "key").select("key", "id", "short"), "line-large")
    labels = _merged(labels, edges)
    release(keys, groups, sizes, rest, edges)
    labels = _linked(large, labels, lines)
    placed = stored(_in_components(large, labels), "line-placed")
    last = stored(placed.join(_open(placed), "key"), "line-last")
    release(large, placed)
    if last.isEmpty():
        return labels
    return _merged(labels, _verified(_met(last), lines, labels))


def line_components(lines: DataFrame) -> DataFrame:
    """(node, component) of the distinct lines (id, line) that are similar to another."""
    # ids meet by bucket in one exchange, read once for the sizes and once for the lines of buckets of two and more
    met = (lines.select("id", "line").mapInArrow(_signatures, "band long, id long")
           .repartition(shuffle_partitions(lines.sparkSession), "band"))
    # counts the ids, so that both readers ask for the same columns and share the exchange
    sizes = met.groupBy("band").agg(F.count("id").alias("n")).filter("n > 1")
    shared = stored(met.join(sizes.hint("shuffle_hash"), "band"), "line-buckets")
    lists = shared.filter(F.col("n") <= max(LIST, 2)).groupBy("band").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids")
    hot = stored(shared.filter(F.col("n") > max(LIST, 2)).select(F.col("band").alias("key"), "id"), "line-hot")
    edges = _verified(lists, lines)
    release(shared)
    labels = connected_components(edges)
    release(edges)
    if not hot.isEmpty():
        labels = _settled(hot, labels, lines)
    release(hot)
    return labels


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    # the lists first: an explode beside the text would copy it for every line
    lists = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines"))
    return lists.select("id", "th", F.posexplode("lines").alias("pos", "line")).filter(F.col("line").rlike(r"[^ \t\r\x0B\f]"))


def _name(line: Column) -> Column:
    """128 bits that stand for a line where its text is not at hand."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit("line")).alias("h2"))


def line_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, drop): positions of the lines that go, per document that loses any.

    The first occurrence stays: smallest id (null ids last), then text hash, then position."""
    every = _lines(docs, id_col, text_col)
    # the name is written beside the line: what only needs the name never moves the text
    distinct = stored(every.groupBy("line").agg(F.count("*").alias("n"))
                      .select(F.monotonically_increasing_id().alias("id"), "line", "n", _name(F.col("line")).alias("name"))
                      .select("id", "line", "n", "name.*"), "line-distinct")
    comps = line_components(distinct)
    doubles = stored(distinct.select("id", "n", "h1", "h2").join(comps.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left")
                     .filter("n > 1 or component is not null")
                     .select("h1", "h2", F.coalesce("component", "id").alias("component")), "line-doubles")
    found = stored(every.select("id", "th", "pos", _name(F.col("line")).alias("name")).select("id", "th", "pos", "name.*")
                   .join(doubles.hint("shuffle_hash"), ["h1", "h2"]).select("component", "id", "th", "pos"), "line-found")
    # the least (id, text hash, position) of a component, one aggregate after another
    order = F.struct(F.col("id").isNull().alias("z"), "id", "th", "pos")
    first = stored(found.groupBy("component").agg(F.min(order).alias("k")).select("component", "k.id", "k.th", "k.pos")
                   .toDF("component", "k_id", "k_th", "k_pos"), "line-first")
    release(distinct, doubles)
    keep = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")) & (F.col("pos") == F.col("k_pos"))
    drops = stored(found.join(first, "component").filter(~keep).groupBy("id", "th").agg(F.collect_list("pos").alias("drop")),
                   "line-drops")
    release(found, first)
    return drops


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """Every row of ``docs`` with the text that stays and, with ``counts``, n_lines and n_removed beside its columns
    (columns of ``docs`` with these names give way to them; without ``counts`` they stay as they are).

    Lines are cut at newline characters.  Blank lines are kept and match nothing; a null text
    stays null; other texts keep their line order.  Of rows that repeat both id and text all but one
    lose every line that is not blank.  An empty table gives no rows."""
    drops = line_drops(docs, id_col, text_col)
    # one key for the join and for the count of repeated rows, so that the texts are shuffled once; null ids are equal in it
    drops = drops.select(F.struct("id", "th").alias("__key"), F.col("drop").alias("__drop"))
    kept = [c for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").cast("string").alias("__text"),
                      F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("th")).alias("__key"))
    joined = own.join(drops, "__key", "left")
    again = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0))) > 1
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    n, names = len(kept), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, total, gone = [], [], []
            for t, drop, twice in zip(*(b.column(n + k).to_pylist() for k in range(3))):
                if not drop and not twice:
                    out.append(t)
                    total.append((t or "").count("\n") + 1)
                    gone.append(0)
                    continue
                lines = (t or "").split("\n")
                lose = {i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")} if twice else set(drop)
                out.append("\n".join([x for i, x in enumerate(lines) if i not in lose]) if lose else t)
                total.append(len(lines))
                gone.append(len(lose))
            cols = [pa.array(out, pa.string()) if name == text_col else c for name, c in zip(names, b.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                             [*(f"c{i}" for i in range(n)), "n_lines", "n_removed"])

    # the text goes to the workers once, as __text
    sent = [F.lit(None).cast("string").alias(f"c{i}") if c == text_col else F.col(f"c{i}") for i, c in enumerate(kept)]
    out = joined.select(*sent, "__text", "__drop", again.alias("__again")).mapInArrow(run, f"{schema}, n_lines long, n_removed long")
    return out.toDF(*kept, "n_lines", "n_removed") if counts else out.select([F.col(f"c{i}").alias(c) for i, c in enumerate(kept)])
