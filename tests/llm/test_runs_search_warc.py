"""Periodic runs, ranked search and the archive against brute force on awkward tables, and on empty ones."""
import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marketlens.llm import lexical_search, periodic_runs, warc
from marketlens.llm.common import documents
from marketlens.llm.queries import QUERIES

from .conftest import SCHEMA
from .test_operators import bag, sha

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- 11 periodic runs
def brute_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q if i > s else 0
            if n >= max(24, 3 * q) and not any(
                    q % f == 0 and all(w[j] == w[j + f] for j in range(s, s + n - f)) for f in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out)


def brute_tail(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if i is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def brute_row(i, text):
    words = brute_tail(i, WORD.findall(text or ""))
    runs = brute_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (i, len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2], sha(listed),
            sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def periodic_texts():
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a\tb\x0bc\n" * 8, "x " * 2000, "a\x1cb c " * 30, "a b " * 30]
    texts.append(" ".join((["w"] * 300 + ["v"] * 40 + [f"u{k}" for k in range(30)]) * 3))
    for _ in range(60):
        out = []
        while len(out) < rng.randrange(10, 500):
            unit = [rng.choice("ab" * rng.randrange(1, 4) + "cdefgh") for _ in range(rng.randrange(1, 70))]
            out += (unit * 9)[:rng.randrange(1, 8 * len(unit) + 1)]
        texts.append(rng.choice([" ", "\n", "  "]).join(out))
    return texts


@pytest.mark.parametrize("settings", [{}, {"GROUP_BYTES": 1}, {"CELLS": 64}])
def test_periodic_runs_against_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(periodic_runs, k, v)
    texts = periodic_texts()
    got = list(periodic_runs._document_runs([(t or "").encode() for t in texts]))
    assert [g[1] for g in got] == [brute_runs(WORD.findall(t or "")) for t in texts]


def test_periodic_query_columns(spark):
    rows = [(k, t) for k, t in enumerate(periodic_texts() * 3)] + [(None, "a " * 30), (5, "b c " * 40), (5, "b c " * 40)]
    rows = [r + ("clash",) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_tails(df)))
    assert bag(map(tuple, got.collect())) == bag(brute_row(i, t) for i, t, _ in rows)


def test_periodic_runs_on_the_table_and_on_nothing(spark, docs, rows, nothing):
    table = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    got = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == {i: brute_row(i, t) for i, t in table}
    out = periodic_runs.periodic_runs(docs).collect()
    assert bag((r["doc_id"], r["n_words"]) for r in out) == bag((i, len(WORD.findall(t or ""))) for i, t in rows)
    empty = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_tails(nothing)))
    assert empty.count() == 0 and empty.columns == QUERIES["op11_periodic_runs"](spark, SF).columns


def test_block_sums_are_exact():
    """Zero in a prime is not zero: values whose sum of squared differences is a multiple of a prime."""
    prime = periodic_runs.PRIMES[0][0]
    a = next(a for a in range(1, 40000) if math.isqrt(prime - a * a) ** 2 == prime - a * a)
    b = math.isqrt(prime - a * a)
    block, window = np.array([[a], [b]]), np.array([[0], [0], [a], [b]])
    assert (a * a + b * b) % prime == 0
    assert periodic_runs.mismatches_zero(block, window, max(a, b))[:, 0].tolist() == [False, False, True]
    rng = np.random.default_rng(2)
    block, window = rng.integers(0, 3, (4, 500)), rng.integers(0, 3, (11, 500))
    want = [[bool((block[:, r] == window[k:k + 4, r]).all()) for r in range(500)] for k in range(8)]
    assert periodic_runs.mismatches_zero(block, window, 2).tolist() == want


def test_long_repetitive_texts():
    one = list(periodic_runs._document_runs([b"ab cd " * 300000]))[0]
    assert one == (600000, [(0, 600000, 2)], b"ab cd")


# ---------------------------------------------------------------- 12 ranked search
TERM = re.compile(lexical_search.TERM)


def terms(text):
    return TERM.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute_search(docs, items, k=20):
    counts = [Counter(terms(t)) for _, t in docs]
    size = [sum(c.values()) for c in counts]
    n_docs, n_words = sum(1 for s in size if s), sum(size)
    df = Counter(w for c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for (i, _), c, n in zip(docs, counts, size):
            m = 75 + 25 * n * n_docs // max(1, n_words)
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m))
                        for w, r in Counter(terms(text)).items() if w in c)
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


ITEMS = [(1, "alpha beta alpha1 Épée7 straße3"), (2, "NODE1 node2 x15 x15 x15"), (3, ""), (4, None), (5, "...!"), (6, "nowhere"),
         (7, "alpha1 alpha2 alpha3 beta4 gamma5 delta6"), (7, "alpha1 alpha2 alpha3 beta4 gamma5 delta6"), (None, "tree endoftext emoji x1 a é"),
         (8, " ".join(f"alpha{k} edge{k}" for k in range(400)))]


@pytest.mark.parametrize("settings", [{}, {"VOCABULARY_BLOCK": 200, "ITEM_BLOCK": 100}, {"CELLS": 16, "HELD": 30}])
@pytest.mark.parametrize("k", [20, 3])
def test_search_against_brute_force(spark, docs, rows, monkeypatch, settings, k):
    for name, v in settings.items():
        monkeypatch.setattr(lexical_search, name, v)
    items = spark.createDataFrame([i + ("clash",) * 3 for i in ITEMS], "item_id long, text string, term string, doc_id string, score string")
    got = lexical_search.search(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()
    assert bag(map(tuple, got)) == bag(brute_search(rows, ITEMS, k))


def test_search_class_of_copies(spark):
    """A third of the rows is one text, another third differs from it only in words that no item holds."""
    rows = [(i, "red green blue") for i in range(300)] + [(i, f"red green off{i}") for i in range(300, 600)] + \
           [(i, f"red word{i % 7} blue{i % 5}") for i in range(600, 900)]
    items = [(1, "green"), (2, "red blue1"), (3, "word3 word3 green")]
    got = lexical_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(7),
                                spark.createDataFrame(items, "item_id long, text string"))
    found = got.collect()
    assert bag((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found) == bag(brute_search(rows, items))
    assert len({r["class_id"] for r in found if r["item_id"] == 1}) == 1  # 600 rows, one class


def test_search_text_ids_and_nothing(spark, nothing):
    rows = [(f"d{i % 40:02}", f"red word{i % 7}") for i in range(90)] + [(None, "red word1")]
    items = [("a", "word1"), ("b", "red")]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    asked = spark.createDataFrame(items, "item_id string, text string")
    got = lexical_search.search(table, asked).collect()
    want = brute_search([(None if i is None else int(i[1:]), t) for i, t in rows], items)
    assert bag((r["item_id"], r["rank"], None if r["doc_id"] is None else int(r["doc_id"][1:]), r["score"]) for r in got) == bag(want)
    assert lexical_search.search(nothing, asked).count() == 0
    assert lexical_search.search(table, asked.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "  ")], "doc_id long, text string")
    assert lexical_search.search(blank, asked).count() == 0


# ---------------------------------------------------------------- 13 archive
PAGES = [(3, "http://a/1", "<p>x</p>"), (1, "http://a/2\r\nWARC-Type: fake", "<p>x</p>"), (2, None, None), (9, "u", ""), (None, "é", "<p>x</p>"),
         (None, "n", "only here\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n"), (4, "u4", "\r\n\r\n" * 3), (5, "u5", "🙂" * 40000),
         (5, "u5", "🙂" * 40000), (6, "", "a\x00b\x1fc"), (7, "u7", "\r\n\r\n" * 3)]
PAGE_SCHEMA = "page_id long, url string, html string, sha1 string, rid string, address string, first string"


def brute_archive(rows, least=0):
    def b32(t):
        return base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()

    out, first = [], {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        i, _, t = rows[k]
        t = t or ""
        small = len(t.encode()) < least
        seen = not small and t in first
        if not seen:
            first[t] = i
        out.append((i, len(t.encode()), b32(t), "revisit" if seen else "response", first[t] if seen else None))
    return bag(out)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([p + ("clash",) * 4 for p in PAGES], PAGE_SCHEMA).repartition(3)


def test_archive_round_trip(spark, pages):
    got = warc.round_trip(pages)
    assert bag(map(tuple, got.collect())) == brute_archive(PAGES)
    empty = warc.round_trip(pages.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns


def test_archive_keeps_payloads_once_and_restores(spark, pages):
    archive = warc.store(pages)
    assert bag(r["payload"] for r in archive.payloads.collect()) == bag({t or "" for _, _, t in PAGES})
    back = warc.restore(archive).collect()
    assert bag((r["id"], r["payload"]) for r in back) == bag((i, t or "") for i, _, t in PAGES)
    for r in back:
        whole = r["head"].encode() + r["payload"].encode() + b"\r\n\r\n"
        (fields, head, payload), = warc.parse(io.BytesIO(whole))
        assert head.decode() == r["head"] and payload.decode() == r["payload"] and fields["WARC-Type"] == "response"
        assert int(fields["Content-Length"]) == len(whole) - whole.index(b"HTTP/1.1") - 4


def test_archive_files(spark, pages, tmp_path):
    archive = warc.store(pages)
    warc.write_files(archive, f"file://{tmp_path}/w")
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*.gz")))
    parsed = list(warc.parse(io.BytesIO(whole)))
    assert len(parsed) == len(PAGES) and len({f["WARC-Record-ID"] for f, _, _ in parsed}) == len(PAGES)
    payload = {f["WARC-Record-ID"]: p for f, _, p in parsed if f["WARC-Type"] == "response"}
    full = bag((payload[f.get("WARC-Refers-To", f["WARC-Record-ID"])].decode()) for f, _, _ in parsed)
    assert full == bag(t or "" for _, _, t in PAGES)
    read = warc.read_files(spark, f"file://{tmp_path}/w").collect()
    assert bag((r["record_id"], bytes(r["head"]), bytes(r["payload"])) for r in read) == bag((f["WARC-Record-ID"], h, p) for f, h, p in parsed)
    assert {f.get("WARC-Target-URI") for f, _, _ in parsed} >= {None, "é", "", "http://a/2%0D%0AWARC-Type: fake"}


def test_archive_digests_that_collide(spark, pages):
    """Equal digests of unequal bytes: each payload still has an address of its own."""
    archive = warc.store(pages, digest=lambda c: F.length(c) % 2)
    assert archive.payloads.select("address").distinct().count() == len({t or "" for _, _, t in PAGES})
    assert bag((r["id"], r["payload"]) for r in warc.restore(archive).collect()) == bag((i, t or "") for i, _, t in PAGES)
    heads = bag((r["id"], r["rid"] == r["first"]) for r in archive.heads.collect())
    assert heads == bag((i, kind == "response") for i, _, _, kind, _ in brute_archive(PAGES).elements())


def test_archive_least_bytes_and_damage(spark, pages):
    archive = warc.store(pages, least_bytes=9)
    small = [r for r in archive.heads.collect() if r["bytes"] < 9]
    assert len(small) == 6 and all(r["rid"] == r["first"] for r in small)
    broken = warc.Archive(archive.heads, archive.payloads.withColumn("payload", F.concat("payload", F.lit("!"))))
    with pytest.raises(PySparkException):
        warc.restore(broken).collect()
    text = spark.createDataFrame([("a\r\n%0Ab", "u", "x"), ("", "u", "x"), (" c ", "u", "y")], "page_id string, url string, html string")
    assert {r["page_id"] for r in warc.round_trip(text).collect()} == {"a\r\n%0Ab", "", " c "}


def test_archive_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert bag(map(tuple, QUERIES["op13_warc"](spark, SF).collect())) == brute_archive(rows)
