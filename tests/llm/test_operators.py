"""Each operator against brute force on a corpus of awkward cases, and on an empty table."""
import hashlib
import html
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import (bpe, components, exact_dedup, fingerprint, html_text, language, line_dedup, packing, quality,
                            simhash_dedup, suffix_dedup)
from marketlens.llm.queries import BYTE_BPE, END_ID, WORD_BPE

needs_files = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="vocabulary files are not here")


def bag(items):
    return Counter(items)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def union(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


# ---------------------------------------------------------------- components
def test_components_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7), (300, 301), (301, 300), (None, 5)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[i] for i in [100, *range(200, 260)]} == {100}
    assert got[300] == got[301] == 300
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 fingerprints
def test_fingerprints_and_edits(docs, rows):
    out = fingerprint.edited_fingerprints(docs)
    got = [r.asDict() for r in out.collect()]
    line = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -2 ** 63), (r[1] or "").encode()))
    texts = [(i, t or "") for i, t in line]
    expected = []
    for k, (i, t) in enumerate(texts):
        half = len(t) // 2
        expected.append((i, len(t), sha(t[:len(t) - half] + texts[(k + 1) % len(texts)][1][:half])))
    assert bag((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got) == bag(expected)
    plain = fingerprint.fingerprints(docs).collect()
    # fingerprints of texts, edited texts and next texts made in Python
    following = [texts[(k + 1) % len(texts)][1] for k in range(len(texts))]
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for (_, t), n in zip(texts, following)]
    fps = {r["id"]: r["fp"] & (2 ** 64 - 1) for r in fingerprint.fingerprints(docs.sparkSession.createDataFrame(
        [(f"{kind}{k}", t) for kind, of in (("t", [t for _, t in texts]), ("e", edited), ("n", following)) for k, t in enumerate(of)],
        "doc_id string, text string")).collect()}

    def like(a, b):
        return 1 - bin(a ^ b).count("1") / 64

    assert bag((g["doc_id"], g["fingerprint"], g["edited_fingerprint"], g["near_edited"], g["near_next"]) for g in got) == bag(
        (i, f"{fps[f't{k}']:016x}", f"{fps[f'e{k}']:016x}", like(fps[f"t{k}"], fps[f"e{k}"]), like(fps[f"t{k}"], fps[f"n{k}"]))
        for k, (i, _) in enumerate(texts))
    assert bag((g["doc_id"], g["fingerprint"]) for g in got) == bag((p["id"], f"{p['fp'] & (2 ** 64 - 1):016x}") for p in plain)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_votes(spark):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "a b a b c"), (3, "A  b\ta b c"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r["id"]: r["fp"] & (2 ** 64 - 1) for r in fingerprint.fingerprints(df).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] == 0
    h = [r["h"] & (2 ** 64 - 1) for r in spark.sql(
        "select xxhash64(a, b) h from values ('a','b'),('b','a'),('a','b'),('b','c'),('c',cast(null as string)) t(a, b)").collect()]
    assert got[1] == sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_block_tables_find_all_within_radius(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for k in range(6):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [f - 2 ** 64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed] * 2, "fp long")
    for radius, blocks in ((3, 5), (2, 4), (0, 2)):
        got = sorted((r["query"] & (2 ** 64 - 1), r["found"] & (2 ** 64 - 1)) for r in fingerprint.near_pairs(df, df, radius, blocks).collect())
        assert got == [(a, b) for a in fps for b in fps if a != b and bin(a ^ b).count("1") <= radius]


def test_fingerprints_of_nothing(nothing):
    assert fingerprint.edited_fingerprints(nothing).count() == 0


# ---------------------------------------------------------------- 2 suffix array
def brute_repeats(texts, span=200):
    seen = Counter(b[k:k + span] for b in texts for k in range(len(b) - span + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k:k + span]] > 1:
                gone[k:k + span] = b"\1" * span
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


@pytest.mark.parametrize("group", [2048, 1])
def test_suffix_dedup(docs, rows, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = suffix_dedup.report(docs).collect()
    expected = brute_repeats([(t or "").encode() for _, t in rows])
    assert bag(tuple(r) for r in got) == bag((i, *e) for (i, _), e in zip(rows, expected))


def test_suffix_contexts_come_in_bounded_batches(monkeypatch):
    """A periodic text recurs at nearly every byte: its contexts leave in batches, all of them."""
    text = "ab" * 20_000
    at, _ = suffix_dedup.anchors(np.frombuffer(text.encode(), np.uint8))

    def batches(most):
        monkeypatch.setattr(suffix_dedup, "BATCH", most)
        b = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([7, 8]), pa.array([text, text[:500]]),
                                        pa.array([at.tolist(), [0, 100, 100]])], ["id", "th", "text", "spots"])
        return list(suffix_dedup._doc_contexts(iter([b])))

    few, whole = batches(1000), batches(10 ** 9)
    assert max(b.num_rows for b in few) < 2000 and len(whole) == 1
    assert pa.Table.from_batches(few).to_pylist() == pa.Table.from_batches(whole).to_pylist()
    assert whole[0].num_rows == len(at) + 2


def test_suffix_sort_orders_and_verifies():
    rng = random.Random(3)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(900)).encode() * 2, np.uint8)
    start = np.array(rng.sample(range(1500), 400))
    size = np.array([rng.randrange(60) for _ in start])
    key = np.array([rng.randrange(3) for _ in start])
    order, lcp = suffix_dedup.neighbours(data, key, start, size)
    text = data.tobytes()
    found = [(key[i], text[start[i]:start[i] + size[i]]) for i in order]
    assert found == sorted(found)
    for k in range(1, len(found)):
        shared = len(os.path.commonprefix([found[k - 1][1], found[k][1]])) if found[k - 1][0] == found[k][0] else 0
        assert lcp[k] == shared


def test_equal_windows_against_strings():
    rng = random.Random(8)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    left = np.array([rng.randrange(len(p) + 1) for p in parts])
    size = np.array(list(map(len, parts)))
    key = np.array([rng.randrange(4) for _ in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.cumsum(size) - size + left
    for offset, fits, again, first in suffix_dedup.equal_windows(data, key, at, left, size - left, span=4, gram=1):
        names = {i: (key[i], parts[i][left[i] - offset:left[i] - offset + 4]) for i in range(len(parts))
                 if left[i] >= offset and size[i] - left[i] >= 4 - offset}
        count = Counter(names.values())
        assert sorted(fits) == sorted(names)
        for i, a, f in zip(fits, again, first):
            assert a == (count[names[i]] > 1) and names[f] == names[i]


def test_suffix_removed_keeps_other_columns(docs, nothing):
    out = suffix_dedup.removed(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.report(nothing).count() == 0 and suffix_dedup.removed(nothing).count() == 0


# ---------------------------------------------------------------- 3 language
def test_language_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = language.prototypes(df.filter(~language.held_out()))
    got = language.predict(df, learned).join(df, "doc_id").withColumn("h", language.held_out()).filter("h").collect()
    assert len(got) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    crc = {r["doc_id"] for r in df.filter(language.held_out()).collect()}
    assert crc == {r["doc_id"] for r in df.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}


def test_language_against_one_gram_at_a_time(spark):
    """Prototypes and cosines from a loop over every n-gram of every text."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.filter("length(text) < 1500").limit(60).collect()]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def vector(text):
        letters = [c.lower() if c.isalpha() else " " for c in text or ""]
        codes = [0 if c == " " else ord(c) for c in " " + " ".join("".join(letters).split()) + " "]
        out, n = np.zeros(language.DIM), len(codes) - language.NGRAM + 1
        for k in range(max(0, n)):
            bound = np.ones(language.DIM)
            for place, c in enumerate(codes[k:k + language.NGRAM]):
                bound = bound * language.letter_vector(c, place, language.DIM, language.SEED)
            out += bound
        return out, max(n, 1)

    proto = {}
    for _, text, lang in rows:
        if text and lang and any(c.isalpha() for c in text):
            v, n = vector(text)
            proto[lang] = proto.get(lang, 0) + v / n
    learned = language.prototypes(some)
    assert set(learned) == set(proto) and all(np.allclose(learned[k], proto[k], atol=1e-3) for k in proto)
    got = {r["doc_id"]: r for r in language.predict(some, learned).collect()}
    for i, text, _ in rows:
        v, _ = vector(text)
        if not any(c.isalpha() for c in text or ""):
            assert got[i]["lang_pred"] == "und"
            continue
        cos = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in proto.items()}
        assert abs(got[i]["score"] - max(0, max(cos.values()))) < 1e-3
        assert cos[got[i]["lang_pred"]] > max(cos.values()) - 1e-3


def test_language_awkward_rows(docs, rows, nothing):
    learned = language.prototypes(docs)
    assert set(learned) <= {"en", "fr"}
    got = language.predict(docs, learned).collect()
    none = bag(i for i, t in rows if t is None or not any(c.isalpha() for c in t))
    assert bag(r["doc_id"] for r in got) == bag(i for i, _ in rows)
    assert bag(r["doc_id"] for r in got if r["lang_pred"] == "und") == none
    assert language.prototypes(nothing) == {}
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}


def test_counts_direct_and_sorted_paths_agree(monkeypatch):
    texts = ["Über den Wolken", "la casa 12 azul", "", "日本語 テキスト", "aaa"]
    a = language.Counts(texts)
    monkeypatch.setattr(language, "DIRECT", 0)
    b = language.Counts(texts)
    for x in (a, b):
        x.found = [{tuple(x.grams[:, j]): row[j] for j in np.flatnonzero(row)} for row in x.table]
    assert a.found == b.found


# ---------------------------------------------------------------- 4 SimHash near-dedup
def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def test_near_groups(docs, rows, nothing):
    got = simhash_dedup.near_groups(docs).collect()
    fps = [brute_fingerprint(t or "") for _, t in rows]
    top = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    ids = defaultdict(list)
    for (i, _), c in zip(rows, top):
        ids[c].append(i)
    least = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    assert bag(tuple(r) for r in got) == bag((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, top))
    assert simhash_dedup.near_groups(nothing).count() == 0
    assert simhash_dedup.representatives(docs).count() == len(ids)
    assert simhash_dedup.representatives(docs).columns == docs.columns


@pytest.mark.parametrize("shard,block,leaf", [(512, 4096, 256), (16, 8, 4)])
def test_vantage_point_links(spark, monkeypatch, shard, block, leaf):
    for name, x in (("SHARD", shard), ("BLOCK", block), ("LEAF", leaf)):
        monkeypatch.setattr(simhash_dedup, name, x)
    rng = random.Random(2)
    fps = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(5):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= (rng.random() < 0.3) << rng.randrange(64)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << i) for i in range(64)}
    fps = sorted(fps)
    signed = [f - 2 ** 64 if f >> 63 else f for f in fps]
    edges = simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    at = {f: i for i, f in enumerate(signed)}
    mine = union(len(fps), [(at[r["a"]], at[r["b"]]) for r in edges])
    true = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    assert mine == true
    assert len(edges) < 20 * len(fps)


# ---------------------------------------------------------------- 5 HTML
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- x --><div class="ad">Buy this now.</div>
<div class="cookie-notice">We use cookies here.</div><article><h1>Title &amp; more</h1><p><b>First</b>   line&nbsp;of text,
with words.<br>Next.<p>Second &lt;block&gt; caf&eacute;.<div class="share">Share it!</div><section id="comments"><p>Nice article, thanks a lot.</p></section></article>
<aside>Related things.</aside><form><label>Mail</label><input></form><footer>&copy; me. All rights.</footer></body></html>"""


def test_html_extraction(spark, nothing):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_text.fit(pages)
    got = {r["page_id"]: r for r in html_text.extract(pages, model).collect()}
    for r in pages.collect():
        page = r["html"]
        begin, end = page.find("<article>"), page.find("</article>")
        body = re.sub(r"<[^>]*(>|$)", " ", re.sub(r"</?b>", "", page[begin + 9:end if end >= 0 else len(page)])) if begin >= 0 else ""
        assert got[r["page_id"]]["text"] == " ".join(html.unescape(body).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert html_text.main_text(PAGE, model) == "Title & more First line of text, with words. Next. Second <block> café."
    odd = spark.createDataFrame([(1, None, None, 5), (2, "u", "", 5), (2, "u", "<p>a<", 5), (None, "u", "<" * 3000 + "\"'", 5)],
                                "page_id long, url string, html string, id int")
    assert html_text.extract(odd, model).count() == 4
    empty = odd.limit(0)
    assert html_text.extract(empty, html_text.fit(empty)).count() == 0


def test_marginals_are_exact():
    """Messages against the sum over all labellings of a small tree."""
    import itertools
    import math

    model = html_text.Model(html_text.page_counts(PAGE))
    nodes = html_text.in_order(html_text.parse("<div><article><p>One two. Three</p></article><div class=ad>Buy</div></div>"))
    keys = html_text.features(nodes)
    place = {n: i for i, n in enumerate(nodes)}
    total, content = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        score = 0.0
        for n, x in zip(nodes, labels):
            score += sum(model.own[k][x] for k in keys[n] if k in model.own)
            if n.parent is not None:
                score += model.pair[html_text.edge(n)][labels[place[n.parent]]][x]
        w = math.exp(score)
        total += w
        for i, x in enumerate(labels):
            content[i] += w * x
    got = model.marginals(nodes)
    assert all(abs(got[n] - content[i] / total) < 1e-9 for i, n in enumerate(nodes))


@pytest.mark.parametrize("before", ['<svg class="x"/>', "<datalist><option value=x></datalist>", "<option value=x>", "<p>\u0130</p><SCRIPT>x</SCRIPT><script>y</SCRIPT>",
                                    "<datalist><option>a<option>b</option></datalist>"])
def test_html_keeps_what_follows_raw_elements(before):
    texts = [x.text for x in html_text.in_order(html_text.parse(f"<body>{before}<article><p>One two three.</p></article></body>"))]
    assert "One two three." in texts


@pytest.mark.parametrize("start", ["<p title=it's>", "<p data-x=a'b class=\"c\">", "<p title='a > b'>", "<p title = \"x>y\" lang=en>"])
def test_html_quotes_in_start_tags(start):
    page = f"<article>{start}One two.</p><p>Don't stop.</p></article>"
    assert [x.text for x in html_text.in_order(html_text.parse(page)) if x.tag == "#"] == ["One two.", "Don't stop."]


def test_html_without_named_content(spark):
    """Pages none of which has an article or main element still have a main text."""
    page = ("<html><head><title>t</title></head><body><div class=nav><a href=/>Home</a> <a href=/b>More</a></div><h1>Head {0}</h1>"
            "<div class=box><p>First words of page {0}, and more of them.</p><p>Second, longer sentence. It has two ends.</p></div>"
            "<footer>All rights {0}.</footer></body></html>")
    pages = spark.createDataFrame([(i, "u", page.format(i)) for i in range(40)], "page_id long, url string, html string")
    for r in html_text.extract(pages, html_text.fit(pages)).collect():
        i = r["page_id"]
        assert r["text"] == f"Head {i} First words of page {i}, and more of them. Second, longer sentence. It has two ends."
    # one page that tells among many that don't is found, however the sample falls
    named = spark.createDataFrame([(99, "u", PAGE)], pages.schema)
    assert html_text.fit(pages.unionByName(named), rows=1).own == html_text.fit(named).own


# ---------------------------------------------------------------- 6 packing
def test_patterns_hold_the_histogram():
    rng = random.Random(4)
    for size in (16, 100):
        histogram = {k: rng.randrange(1, 500) for k in rng.sample(range(1, size + 1), size // 2)}
        found = packing.patterns(histogram, size)
        assert all(sum(p) <= size and n > 0 for n, p in found)
        used = Counter()
        for n, p in found:
            for x in p:
                used[x] += n
        assert used == histogram
    assert packing.patterns({}, 16) == []
    assert packing.patterns({1: 10 ** 12}, 16)[0][0] == 10 ** 12 // 16


@needs_files
def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    got = packing.pack(packing.pieces(docs, WORD_BPE, END_ID, 64), 64).collect()
    expected = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [END_ID]
        expected += [(i, s, len(ids[s:s + 64]), zlib.crc32(np.array(ids[s:s + 64], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    assert bag((r["id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == bag(expected)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(length for parts in seqs.values() for _, length in parts)
    assert 64 * len(seqs) - total <= 0.05 * total + 64
    assert packing.pack(packing.pieces(nothing, WORD_BPE, END_ID)).count() == 0


@needs_files
def test_packing_encodes_a_word_once_whatever_marks_it_has(monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)

    def ids(text):
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    monkeypatch.setattr(packing, "_WORKER", {})
    for text in ("Zorble zorble, (zorble) zorble*** zorble.", "été été, Été;"):
        assert packing.token_bytes(WORD_BPE, text) == ids(text)
    assert set(packing._tokenizer(WORD_BPE)[-1]) == {"zorble", ",", "(", ")", "***", ".", "été", ";"}
    rng = random.Random(6)
    signs = [*map(chr, range(1, 0x190)), *"stremvdSLA.,<|>/'09 \t\n" * 5, "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "'LL", "n\u0303", "Σ", "中", "\U0001f600"]
    for _ in range(5000):
        text = "".join(rng.choices(signs, k=rng.randrange(14)))
        assert packing.token_bytes(WORD_BPE, text) == ids(text), repr(text)


# ---------------------------------------------------------------- 7 exact dedup
def test_exact_dedup(docs, rows, nothing):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    expected = bag((i, min(g)[3], len(g), sha(k)) for k, g in groups.items() for *_, i in g)
    assert bag((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_dedup_splits_late(spark):
    texts = ["p" * 5000 + c for c in "aabbc"] + ["p" * 31 + "x", "p" * 31 + "y", "é" * 40, "é" * 40]
    got = exact_dedup.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7)]


# ---------------------------------------------------------------- 8 line dedup
def brute_lines(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2]))
    lines = list(dict.fromkeys(x for k in order for x in (rows[k][1] or "").split("\n") if x.strip(" \t\r\x0b\x0c")))
    sh = [line_dedup.shingles(x) for x in lines]
    top = union(len(lines), [(i, j) for i in range(len(lines)) for j in range(i)
                             if len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j])])
    comp = dict(zip(lines, top))
    seen, out = set(), {}
    for k in order:
        kept = []
        for x in (rows[k][1] or "").split("\n"):
            if x in comp:
                if comp[x] in seen:
                    continue
                seen.add(comp[x])
            kept.append(x)
        out[k] = None if rows[k][1] is None else "\n".join(kept)
    return [out[k] for k in range(len(rows))]


@pytest.mark.parametrize("most", [256, 1])
def test_line_dedup(docs, nothing, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "LIST", most)
    keyed = [(r["doc_id"], r["text"], r["th"]) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) th").collect()]
    out = line_dedup.deduplicated(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert bag(got) == bag((i, t) for (i, _, _), t in zip(keyed, brute_lines(keyed)))
    assert line_dedup.deduplicated(nothing).count() == 0


def test_line_dedup_with_columns_of_the_counts(spark):
    """Tables that have n_lines or n_removed, very short lines, repeated rows and null ids."""
    rows = [(1, "abc\nab\na", 7, "x"), (2, "a\nbb", 8, None), (None, "ab", 9, "y"), (None, "ab", 9, "y"), (3, None, 1, "z"), (4, "\n \n", 2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed string")
    got = line_dedup.deduplicated(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert bag(map(tuple, got.collect())) == bag([(1, "abc\nab\na", 3, 0), (2, "bb", 2, 1), (None, "", 1, 1), (None, "", 1, 1), (3, None, 1, 0), (4, "\n \n", 3, 0)])
    bare = line_dedup.deduplicated(df, counts=False)
    assert bare.columns == df.columns and {r["n_removed"] for r in bare.collect()} == {"x", None, "y", "z"}
    one = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    assert line_dedup.deduplicated(one).collect()[0]["text"] == "short"


def test_shared_shingles_are_exact(monkeypatch):
    """Counts against sets of strings: parts, hashes that collide, lines shorter than a shingle."""
    rng = random.Random(9)
    hashes = line_dedup._shingle_hashes
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(line_dedup, "_shingle_hashes", lambda x: (lambda h, f: (h % np.uint64(7), f))(*hashes(x)))
        for entries in (1 << 19, 64):
            monkeypatch.setattr(line_dedup, "ENTRIES", entries)
            for _ in range(12):
                base = [rng.choice("abcdé🙂 ") for _ in range(rng.randrange(1, 60))]
                lines = list({"".join(c if rng.random() > 0.05 else rng.choice("xyz") for c in base) for _ in range(20)}) + ["q", "qq"]
                some = np.array(sorted(rng.sample(range(len(lines)), 2)))
                size, both = line_dedup.shared_shingles(lines, some)
                sh = [line_dedup.shingles(x) for x in lines]
                assert size.tolist() == [len(x) for x in sh]
                assert all(int(both[a, j]) == len(sh[i] & sh[j]) for a, i in enumerate(some) for j in range(len(lines)) if i != j)


def test_verifier_compares_integers(monkeypatch):
    rng, brute = random.Random(8), line_dedup.shingles
    kinds = ["ab", "abé\x00ß", "abœ中", "".join(map(chr, range(0x4e00, 0x4f40)))]

    def edges(lines):
        verifier, ids = line_dedup.Verifier(), list(range(len(lines)))
        verifier.add(ids, lines, ids)
        return verifier.edges()

    for _ in range(300):
        signs = rng.choice(kinds)
        base = "".join(rng.choices(signs, k=rng.randrange(3, 60)))
        places = [rng.randrange(len(base)) for _ in range(rng.randrange(2, 14))]
        lines = list({base[:i] + rng.choice(signs) * rng.randrange(4) + base[i:] for i in places})
        sets = [brute(x) for x in lines]
        top = union(len(lines), [(i, j) for j in range(len(lines)) for i in range(j)
                                 if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
        assert edges(lines) == [(t, i) for i, t in enumerate(top) if t != i]
    # lines of few kinds of characters need no sets of strings
    monkeypatch.setattr(line_dedup, "shingles", None)
    assert edges(["œuvre: " + "abcdefgh" * 3 + x for x in ("", "x", "yyyyyyyyyyyyyyyyyyyyyy")]) == [(0, 1)]


def test_line_dedup_bounds_hot_buckets(spark, monkeypatch):
    """A templated line that differs in a number: no verifier sees the whole bucket, and lists stay few."""
    monkeypatch.setattr(line_dedup, "LIST", 16)
    sizes, verified = [], line_dedup._verified

    def counted(lists, *others):
        sizes.extend(len(r["ids"]) for r in lists.distinct().collect())
        return verified(lists, *others)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    n = 600
    near = [f"the archived record number {i:04d} of the northern office was taken over without any remark or change by the clerk" for i in range(n)]
    apart = [f"entry {i * 7919 % 100000:05d} has been seen and closed" for i in range(n)]
    lines = near + apart
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {r["node"]: r["component"] for r in line_dedup.line_components(df).collect()}
    sh = [line_dedup.shingles(x) for x in lines]
    top = union(len(lines), [(i, j) for i in range(len(lines)) for j in range(i)
                             if len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j])])
    least = {}
    for i, c in enumerate(top):
        least.setdefault(c, i)
    assert [got.get(i, i) for i in range(len(lines))] == [least[c] for c in top]
    assert max(sizes) <= 4 * 16 and sum(sizes) <= 40 * len(lines)


# ---------------------------------------------------------------- 9 quality
def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    teach = labels.filter("doc_id % 3 <> 0")
    got = {r["doc_id"]: r["keep"] for r in quality.score(df, quality.fit(df, teach)).collect()}
    held = labels.filter("doc_id % 3 = 0").collect()
    clean = [got[r["doc_id"]] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    junk = [got[r["doc_id"]] for r in held if r["quality"] == 0]
    assert len(got) == df.count() and np.mean(clean) >= 0.95 and np.mean(junk) <= 0.4


def test_quality_pool_is_whole(spark):
    """What views teach each other, against plain loops over every row that isn't fitted; copies of the
    pool count each time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    many = docs.unionByName(docs).unionByName(docs).withColumn("doc_id", F.monotonically_increasing_id())
    rng = np.random.default_rng(3)
    views = {v: np.concatenate([rng.normal(0, 0.3, 1 << bits), [0.2, 2.0, 0.1, 0.4]])
             for v, bits in (("text", quality.TEXT_BITS), ("meta", quality.META_BITS))}
    got = quality.hand_over(quality._rows(many, "doc_id", "text"), views)
    taught = {v: {k: np.zeros((2, len(w) - 3)) for k in ("slope", "bend", "seen")} for v, w in views.items()}
    for r in docs.collect():
        text = r["text"] or ""
        lines = text.split("\n")
        found = {"text": quality.text_features(text),
                 "meta": quality.meta_features(r["source"], r["lang"], r["n_chars"], len(lines), max(map(len, lines)))}
        z = {v: sum(views[v][j] for j in f.tolist()) + views[v][-4] for v, f in found.items()}
        for teacher, student in (("text", "meta"), ("meta", "text")):
            odds = np.exp(z[teacher] * 2.0 + 0.1) / np.exp(0.4)
            own = 1 / (1 + np.exp(-np.clip(z[student], -30, 30)))
            for label, sure in ((0, odds <= 1 / quality.SURE), (1, odds >= quality.SURE)):
                if sure:
                    for j in [*found[student].tolist(), -1]:
                        taught[student]["slope"][label, j] += 3 * (own - label)
                        taught[student]["bend"][label, j] += 3 * (len(found[student]) + 1) / 4
                        taught[student]["seen"][label, j] += 3
    for view, sums in taught.items():
        assert sums["seen"].any()
        for k, x in sums.items():
            assert np.allclose(getattr(got[view], k), x, atol=1e-3)


def test_quality_learns_from_rows_without_a_label(spark, monkeypatch):
    """Labelled rows beyond the bound and rows without a label teach; the order of rows and tasks doesn't matter."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    monkeypatch.setattr(quality, "FIT_ROWS", 150)
    counts, real = [], quality.hand_over
    monkeypatch.setattr(quality, "hand_over", lambda rows, views: counts.append((rows.count(), real(rows, views))) or counts[-1][1])
    one = quality.fit(docs, labels)
    n = docs.count()
    assert [c for c, _ in counts] == [n - 150] * (quality.ROUNDS - 1)
    assert any(x.count(c) > 0 for _, got in counts for x in got.values() for c in (0, 1))
    two = quality.fit(docs.repartition(7, "text"), labels)
    assert all(np.array_equal(a, b) for a, b in zip(one, two))


def test_lessons_bound_the_loss():
    """The quadratic that stands for the pool touches its log loss and lies above it."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(40)]
    w = rng.normal(0, 1, 31)

    def loss(u):
        return sum(np.log1p(np.exp(-(u[r].sum() + u[-1]))) for r in rows)

    slope, bend = np.zeros(31), np.zeros(31)
    for r in rows:
        at = np.append(r, 30)
        slope[at] += 1 / (1 + np.exp(-(w[r].sum() + w[-1]))) - 1
        bend[at] += len(at)
    taught = quality.Lessons({"slope": slope * quality.UNIT, "bend": bend, "seen": bend}, w[:-1], w[-1])
    for _ in range(200):
        d = rng.normal(0, rng.choice([0.01, 0.3, 2]), 31)
        assert loss(w + d) <= loss(w) + taught.slope @ d + (taught.bend * d * d).sum() / 2 + 1e-9


def test_quality_without_labels_keeps_all(docs, nothing, spark):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) is None
    assert quality.score(docs, None).filter("keep").count() == docs.count()
    assert quality.score(docs, None, with_row=True).columns == docs.columns
    few = spark.createDataFrame([(i * 3 + 1, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    weights = quality.fit(docs, few)
    assert quality.score(docs, weights).count() == docs.count()
    assert quality.score(docs, weights, with_row=True).columns == docs.columns
    assert quality.score(nothing, weights).count() == 0


# ---------------------------------------------------------------- 10 BPE
@needs_files
def test_bpe_round_trip(docs, rows, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    got = bpe.encode_round_trip(docs, BYTE_BPE).collect()
    expected = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert bag(tuple(r) for r in got) == bag(expected)
    back = bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE).collect()
    assert bag((r["doc_id"], r["text"]) for r in back) == bag((i, t or "") for i, t in rows)
    assert bpe.encode_round_trip(nothing, BYTE_BPE).count() == 0


@needs_files
def test_automaton_on_strange_strings():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(6)
    parts = ["a", "aa", "th", " ", "  ", "\n", "'s", "é", "漢", "🙂", "1", "22", "...", "\t", "<|endoftext|>", " the", "===", " "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert bpe.encode_ids(BYTE_BPE, text).tolist() == tok.encode(text, add_special_tokens=False).ids
