"""The pipeline on sf0.001 against brute force, stage by stage, and its registration."""
from collections import Counter

import numpy as np

import __spark_entry__
import corpus_pipeline
from marketlens.llm import quality
from marketlens.llm.common import documents, stored
from marketlens.llm.queries import END_ID, ORACLE, QUERIES, WORD_BPE

from .test_operators import brute_fingerprint, brute_lines, brute_repeats, union

SF = "/root/testdata/sf0.001"


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} <= {q.split("_")[0] + "_" for q in QUERIES}
    assert "pipeline" in __spark_entry__.queries() and set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    seen = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = stored(stage(spark, current, SF), "test-stage")
        seen[name] = current
        if name != "packing":
            assert current.columns == columns
    weights = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score(docs, weights).filter("keep").collect()}
    rows = [(r["doc_id"], r["text"], 0) for r in docs.collect() if r["doc_id"] in kept]
    assert {r["doc_id"] for r in seen["quality classifier"].collect()} == kept

    rows = [(i, t, 0) for (i, _, _), t in zip(rows, brute_lines(rows))]
    got = {r["doc_id"]: r["text"] for r in seen["line dedup"].collect()}
    assert got == {i: t for i, t, _ in rows}

    fps = [brute_fingerprint(t or "") for _, t, _ in rows]
    top = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    best = {}
    for k, c in enumerate(top):
        if c not in best or rows[k][0] < rows[best[c]][0]:
            best[c] = k
    rows = [rows[k] for k in sorted(best.values())]
    assert {r["doc_id"] for r in seen["SimHash near-dedup"].collect()} == {i for i, _, _ in rows}

    expected = brute_repeats([(t or "").encode() for _, t, _ in rows])
    got = {r["doc_id"]: r["text"] for r in seen["suffix-array dedup"].collect()}
    for (i, t, _), (size, gone, _, _) in zip(rows, expected):
        assert 0 <= size - gone - len((got[i] or "").encode()) <= 8 if gone else got[i] == t

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    total = Counter()
    packed = seen["packing"].collect()
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in got.items()}
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and END_ID == 2
    assert np.sum([4096 - x for x in fill.values()]) < 0.05 * 4096 * len(fill) + 4096
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_stages_on_awkward_and_empty_tables(spark, docs, nothing):
    """Nulls, blank and long texts, repeated ids and rows and clashing columns pass every stage; a document that
    is kept keeps its other columns."""
    for table in (docs, nothing):
        current = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stored(stage(spark, current, SF), "test-awkward")
            assert found.columns == table.columns
            assert found.count() <= current.count()
            assert found.filter("n_chars <> length(coalesce(text, ''))").count() == 0 or name in ("quality classifier", "SimHash near-dedup")
            assert found.filter("id <> 'clash' or fp <> 'clash' or h <> 1 or line <> 'clash' or length <> 'clash'").count() == 0
            current = found
        packed = corpus_pipeline.STAGES[-1][1](spark, current, SF)
        ids = Counter(r["doc_id"] for r in packed.select("doc_id").distinct().collect())
        assert set(ids) == {r["doc_id"] for r in current.select("doc_id").collect()}
