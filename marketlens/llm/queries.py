"""One registered query per operator, over whole tables with production parameters.

``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame; ``ORACLE`` has the DuckDB statement where
SQL can express the result.  The others are held against brute force in tests/llm.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language, line_dedup, periodic_runs, quality, suffix_dedup, warc
from .bpe import encode_round_trip
from .common import documents, tuned
from .exact_dedup import exact_groups
from .fingerprint import edited_fingerprints
from .lexical_search import search
from .packing import pack, pieces
from .simhash_dedup import near_groups

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
#: Token that ends a document when packing.
END_ID = 2


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = language.prototypes(docs.filter(~language.held_out()))
    found = language.predict(docs, learned)
    return found.withColumn("held_out", language.held_out())


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tuned(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.extract(pages, html_text.fit(pages))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pack(pieces(docs, WORD_BPE, END_ID)).withColumnRenamed("id", "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_round_trip(documents(spark, sf_dir), BYTE_BPE)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_tails(documents(spark, sf_dir))))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tuned(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_fingerprint, op2_suffix_dedup, op3_language, op4_simhash_dedup, op5_html_text,
        op6_packing, op7_exact_dedup, op8_line_dedup, op9_quality, op10_bpe, op11_periodic_runs,
        op12_search, op13_warc)}

ORACLE: dict[str, str] = {
    "op7_exact_dedup": r"""
with n as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size,
       row_number() over w = 1 as kept, sha256(t) as text_sha256
from n window w as (partition by t order by points desc, doc_id)""",
    "op12_search": r"""
with t as (
  select doc_id, row_number() over () as rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
it as (
  select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
iw as (select item_id, term, count(*) as repeats from it group by all),
size as (select count(*)::bigint as n_docs, sum(len(terms))::bigint as n_words from t where len(terms) > 0),
norm as (select doc_id, rid, 75 + (25 * len(terms)::bigint * n_docs) // n_words as m from t, size),
tf as (select rid, term, count(*)::bigint as f from (select rid, unnest(terms) as term from t)
       where term in (select term from iw) group by all),
df as (select term, count(*) as df from tf group by term),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, size),
s as (select item_id, rid, sum(repeats * w * ((1000000000 * f) // (1000 * f + 12 * m)))::bigint as score
      from iw join w using (term) join tf using (term) join norm using (rid) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
      from s join norm using (rid) where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20""",
    "op13_warc": r"""
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload)::bigint as payload_bytes, upper(sha1(payload)) as hex,
             first_value(page_id) over w as first_id, row_number() over w as r
      from p window w as (partition by payload order by page_id))
select page_id, payload_bytes,
       translate(to_base(('0x' || substr(hex, 1, 10))::bigint, 32, 8) || to_base(('0x' || substr(hex, 11, 10))::bigint, 32, 8) ||
                 to_base(('0x' || substr(hex, 21, 10))::bigint, 32, 8) || to_base(('0x' || substr(hex, 31, 10))::bigint, 32, 8),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
       case when r = 1 then 'response' else 'revisit' end as record_type,
       case when r > 1 then first_id end as refers_to
from d""",
}
