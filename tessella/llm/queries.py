"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of rules whose cutoffs labelled rows certify."""
    from tessella.llm import rules

    out = rules.judge_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by per-prefix dynamic programming, and the text decoded from them, as digests."""
    import public_tokenizers

    from tessella.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))



def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 10-word windows of the benchmark items in every document, over a stored positional index; n_near_items also counts items with one word put between."""
    from tessella.llm import decontam

    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items").withColumn("n_near_items", F.size("near").cast("long")).drop("near")



def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-packed files of every text's ids in doc_id order, and each document as it is read back from them."""
    import public_tokenizers

    from tessella.llm import token_files

    return token_files.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))



def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base spans, and those that rewriting disguises adds."""
    from tessella.llm import pii

    return pii.report(table(spark, sf_dir, "documents"))



def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles are similar to 80 % or more, links confirmed on full sets."""
    from tessella.llm import minhash

    return minhash.groups(table(spark, sf_dir, "documents"), k=4, percent=80).drop("mark").withColumnRenamed("id", "doc_id")



def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by a factorisation machine fitted out of the held-out fold."""
    from tessella.llm import quality

    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))



def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, its blocks labelled by a bidirectional LSTM."""
    from tessella.llm import html_text

    return html_text.main_text(table(spark, sf_dir, "pages"))



def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families stated in every document, named paragraph by paragraph and confirmed by templates."""
    from tessella.llm import licenses

    return licenses.scanned(table(spark, sf_dir, "documents"))



def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that every document shares, exactly or nearly, with another one."""
    from tessella.llm import substring

    return substring.passages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")



QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_substring_dedup": op10_substring_dedup, "op5_licenses": op5_licenses, "op3_main_text": op3_main_text, "op1_quality": op1_quality, "op4_minhash": op4_minhash, "op7_pii": op7_pii, "op9_token_files": op9_token_files, "op6_decontamination": op6_decontamination, "op2_bpe": op2_bpe, "op8_quality_rules": op8_quality_rules}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for what SQL can express; the other operators are tested against brute force or the tokenizers library in tests/llm.
ORACLES: dict[str, str] = {
    "op4_minhash": rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w from documents),
sets as (select distinct doc_id, array_to_string(w[s : s + 3], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) s from w where len(w) > 0)),
n as (select doc_id, count(*) n from sets group by doc_id),
inter as (select a.doc_id x, b.doc_id y, count(*) i from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from inter join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 80 * (a.n + b.n - i)),
edge as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (select doc_id, doc_id from w union select r.doc_id, b.y from reach r join edge b on b.x = r.other),
comp as (select doc_id, min(other) component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from comp left join n using (doc_id)""",
    "op6_decontamination": rf"""
with it as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iw as (select distinct item_id, least(10, len(w)) m, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') g from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) s from it where len(w) > 0)),
dw as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
g as (select doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') g from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) s from dw, (select distinct m from iw) where len(w) >= m)),
hit as (select doc_id, s, m, item_id from g join iw using (m, g)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + m)) p from hit) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from hit group by doc_id),
loose as (select doc_id, m, array_to_string(list_concat(w[s : s + d - 1], w[s + d + 1 : s + m]), ' ') g from (select *, unnest(range(1, m)) d from (select doc_id, w, m, unnest(range(1, len(w) - m + 1)) s from dw, (select distinct m from iw) where len(w) > m))),
close as (select doc_id, count(distinct item_id) n_near_items from (select doc_id, item_id from hit union all select doc_id, item_id from loose join iw using (m, g)) group by doc_id)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(n_near_items, 0) n_near_items
from dw left join pos using (doc_id) left join its using (doc_id) left join close using (doc_id)""",
}
