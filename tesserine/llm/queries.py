"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, hyperminhash, jaccard, langid, lines, lm, merkle, oracles, packing, quality, secrets, urls
from .common import no_nulls_id, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines with a word, how many of them stay and which (positions, joined by commas)."""
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.size(F.filter(lines.lines_of(F.col("text")), lambda x: x.rlike(lines.WORD))).cast("long").alias("n_lines"))
    found = counted.join(lines.kept_lines(docs), "doc_id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    return found.select("doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"), F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept_at"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), no_nulls_id() % 7 == 2)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge(pages, pages.join(labels, "page_id")).drop("confidence")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def learned_languages(docs: DataFrame) -> langid.Filters:
    """Filters from the text and lang of two thirds of the documents."""
    return langid.train(docs.filter(no_nulls_id() % 3 != 1))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), learned_languages(docs))
    return found.select("doc_id", (no_nulls_id() % 3 == 1).alias("held_out"), "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of the documents; the proofs are tried on rows of which half have lost their line breaks."""
    docs = table(spark, sf_dir, "documents")
    claimed = F.when(no_nulls_id() % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaf = lambda text: merkle.leaf_of(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    proven = merkle.manifest(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), leaf(claimed).alias("claimed")), keep=("claimed",))
    proof = F.sha2(merkle.siblings(F.col("path")), 256)
    found = proven.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), merkle.fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.dedup(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_best_fit_packing, op4_quality_rules, op5_graph_neighbours, op6_byte_bpe, op7_pitman_yor, op8_url_filter, op9_ngram_jaccard, op10_language_id, op11_merkle_manifest, op12_hyper_minhash, op13_source_divergence)}


def stop_list() -> str:
    return "[" + ", ".join(f"'{w}'" for w in quality.STOP_WORDS) + "]"


#: The words of a text in DuckDB's SQL.
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '')"

QUALITY_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, {WORDS} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as l
  from documents),
win as (
  select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) as k from d where len(w) >= 3),
rep as (select r, i from win qualify count(*) over (partition by r, k) >= 2),
reps as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from rep) group by r),
m as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(l)::bigint as n_lines,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
         len(list_filter(w, lambda x: list_contains({stop_list()}, x))) as stop_words,
         length(regexp_replace(t, '[^0-9.,;:!?''"()\[\]{{}}\-_/\\+=~`@^#*$%&|<>]', '', 'g')) as marks
  from d left join reps using (r)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and word_chars >= 2 * n_words and word_chars <= 14 * n_words and n_symbols <= n_words / 10 and stop_words >= 2
       and n_dup_lines <= n_lines * 0.3 and 1 - marks / word_chars >= 0.6 as kept
from v
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": QUALITY_SQL,
        "op9_ngram_jaccard": oracles.classes(3, 90),
        "op11_merkle_manifest": oracles.MERKLE,
        "op12_hyper_minhash": oracles.classes(4, 80, ", min(root) = node as kept"),
        "op13_source_divergence": oracles.DIVERGENCE,
    }
