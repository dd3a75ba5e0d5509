"""Registered queries of the text operators: one per operator, over its whole table."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table_path
from . import (bpe, decontaminate, exact_dedup, filter_audit, html_extract, language_id, line_dedup, pii, quality_rules, simhash,
               substring_dedup, suffix_dedup, tokenizer_alignment)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_simhash(spark, sf_dir):
    """SimHash groups of all documents: 3-word shingles, links at 2 or fewer differing bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op2_pii(spark, sf_dir):
    """Personal data in all documents: counts and digest of the base spans, and all spans."""
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    base = F.flatten(F.array(*[pii.listed(k, F.col(k)) for k in pii.KINDS]))
    both = F.flatten(F.array(*[pii.listed(k, F.array_sort(F.array_distinct(F.concat(F.col(k), F.col(f"more_{k}")))))
                               for k in pii.KINDS]))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(both, ",").alias("spans"),
        sum(F.size(f"more_{k}") for k in pii.KINDS).cast("long").alias("n_added"))


def op3_substring(spark, sf_dir):
    """Passages of 50 words that an earlier document has, removed from all documents."""
    out = substring_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_bpe(spark, sf_dir):
    """Token ids of all documents by the public word-level vocabulary, and their decoding."""
    import public_tokenizers
    out = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality(spark, sf_dir):
    """Quality counts and verdict of all documents."""
    return quality_rules.quality(_table(spark, sf_dir, "documents"))


def op6_lines(spark, sf_dir):
    """Lines of all documents that repeat an earlier line within one edit, removed."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_html(spark, sf_dir):
    """Main text of all pages."""
    out = html_extract.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_language(spark, sf_dir):
    """Language of all documents, learned from labelled documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), language_id.fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_suffix(spark, sf_dir):
    """Byte strings of length 200 that occur twice, removed from all documents."""
    out = suffix_dedup.remove_repeated_strings(_table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_benchmark(spark, sf_dir):
    """Documents and the benchmark items that leak into them, within 20 % word edits."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filters(spark, sf_dir):
    """Steps of all orders of five filters, per source."""
    return filter_audit.audit(filter_audit.failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op12_exact(spark, sf_dir):
    """Rows of all documents with the row that stays of each group of equal texts."""
    index = exact_dedup.Index(spark, table_path(sf_dir, "documents"), scratch_path(spark, f"exact-{uuid.uuid4().hex}"))
    index.update()
    return index.result().select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_alignment(spark, sf_dir):
    """Links between the tokens of two public tokenizers in all documents."""
    import public_tokenizers
    return tokenizer_alignment.alignment(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_pii, op3_substring, op4_bpe, op5_quality, op6_lines, op7_html,
                                   op8_language, op9_suffix, op10_benchmark, op11_filters, op12_exact,
                                   op13_alignment)}
ORACLES = {"op5_quality": quality_rules.oracle_sql(), "op11_filters": filter_audit.oracle_sql(),
           "op12_exact": exact_dedup.oracle_sql()}
