"""The queries of this subpackage: name to function of (spark, sf_dir)."""

from __future__ import annotations

from vectide.llm import chat, fingerprints, licences, mixing, ngram_join, packing, quality, sharding, token_files, trie_counts
from vectide.llm.scratch import table


def op5_histogram_shards(spark, sf_dir):
    return sharding.query(table(spark, sf_dir, "documents"))


def op6_chat_examples(spark, sf_dir):
    return chat.query(spark, table(spark, sf_dir, "conversations"))


def op7_trie_token_counts(spark, sf_dir):
    return trie_counts.query(table(spark, sf_dir, "documents"))


def op8_licence_digests(spark, sf_dir):
    return licences.query(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_soft_mixing(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_id_files(spark, sf_dir):
    return token_files.query(table(spark, sf_dir, "documents"))


def op3_harmonic_packing(spark, sf_dir):
    return packing.query(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.query(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark, sf_dir):
    return fingerprints.query(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_soft_mixing,
    op2_token_id_files,
    op3_harmonic_packing,
    op4_ngram_jaccard_join,
    op5_histogram_shards,
    op6_chat_examples,
    op7_trie_token_counts,
    op8_licence_digests,
    op9_quality_rules,
    op10_document_fingerprints,
)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op6_chat_examples": chat.ORACLE, "op8_licence_digests": licences.ORACLE}
