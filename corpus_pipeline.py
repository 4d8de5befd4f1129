"""A corpus from raw documents: quality rules, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again, so a later
stage never computes an earlier one twice and lost executors cost one stage's tasks.

Defined results: rows with a null or empty text fail the quality rules; rows equal in doc_id and text are one document
to the near-duplicate stage, of texts that link the one with the smallest doc_id stays, rows without a doc_id last; rows that share a doc_id
but not their text stay apart; ties are broken by hashes of doc_id and text, so a second run gives the same rows; an empty table
gives no row; columns beside doc_id and text are carried along, whatever their names, and are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import mixing, ngram_join, packing, quality
from vectide.llm.scratch import materialize, table

#: Token weights of the domains that are left when it comes to mixing.
TARGETS = {"clean": 0.96, "toxic": 0.04}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the model reject go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more stays."""
    return ngram_join.dedupe(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents are taken about once, toxic ones at the rate that leaves them their target
    weight; the first stage has taken the domain of low quality away."""
    labels = table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of().alias("domain"))
    return mixing.mix(docs, labels, TARGETS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, in sequences of 2048."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: The model of the first stage and the tokenizer of the last cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
