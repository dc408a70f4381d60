"""A corpus pipeline: toxic documents, near-duplicates and benchmark items go, personal values are replaced, and what stays is packed.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all
but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import decontamination, packing, pseudonyms, simhash, toxicity
from ledgerlake.llm.common import checkpointed, ship, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity rejects go; null and empty texts stay (toxicity.cleaned)."""
    ship(spark)
    return toxicity.cleaned(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id; rows without doc_id come last,
    null texts count as empty, repeated rows leave one, columns keep their names (simhash.deduplicated)."""
    ship(spark)
    return simhash.deduplicated(docs, shingle=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other values, go; all stay if the benchmark is empty
    (decontamination.cleaned)."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are replaced in the text, null texts stay null, and no row goes (pseudonyms.with_pseudonyms)."""
    return pseudonyms.with_pseudonyms(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the documents; a null or empty text is one piece of one id (packing.pack)."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", without_toxic), ("simhash_near_dedup", without_near_duplicates), ("benchmark_decontamination", without_benchmark), ("pii", with_pseudonyms), ("packing", packed)]

#: Learnt scores, fingerprints and tokenizer ids have no SQL; tests/llm/test_corpus_operators.py tests the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it kept is checkpointed."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
