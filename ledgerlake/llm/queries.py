"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, decontamination, packing, passages, preference, pseudonyms, rules, secret_scan, simhash, toxicity
from .common import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.formatted(preference.swapped_pairs(table(spark, sf_dir, "conversations")))
    shown = lambda mask: F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return pairs.withColumns({"chosen_mask": shown("chosen_mask"), "rejected_mask": shown("rejected_mask")})


def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), digest=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op6_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.replaced(table(spark, sf_dir, "documents"))


QUERIES = [op1_secret_scan, op2_preference_format, op3_power_of_two_packing, op4_quality_rules, op5_template_decontamination, op6_quality_attention, op7_simhash_bk_trees, op8_toxicity_neighbours, op9_repeated_passages, op10_feistel_pseudonyms]


def shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Query]:
    return {q.__name__: shipped(q) for q in QUERIES}


PREFERENCE_SQL = r"""
WITH own AS (
  SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, role, text
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
last AS (
  SELECT pair_id, place, text FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY place DESC) AS r FROM own WHERE role = 'assistant') WHERE r = 1),
swapped AS (
  SELECT o.pair_id, o.place, o.role, o.text, CASE WHEN l.pair_id IS NOT NULL AND n.pair_id IS NOT NULL THEN n.text ELSE o.text END AS other
  FROM own o LEFT JOIN last l ON l.pair_id = o.pair_id AND l.place = o.place LEFT JOIN last n ON n.pair_id = xor(o.pair_id, 1)),
split AS (
  SELECT *, min(CASE WHEN text <> other THEN place END) OVER (PARTITION BY pair_id) AS cut,
         '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS a, '<|' || role || '|>' || chr(10) || other || chr(10) || '<|end|>' || chr(10) AS b FROM swapped),
placed AS (
  SELECT *, cut IS NULL OR place < cut AS shared,
         sum(length(a)) OVER (PARTITION BY pair_id, cut IS NULL OR place < cut ORDER BY place) AS a_end,
         sum(length(b)) OVER (PARTITION BY pair_id, cut IS NULL OR place < cut ORDER BY place) AS b_end FROM split)
SELECT pair_id, count(*) FILTER (WHERE shared) AS n_prefix_turns,
       coalesce(string_agg(a, '' ORDER BY place) FILTER (WHERE shared), '') AS prompt,
       coalesce(string_agg(a, '' ORDER BY place) FILTER (WHERE NOT shared), '') AS chosen,
       coalesce(string_agg(b, '' ORDER BY place) FILTER (WHERE NOT shared), '') AS rejected,
       coalesce(string_agg((a_end - length(text) - 9) || ':' || (a_end - 1), ',' ORDER BY place) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((b_end - length(other) - 9) || ':' || (b_end - 1), ',' ORDER BY place) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""


def oracle_sql() -> dict[str, str]:
    """Only for what SQL can express; the others are tested against brute force in tests/llm."""
    return {"op2_preference_format": PREFERENCE_SQL}
