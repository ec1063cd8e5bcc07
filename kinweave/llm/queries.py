"""The queries of the training-data operators on text: name -> (query(spark, sf_dir), SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import abuse, leaks, mojibake, spellings, survivor, titles, tokens, visual
from kinweave.plans.workspace import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_records(table(spark, d, "gedcom_lines")).select("file_id", "line_no")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_records(table(spark, d, "gedcom_lines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.variant_pairs(table(spark, d, "persons"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "persons"))


def p4_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivor.latent_truth(table(spark, d, "persons"))[0]


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    return survivor.latent_truth(table(spark, d, "persons"))[1]


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often the quality model keeps what the rule picks."""
    return survivor.agreement(table(spark, d, "persons"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.affected_fields(table(spark, d, "persons"))


def p5_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name text in its consistent form."""
    return visual.consistent_names(table(spark, d, "persons"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return titles.occupation_codes(table(spark, d, "occupations"), table(spark, d, "title_reference"))


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The titles that mean none of the list, with the number of occupations."""
    return titles.unmatched(table(spark, d, "occupations"), table(spark, d, "title_reference"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_table(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: texts from ids."""
    return tokens.decode_table(tokens.encode_table(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_removal_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.removal_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.offending(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


_P4 = """
WITH c AS (
  SELECT id, row_id, count(*) OVER (PARTITION BY id) AS n, try_cast(updated_at AS TIMESTAMPTZ) AS changed,
    birth.date.value AS b, birth.confidence AS bc, death.date.value AS d, death.confidence AS dc,
    len(identity.names) AS has, len(list_distinct(list_transform(identity.names, lambda x: x.display))) AS shown
  FROM persons WHERE id IS NOT NULL),
r AS (
  SELECT id, 'birth_date' AS field_name, row_id, row_number() OVER (PARTITION BY id ORDER BY bc DESC NULLS LAST, length(b) DESC, changed DESC NULLS LAST, row_id) AS k FROM c WHERE n > 1 AND b IS NOT NULL
  UNION ALL
  SELECT id, 'death_date', row_id, row_number() OVER (PARTITION BY id ORDER BY dc DESC NULLS LAST, length(d) DESC, changed DESC NULLS LAST, row_id) FROM c WHERE n > 1 AND d IS NOT NULL
  UNION ALL
  SELECT id, 'names', row_id, row_number() OVER (PARTITION BY id ORDER BY shown DESC, changed DESC NULLS LAST, row_id) FROM c WHERE n > 1 AND has > 0)
SELECT id AS person_id, field_name, row_id FROM r WHERE k = 1"""

QUERIES = {
    "p2_found": (p2_found, None),
    "p2_restored": (p2_restored, None),
    "p3_found": (p3_found, None),
    "p4_found": (p4_found, _P4),
    "p4_truth": (p4_truth, None),
    "p4_sources": (p4_sources, None),
    "p4_agreement": (p4_agreement, None),
    "p5_found": (p5_found, None),
    "p5_names": (p5_names, None),
    "p7_found": (p7_found, None),
    "p7_unmatched": (p7_unmatched, None),
    "p8_ids": (p8_ids, None),
    "p8_decoded": (p8_decoded, "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
    "p10_found": (p10_found, None),
    "p10_scores": (p10_scores, None),
    "p10_rates": (p10_rates, None),
    "p9_found": (p9_found, None),
    "p9_removal_spans": (p9_removal_spans, None),
}
