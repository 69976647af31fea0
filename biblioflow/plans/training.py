"""Queries of the training-data operators that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.operators.collapse import collapse_records, further_copies
from biblioflow.operators.known import known_rows
from biblioflow.operators.names import name_entities, name_members, variant_links, variant_pairs
from biblioflow.operators.survivor import best_values, surviving_records
from biblioflow.session import table

AUTHOR_TABLES = ("papers", "incoming_papers", "crossref_works", "openalex_works")


def _authors(spark: SparkSession, sf: str) -> list[tuple[DataFrame, str]]:
    return [(table(spark, sf, t), "authors") for t in AUTHOR_TABLES]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return best_values(table(spark, sf, "papers"))


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    return surviving_records(table(spark, sf, "papers"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return known_rows(table(spark, sf, "papers"), table(spark, sf, "incoming_papers")).select("incoming_id")


def p4_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch, how many rows are known and by what."""
    incoming = table(spark, sf, "incoming_papers")
    known = known_rows(table(spark, sf, "papers"), incoming)
    joined = incoming.select("incoming_id", "batch_no").join(known, "incoming_id", "left")
    return joined.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("reason") == r).alias(f"known_by_{r}") for r in ("doi", "url", "title")])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return further_copies(table(spark, sf, "papers"))


def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_records(table(spark, sf, "papers"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return variant_pairs(_authors(spark, sf))


def p6_links(spark: SparkSession, sf: str) -> DataFrame:
    return variant_links(_authors(spark, sf))


def p6_members(spark: SparkSession, sf: str) -> DataFrame:
    return name_members(_authors(spark, sf))


def p6_entities(spark: SparkSession, sf: str) -> DataFrame:
    return name_entities(_authors(spark, sf))


QUERIES = {q.__name__: q for q in (p3_found, p3_records, p4_found, p4_batches, p5_found, p5_records, p6_found, p6_links, p6_members, p6_entities)}

_RECORD = r"""
keyed AS (
    SELECT paper_id,
           nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(doi), '[\p{Z}\p{C}]+', '', 'g'), '^.*doi\.org/+', ''), '^[\p{P}<>]*(doi[:=]?)?', ''), '[\p{P}`^~|<>]+', '', 'g'), '') AS d,
           nullif(regexp_replace(replace(lower(upper(regexp_replace(title, '</?[A-Za-z][A-Za-z0-9:]{0,15}( [^<>]*)?/?>', ' ', 'g'))), 'ς', 'σ'), '[\p{P}\p{Z}\p{C}`^~|<>]+', '', 'g'), '') AS t
    FROM papers)
"""

ORACLES = {
    "p5_found": f"WITH {_RECORD} SELECT keep_id, paper_id FROM (SELECT paper_id, min(paper_id) OVER (PARTITION BY d, t) AS keep_id FROM keyed WHERE d IS NOT NULL OR t IS NOT NULL) WHERE paper_id > keep_id",
    "p5_records": f"WITH {_RECORD} SELECT min(paper_id) AS keep_id, count(*) AS copies FROM keyed GROUP BY d, t, CASE WHEN d IS NULL AND t IS NULL THEN paper_id END",
}
