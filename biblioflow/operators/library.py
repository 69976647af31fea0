"""Library items: projection of papers, parent items, lookup of what is there, export outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions.text import export_keys, library_keys
from biblioflow.operators.greedy import export_in_batch

#: Fields of a library item and the columns they come from (fixed values).
ITEM_FIELDS = {
    "itemType": "item_type", "title": "title", "abstractNote": "abstract", "publicationTitle": "publication_title", "journalAbbreviation": "journal_abbreviation", "publisher": "publisher", "place": "place", "volume": "volume", "issue": "issue", "pages": "pages",
    "section": "section", "partNumber": "part_number", "partTitle": "part_title", "series": "series", "seriesTitle": "series_title", "seriesText": "series_text", "DOI": "doi", "citationKey": "citation_key", "url": "url", "PMID": "pmid", "PMCID": "pmcid", "ISSN": "issn",
    "archive": "archive", "archiveLocation": "archive_location", "shortTitle": "short_title", "language": "language", "libraryCatalog": "library_catalog", "callNumber": "call_number", "rights": "rights",
}
#: Fields a preprint item may have (fixed values).
PREPRINT_FIELDS = ("itemType", "title", "creators", "abstractNote", "repository", "archive", "archiveLocation", "DOI", "citationKey", "url", "accessDate", "date", "shortTitle", "language", "rights", "collections", "extra")


def library_items(papers: DataFrame, access_day: str, collections: list[str] | None = None, key: str = "paper_id") -> DataFrame:
    """``(key, item)``: each paper as the JSON of a library item; NULL fields are left out.

    ``access_day`` stands where a paper has no access date. Preprints keep their subset of fields and show
    their journal as repository.
    """
    creators = F.transform(F.coalesce(F.col("authors"), F.array().cast("array<string>")), lambda a: F.struct(F.lit("author").alias("creatorType"), a.alias("name")))
    kind = F.coalesce(F.nullif(F.col("item_type"), F.lit("")), F.lit("journalArticle"))
    preprint = F.lower(F.trim(kind)) == "preprint"
    fields: dict[str, Column] = {name: F.col(c) for name, c in ITEM_FIELDS.items()}
    fields["itemType"] = kind
    fields["abstractNote"] = F.nullif(F.col("abstract"), F.lit(""))
    fields["creators"] = creators
    fields["accessDate"] = F.coalesce(F.date_format("access_date", "yyyy-MM-dd"), F.lit(access_day))
    fields["date"] = F.date_format("published_date", "yyyy-MM-dd")
    if collections:
        fields["collections"] = F.array(*[F.lit(c) for c in collections])
    fields["repository"] = F.when(preprint, F.nullif(F.col("publication_title"), F.lit("")))
    shown = [(c if name in PREPRINT_FIELDS else F.when(~preprint, c)).alias(name) for name, c in fields.items()]
    return papers.select(key, F.to_json(F.struct(*shown)).alias("item"))


def is_parent(parent_item: Column, item_type: Column) -> Column:
    """Whether a library item stands for itself: no parent, and no attachment, note or annotation."""
    return (F.coalesce(F.trim(parent_item), F.lit("")) == "") & ~F.coalesce(F.lower(F.trim(item_type)).isin("attachment", "note", "annotation"), F.lit(False))


def already_there(papers: DataFrame, library: DataFrame, key: str = "paper_id") -> DataFrame:
    """``(key, skipped_by)``: papers with a key of a library item; the kind of their first such key.

    ``library`` has ``doi, title, date, url`` of its parent items. One row per distinct key is joined, so
    keys on many items cost nothing.
    """
    held = library.select(F.explode(library_keys(F.col("doi"), F.col("title"), F.col("date"), F.col("url"))).alias("k")).select("k.kind", "k.value").distinct()
    probes = papers.select(F.col(key), F.posexplode(export_keys(F.col("doi"), F.col("title"), F.col("published_date"), F.col("url"))).alias("place", "k")).select(key, "place", "k.kind", "k.value")
    return probes.join(held, ["kind", "value"]).groupBy(key).agg(F.min_by("kind", "place").alias("skipped_by"))


def export_plan(papers: DataFrame, library: DataFrame, key: str = "paper_id") -> DataFrame:
    """``(key, outcome, skipped_by)``: create, or skip for the library or for an earlier paper of the same export."""
    there = already_there(papers, library, key)
    fresh = papers.join(there, key, "left_anti")
    text = lambda k: F.concat_ws(":", k["kind"], k["value"])
    probe = fresh.select(F.col(key).alias("pos"), F.explode(F.transform(export_keys(F.col("doi"), F.col("title"), F.col("published_date"), F.col("url")), text)).alias("value"))
    register = fresh.select(F.col(key).alias("pos"), F.explode(F.transform(library_keys(F.col("doi"), F.col("title"), F.date_format("published_date", "yyyy-MM-dd"), F.col("url")), text)).alias("value"))
    decided = export_in_batch(probe, register).withColumnRenamed("pos", key)
    outcome = F.when(F.col("skipped_by").isNotNull(), F.lit("in_library")).when(F.coalesce("kept", F.lit(True)), F.lit("create")).otherwise(F.lit("in_batch"))
    return papers.select(key).join(there, key, "left").join(decided, key, "left").select(key, outcome.alias("outcome"), "skipped_by")
