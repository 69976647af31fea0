"""The record schema of papers."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = ("publication_title", "journal_abbreviation", "publisher", "place", "volume", "issue", "pages", "section", "part_number", "part_title", "series", "series_title", "series_text", "citation_key")
_MORE = ("pmid", "pmcid", "issn", "archive", "archive_location", "short_title", "language", "library_catalog", "call_number", "rights")


def _string(name: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable)


PAPER_SCHEMA = T.StructType(
    [_string(n) for n in ("title", "source", "source_type")]
    + [T.StructField("authors", T.ArrayType(T.StringType())), _string("abstract"), T.StructField("published_date", T.DateType())]
    + [_string(n) for n in ("doi", "url", "pdf_url", *_TEXT)]
    + [T.StructField("access_date", T.DateType())]
    + [_string(n) for n in (*_MORE, "item_type", "source_id", "extra")]
)
REQUIRED = ("title", "source", "source_type")
