"""Feed documents (RSS 2.0, RDF, Atom) as entries, and entries as papers."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions.text import blank_to_null, extract_bounded_doi

ENTRY_SCHEMA = (
    "feed_pos long, entry_pos long, source string, title string, link string, id string, summary string, content string, authors array<string>, contributors array<string>, "
    "published date, updated date, dc_identifier string, prism_doi string, pdf_href string, publisher string, rights string, feed_title string, feed_language string"
)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _first(node: ET.Element, *names: str) -> str | None:
    for name in names:
        for child in node:
            if _local(child.tag) == name and (child.text or "").strip():
                return child.text.strip()
    return None


def _day(text: str | None):
    if not text:
        return None
    for read in (parsedate_to_datetime, lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))):
        try:
            when = read(text)
        except (TypeError, ValueError):
            continue
        return (when.astimezone(UTC) if when.tzinfo else when).date()
    return None


def _people(node: ET.Element, *names: str) -> list[str]:
    out = []
    for child in node:
        if _local(child.tag) in names:
            name = _first(child, "name", "email") or (child.text or "").strip()
            if name:
                out.append(name)
    return out


def split_authors(names: list[str]) -> list[str]:
    """One string of several authors is split at the first kind of separator it has: comma, semicolon, ``and``."""
    if len(names) != 1:
        return names
    for separator in (",", ";", " and "):
        if separator in names[0]:
            return [part.strip() for part in names[0].split(separator) if part.strip()]
    return names


def parse_feed(text: str) -> list[dict]:
    """The entries of a feed document of any kind; a document that is no XML has none."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    head = next((n for n in root.iter() if _local(n.tag) in ("channel", "feed")), root)
    entries = []
    for node in (n for n in root.iter() if _local(n.tag) in ("item", "entry")):
        links = [n for n in node if _local(n.tag) in ("link", "enclosure")]
        hrefs = [(n.get("href") or n.get("url") or (n.text or "").strip(), n.get("type") or "", n.get("rel") or "alternate") for n in links]
        pages = [h for h, kind, rel in hrefs if h and kind != "application/pdf" and rel == "alternate"]
        entries.append(
            {
                "title": _first(node, "title"),
                "link": pages[0] if pages else None,
                "id": _first(node, "guid", "id"),
                "summary": _first(node, "summary", "description"),
                "content": _first(node, "encoded", "content"),
                "authors": split_authors(_people(node, "author", "creator")),
                "contributors": _people(node, "contributor"),
                "published": _day(_first(node, "pubdate", "published", "date")),
                "updated": _day(_first(node, "updated", "modified")),
                "dc_identifier": _first(node, "identifier"),
                "prism_doi": _first(node, "doi"),
                "pdf_href": next((h for h, kind, _ in hrefs if kind == "application/pdf"), None),
                "publisher": _first(node, "publisher"),
                "rights": _first(node, "rights", "copyright"),
                "feed_title": _first(head, "title"),
                "feed_language": _first(head, "language"),
            }
        )
    return entries


def feed_errors(feeds: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """``(feed_pos, url, error)`` of the feeds that cannot be fetched or read: what ``feed_entries`` passes over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pos, url in batch[["feed_pos", "url"]].itertuples(index=False, name=None):
                try:
                    ET.fromstring(fetch(url))
                except Exception as e:
                    rows.append((pos, url, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["feed_pos", "url", "error"])

    return feeds.select("feed_pos", "url").mapInPandas(run, "feed_pos long, url string, error string")


def feed_entries(feeds: DataFrame, fetch: Callable[[str], str] | None = None) -> DataFrame:
    """Entries of ``feeds(feed_pos, title, url[, document])``: one task works on many feeds, a failing one has no entries.

    Documents stand in the ``document`` column or come from ``fetch(url)``, which runs on the executors.
    """
    names = [f.split()[0] for f in ENTRY_SCHEMA.split(", ")]
    shown = feeds.select("feed_pos", "title", "url", F.col("document") if "document" in feeds.columns else F.lit(None).cast("string").alias("document"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pos, title, url, document in batch.itertuples(index=False, name=None):
                try:
                    text = document if document is not None or fetch is None else fetch(url)
                    entries = parse_feed(text or "")
                except Exception:
                    entries = []
                rows += [{"feed_pos": pos, "entry_pos": i, "source": title, **entry} for i, entry in enumerate(entries)]
            yield pd.DataFrame(rows, columns=names)

    return shown.mapInPandas(run, ENTRY_SCHEMA)


def entry_doi(identifier: Column, prism: Column, link: Column, guid: Column) -> Column:
    """The identifier that begins with a DOI, whole and without ``doi:``, else the first DOI in link or id, else ''."""
    bare = lambda c: F.regexp_replace(F.trim(c), r"(?i)^doi:\s*", "")
    whole = lambda c: F.when(bare(c).rlike(r"(?i)^10\.\d{4,9}/[-._;()/:A-Z0-9]+"), bare(c))
    return F.coalesce(whole(identifier), whole(prism), extract_bounded_doi(link), extract_bounded_doi(guid), F.lit(""))


#: Entries of one feed, and items of one message, that a place has room for.
PLACES = 1 << 32


def placed(papers: DataFrame, outer: str = "feed_pos", inner: str = "entry_pos", name: str = "_pos") -> DataFrame:
    """``papers`` with one number for their place: feeds in order, entries in order within each."""
    return papers.withColumn(name, F.col(outer).cast("long") * PLACES + F.col(inner).cast("long"))


def entries_to_papers(entries: DataFrame, since=None) -> DataFrame:
    """Papers of the entries that have a title, with ``_pos`` in feed order; entries before ``since`` are left out, undated ones pass."""
    known = F.transform(F.coalesce("authors", F.array().cast("array<string>")), F.lower)
    authors = F.concat(F.coalesce("authors", F.array().cast("array<string>")), F.filter(F.coalesce("contributors", F.array().cast("array<string>")), lambda c: ~F.array_contains(known, F.lower(c))))
    day = F.coalesce("published", "updated")
    arxiv = F.when(F.col("link").contains("arxiv.org/abs/"), F.concat(F.replace("link", F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf")))
    extra = F.to_json(F.struct(blank_to_null(F.col("publisher")).alias("publisher"), blank_to_null(F.col("rights")).alias("rights"), F.when(F.col("feed_title").isNotNull(), F.struct(F.col("feed_title").alias("title"), F.col("feed_language").alias("language"))).alias("feed")))
    papers = entries.where(F.coalesce("title", F.lit("")) != "").select(
        "feed_pos", "entry_pos", "title", "source", F.lit("rss").alias("source_type"), authors.alias("authors"),
        F.coalesce(blank_to_null(F.trim("content")), blank_to_null(F.col("summary")), F.lit("")).alias("abstract"), day.alias("published_date"),
        entry_doi(F.col("dc_identifier"), F.col("prism_doi"), F.col("link"), F.col("id")).alias("doi"), blank_to_null(F.col("link")).alias("url"), F.coalesce("pdf_href", arxiv).alias("pdf_url"),
        F.coalesce(blank_to_null(F.col("id")), blank_to_null(F.col("link"))).alias("source_id"), extra.alias("extra"),
    )
    return papers if since is None else papers.where(F.col("published_date").isNull() | (F.col("published_date") >= F.lit(since)))
