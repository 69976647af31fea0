"""Feed lists: OPML outlines as rows."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_SCHEMA = "feed_pos long, url string, title string, html_url string, category string"
_FEED_TYPES = {"", "rss", "atom"}


def parse_opml(text: str) -> list[tuple[str, str, str, str | None]]:
    """``(url, title, html_url, category)`` of every feed in an outline, parents first; malformed XML raises."""

    def walk(node: ET.Element, category: str | None) -> Iterator[tuple[str, str, str, str | None]]:
        for outline in node.findall("outline"):
            url = outline.get("xmlUrl")
            name = outline.get("title") or outline.get("text")
            if url and (outline.get("type") or "").strip().lower() in _FEED_TYPES:
                yield url, name or "Unknown", outline.get("htmlUrl") or "", category
            yield from walk(outline, name or category)

    body = ET.fromstring(text).find("body")
    return [] if body is None else list(walk(body, None))


def read_opml(spark: SparkSession, path: str | None = None, env: str = "BIBLIOFLOW_OPML", default: str | None = None) -> DataFrame:
    """The feeds of an OPML file in document order: the argument's, else the environment's, else the default one."""
    path = path or os.environ.get(env) or default
    if not path:
        raise ValueError(f"no feed list: give a path or set {env}")
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file, wherever it lies
    return spark.createDataFrame([(i, *feed) for i, feed in enumerate(parse_opml(text))], FEED_SCHEMA)


def feeds_of_outlines(outlines: DataFrame) -> DataFrame:
    """``(feed_id, url, title, html_url, category)`` of flattened outlines with a URL and a feed type."""
    kind = F.lower(F.trim(F.coalesce(F.col("type"), F.lit(""))))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return outlines.where((F.coalesce(F.col("xml_url"), F.lit("")) != "") & kind.isin(*sorted(_FEED_TYPES))).select("feed_id", F.col("xml_url").alias("url"), F.coalesce(blank("title"), blank("text"), F.lit("Unknown")).alias("title"), F.coalesce("html_url", F.lit("")).alias("html_url"), blank("category").alias("category"))
