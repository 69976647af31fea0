"""Deduplicating new batches against all history: identity keys, and titles through a sharded graph index."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioflow.functions.canonical import doi_canonical, not_blank
from biblioflow.functions.titles import match_form
from biblioflow.operators.title_index import DATE_SLACK, TitleIndex
from biblioflow.session import cut_lineage, shared_folder

#: Query keys that only track a click (fixed values; ``utm_*`` besides).
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "mkt_tok", "ref", "source", "dclid", "msclkid", "yclid", "igshid", "cmpid", "campaign", "trk")

def _resolves(c: Column) -> Column:
    """Whether a URL is a resolver's, with a DOI."""
    low = F.lower(c)
    return F.coalesce(low.contains("doi.org/") & low.rlike(r"doi\.org/+10\."), F.lit(False))


def url_doi(c: Column) -> Column:
    """The canonical DOI in a resolver URL; NULL for other URLs."""
    return F.when(_resolves(c), doi_canonical(c))


def url_identity(c: Column) -> Column:
    """A URL without scheme, host case, tracking keys, fragment, trailing slash and white space; NULL when blank."""
    shown = F.substring_index(F.trim(c), "#", 1)
    before = F.substring_index(shown, "?", 1)
    query = F.substr(shown, F.length(before) + 2, F.length(shown))
    path = F.regexp_replace(before, r"^(?i:https?)://(?:www\.)?", "")
    host = lambda p: F.substring_index(p, "/", 1)
    place = F.get(F.transform(F.array(path), lambda p: F.concat(F.lower(host(p)), F.rtrim(F.substr(p, F.length(host(p)) + 1, F.length(p)), F.lit("/")))), F.lit(0))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(*TRACKING_KEYS) & ~name(p).startswith("utm_"))), "&")
    asked = F.when(query == "", F.lit("")).otherwise(F.regexp_replace(kept, r"(?s)^(.+)$", "?$1"))
    return not_blank(F.concat(place, asked))


@F.pandas_udf(T.StringType())
def _match_form(titles: pd.Series) -> pd.Series:
    return pd.Series([match_form(t) or None for t in titles], dtype=object)


def _keyed(df: DataFrame, order: Column, batch: Column, key: Column) -> DataFrame:
    doi = F.coalesce(doi_canonical(F.col("doi")), url_doi(F.col("url")))
    return df.select(key.cast("long").alias("k"), order.cast("long").alias("ord"), batch.cast("int").alias("batch"), doi.alias("doi"), F.when(~_resolves(F.col("url")), url_identity(F.col("url"))).alias("url"), F.col("title").alias("title"), F.col("published_date").alias("day"))


def _day(extreme, side: int) -> Column:
    """The first or last day of a title's rows; far out where one has none."""
    far = F.lit(side * 10_000_000)
    return extreme(F.coalesce(F.unix_date("day"), far)).cast("int")


def known_rows(papers: DataFrame, incoming: DataFrame, index_path: str | None = None) -> DataFrame:
    """``(incoming_id, reason)``: rows of the batches whose work is in ``papers`` or in a row with a smaller id.

    ``reason`` is the first of ``doi``, ``url`` and ``title`` that shows it. DOIs (also in resolver URLs)
    and URLs are looked up by equality against one row per key; a URL does not unite two rows with
    different DOIs. Rows left over are searched by title in the graph index, where a DOI is missing on one
    side and publication dates are at most ``DATE_SLACK`` days apart or absent. Where two or three words about
    the matter itself differ, both dates must be there: only they tell a reworded title from a sibling study.

    The index is a folder: history is indexed there once, batches are added as runs, and what is asked
    reads the shards of the cells it looks into. ``index_path`` names it; without one it is made in the
    shared folder for this call. All batches of ``incoming`` are replayed at once, each against what came
    before it; a pipeline that holds the index calls ``TitleIndex.search`` and ``extend`` batch by batch.

    NULL and blank DOIs, URLs and titles identify nothing. Other columns are ignored.
    """
    old = _keyed(papers, F.lit(0), F.lit(0), -F.col("paper_id") - 1)
    new = _keyed(incoming, F.col("incoming_id"), F.greatest(F.col("batch_no"), F.lit(1)), F.col("incoming_id"))
    every = old.unionByName(new)
    by_doi = every.where(F.col("doi").isNotNull()).groupBy("doi").agg(F.min("ord").alias("doi_first"))
    urls = every.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("ord").alias("url_first"), F.min(F.when(F.col("doi").isNull(), F.col("ord"))).alias("url_first_bare"))
    keyed = new.join(by_doi, "doi", "left").join(urls, "url", "left")
    url_before = F.when(F.col("doi").isNull(), F.col("url_first")).otherwise(F.col("url_first_bare"))
    reason = F.when(F.col("doi_first") < F.col("ord"), F.lit("doi")).when(url_before < F.col("ord"), F.lit("url"))
    judged = cut_lineage(keyed.select("k", "ord", "batch", "title", "day", F.col("doi").isNotNull().alias("has_doi"), reason.alias("reason")))
    found = judged.where(F.col("reason").isNotNull()).select(F.col("k").alias("incoming_id"), "reason")

    titled = every.select("k", "ord", "batch", "day", F.col("doi").isNotNull().alias("has_doi"), _match_form("title").alias("form")).where(F.col("form").isNotNull())
    dated = cut_lineage(titled.groupBy("form", "day", "has_doi").agg(F.min("ord").alias("ord"), F.min("k").alias("k"), F.min("batch").alias("batch")))
    asking = cut_lineage(judged.where(F.col("reason").isNull()).select("k", "ord", "batch", "day", "has_doi", _match_form("title").alias("form")).where(F.col("form").isNotNull()))
    nodes = dated.groupBy("form").agg(F.min("k").alias("node"), F.min("batch").alias("batch"), _day(F.min, -1).alias("first_day"), _day(F.max, 1).alias("last_day"), (~F.bool_and("has_doi")).alias("bare"))
    asked = asking.groupBy("form").agg(F.max("batch").alias("ask"))
    indexed = cut_lineage(nodes.join(asked, "form", "left").withColumn("ask", F.coalesce("ask", F.lit(-1))))
    index = TitleIndex(papers.sparkSession, index_path or f"{shared_folder(papers.sparkSession)}/titles-{uuid.uuid4().hex}")
    columns = ["node", "form", "batch", "first_day", "last_day", "bare"]
    index.create(indexed.where("batch = 0").select(*columns))
    index.add(indexed.where("batch > 0").select(*columns), 1, 2**31 - 1)
    pairs = index.search(indexed.where("ask >= 0").withColumn("batch", F.col("ask")).select(*columns))
    pairs = pairs.unionByName(indexed.where(F.col("ask") >= 0).select(F.col("node").alias("ask_node"), "node", F.lit(1).alias("how")))

    names = indexed.select("form", F.col("node").alias("_node"))
    queries = asking.join(names, "form").select("k", F.col("ord").alias("q_ord"), F.col("day").alias("q_day"), F.col("has_doi").alias("q_doi"), F.col("_node").alias("ask_node"))
    held = dated.join(names, "form").select("ord", "day", "has_doi", F.col("_node").alias("node"))
    apart = F.abs(F.datediff("day", "q_day"))
    near = F.when(F.col("how") == 1, F.coalesce(apart <= DATE_SLACK, F.lit(True))).otherwise(F.coalesce(apart <= DATE_SLACK, F.lit(False)))
    met = queries.join(pairs, "ask_node").join(held, "node").where((F.col("ord") < F.col("q_ord")) & ~(F.col("q_doi") & F.col("has_doi")) & near)
    return found.unionByName(met.select(F.col("k").alias("incoming_id")).distinct().withColumn("reason", F.lit("title")))
