"""A reference library as source and target: scan of its items, their shapes, collections, and the export of papers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.functions.text import export_keys
from biblioflow.operators.library import export_plan, is_parent, library_items
from biblioflow.session import cut_lineage

#: Items of a page, and pages of a scan at most (fixed values).
PAGE_ITEMS, MOST_PAGES = 100, 200

# ---------------------------------------------------------------- scan


def scan_pages(page: Callable[[int, int], object], size: int = PAGE_ITEMS, most: int = MOST_PAGES) -> Iterator[list[dict]]:
    """The items of ``page(start, limit)``, page by page up to the first short one. What is no list of items ends the scan with an error."""
    start = 0
    for _ in range(most):
        items = items_in(page(start, size))
        if items is None:
            raise ValueError("the library's reply holds no items")
        yield items
        if len(items) < size:
            return
        start += len(items)


def items_in(reply: object) -> list[dict] | None:
    """The items in a reply: a list, a list under ``items``, ``results`` or ``data`` (or ``items`` in these), or one item."""
    held = reply
    if isinstance(reply, dict):
        wrapped = (reply.get(k) for k in ("items", "results", "data"))
        inner = (w.get("items") if isinstance(w, dict) else w for w in wrapped)
        held = next((w for w in inner if isinstance(w, list)), [reply])
    return [item for item in held if isinstance(item, dict)] if isinstance(held, list) else None


def scan_library(spark: SparkSession, page: Callable[[int, int], object]) -> DataFrame:
    """``(item)``: every item of a library as JSON, one row each; pages are read in turn, as each says where the next begins."""
    rows = [(json.dumps(item),) for items in scan_pages(page) for item in items]
    return spark.createDataFrame(rows, "item string")


def library_rows(items: DataFrame, item: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doi, title, date, url)`` of the parent items among stored ones, nested under ``data`` or flat; names may be in capitals or not.

    What is no JSON object is left out, and so are attachments, notes, annotations and what has a parent.
    """
    bag = F.try_parse_json(F.col(item))
    first = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("_b", f"$.{place}{name}", "string"), F.lit("")) for name in names for place in ("data.", "")])
    read = items.select(*keep, bag.alias("_b")).where(F.schema_of_variant("_b").startswith("OBJECT"))
    parents = read.where(is_parent(first("parentItem", "parent_item"), first("itemType", "item_type")))
    return parents.select(*keep, first("DOI", "doi").alias("doi"), first("title").alias("title"), first("date").alias("date"), first("url", "URL").alias("url"))


def creator_names(creators: Column) -> Column:
    """Names in a ``creators`` string: separated by semicolons or ``and``."""
    parts = F.split(F.regexp_replace(creators, r"\s+and\s+", ";"), ";")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


# ---------------------------------------------------------------- collections


def is_collection_key(text: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9]{8}", text))


def collection_key(wanted: str | None, collections: Callable[[], object]) -> str | None:
    """The key of a collection given by key or name: an equal name before one that differs in case only; None for none."""
    name = (wanted or "").strip()
    if not name or is_collection_key(name):
        return name or None
    try:
        listed = collections()
    except Exception as e:
        raise ValueError(f"the collections cannot be listed: {e}") from e
    if not isinstance(listed, list):
        raise ValueError("the list of collections has an unknown form")
    named = []
    for entry in filter(lambda x: isinstance(x, dict), listed):
        data = entry["data"] if isinstance(entry.get("data"), dict) else entry
        key, label = entry.get("key") or data.get("key"), data.get("name")
        if isinstance(key, str) and isinstance(label, str) and label.casefold() == name.casefold():
            named.append((label != name, len(named), key))
    if not named:
        raise ValueError(f"no collection is named {name}")
    return min(named)[2]


# ---------------------------------------------------------------- export

#: Under which names a reply to a creation counts what happened: lists or numbers first, plain counts where these are all zero (fixed values).
_COUNTED = {"created": ("created", "successful"), "skipped": ("skipped_duplicates",), "failed": ("failed", "failures")}
_COUNTS = {"created": ("created_count", "success_count", "inserted_count"), "skipped": ("skipped_count", "duplicate_count"), "failed": ("failed_count", "error_count")}


def _amount(value: object) -> int:
    return max(value, 0) if isinstance(value, int) else len(value) if isinstance(value, list | dict) else 0


def creation_counts(reply: object) -> dict[str, int]:
    """How many items a creation made, skipped and failed on."""
    known = reply if isinstance(reply, dict) else {}
    first = lambda names, amount: next((n for n in map(amount, map(known.get, names)) if n), 0)
    counts = {kind: first(names, _amount) for kind, names in _COUNTED.items()}
    return counts if any(counts.values()) else {kind: first(names, lambda v: v if isinstance(v, int) and v > 0 else 0) for kind, names in _COUNTS.items()}


def creation_errors(reply: object, failed: int) -> str:
    """The messages of what failed, each once, in order."""
    known = reply if isinstance(reply, dict) else {}
    for details, shows_all in ((known.get("failed"), True), (known.get("failures"), False)):
        entries = list(details.values()) if shows_all and isinstance(details, dict) else details if not shows_all and isinstance(details, list) else []
        said = [(d.get("message") or d.get("error") or (shows_all and d)) if isinstance(d, dict) else d for d in entries]
        if messages := list(dict.fromkeys(str(m) for m in said if m or (shows_all and m is not False))):
            return "; ".join(messages)
    return f"{failed} items failed without a message"


def export_papers(papers: DataFrame, create: Callable[[dict], object], held: DataFrame | None, access_day: str, collection: str | None = None, key: str = "paper_id") -> DataFrame:
    """``(key, title, outcome, skipped_by, error)``: what became of each paper; items are created from the executors.

    Papers that the library (``held``, rows of ``library_rows``; None where it could not be read) or an earlier paper
    of the export has are skipped. A creation that fails or raises says so in ``error``. The outcomes are
    written down before they are returned, so reading them twice creates nothing twice.
    """
    none = papers.sparkSession.createDataFrame([], "doi string, title string, date string, url string")
    plan = export_plan(papers, none if held is None else held, key)
    items = library_items(papers, access_day, [collection] if collection else None, key)
    kinds = F.transform(export_keys(F.col("doi"), F.col("title"), F.col("published_date"), F.col("url")), lambda k: k["kind"])
    only = F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise(F.lit("runtime_duplicate"))
    work = plan.join(items, key).join(papers.select(key, "title", only.alias("_kind")), key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, outcome, skipped_by, item, title, kind in batch[["_key", "outcome", "skipped_by", "item", "title", "_kind"]].itertuples(index=False, name=None):
                error = None
                if outcome == "create":
                    try:
                        reply = create(json.loads(item))
                        counts = creation_counts(reply)
                        outcome = "created" if counts["created"] else "skipped" if counts["skipped"] else "failed" if counts["failed"] else "nothing"
                        skipped_by, error = (kind if counts["skipped"] else None), creation_errors(reply, counts["failed"]) if counts["failed"] else None
                    except Exception as e:
                        outcome, error = "failed", str(e)
                rows.append((k, title, outcome, skipped_by, error))
            yield pd.DataFrame(rows, columns=["_key", "title", "outcome", "skipped_by", "error"])

    shown = work.select(F.col(key).alias("_key"), "outcome", "skipped_by", "item", "title", "_kind")
    kind = dict(papers.dtypes)[key]
    return cut_lineage(shown.mapInPandas(run, f"_key {kind}, title string, outcome string, skipped_by string, error string")).withColumnRenamed("_key", key)


def export_statistics(outcomes: DataFrame) -> DataFrame:
    """One row: papers, created, skipped in all and by kind of key, and failed."""
    skipped = F.col("skipped_by").isNotNull() | (F.col("outcome") == "in_batch")
    runtime = F.coalesce(F.col("skipped_by"), F.when(F.col("outcome") == "in_batch", F.lit("runtime_duplicate")))
    by = [F.count_if(runtime == k).alias(f"skipped_{k}") for k in ("doi", "title_date", "url", "runtime_duplicate")]
    return outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome").isin("create", "created")).alias("success_count"), F.count_if(skipped).alias("skipped_count"), *by, F.count_if(F.col("outcome") == "failed").alias("failed"))
