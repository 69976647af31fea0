"""The engine behind tools and command line: fetch, filter, enrich, export as DataFrame plans."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.functions.text import export_keys, identity_keys, source_from_sender
from biblioflow.operators import enrich, filters, keywords, library
from biblioflow.operators.filters import Criteria
from biblioflow.operators.greedy import best_per_title, deduplicate
from biblioflow.schema import PAPER_SCHEMA
from biblioflow.session import cut_lineage
from biblioflow.sources.feeds import PLACES, entries_to_papers, feed_entries, placed
from biblioflow.sources.mail import allowed_senders, item_quality, message_items, parse_sender_map
from biblioflow.sources.opml import read_opml
from biblioflow.sources.papers_json import papers_from_text, write_papers

def _schema(required: str, **properties: str) -> dict:
    """A JSON schema; a property is described as ``type: text``."""
    shown = {name: {"type": text.partition(": ")[0], "description": text.partition(": ")[2]} for name, text in properties.items()}
    for entry in shown.values():
        if entry["type"] == "array":
            entry["items"] = {"type": "string"}
    return {"type": "object", "properties": shown, "required": required.split()}


_PAPERS = "string: papers as a JSON array"
TOOLS = {
    "fetch_rss": _schema("", opml="string: path of the feed list", limit="integer: most papers", since="string: first day"),
    "fetch_gmail": _schema("messages", messages="string: path of a table of messages", limit="integer: most papers", since="string: first day", senders="string: allowed senders", sender_names="string: names of senders as a JSON object"),
    "filter_keywords": _schema("papers_json", papers_json=_PAPERS, keywords="array: any of these", exclude_keywords="array: none of these", authors="array: any of these", min_date="string: first day", has_pdf="boolean: with PDF only"),
    "filter_ai": _schema("papers_json", papers_json=_PAPERS),
    "enrich": _schema("papers_json", papers_json=_PAPERS, provider="string: crossref, openalex or all"),
    "export_json": _schema("papers_json filepath", papers_json=_PAPERS, filepath="string: target", include_metadata="boolean: keep the open bag"),
    "generate_keywords": _schema("prompt", prompt="string: research interest"),
    "search_crossref": _schema("query", query="string: title", rows="integer: most works"),
    "search_openalex": _schema("query", query="string: title", rows="integer: most works"),
}
PROMPTS = {"latest_papers": ("List the papers of the last days about {topic}, most relevant first, with one sentence on each.", ("topic",))}
PROMPT = PROMPTS["latest_papers"][0]


def list_tools() -> list[dict]:
    return [{"name": name, "inputSchema": schema} for name, schema in TOOLS.items()]


def list_prompts() -> list[dict]:
    return [{"name": name, "arguments": [{"name": a, "required": True} for a in wanted]} for name, (_, wanted) in PROMPTS.items()]


def render_prompt(name: str, arguments: dict) -> str:
    """A prompt with its arguments filled in; unknown prompts and missing arguments raise."""
    if name not in PROMPTS:
        raise ValueError(f"unknown prompt {name}")
    text, wanted = PROMPTS[name]
    if missing := [a for a in wanted if not str(arguments.get(a) or "").strip()]:
        raise ValueError(f"missing argument {missing[0]}")
    return text.format(**{a: str(arguments[a]).strip() for a in wanted})


def _positive(value, name: str = "limit") -> int | None:
    if value is not None and int(value) < 1:
        raise ValueError(f"{name} must be at least 1")
    return None if value is None else int(value)


class Engine:
    """Plans over one session. ``catalogs`` maps a provider to a table of works; ``fetch``, ``judge`` and ``generate`` are the calls out."""

    def __init__(self, spark: SparkSession, catalogs: dict[str, DataFrame] | None = None, fetch: Callable[[str], str] | None = None, judge: Callable[[str], str] | None = None, generate: Callable[[str], str] | None = None):
        self.spark, self.catalogs, self.fetch, self.judge, self.generate = spark, catalogs or {}, fetch, judge, generate

    def _unique(self, papers: DataFrame, pos: str, limit: int | None) -> DataFrame:
        kept = deduplicate(papers, identity_keys(F.col("doi"), F.col("url"), F.col("title")), pos).where("kept").drop("kept", "matched_kind").orderBy(pos)
        return kept if limit is None else kept.limit(limit)

    def fetch_rss(self, opml: str | None = None, limit: int | None = None, since: date | None = None, documents: DataFrame | None = None) -> DataFrame:
        """Papers of all feeds in feed order, deduplicated over feeds, then limited; a failing feed gives none."""
        limit = _positive(limit)
        feeds = read_opml(self.spark, opml) if documents is None else documents
        if feeds.isEmpty():
            raise ValueError("the feed list has no feeds")
        papers = entries_to_papers(feed_entries(feeds, self.fetch), since)
        return self._unique(placed(papers).drop("feed_pos", "entry_pos"), "_pos", limit)

    def fetch_mail(self, messages: DataFrame, limit: int | None = None, since: date | None = None, senders: str = "", sender_names: dict[str, str] | None = None) -> DataFrame:
        """Papers in ``messages(message_id, message_pos, sender, timestamp, payload_json)``, best of each title, deduplicated.

        Messages without HTML give the DOIs of their plain text. A source is the sender's name in
        ``sender_names``, else that of an allowed address, else the sender as it stands.
        """
        limit = _positive(limit)
        read = allowed_senders(messages, senders)
        if since is not None:
            read = read.where(F.col("timestamp").isNull() | (F.to_date("timestamp") >= F.lit(since)))
        allowed = [a.strip() for a in re.split(r"[;,]", senders) if a.strip()]
        source = F.coalesce(source_from_sender(F.col("sender"), sender_names or {}, allowed), F.col("sender"))
        items = message_items(read).join(read.select("message_id", "message_pos", "timestamp", source.alias("source")), "message_id")
        inner = F.col("strategy").cast("long") * (PLACES >> 2) + F.col("item_pos")
        papers = placed(items.withColumn("_inner", inner), "message_pos", "_inner").select("_pos", "title", "source", F.lit("email").alias("source_type"), "authors", F.lit("").alias("abstract"), F.to_date("timestamp").alias("published_date"), "doi", "url", F.concat(F.lit("msg-"), "message_id").alias("source_id"))
        best = best_per_title(papers, item_quality(F.col("doi"), F.col("url"), F.col("abstract"), F.col("authors")), pos="_pos")
        return self._unique(best.withColumn("_pos", F.col("place")).drop("place"), "_pos", limit)

    def filter_keywords(self, papers: DataFrame, **criteria) -> DataFrame:
        return filters.keep_matching(papers, Criteria(**criteria))

    def filter_ai(self, papers: DataFrame, key: str = "_pos") -> DataFrame:
        return papers if self.judge is None else filters.judge_in_batches(papers, self.judge, key)

    def enrich(self, papers: DataFrame, provider: str = "all") -> DataFrame:
        """One catalog over the papers' values, the other into their gaps; by DOI, and by title and authors without one."""
        if provider not in ("crossref", "openalex", "all"):
            raise ValueError(f"unknown provider {provider}")
        columns = papers.columns
        if "_key" not in columns:  # materialised, so that every use of a row sees the same number
            papers = cut_lineage(papers.withColumn("_key", F.monotonically_increasing_id()))
        for catalog in (enrich.CROSSREF, enrich.OPENALEX):
            if provider in (catalog.name, "all"):
                papers = enrich.enrich_from(papers, self.catalogs[catalog.name], catalog, "_key")
        return papers.select(*columns)

    def search(self, provider: str, title: str, rows: int = 5) -> DataFrame:
        """The works whose titles share most words with ``title``; works without any are left out."""
        works = {"crossref": enrich.crossref_works, "openalex": enrich.openalex_works}[provider](self.catalogs[provider])
        from biblioflow.functions.text import match_title, words

        shared = F.size(F.array_intersect(words(match_title(F.col("title"))), words(match_title(F.lit(title)))))
        return works.withColumn("shared", shared).where("shared > 0").orderBy(F.desc("shared"), "work_id").limit(_positive(rows, "rows"))

    def export_plan(self, papers: DataFrame, items: DataFrame, key: str = "_pos") -> DataFrame:
        return library.export_plan(papers, items, key)

    def run_tool(self, name: str, arguments: dict) -> dict:
        """``{ok, data}`` or ``{ok: false, error}`` of one tool call; whatever fails becomes the error text."""
        try:
            return {"ok": True, "data": self._tool(name, dict(arguments or {}))}
        except Exception as e:
            return {"ok": False, "error": f"{type(e).__name__}: {e}"}

    def _tool(self, name: str, a: dict):
        if name not in TOOLS:
            raise ValueError(f"unknown tool {name}")
        if missing := [r for r in TOOLS[name]["required"] if r not in a]:
            raise ValueError(f"missing argument {missing[0]}")
        if name == "fetch_rss":
            return _rows(self.fetch_rss(a.get("opml"), a.get("limit"), _day(a.get("since"))))
        if name == "fetch_gmail":
            return _rows(self.fetch_mail(self.spark.read.parquet(a["messages"]), a.get("limit"), _day(a.get("since")), a.get("senders", ""), parse_sender_map(a.get("sender_names"))))
        if name == "generate_keywords":
            return keywords.extract_keywords(a["prompt"], self.generate)
        if name.startswith("search_"):
            return _rows(self.search(name.removeprefix("search_"), a["query"], a.get("rows", 5)))
        papers = papers_from_text(self.spark, a["papers_json"])
        if name == "filter_keywords":
            chosen = {k: a[k] for k in ("keywords", "exclude_keywords", "authors", "has_pdf") if a.get(k)}
            return _rows(self.filter_keywords(papers, min_date=_day(a.get("min_date")), **chosen))
        if name == "filter_ai":
            return _rows(self.filter_ai(papers.withColumn("_pos", F.monotonically_increasing_id())).drop("_pos"))
        if name == "enrich":
            return _rows(self.enrich(papers, a.get("provider", "all")))
        return write_papers(papers, a["filepath"], include_metadata=a.get("include_metadata", True))


def _day(value) -> date | None:
    return date.fromisoformat(value) if isinstance(value, str) else value


def _rows(df: DataFrame) -> list[dict]:
    shown = df.select(*[c for c in df.columns if c in PAPER_SCHEMA.names or c == "work_id"])
    return [json.loads(line) for line in shown.toJSON().collect()]


def papers_text(papers: DataFrame, most: int = 50, order: str = "_pos") -> str:
    """A readable list of the first papers: title, three authors, source, date, link."""
    total = papers.count()
    rows = papers.orderBy(order).limit(most).select("title", F.array_join(F.slice("authors", 1, 3), ", ").alias("a"), "source", F.col("published_date").cast("string").alias("d"), "url").collect()
    blocks = [f"{i}. {r.title}\n   {r.a or ''}\n   {r.source} {r.d or ''}\n   {r.url or ''}" for i, r in enumerate(rows, 1)]
    return f"{total} papers\n\n" + "\n\n".join(blocks) + (f"\n\n... and {total - most} more" if total > most else "")


def default_since(today: date) -> date:
    return today - timedelta(days=15)


def delete_output(path: str, force: bool = False) -> None:
    """Remove an output folder; the working folder, its parents, the root and, without ``force``, folders not named output are refused."""
    import shutil

    target = os.path.realpath(path)
    here = os.path.realpath(os.getcwd())
    if target == "/" or here == target or here.startswith(target + os.sep) or (os.path.basename(target) != "output" and not force):
        raise ValueError(f"refusing to delete {target}")
    shutil.rmtree(target, ignore_errors=True)


__all__ = ["Engine", "TOOLS", "PROMPT", "papers_text", "default_since", "delete_output", "export_keys"]
