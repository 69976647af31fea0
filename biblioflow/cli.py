"""Command line: fetch, filter, enrich, export, delete."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from biblioflow.engine import Engine, default_since, delete_output
from biblioflow.operators.filters import Criteria, keep_matching
from biblioflow.operators.keywords import filter_by_prompt
from biblioflow.session import cut_lineage
from biblioflow.settings import Settings
from biblioflow.sources.library import collection_key, export_papers, export_statistics, library_rows, scan_library
from biblioflow.sources.mail import parse_sender_map
from biblioflow.sources.papers_json import read_papers, write_papers
from biblioflow.sources.web import WebClient, polite_headers, urllib_transport


def _positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return value


def default_output(verb: str, today: date) -> str:
    return f"output/{today.isoformat()}/{verb}.json"


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="biblioflow")
    verbs = parser.add_subparsers(dest="verb", required=True)
    fetch = verbs.add_parser("fetch")
    fetch.add_argument("--source", choices=("rss", "mail"), default="rss")
    fetch.add_argument("--opml")
    fetch.add_argument("--messages")
    fetch.add_argument("--senders", default="")
    fetch.add_argument("--sender-names", default="")
    fetch.add_argument("--limit", type=_positive)
    fetch.add_argument("--since", type=date.fromisoformat, default=default_since(date.today()))
    fetch.add_argument("--output")
    filter_ = verbs.add_parser("filter")
    filter_.add_argument("--input", required=True)
    filter_.add_argument("--output")
    for name in ("keywords", "exclude-keywords", "authors"):
        filter_.add_argument(f"--{name}", nargs="*", default=[])
    filter_.add_argument("--min-date", type=date.fromisoformat)
    filter_.add_argument("--has-pdf", action="store_true")
    enrich = verbs.add_parser("enrich")
    enrich.add_argument("--input", required=True)
    enrich.add_argument("--output")
    enrich.add_argument("--provider", choices=("crossref", "openalex", "all"), default="all")
    enrich.add_argument("--crossref")
    enrich.add_argument("--openalex")
    export = verbs.add_parser("export")
    export.add_argument("--input", required=True)
    export.add_argument("--output")
    export.add_argument("--to", choices=("json", "library"), default="json")
    export.add_argument("--collection")
    export.add_argument("--no-metadata", action="store_true")
    delete = verbs.add_parser("delete")
    delete.add_argument("path")
    delete.add_argument("--force", action="store_true")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None, generate=None, library: Library | None = None) -> int:
    """Run one verb. ``generate`` is a model call for keywords, ``library`` what papers are exported to; both are the caller's."""
    args = build_parser().parse_args(argv)
    try:
        if args.verb == "delete":
            delete_output(args.path, args.force)
            return 0
        settings = Settings.read()
        spark = spark or SparkSession.builder.getOrCreate()
        output = args.output or default_output(args.verb, date.today())
        if args.verb == "fetch":
            print(write_papers(_fetched(spark, args, settings), output, "_pos"))
            return 0
        papers = cut_lineage(read_papers(spark, args.input).withColumn("_pos", F.monotonically_increasing_id()))
        if args.verb == "filter":
            criteria = Criteria(args.keywords, args.exclude_keywords, args.min_date, args.authors, args.has_pdf)
            if not criteria.applicable and generate is not None and settings.prompt():  # no criterion at all: keywords of the research prompt
                papers = filter_by_prompt(papers, settings.prompt(), generate).where("relevant").drop("relevant")
            papers = keep_matching(papers, criteria)
        elif args.verb == "enrich":
            catalogs = {k: spark.read.parquet(p) for k, p in (("crossref", args.crossref), ("openalex", args.openalex)) if p}
            papers = Engine(spark, catalogs).enrich(papers, args.provider)
        elif args.verb == "export" and args.to == "library":
            if library is None:
                raise ValueError("no library to export to")
            print(_exported(spark, papers, library, args.collection or settings.library_collection))
            return 0
        print(write_papers(papers, output, "_pos", not getattr(args, "no_metadata", False)))
        return 0
    except (OSError, ValueError, KeyError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def _fetched(spark: SparkSession, args: argparse.Namespace, settings: Settings):
    if args.source == "mail":
        if not args.messages:
            raise ValueError("mail needs a table of messages")
        return Engine(spark).fetch_mail(spark.read.parquet(args.messages), args.limit, args.since, args.senders or settings.mail_sender_filter or "", parse_sender_map(args.sender_names or settings.mail_sender_map))
    client = WebClient(urllib_transport(settings.rss_timeout), polite_headers(settings.user_agent))
    return Engine(spark, fetch=client).fetch_rss(args.opml, args.limit, args.since)


@dataclass(frozen=True)
class Library:
    """A reference library's calls: a page of items, the creation of one, the list of collections."""

    page: Callable[[int, int], object]
    create: Callable[[dict], object]
    collections: Callable[[], object]


def _exported(spark: SparkSession, papers, library: Library, collection: str | None) -> dict:
    """Statistics of an export; a library that cannot be read is written to without a look at what it has."""
    key = collection_key(collection, library.collections)
    try:
        held = library_rows(scan_library(spark, library.page))
    except (OSError, ValueError) as e:
        print(f"the library cannot be read, exporting without a check: {e}", file=sys.stderr)
        held = None
    done = export_papers(papers, library.create, held, date.today().isoformat(), key, "_pos")
    return export_statistics(done).first().asDict()


if __name__ == "__main__":
    sys.exit(main())
