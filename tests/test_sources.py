"""Calls out, the library, settings, keyword extraction, the data source and the stream."""

import json
import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from biblioflow.cli import Library, default_output, main
from biblioflow.engine import Engine, list_prompts, list_tools, render_prompt
from biblioflow.functions.text import identity_keys
from biblioflow.operators import enrich
from biblioflow.operators.filters import Criteria, dense_position, json_objects, parse_reply, pipeline_statistics
from biblioflow.operators.keywords import choose_keywords, extract_keywords, filter_by_prompt, stem, stem_of
from biblioflow.settings import Settings
from biblioflow.sources import datasource, library
from biblioflow.sources.feeds import feed_errors
from biblioflow.sources.mail import message_items, parse_sender_map
from biblioflow.sources.papers_json import read_papers, write_papers
from biblioflow.sources.web import CallFailed, Reply, WebClient, polite_headers, wait_before
from biblioflow.streaming.incremental import deduplicate_stream


def test_attempts_waits_and_rate():
    waits, now = [], [0.0]

    def sleep(s):
        waits.append(round(s, 3))
        now[0] += s

    replies = [Reply(429, {"Retry-After": "3"}), Reply(503), Reply(200, {}, "body")]
    client = WebClient(lambda url, headers: replies.pop(0), sleep=sleep, clock=lambda: now[0])
    assert client("u") == "body" and waits == [3.0, 2.0]
    calls = []

    def broken(url, headers):
        calls.append(headers)
        raise ConnectionError("down")

    with pytest.raises(ConnectionError):
        WebClient(broken, {"User-Agent": "x"}, sleep=sleep, clock=lambda: now[0])("u")
    assert len(calls) == 3
    with pytest.raises(CallFailed):
        WebClient(lambda url, headers: Reply(404), sleep=sleep)("u")
    waits.clear()
    limited = WebClient(lambda url, headers: Reply(200), per_second=4, sleep=sleep, clock=lambda: now[0])
    for _ in range(3):
        limited("u")
    assert waits == [0.25, 0.25]
    assert wait_before(1, {"retry-after": "Thu, 01 Jan 1970 00:00:10 GMT"}, 4.0) == 6.0 and wait_before(9, {}, 0.0) == 4.0
    assert wait_before(1, {"X-RateLimit-Reset": "7"}, 0.0, "x-ratelimit-reset") == 7.0
    assert polite_headers("tool/1 (mailto:{email})", "a@b.example")["User-Agent"] == "tool/1 (mailto:a@b.example)" and polite_headers("tool/1", "a@b.example")["User-Agent"] == "tool/1 (mailto:a@b.example)"


def test_library_scan_and_shapes(spark):
    stored = [{"key": f"K{i}", "data": {"itemType": "journalArticle", "title": f"T{i}", "DOI": f"10.1/{i}"}} for i in range(250)]
    pages = list(library.scan_pages(lambda start, limit: {"items": stored[start : start + limit]}))
    assert [len(p) for p in pages] == [100, 100, 50]
    assert library.items_in({"data": {"items": [{"a": 1}, 5]}}) == [{"a": 1}] and library.items_in({"title": "one"}) == [{"title": "one"}] and library.items_in(None) is None
    with pytest.raises(ValueError):
        list(library.scan_pages(lambda start, limit: "nothing"))
    shown = [{"title": "Flat", "doi": "10.1/a", "itemType": "book"}, {"data": {"title": "Note", "itemType": "note"}}, {"data": {"title": "Child", "parentItem": "K1", "itemType": "book"}}, {"data": {"title": "Nested", "url": "u", "date": "2020", "itemType": "book"}}]
    items = library.scan_library(spark, lambda start, limit: shown[start : start + limit]).unionByName(spark.createDataFrame([("[]",), ("broken",), (None,)], "item string"))
    assert {tuple(r) for r in library.library_rows(items).collect()} == {("10.1/a", "Flat", None, None), (None, "Nested", "2020", "u")}
    assert spark.range(1).select(library.creator_names(F.lit("A B; C D and E"))).first()[0] == ["A B", "C D", "E"]


def test_collections():
    listed = [{"key": "AAAAAAA1", "data": {"name": "reading"}}, {"key": "AAAAAAA2", "data": {"name": "Reading"}}, "odd"]
    assert library.collection_key("Reading", lambda: listed) == "AAAAAAA2" and library.collection_key("READING", lambda: listed) == "AAAAAAA1"
    assert library.collection_key("ABCD1234", None) == "ABCD1234" and library.collection_key(" ", None) is None
    for bad in (lambda: listed, lambda: {}, lambda: 1 / 0):
        with pytest.raises(ValueError):
            library.collection_key("Missing", bad)


def test_creation_replies():
    assert library.creation_counts({"successful": {"0": {}}, "failed": {"1": {}}}) == {"created": 1, "skipped": 0, "failed": 1}
    assert library.creation_counts({"created_count": 2, "duplicate_count": 1}) == {"created": 2, "skipped": 1, "failed": 0} and library.creation_counts(None)["created"] == 0
    assert library.creation_errors({"failed": {"0": {"message": "a"}, "1": {"error": "b"}, "2": {"message": "a"}}}, 3) == "a; b"
    assert library.creation_errors({"failures": [{"message": "m"}, "n", {}]}, 2) == "m; n" and "2" in library.creation_errors({}, 2)


def test_export_creates_once_and_reports(spark, tmp_path):
    rows = [(1, "A", "10.1234/a"), (2, "B", "10.1234/b"), (3, "B again", "10.1234/b"), (4, "Fails", "10.1234/f"), (5, "Raises", "10.1234/r"), (6, "Held", "10.1234/h"), (7, "Skipped", "10.1234/s")]
    empty = [c for c in library.library_items.__globals__["ITEM_FIELDS"].values() if c not in ("title", "doi")]
    papers = spark.createDataFrame(rows, "paper_id long, title string, doi string").withColumns({c: F.lit(None).cast("string") for c in empty} | {"authors": F.lit(None).cast("array<string>"), "published_date": F.lit(None).cast("date"), "access_date": F.lit(None).cast("date")})
    folder = str(tmp_path)

    def create(item):
        with open(f"{folder}/{item['title']}", "a") as out:
            out.write("x")
        if item["title"] == "Raises":
            raise OSError("refused")
        return {"failed": {"0": {"message": "bad"}}} if item["title"] == "Fails" else {"skipped_duplicates": 1} if item["title"] == "Skipped" else {"created": 1}

    held = spark.createDataFrame([("10.1234/h", "Held", None, None)], "doi string, title string, date string, url string")
    done = library.export_papers(papers, create, held, "2026-01-01")
    assert {r.paper_id: (r.outcome, r.skipped_by, r.error) for r in done.collect()} == {1: ("created", None, None), 2: ("created", None, None), 3: ("in_batch", None, None), 4: ("failed", None, "bad"), 5: ("failed", None, "refused"), 6: ("in_library", "doi", None), 7: ("skipped", "doi", None)}
    stats = library.export_statistics(done).first()
    assert (stats.total, stats.success_count, stats.skipped_count, stats.skipped_doi, stats.skipped_runtime_duplicate, stats.failed) == (7, 2, 3, 2, 1, 2)
    assert (tmp_path / "A").read_text() == "x"  # read twice, created once
    assert library.export_papers(papers.limit(0), create, None, "2026-01-01").count() == 0


def test_settings(tmp_path):
    file = tmp_path / "env"
    file.write_text("# c\nexport BIBLIOFLOW_RSS_TIMEOUT='7'\nBIBLIOFLOW_POLITE_EMAIL=a@b.example\nBIBLIOFLOW_MAIL_MARK_AS_READ=yes\n")
    read = Settings.read({"BIBLIOFLOW_RSS_TIMEOUT": "9", "BIBLIOFLOW_OPML": " ", "BIBLIOFLOW_CROSSREF_TIMEOUT": "3"}, str(file))
    assert (read.rss_timeout, read.opml, read.mail_mark_as_read) == (9, "feeds.opml", True)
    assert read.catalog("crossref") == {"email": "a@b.example", "timeout": 3, "user_agent": "biblioflow"} and read.catalog("openalex")["timeout"] == 45
    with pytest.raises(ValueError):
        Settings.read({"BIBLIOFLOW_RSS_TIMEOUT": "soon"})
    (tmp_path / "p").write_text("  \n")
    assert Settings(research_prompt=" x ").prompt() == "x" and Settings(research_prompt_file=str(tmp_path / "p")).prompt() is None and Settings().prompt() is None


def test_keyword_extraction(tmp_path):
    calls, lock = [], threading.Lock()

    def generate(prompt, **options):
        with lock:
            calls.append(options)
            n = len(calls)
        if "Choose" in prompt:
            return json.dumps({"keywords": [f"k{i}" for i in range(20, 4, -1)]})
        if n == 1:
            raise OSError("down")
        return json.dumps({"keywords": [f"k{i}" for i in range(8 * n, 8 * n + 8)]})

    cache = str(tmp_path / "c" / "keywords.json")
    found = extract_keywords("zinc", generate, cache=cache, temperature=0)
    assert len(found) == 10 and len(calls) == 4 and calls[0] == {"temperature": 0}
    assert extract_keywords("zinc", generate, cache=cache) == found and len(calls) == 4
    assert choose_keywords(["a", "b", "a"], None) == ["a", "b"] and choose_keywords([str(i) for i in range(12)], lambda p: 1 / 0) == [str(i) for i in range(10)]
    with pytest.raises(ValueError):
        extract_keywords(" ", generate)


def test_stems_are_one_rule(spark):
    words = ["batteries", "ies", "processes", "es", "glass", "cells", "s", "coated", "ed", "coating", "ing", "zinc", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: stem_of(w) for w in words}


def test_prompt_without_keywords_keeps_nothing(spark):
    papers = spark.createDataFrame([("Zinc cells", None), (None, None)], "title string, abstract string")
    assert [r.relevant for r in filter_by_prompt(papers, "x", lambda p: '["zinc"]').collect()] == [True, False]
    assert [r.relevant for r in filter_by_prompt(papers, "x", lambda p: 1 / 0).collect()] == [False, False]


def test_replies_in_any_dress():
    assert parse_reply('Sure! ```json\n{"relevant": [0, "2", 9, null, 1.0]}\n``` done', 3) == {0, 1, 2}
    assert parse_reply('{"note": {"x": 1}, "relevant": []}', 3) == set() and parse_reply("{broken {\"relevant\": [1]}", 3) == {1}
    assert parse_reply("none", 3) == set() and parse_reply('{"relevant": 3}', 4) == set() and list(json_objects("[1, {}]")) == [{}]


def test_positions_and_stages(spark):
    df = spark.createDataFrame([(i * i % 1009 << 33, f"t{i}", None, None, None, None) for i in range(500)], "k long, title string, abstract string, authors array<string>, pdf_url string, published_date date").distinct()
    rows = sorted((r.k, r._pos) for r in dense_position(df.select("k"), "k").collect())
    assert [p for _, p in rows] == list(range(len(rows)))
    stages = {r.stage: tuple(r)[1:] for r in pipeline_statistics(df, Criteria(keywords=["t1"])).collect()}
    assert stages["keyword"][3] is None and stages["judge"][3] == "no judge" and stages["keyword"][0] == len(rows)


def test_papers_as_a_format(spark, tmp_path):
    folder = str(tmp_path)

    def keep(records, options):
        with open(f"{options['path']}/{threading.get_ident()}-{id(records)}.txt", "w") as out:
            out.writelines(r["title"] + "\n" for r in records)

    datasource.register(spark, "papers_here", lambda options: [1, 2], lambda p, options: iter([{"title": f"T{p}", "source": "s", "source_type": "rss", "published_date": "2024-01-02"}]), keep)
    read = spark.read.format("papers_here").load()
    assert sorted((r.title, r.published_date) for r in read.collect()) == [("T1", date(2024, 1, 2)), ("T2", date(2024, 1, 2))]
    read.write.format("papers_here").mode("append").option("path", folder).save()
    assert sorted(line for f in tmp_path.iterdir() for line in f.read_text().split()) == ["T1", "T2"]


def test_json_documents_round_trip(spark, tmp_path):
    papers = spark.createDataFrame([(i, f'Title "{i}"', "s", "rss", "[x],") for i in range(500)], "_pos long, title string, source string, source_type string, abstract string").repartition(5)
    path = str(tmp_path / "papers.json")
    assert write_papers(papers, path, "_pos")["count"] == 500
    assert [p["title"] for p in json.loads(open(path).read())] == [f'Title "{i}"' for i in range(500)]
    assert read_papers(spark, path).count() == 500 and [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
    write_papers(papers.limit(0), path)
    assert json.loads(open(path).read()) == []
    (tmp_path / "other.json").write_text(json.dumps([{"title": "T", "source": "s", "source_type": "rss"}], indent=1))
    assert read_papers(spark, str(tmp_path / "other.json")).first().item_type == "journalArticle"


def test_stream_against_its_own_history(spark, tmp_path):
    schema = "paper_id long, doi string, url string, title string"
    incoming, keys, sink = str(tmp_path / "in"), str(tmp_path / "keys"), str(tmp_path / "out")
    key = identity_keys(F.col("doi"), F.col("url"), F.col("title"))
    for batch in ([(1, "10.1234/a", None, "A"), (2, "10.1234/A", None, "B")], [(3, "10.1234/a", None, "C"), (4, None, None, "new")], [(5, None, None, "New")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(schema).parquet(incoming)
        deduplicate_stream(stream, key, keys, sink, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.paper_id for r in spark.read.parquet(sink).collect()) == [1, 4]
    for file in (tmp_path / "keys" / "batch=0").glob("*.parquet"):
        file.write_bytes(b"broken")
    spark.createDataFrame([(9, "10.1234/a", None, "A")], schema).coalesce(1).write.mode("append").parquet(incoming)
    with pytest.raises(Exception):  # a history that cannot be read is no empty one
        deduplicate_stream(spark.readStream.schema(schema).parquet(incoming), key, keys, sink, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()


def test_mail_without_html(spark):
    part = lambda kind, text: {"mimeType": kind, "body": {"data": __import__("base64").urlsafe_b64encode(text.encode()).decode()}}
    payloads = [("m1", json.dumps({"mimeType": "multipart/mixed", "parts": [part("text/plain", "see 10.1234/ab.c and 10.1234/AB.c")]})), ("m2", json.dumps(part("text/html", "<a href='https://doi.org/10.1234/x'>A long enough title of a paper</a>"))), ("m3", None)]
    items = message_items(spark.createDataFrame(payloads, "message_id string, payload_json string")).collect()
    assert sorted((r.message_id, r.strategy, r.doi) for r in items) == [("m1", 3, "10.1234/ab.c"), ("m2", 2, "10.1234/x")]
    assert parse_sender_map('{"A@b.example ": "Name", "c": 3}') == {"a@b.example": "Name"} and parse_sender_map("[]") == parse_sender_map("x") == parse_sender_map(None) == {}


def test_feeds_that_fail(spark):
    def fetch(url):
        return {"good": "<rss/>", "bad": "<rss"}[url]

    feeds = spark.createDataFrame([(0, "good"), (1, "bad"), (2, "gone")], "feed_pos long, url string")
    assert sorted(r.feed_pos for r in feed_errors(feeds, fetch).collect()) == [1, 2]


def test_tools_and_prompts(spark):
    assert all(t["inputSchema"]["type"] == "object" for t in list_tools()) and list_prompts()[0]["arguments"][0]["required"]
    assert "zinc" in render_prompt("latest_papers", {"topic": " zinc "})
    for name, arguments in (("latest_papers", {}), ("other", {})):
        with pytest.raises(ValueError):
            render_prompt(name, arguments)
    assert Engine(spark).run_tool("filter_keywords", {})["error"].startswith("ValueError: missing argument papers_json")


def test_title_and_authors_where_there_is_no_doi(spark):
    raw = spark.createDataFrame([(1, "10.1234/a", ["Zinc foam anodes for aqueous cells at low cost"], [("Doe", "Jane", None)], "Journal")], "work_id long, doi string, title array<string>, author array<struct<family: string, given: string, name: string>>, j string")
    kinds = {"container_title": "array<string>", "published": "struct<date_parts: array<array<int>>>", "published_print": "struct<date_parts: array<array<int>>>", "published_online": "struct<date_parts: array<array<int>>>", "issn": "array<string>", "subject": "array<string>", "funder": "array<struct<name: string, award: array<string>>>", "reference": "array<string>", "link": "array<struct<url: string, content_type: string>>"}
    raw = raw.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()} | {c: F.lit(None).cast("string") for c in ("volume", "issue", "page", "abstract", "url", "publisher", "type", "language")}).withColumn("authors", F.lit(None).cast("array<string>"))
    rows = [(1, None, None, "Zinc foam anodes for aqueous cells at low cost", ["Jane Doe"], '{"kept": 1}'), (2, "10.9999/none", None, "Zinc foam anodes for aqueous cells at low cost", ["Jane Doe"], None), (3, None, None, "Another title altogether", None, "broken"), (4, None, None, None, None, None)]
    fields = [c for c in ("abstract", "publication_title", "volume", "issue", "pages", "pdf_url", "publisher", "issn", "language", "item_type")]
    papers = spark.createDataFrame(rows, "paper_id long, doi string, url string, title string, authors array<string>, extra string").withColumns({c: F.lit(None).cast("string") for c in fields} | {"published_date": F.lit(None).cast("date")})
    done = {r.paper_id: r for r in enrich.enrich_from(papers, raw, enrich.CROSSREF).collect()}
    assert done[1].doi == "10.1234/a" and json.loads(done[1].extra)["kept"] == 1 and "crossref" in json.loads(done[1].extra)
    assert json.loads(done[1].extra)["crossref_extra"] == {"j": "Journal"}
    assert done[2].doi == "10.9999/none" and json.loads(done[2].extra)["crossref_unmatched"]["strategy"] == "doi_only"
    assert json.loads(done[3].extra)["crossref_unmatched"]["strategy"] == "title_author"
    assert enrich.enriched_count(papers, enrich.enrich_from(papers, raw, enrich.CROSSREF)).first().enriched == 1
    assert Engine(spark, {"crossref": raw}).enrich(papers, "crossref").count() == 4


def test_command_line_exports_to_a_library(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("BIBLIOFLOW_RESEARCH_PROMPT", "zinc")
    made = str(tmp_path / "made")
    path = str(tmp_path / "in.json")
    open(path, "w").write(json.dumps([{"title": f"{t} paper", "source": "s", "source_type": "rss", "doi": f"10.1234/{t}", "extra": "{}"} for t in ("Zinc", "Iron")]))

    def create(item):
        with open(made, "a") as out:
            out.write(item["title"] + "|" + ",".join(item["collections"]))
        return {"created": 1}

    held = [{"data": {"itemType": "book", "title": "Iron paper", "DOI": "10.1234/Iron"}}]
    there = Library(lambda start, limit: held[start : start + limit], create, lambda: [{"key": "AAAAAAA1", "name": "Reading"}])
    assert main(["export", "--input", path, "--to", "library", "--collection", "reading"], spark, library=there) == 0
    assert open(made).read() == "Zinc paper|AAAAAAA1" and "'skipped_doi': 1" in capsys.readouterr().out
    kept = str(tmp_path / "kept.json")
    assert main(["filter", "--input", path, "--output", kept], spark, generate=lambda p: '["zinc"]') == 0
    assert [p["title"] for p in json.loads(open(kept).read())] == ["Zinc paper"]
    assert main(["export", "--input", path, "--to", "library"], spark) == 1 and default_output("fetch", date(2026, 1, 2)) == "output/2026-01-02/fetch.json"
