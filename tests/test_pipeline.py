import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from biblioflow.engine import Engine, delete_output
from biblioflow.functions.text import identity_keys
from biblioflow.operators import filters, greedy, keywords, library
from biblioflow.operators.filters import Criteria
from biblioflow.sources.feeds import entries_to_papers, feed_entries, parse_feed
from biblioflow.sources.mail import html_body, html_items, plain_text_dois, search_query
from biblioflow.sources.opml import parse_opml
from biblioflow.sources.papers_json import papers_from_text, read_papers, write_papers

PAPERS = "paper_id long, title string, abstract string, authors array<string>, pdf_url string, published_date date, doi string, url string"


def papers(spark):
    rows = [
        (1, "Machine learning for NLP", "text", ["Doe, J."], "x.pdf", date(2024, 1, 15), "10.1000/a", "https://x.example/1"),
        (2, "Deep vision", "images", ["Roe"], "y.pdf", date(2024, 2, 20), "https://doi.org/10.1000/A", None),
        (3, "Quantum states", None, None, None, None, None, "https://x.example/3"),
        (4, "Quantum states In Press", "machine", [], "", date(2023, 1, 1), "", "https://x.example/3?utm_source=z"),
    ]
    return spark.createDataFrame(rows, PAPERS)


def test_filter_chain(spark):
    df = papers(spark)
    reasons = {r.paper_id: r.reject_reason for r in filters.with_reason(df, Criteria(keywords=["MACHINE", "quantum"], exclude_keywords=["nlp"], authors=["doe"])).collect()}
    assert reasons == {1: "exclude", 2: "keyword", 3: "author", 4: "author"}
    assert [r.paper_id for r in filters.keep_matching(df, Criteria(min_date=date(2024, 1, 1))).orderBy("paper_id").collect()] == [1, 2, 3]
    assert [r.paper_id for r in filters.keep_matching(df, Criteria(has_pdf=True)).orderBy("paper_id").collect()] == [1, 2, 4]
    assert filters.keep_matching(df, Criteria()).count() == 4
    stats = filters.filter_statistics(df, Criteria(keywords=["quantum"])).first()
    assert (stats.total, stats.passed, stats.rejected_keyword) == (4, 2, 2)


def test_greedy_small(spark):
    marked = greedy.deduplicate(papers(spark), identity_keys(F.col("doi"), F.col("url"), F.col("title")))
    assert {r.paper_id: (r.kept, r.matched_kind) for r in marked.collect()} == {1: (True, None), 2: (False, "doi"), 3: (True, None), 4: (False, "url")}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_like_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"k{rng.randrange(25)}") for i in range(60) for _ in range(rng.randrange(1, 4))]
    seen, kept = set(), {}
    for i in range(60):
        mine = {v for p, v in rows if p == i}
        kept[i] = not (mine & seen)
        if kept[i]:
            seen |= mine
    got = {r.pos: r.kept for r in greedy.greedy_keep(spark.createDataFrame(rows, "pos long, value string")).collect()}
    assert got == kept


@pytest.mark.parametrize("seed", range(2))
def test_export_like_one_by_one(spark, seed):
    rng = random.Random(seed)
    probe = [(i, f"k{rng.randrange(15)}") for i in range(40) for _ in range(rng.randrange(1, 3))]
    register = sorted(set(probe) | {(i, f"k{rng.randrange(15)}") for i in range(40)})
    seen, kept = set(), {}
    for i in range(40):
        kept[i] = not ({v for p, v in probe if p == i} & seen)
        if kept[i]:
            seen |= {v for p, v in register if p == i}
    got = {r.pos: r.kept for r in greedy.export_in_batch(spark.createDataFrame(probe, "pos long, value string"), spark.createDataFrame(register, "pos long, value string")).collect()}
    assert got == kept


def test_judge(spark):
    df = papers(spark)
    ids = lambda d: sorted(r.paper_id for r in d.collect())
    assert ids(filters.judge_in_batches(df, lambda p: '{"relevant": [0, "1", 99]}', batch=3)) == [1, 2, 4]
    assert ids(filters.judge_in_batches(df, lambda p: 1 / 0)) == [1, 2, 3, 4]
    assert ids(filters.judge_in_batches(df, lambda p: "no idea")) == [1, 2, 3, 4]
    assert filters.parse_reply('Sure:\n```json\n{"relevant": [2, 0]}\n```', 3) == {0, 2}
    assert filters.parse_reply('x {"relevant": [1], "why": "y"} z', 3) == {1}


def test_keywords(spark):
    df = spark.createDataFrame([("Zn anode for flow cells",), ("In-situ synchrotron XRD study",), ("Protein folding",)], "title string").withColumn("abstract", F.lit(None).cast("string"))
    hit = lambda k: [r.relevant for r in keywords.with_relevance(df, [k]).collect()]
    assert hit("zinc") == [True, False, False]
    assert hit("xrd") == [False, True, False]
    words = spark.createDataFrame([("batteries boxes materials electrodes studied running zinc",)], "t string").select(F.transform(F.split("t", " "), keywords.stem)).first()[0]
    assert words == ["battery", "box", "material", "electrod", "studi", "runn", "zinc"]
    with pytest.raises(ValueError):
        keywords.with_relevance(df, [])
    assert keywords.parse_keywords('```json\n["a", " b "]\n```') == ["a", "b"]
    assert keywords.extract_keywords("p", lambda p: '["b", "a"]') == ["a", "b"]


def test_library(spark):
    df = papers(spark).withColumns({c: F.lit(None).cast("string") for c in set(library.ITEM_FIELDS.values()) - {"title", "abstract", "doi", "url", "item_type"}}).withColumn("access_date", F.lit(None).cast("date"))
    item = json.loads(library.library_items(df.withColumn("item_type", F.lit("preprint")).withColumn("publication_title", F.lit("Server")).where("paper_id = 1"), "2026-01-01").first().item)
    assert item["repository"] == "Server" and "publicationTitle" not in item and item["accessDate"] == "2026-01-01"
    held = spark.createDataFrame([("10.1000/A", "", None, None)], "doi string, title string, date string, url string")
    plan = {r.paper_id: r.outcome for r in library.export_plan(papers(spark), held).collect()}
    assert plan == {1: "in_library", 2: "in_library", 3: "create", 4: "in_batch"}


def test_opml_and_feeds(spark):
    feeds = parse_opml("<opml><body><outline text='Cat'><outline text='A' xmlUrl='u1' type='RSS'/><outline title='B' xmlUrl='u2' type='html'/></outline><outline xmlUrl='u3'/></body></opml>")
    assert feeds == [("u1", "A", "", "Cat"), ("u3", "Unknown", "", None)]
    assert parse_opml("<opml/>") == [] and parse_feed("<rss><broken") == []
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><entry><title>T</title><link href='https://arxiv.org/abs/1'/><updated>2024-05-01T00:00:00Z</updated><author><name>A</name></author><summary>S</summary></entry><entry><title></title></entry></feed>"
    df = spark.createDataFrame([(0, "F", "u", atom), (1, "G", "v", None)], "feed_pos long, title string, url string, document string")

    def fetch(url):
        raise OSError(url)

    rows = entries_to_papers(feed_entries(df, fetch)).collect()
    assert [(r.title, r.pdf_url, r.published_date, r.authors) for r in rows] == [("T", "https://arxiv.org/pdf/1.pdf", date(2024, 5, 1), ["A"])]
    assert Engine(spark, fetch=fetch).fetch_rss(documents=df, limit=5).count() == 1


def test_mail(spark):
    html = "<table><tr><td><a href='https://doi.org/10.1021/acs.x.1'>A sufficiently long article title</a></td><td>Doe, Roe</td></tr><tr><td><a href='#'>Read more</a></td></tr></table>"
    found = html_items(html)
    assert found[0] == (0, 0, "A sufficiently long article title", "https://doi.org/10.1021/acs.x.1", "10.1021/acs.x.1", ["Doe", "Roe"])
    assert html_items("") == [] and html_items("<p>no <b>links<br>") == []
    assert html_body('{"mimeType": "text/html", "body": {"data": "PGI-aGk8L2I-"}}') == "<b>hi</b>"
    assert html_body("{}") is None
    dois = plain_text_dois(spark.createDataFrame([("m", "see 10.1234/a and 10.1234/A, 10.5678/b")], "message_id string, body string"))
    assert [r.doi for r in dois.orderBy("doi_pos").collect()] == ["10.1234/a", "10.5678/b"]
    assert search_query(["b@x", "a@x"], trash=True) == "in:trash (from:a@x OR from:b@x)"


def test_json(spark, tmp_path):
    text = json.dumps([{"title": "T", "source": "s", "source_type": "rss", "unknown": 1}])
    done = write_papers(papers_from_text(spark, text), str(tmp_path / "a" / "p.json"))
    assert done["count"] == 1
    assert read_papers(spark, done["filepath"]).first().item_type == "journalArticle"
    with pytest.raises(ValueError):
        papers_from_text(spark, '[{"title": "T"}]')
    assert Engine(spark).run_tool("filter_keywords", {"papers_json": text, "keywords": ["t"]})["data"][0]["title"] == "T"
    assert Engine(spark).run_tool("nothing", {})["ok"] is False
    with pytest.raises(ValueError):
        delete_output("/")
