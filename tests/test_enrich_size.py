"""Title matches against brute force, and the work of DOI forms."""

import random

from pyspark.sql import functions as F

from biblioflow.functions.canonical import doi_canonical
from biblioflow.functions.text import normalize_doi
from biblioflow.operators import enrich
from biblioflow.operators.known import url_identity


def _jaccard(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


def _titles(count: int, sizes: tuple[int, ...], seed: int) -> list[str]:
    draw = random.Random(seed)
    return [" ".join(draw.sample([f"w{i}" for i in range(45)], draw.choice(sizes))) for _ in range(count)]


def test_titles_of_common_words(spark):
    """Every word stands in a quarter of the titles."""
    ours, theirs = _titles(700, (11, 12), 1), _titles(700, (11, 12), 2)
    theirs[:50] = [t + " extra" for t in ours[:50]]
    papers = spark.createDataFrame([(i, t, []) for i, t in enumerate(ours)], "paper_id long, title string, authors array<string>")
    works = spark.createDataFrame([(i, t, []) for i, t in enumerate(theirs)], "work_id long, title string, authors array<string>")
    found = {r.paper_id: r.work_id for r in enrich.best_title_matches(papers, works, True).collect()}
    want = {i: min(((-_jaccard(t, u), j) for j, u in enumerate(theirs)), key=lambda x: x) for i, t in enumerate(ours)}
    assert found == {i: j for i, (s, j) in want.items() if -s >= 0.8} and len(found) == 50


def test_similar_titles_of_all_sizes(spark):
    draw = random.Random(3)
    ours = list(dict.fromkeys(_titles(120, (1, 2, 3, 4, 5, 8, 12, 16, 20, 23, 24, 25, 27, 33, 40), 4)))
    theirs = []
    for t in ours:
        words = t.split()
        kept = draw.sample(words, max(1, len(words) - draw.choice((0, 0, 1, 2, len(words) // 5))))
        theirs.append(" ".join(kept + draw.sample(["new", "more", "other", "less", "late", "early"], draw.choice((0, 0, 1, 2, min(6, len(words) // 5))))))
    theirs = list(dict.fromkeys(theirs))
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts], "_t string")
    for least in (11 / 15, 0.5, 1.0):
        found = {(r._ta, r._tb) for r in enrich._similar_titles(frame(ours), frame(theirs), least).collect()}
        assert found == {(a, b) for a in ours for b in theirs if _jaccard(a, b) >= least - 1e-9}


def test_a_title_of_many_works_offers_the_first(spark):
    papers = spark.createDataFrame([(i, "One title of many works", ["Doe, Ann"]) for i in range(40)], "paper_id long, title string, authors array<string>")
    works = spark.createDataFrame([(i, "One title: of many works", ["Ann Doe" if i in (3, 9) else "Eve Roe"]) for i in range(40)], "work_id long, title string, authors array<string>")
    assert {(r.work_id, r.score) for r in enrich.best_title_matches(papers, works, True).collect()} == {(3, 1.0)}


def test_doi_forms_name_each_pattern_once(spark):
    values = ["https://DOI.org/10.1234/ABC).", "doi:10.1234/x", " DOI:10.1234/y; ", "see doi.org/ and doi.org/10.12345/z,", "doi:10.1/x", "", None, "x\ndoi.org/\n10.1234/q"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(normalize_doi(F.col("v")).alias("d"))
    assert [r.d for r in df.collect()] == ["10.1234/abc", "10.1234/x", "10.1234/y", "10.12345/z", None, None, None, "10.1234/q"]
    asked = spark.createDataFrame([("a", "b")], "doi string, url string")
    plan = asked.select(enrich.doi_candidate(asked))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 10


def test_identities_name_each_pattern_once(spark):
    """A DOI and a URL are computed once for a row, not once for each place that asks whether they are blank."""
    urls = ["HTTPS://www.Host.example/A//?b=2&utm_x=1&a=1#f", "host.example/", " http://h.example?ref=1 ", "https://", "", None, "h.example/p?&", "h.example/a\nb?q=1\n2"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(url_identity(F.col("u")).alias("u"))
    assert [r.u for r in df.collect()] == ["host.example/A?a=1&b=2", "host.example", "h.example", None, None, None, "h.example/p", "h.example/a\nb?q=1\n2"]
    dois = spark.createDataFrame([("https://doi.org/10.1234/AB-c",), (" . ",), (None,)], "d string").select(doi_canonical(F.col("d")).alias("d"))
    assert [r.d for r in dois.collect()] == ["101234abc", None, None]
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (df, dois)]
    assert plans[0].count("regexp_replace") <= 2 and plans[1].count("regexp_replace") <= 4


def _joined(spark):
    papers = spark.createDataFrame(
        [(1, "One long title of a paper", ["Doe, Ann"], None, None), (2, "Other", [], "10.1234/AB", None), (3, "Third", [], None, "see 10.1234/nowhere"), (4, None, [], " \t", "10.x"), (5, "", [], "", None)],
        "paper_id long, title string, authors array<string>, doi string, url string",
    )
    raw = spark.createDataFrame(
        [(7, "10.1234/ab", ["Else"], "old &amp; new"), (8, None, ["One long title: of a paper"], "text")], "work_id long, doi string, title array<string>, abstract string"
    )
    works = lambda df: df.select("work_id", "doi", F.get("title", F.lit(0)).alias("title"), F.array(F.lit("Ann Doe")).alias("authors"), enrich.clean_abstract(F.col("abstract")).alias("abstract"))
    catalog = enrich.Catalog("small", works, lambda: F.col("doi"), True, frozenset(raw.columns))
    return papers, enrich.join_works(papers, raw, catalog)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_lookup_is_named_without_normalizing_a_doi(spark):
    papers, joined = _joined(spark)
    shown = joined.select("paper_id", "lookup", F.col("work.work_id").alias("w"))
    assert [tuple(r) for r in shown.orderBy("paper_id").collect()] == [(1, "title_author", 8), (2, "doi_only", 7), (3, "doi_only", None), (4, "none", None), (5, "none", None)]
    assert "doi\\.org" not in _plan(shown)
    asked = papers.select(enrich.has_doi(papers).alias("h"), enrich.doi_candidate(papers).isNotNull().alias("c")).collect()
    assert all(r.h == r.c for r in asked)


def test_who_lacks_a_work_is_known_without_its_fields(spark):
    lacking = enrich.unmatched(_joined(spark)[1])
    assert sorted(r.paper_id for r in lacking.collect()) == [3, 4, 5] and "&#" not in _plan(lacking)


def test_fields_of_works_that_nobody_reads_are_not_moved(spark):
    shown = _joined(spark)[1].select("paper_id", "work.doi", "work.title")
    assert [tuple(r) for r in shown.orderBy("paper_id").collect()][:2] == [(1, None, "One long title: of a paper"), (2, "10.1234/ab", "Else")]
    assert "&#" not in _plan(shown)


def test_similar_titles_keys_do_not_multiply_by_sizes(spark):
    """A title of eleven words is written for the pairs of its first four, not once more for every size."""
    ours = [" ".join(f"v{i}x{k}" for k in range(11)) for i in range(20)]
    frame = spark.createDataFrame([(t,) for t in ours], "_t string")
    rows = enrich._title_keys(enrich._hashed_titles(frame, frame), 11 / 15)
    assert rows.count() == 2 * 20 * 6
