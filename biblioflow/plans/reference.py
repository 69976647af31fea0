"""Queries of the bibliographic operators, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.functions import text as X
from biblioflow.operators import enrich, filters, greedy, keywords, library
from biblioflow.operators.filters import Criteria
from biblioflow.plans import sqltext as Q
from biblioflow.session import table
from biblioflow.sources.feeds import entries_to_papers, feed_entries, placed
from biblioflow.sources.library import export_statistics, library_rows
from biblioflow.sources.mail import html_bodies, item_quality, mail_items, plain_text_dois
from biblioflow.sources.opml import feeds_of_outlines
from biblioflow.sources.papers_json import with_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[name or function.__name__] = function
        if sql is not None:
            ORACLES[name or function.__name__] = sql
        return function

    return register


CRITERIA = Criteria(keywords=["cells", "kinetics", "zinc"], exclude_keywords=["erratum", "graphit"], min_date=date(2021, 1, 1), authors=["an"], has_pdf=False)
WORDS = ("operando XRD", "zinc electrodes", "photodetector", "in-situ study", "mn")


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "papers")


def _keys() -> F.Column:
    return X.identity_keys(F.col("doi"), F.col("url"), F.col("title"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy deduplication, then the filter chain, then papers per source and reason."""
    kept = greedy.deduplicate(_papers(spark, sf), _keys()).where("kept")
    return filters.with_reason(kept, CRITERIA).groupBy("source", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scalar functions


@query(f"SELECT paper_id, {Q.normalize_title('title')} AS normalized, {Q.clean_title('title')} AS cleaned, {Q.norm_text('title')} AS plain, {Q.match_title('title')} AS matched FROM papers")
def title_forms(spark, sf):
    t = F.col("title")
    return _papers(spark, sf).select("paper_id", X.normalize_title(t).alias("normalized"), X.clean_title(t).alias("cleaned"), X.norm_text(t).alias("plain"), X.match_title(t).alias("matched"))


@query("SELECT paper_id, md5(regexp_replace(abstract, '<.*?>', '', 'g')) AS untagged FROM papers")
def clean_html(spark, sf):
    return _papers(spark, sf).select("paper_id", F.md5(X.clean_html(F.col("abstract"))).alias("untagged"))


@query(f"SELECT paper_id, {Q.clean_abstract('abstract')} AS cleaned FROM papers")
def clean_abstract(spark, sf):
    return _papers(spark, sf).select("paper_id", X.clean_abstract(F.col("abstract")).alias("cleaned"))


@query(f"SELECT paper_id, {Q.normalize_doi('doi')} AS normalized, {Q.extract_doi('doi')} AS extracted, nullif(regexp_extract(doi, '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b'), '') AS bounded FROM papers")
def doi_forms(spark, sf):
    d = F.col("doi")
    return _papers(spark, sf).select("paper_id", X.normalize_doi(d).alias("normalized"), X.extract_doi(d).alias("extracted"), X.extract_bounded_doi(d).alias("bounded"))


@query(f"SELECT incoming_id, {Q.normalize_url('url')} AS normalized, {Q.source_from_url('url')} AS source_name FROM incoming_papers")
def url_forms(spark, sf):
    u = F.col("url")
    return table(spark, sf, "incoming_papers").select("incoming_id", X.normalize_url(u).alias("normalized"), X.source_from_url(u).alias("source_name"))


_DAY = "CASE paper_id % 4 WHEN 0 THEN strftime(fetched_at, '%Y-%m-%d') WHEN 1 THEN strftime(fetched_at, '%Y/%m') || ' issue' WHEN 2 THEN 'of ' || strftime(fetched_at, '%Y.%m.%d') || 'T05:00' ELSE strftime(fetched_at, '%d %B') END"


@query(f"SELECT paper_id, {Q.date_text(_DAY)} AS day, {Q.title_date('title', Q.date_text(_DAY))} AS title_day FROM papers")
def date_texts(spark, sf):
    f = lambda p: F.date_format("fetched_at", p)
    kind = F.col("paper_id") % 4
    day = F.when(kind == 0, f("yyyy-MM-dd")).when(kind == 1, F.concat(f("yyyy/MM"), F.lit(" issue"))).when(kind == 2, F.concat(F.lit("of "), f("yyyy.MM.dd"), F.lit("T05:00"))).otherwise(f("dd MMMM"))
    return _papers(spark, sf).select("paper_id", X.date_text(day).alias("day"), X.title_date_key(F.col("title"), X.date_text(day)).alias("title_day"))


_SENDER = "CASE feed_id % 3 WHEN 0 THEN upper(split_part(title, ' ', 1)) || ' <News-' || split_part(title, ' ', 1) || '@Alerts.example>' WHEN 1 THEN 'toc_' || lower(split_part(title, ' ', 1)) || '@mail.example ' ELSE ' ' END"


@query(f"SELECT feed_id, nullif(lower({Q.strip(f"coalesce(nullif(regexp_extract({_SENDER}, '<([^>]+)>', 1), ''), {_SENDER})")}), '') AS address FROM feeds")
def sender_emails(spark, sf):
    first, kind = F.substring_index("title", " ", 1), F.col("feed_id") % 3
    sender = F.when(kind == 0, F.concat(F.upper(first), F.lit(" <News-"), first, F.lit("@Alerts.example>"))).when(kind == 1, F.concat(F.lit("toc_"), F.lower(first), F.lit("@mail.example "))).otherwise(F.lit(" "))
    return table(spark, sf, "feeds").select("feed_id", X.sender_email(sender).alias("address"))


@query(f"SELECT paper_id, array_to_string(list_sort({Q.stems(Q.norm_text('title'))}), ' ') AS stems, array_to_string(list_sort({Q.with_synonyms(Q.norm_text('title'))}), ' ') AS synonyms FROM papers")
def stems_and_synonyms(spark, sf):
    t = X.norm_text(F.col("title"))
    return _papers(spark, sf).select("paper_id", F.array_join(F.array_sort(keywords.stems(t)), " ").alias("stems"), F.array_join(F.array_sort(keywords.with_synonyms(t)), " ").alias("synonyms"))


@query("SELECT paper_id, sha256(title) AS prompt_hash FROM papers")
def prompt_hash(spark, sf):
    return _papers(spark, sf).select("paper_id", keywords.prompt_hash(F.col("title")).alias("prompt_hash"))


_ID_KEYS = f"""ids AS (SELECT paper_id, {Q.normalize_doi('doi')} AS d, {Q.normalize_url('url')} AS u, nullif({Q.normalize_title('title')}, '') AS t, {Q.title_date('title', "strftime(published_date, '%Y-%m-%d')")} AS td FROM papers),
    keys AS (SELECT paper_id, 0 AS place, 'doi' AS kind, d AS value FROM ids WHERE d IS NOT NULL UNION ALL SELECT paper_id, (d IS NOT NULL)::INT, 'url', u FROM ids WHERE u IS NOT NULL
        UNION ALL SELECT paper_id, (u IS NOT NULL)::INT, 'title', t FROM ids WHERE d IS NULL AND t IS NOT NULL)"""


@query(f"WITH {_ID_KEYS} SELECT * FROM keys")
def identity_keys(spark, sf):
    return _papers(spark, sf).select("paper_id", F.posexplode(_keys()).alias("place", "k")).select("paper_id", "place", "k.kind", "k.value")


_EXPORT_KEYS = "exports AS (SELECT paper_id, 0 AS place, 'doi' AS kind, d AS value FROM ids WHERE d IS NOT NULL UNION ALL SELECT paper_id, 0, 'title_date', td FROM ids WHERE d IS NULL AND td IS NOT NULL UNION ALL SELECT paper_id, (td IS NOT NULL)::INT, 'url', u FROM ids WHERE d IS NULL AND u IS NOT NULL)"


@query(f"WITH {_ID_KEYS}, {_EXPORT_KEYS} SELECT * FROM exports")
def export_keys(spark, sf):
    keys = X.export_keys(F.col("doi"), F.col("title"), F.col("published_date"), F.col("url"))
    return _papers(spark, sf).select("paper_id", F.posexplode(keys).alias("place", "k")).select("paper_id", "place", "k.kind", "k.value")


# ---------------------------------------------------------------- filters

_TEXT = "lower(coalesce(title, '') || ' ' || coalesce(abstract, ''))"
_HAS = lambda ks: "(" + " OR ".join(f"contains({_TEXT}, '{k}')" for k in ks) + ")"
_AUTHOR = "coalesce(list_bool_or(list_transform(authors, lambda a: contains(lower(a), 'an'))), false)"
_REASON = f"CASE WHEN {_HAS(CRITERIA.exclude_keywords)} THEN 'exclude' WHEN NOT {_HAS(CRITERIA.keywords)} THEN 'keyword' WHEN NOT {_AUTHOR} THEN 'author' WHEN coalesce(published_date < DATE '2021-01-01', false) THEN 'date' END"


@query(f"SELECT paper_id FROM papers WHERE {_HAS(CRITERIA.keywords)}")
def keyword_include(spark, sf):
    return filters.keep_matching(_papers(spark, sf), Criteria(keywords=CRITERIA.keywords)).select("paper_id")


@query(f"SELECT paper_id FROM papers WHERE NOT {_HAS(CRITERIA.exclude_keywords)}")
def keyword_exclude(spark, sf):
    return filters.keep_matching(_papers(spark, sf), Criteria(exclude_keywords=CRITERIA.exclude_keywords)).select("paper_id")


@query(f"SELECT paper_id FROM papers WHERE {_AUTHOR}")
def author_filter(spark, sf):
    return filters.keep_matching(_papers(spark, sf), Criteria(authors=CRITERIA.authors)).select("paper_id")


@query("SELECT paper_id FROM papers WHERE pdf_url IS NOT NULL")
def has_pdf(spark, sf):
    return filters.keep_matching(_papers(spark, sf), Criteria(has_pdf=True)).select("paper_id")


@query("SELECT paper_id FROM papers WHERE published_date IS NULL OR published_date >= DATE '2021-01-01'")
def min_date_null_passes(spark, sf):
    return filters.keep_matching(_papers(spark, sf), Criteria(min_date=CRITERIA.min_date)).select("paper_id")


@query(f"SELECT paper_id, {_REASON} AS reject_reason FROM papers")
def combined_reason(spark, sf):
    return filters.with_reason(_papers(spark, sf), CRITERIA).select("paper_id", "reject_reason")


@query(f"SELECT reject_reason, count(*) AS n FROM (SELECT {_REASON} AS reject_reason FROM papers) GROUP BY 1")
def reason_histogram(spark, sf):
    return filters.with_reason(_papers(spark, sf), CRITERIA).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT paper_id, reject_reason, 'Rejected by ' || reject_reason || ': ' || title[1:50] || '...' AS message FROM (SELECT paper_id, title, {_REASON} AS reject_reason FROM papers) WHERE reject_reason IS NOT NULL")
def rejection_messages(spark, sf):
    return filters.rejection_messages(_papers(spark, sf), CRITERIA)


@query(f"WITH r AS (SELECT {_REASON} AS r FROM papers) SELECT count(*) AS total, count(*) FILTER (r IS NULL) AS passed, count(*) FILTER (r IS NOT NULL) AS rejected, " + ", ".join(f"count(*) FILTER (r = '{k}') AS rejected_{k}" for k in ("exclude", "keyword", "author", "pdf", "date")) + " FROM r")
def filter_stats(spark, sf):
    return filters.filter_statistics(_papers(spark, sf), CRITERIA)


def _entries(papers):
    """Papers as entries of a feed: what ``entries_to_papers`` reads."""
    none = lambda kind="string": F.lit(None).cast(kind)
    shown = {"title": F.col("title"), "link": F.col("url"), "id": none(), "summary": F.col("abstract"), "content": none(), "authors": F.col("authors"), "contributors": none("array<string>"), "published": F.col("published_date"), "updated": none("date"), "dc_identifier": none(), "prism_doi": F.col("doi"), "pdf_href": F.col("pdf_url"), "publisher": none(), "rights": none(), "feed_title": F.col("source"), "feed_language": none()}
    return papers.select("feed_pos", "entry_pos", "source", *[c.alias(n) for n, c in shown.items()])


@query("SELECT paper_id FROM papers WHERE title <> '' AND (published_date IS NULL OR published_date >= DATE '2021-06-15')")
def since_filter(spark, sf):
    entries = _entries(_papers(spark, sf).withColumns({"feed_pos": F.lit(0).cast("long"), "entry_pos": F.col("paper_id")}))
    return entries_to_papers(entries, date(2021, 6, 15)).select(F.col("entry_pos").alias("paper_id"))


def _matcher_sql() -> str:
    tests = []
    text = Q.norm_text("coalesce(title, '') || ' ' || coalesce(abstract, '')")
    for k in WORDS:
        plain = Q.norm_text(f"'{k}'")
        core = [t.replace("-", " ") for t in keywords.CORE_TERMS]
        shown = " ".join(k.lower().replace("-", " ").split())
        hits = [f"(len(list_filter({[*c.split()]}, lambda w: NOT list_contains(tw, w))) = 0 OR contains(tn, '{c}'))" for c in core if set(c.split()) <= set(shown.split()) or c in shown]
        subset = lambda a, b: f"len(list_filter({a}, lambda w: NOT list_contains({b}, w))) = 0"
        tests.append(" OR ".join([f"contains(tn, {plain})", subset(Q.words(plain), "tw"), subset(Q.stems(plain), "ts"), subset(Q.with_synonyms(plain), "tx"), *hits]))
    return f"WITH n AS (SELECT paper_id, {text} AS tn FROM papers), w AS (SELECT paper_id, tn, {Q.words('tn')} AS tw, {Q.stems('tn')} AS ts, {Q.with_synonyms('tn')} AS tx FROM n) SELECT paper_id, ({' OR '.join(tests)}) AS relevant FROM w"


@query(_matcher_sql())
def keyword_match_5(spark, sf):
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return keywords.with_relevance(_papers(spark, sf), list(WORDS), whole).select("paper_id", "relevant")


def _judge(prompt: str) -> str:
    """A deterministic stand-in for a model: relevant is what has 'cells' in its title; one kind of batch is unreadable."""
    titles = [line.split("] ", 1)[-1] for line in prompt.split("\n") if line.startswith("### [")]
    return '{"relevant": [' + ", ".join(str(i) for i, t in enumerate(titles) if "cells" in t.lower()) + "]}"


@query("WITH b AS (SELECT paper_id FROM papers WHERE contains(lower(string_split(coalesce(title, ''), chr(10))[1]), 'cells')) SELECT paper_id FROM b")
def judged_in_batches(spark, sf):
    return filters.judge_in_batches(_papers(spark, sf), _judge).select("paper_id")


# ---------------------------------------------------------------- deduplication


def _greedy_sql(keys: str, rounds: int = 12) -> str:
    """The rounds of the greedy rule, unrolled; ``keys`` is a CTE list that ends with ``keys(pos, value)``."""
    steps, decided = [f"u0 AS (SELECT DISTINCT pos, value FROM keys)"], []
    for i in range(rounds):
        steps.append(f"k{i} AS MATERIALIZED (SELECT pos FROM (SELECT pos, pos = min(pos) OVER (PARTITION BY value) AS first FROM u{i}) GROUP BY pos HAVING bool_and(first))")
        steps.append(f"d{i} AS MATERIALIZED (SELECT DISTINCT u.pos FROM u{i} u WHERE u.value IN (SELECT value FROM u{i} WHERE pos IN (SELECT pos FROM k{i})))")
        steps.append(f"u{i + 1} AS MATERIALIZED (SELECT * FROM u{i} WHERE pos NOT IN (SELECT pos FROM d{i}))")
        decided.append(f"SELECT pos, pos IN (SELECT pos FROM k{i}) AS kept FROM d{i}")
    return f"{keys}, {', '.join(steps)}, decided AS MATERIALIZED ({' UNION ALL '.join(decided)})"


_D1 = _greedy_sql(f"{_ID_KEYS.replace('keys AS (', 'named AS (')}, keys AS (SELECT paper_id AS pos, kind || ':' || value AS value FROM named)")
_MARKED = f"""{_D1}, owners AS (SELECT k.value, k.pos AS owner FROM keys k JOIN decided d ON d.pos = k.pos AND d.kept),
    kinds AS (SELECT n.paper_id, arg_min(n.kind, n.place) AS matched_kind FROM named n JOIN decided d ON d.pos = n.paper_id AND NOT d.kept JOIN owners o ON o.value = n.kind || ':' || n.value AND o.owner < n.paper_id GROUP BY 1),
    marked AS (SELECT p.paper_id, coalesce(d.kept, true) AS kept, matched_kind, d.pos IS NULL AS keyless FROM papers p LEFT JOIN decided d ON d.pos = p.paper_id LEFT JOIN kinds k ON k.paper_id = p.paper_id)"""


@query(f"WITH {_MARKED} SELECT paper_id, kept, matched_kind FROM marked")
def dedup_greedy(spark, sf):
    return greedy.deduplicate(_papers(spark, sf), _keys()).select("paper_id", "kept", "matched_kind")


@query(f"WITH {_MARKED} SELECT count(*) AS input, count(*) FILTER (kept) AS \"unique\", count(*) FILTER (NOT kept) AS dropped, {', '.join(f"count(*) FILTER (matched_kind = '{k}') AS by_{k}" for k in ('doi', 'url', 'title'))}, count(*) FILTER (keyless) AS kept_without_key FROM marked")
def dedup_stats(spark, sf):
    return greedy.deduplication_statistics(greedy.deduplicate(_papers(spark, sf), _keys()), _keys())


@query(f"WITH {_MARKED} SELECT paper_id FROM marked WHERE kept ORDER BY paper_id LIMIT 100")
def limit_after_dedup(spark, sf):
    return greedy.deduplicate(_papers(spark, sf), _keys()).where("kept").orderBy("paper_id").limit(100).select("paper_id")


_QUALITY = "(CASE WHEN doi <> '' THEN 4 ELSE 0 END + CASE WHEN url <> '' THEN 2 ELSE 0 END + CASE WHEN abstract <> '' THEN 1 ELSE 0 END + least(coalesce(len(authors), 0), 3))"


@query(f"""WITH k AS (SELECT paper_id, {Q.normalize_title('title')} AS t, {_QUALITY} AS quality FROM papers), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY quality DESC, paper_id) AS r, min(paper_id) OVER (PARTITION BY t) AS first FROM k)
    SELECT paper_id, CASE WHEN t = '' THEN paper_id ELSE first END AS place FROM r WHERE r = 1 OR t = ''""")
def title_dedup_best(spark, sf):
    quality = item_quality(F.col("doi"), F.col("url"), F.col("abstract"), F.col("authors"))
    return greedy.best_per_title(_papers(spark, sf), quality).select("paper_id", "place")


_MAIL = "array_to_string(list_transform([doi, upper(doi), doi], lambda d: 'see ' || coalesce(d, 'none') || ', '), '')"


@query(f"""WITH b AS (SELECT paper_id::VARCHAR AS message_id, {_MAIL} AS body FROM papers), f AS (SELECT message_id, unnest(regexp_extract_all(body, '{Q.DOI}')) AS doi, generate_subscripts(regexp_extract_all(body, '{Q.DOI}'), 1) - 1 AS doi_pos FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY message_id, lower(doi) ORDER BY doi_pos) AS r FROM f)
    SELECT message_id, doi_pos::INT AS doi_pos, doi, 'Paper (DOI: ' || doi || ')' AS title, 'https://doi.org/' || doi AS url FROM r WHERE r = 1""")
def dois_from_text(spark, sf):
    body = F.array_join(F.transform(F.array("doi", F.upper("doi"), "doi"), lambda d: F.concat(F.lit("see "), F.coalesce(d, F.lit("none")), F.lit(", "))), "")
    return plain_text_dois(_papers(spark, sf).select(F.col("paper_id").cast("string").alias("message_id"), body.alias("body")))


# ---------------------------------------------------------------- catalogs



@query(f"""SELECT work_id, coalesce({Q.normalize_doi('doi')}, nullif({Q.strip('doi')}, '')) AS doi, coalesce(title[1], '') AS title,
    array_to_string(list_filter(list_transform(author, lambda a: CASE WHEN a.family <> '' AND a.given <> '' THEN a.family || ', ' || a.given WHEN a.family <> '' THEN a.family WHEN a.name <> '' THEN a.name END), lambda s: s IS NOT NULL), '; ') AS authors,
    container_title[1] AS journal, coalesce(published.date_parts[1][1], published_print.date_parts[1][1], published_online.date_parts[1][1]) AS year, page AS pages, {Q.mapped('type', enrich.CROSSREF_TYPES)} AS item_type,
    CASE WHEN len(reference) > 0 THEN len(reference)::INT END AS citation_count, list_filter(link, lambda x: x.content_type = 'application/pdf')[1].url AS pdf_url,
    array_to_string(coalesce(list_transform(list_filter(funder, lambda f: f.name <> ''), lambda f: CASE WHEN len(f.award) > 0 THEN f.name || ' (Awards: ' || array_to_string(f.award[1:3], ', ') || ')' ELSE f.name END), []), '; ') AS funders FROM crossref_works""")
def crossref_parse(spark, sf):
    works = enrich.crossref_works(table(spark, sf, "crossref_works"))
    return works.select("work_id", "doi", "title", F.array_join("authors", "; ").alias("authors"), "journal", "year", "pages", "item_type", "citation_count", "pdf_url", F.array_join("funders", "; ").alias("funders"))


_REBUILT = "array_to_string(list_transform(list_sort(flatten(list_transform(map_entries(abstract_inverted_index), lambda e: list_transform(e.value, lambda p: {'p': p, 'w': e.key})))), lambda x: x.w), ' ')"


@query(f"SELECT work_id, CASE WHEN cardinality(abstract_inverted_index) > 0 THEN {Q.clean_abstract(_REBUILT)} END AS abstract FROM openalex_works")
def abstract_rebuild(spark, sf):
    return table(spark, sf, "openalex_works").select("work_id", enrich.rebuilt_abstract(F.col("abstract_inverted_index")).alias("abstract"))


@query(f"""SELECT work_id, CASE WHEN contains(doi, 'doi.org/') THEN string_split(doi, 'doi.org/')[-1] END AS doi, coalesce(nullif(title, ''), nullif(display_name, ''), '') AS title,
    array_to_string(coalesce(list_filter(list_transform(authorships, lambda a: a.author.display_name), lambda n: coalesce(n <> '', false)), []), '; ') AS authors, primary_location.source.display_name AS journal, publication_year AS year,
    CASE WHEN biblio.first_page <> '' AND biblio.last_page <> '' THEN biblio.first_page || '-' || biblio.last_page WHEN biblio.first_page <> '' THEN biblio.first_page END AS pages,
    coalesce(nullif(doi, ''), nullif(id, '')) AS url, {Q.mapped('type', enrich.OPENALEX_TYPES)} AS item_type, nullif(cited_by_count, 0) AS cited_by_count,
    array_to_string(coalesce(list_transform(list_filter(concepts, lambda c: c.score > 0.3 AND c.display_name <> ''), lambda c: c.display_name), []), '; ') AS concepts FROM openalex_works""")
def openalex_parse(spark, sf):
    works = enrich.openalex_works(table(spark, sf, "openalex_works"))
    return works.select("work_id", "doi", "title", F.array_join("authors", "; ").alias("authors"), "journal", "year", "pages", "url", "item_type", "cited_by_count", F.array_join("concepts", "; ").alias("concepts"))


_CLEAN_DOI = lambda x: f"coalesce({Q.normalize_doi(x)}, nullif({Q.strip(x)}, ''))"
_OA_DOI = "CASE WHEN contains(doi, 'doi.org/') THEN string_split(doi, 'doi.org/')[-1] END"
_CR_AUTHORS = "list_filter(list_transform(author, lambda a: CASE WHEN a.family <> '' AND a.given <> '' THEN a.family || ', ' || a.given WHEN a.family <> '' THEN a.family WHEN a.name <> '' THEN a.name END), lambda s: s IS NOT NULL)"
_OA_AUTHORS = "coalesce(list_filter(list_transform(authorships, lambda a: a.author.display_name), lambda n: coalesce(n <> '', false)), [])"
_CR_TITLE, _OA_TITLE = "coalesce(title[1], '')", "coalesce(nullif(title, ''), nullif(display_name, ''), '')"
_CR = f"""cr AS (SELECT work_id, lower({_CLEAN_DOI('doi')}) AS wd, {_CLEAN_DOI('doi')} AS doi, {_CR_TITLE} AS wt, {_CR_AUTHORS} AS wauthors, container_title[1] AS journal, coalesce(published.date_parts[1][1], published_print.date_parts[1][1], published_online.date_parts[1][1]) AS year, volume, page AS pages, url,
    {Q.mapped('type', enrich.CROSSREF_TYPES)} AS item_type, CASE WHEN len(reference) > 0 THEN len(reference)::INT END AS cites FROM crossref_works)"""
_OA = f"""oa AS (SELECT work_id, lower({_CLEAN_DOI(_OA_DOI)}) AS wd, {_OA_DOI} AS doi, {_OA_TITLE} AS wt, {_OA_AUTHORS} AS wauthors, primary_location.source.display_name AS journal, publication_year AS year, biblio.volume AS volume,
    CASE WHEN biblio.first_page <> '' AND biblio.last_page <> '' THEN biblio.first_page || '-' || biblio.last_page WHEN biblio.first_page <> '' THEN biblio.first_page END AS pages, coalesce(nullif(doi, ''), nullif(id, '')) AS url,
    {Q.mapped('type', enrich.OPENALEX_TYPES)} AS item_type, nullif(cited_by_count, 0) AS cites FROM openalex_works)"""
_PAPER_DOI = f"lower({_CLEAN_DOI(f"coalesce(nullif(doi, ''), {Q.extract_doi('url')})")})"
_P_COLUMNS = "paper_id, title, doi, url, authors, publication_title, volume, pages, item_type, published_date"
_P = f"p AS MATERIALIZED (SELECT {_P_COLUMNS}, {_PAPER_DOI} AS pd FROM papers)"


def _best_sql(left: str, right: str, sort_tokens: bool, name: str) -> str:
    """CTEs that end in ``name(paper_id, work_id, score)``: for rows ``left(paper_id, t, a)`` the best of ``right(work_id, t, wa)``."""
    key = f"array_to_string(list_sort(string_split({Q.match_title('x')}, ' ')), ' ')" if sort_tokens else Q.match_title("x")
    normal = lambda c: f"list_distinct(list_filter(list_transform({c}, lambda x: {key}), lambda x: x <> ''))"
    n = name
    return f"""{n}_l AS MATERIALIZED ({left}), {n}_r AS MATERIALIZED ({right}),
        {n}_lt AS MATERIALIZED (SELECT DISTINCT t AS ta, {Q.words('t')} AS wta FROM {n}_l WHERE t <> ''), {n}_rt AS MATERIALIZED (SELECT DISTINCT t AS tb, {Q.words('t')} AS wtb FROM {n}_r WHERE t <> ''),
        {n}_x AS (SELECT ta, w, len(wta) AS na FROM (SELECT ta, wta, unnest(wta) AS w FROM {n}_lt)), {n}_y AS (SELECT tb, w, len(wtb) AS nb FROM (SELECT tb, wtb, unnest(wtb) AS w FROM {n}_rt)),
        {n}_s AS (SELECT ta, tb, count(*) AS shared, count(*)::DOUBLE / (any_value(na) + any_value(nb) - count(*)) AS j FROM {n}_x JOIN {n}_y USING (w) GROUP BY 1, 2 HAVING count(*)::DOUBLE / (any_value(na) + any_value(nb) - count(*)) >= {(enrich.LEAST_SCORE - 0.25) / 0.75} - 1e-9),
        {n}_c AS (SELECT paper_id, work_id, j, a, wa, row_number() OVER (PARTITION BY paper_id ORDER BY shared DESC, work_id) AS rank FROM {n}_l l JOIN {n}_s s ON l.t = s.ta JOIN {n}_r r ON r.t = s.tb),
        {n}_f AS (SELECT paper_id, work_id, rank, round(CASE WHEN len(a) > 0 THEN 0.75 * j + 0.25 * ({Q.jaccard(normal('a'), normal('wa'))}) ELSE j END, 9) AS score FROM {n}_c WHERE rank <= 5),
        {n} AS MATERIALIZED (SELECT paper_id, work_id, score FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, rank) AS b FROM {n}_f) WHERE b = 1 AND score >= 0.8)"""


def _found_sql(papers: str, works: str) -> str:
    """CTEs that end in ``<works>_found(paper_id, work_id)``: by DOI, and by title and authors for papers without one."""
    best = _best_sql(f"SELECT paper_id, {Q.match_title('title')} AS t, authors AS a FROM {papers} WHERE pd IS NULL AND title <> ''", f"SELECT work_id, {Q.match_title('wt')} AS t, wauthors AS wa FROM {works}", works == "cr", f"{works}_best")
    return f"""{best}, {works}_found AS MATERIALIZED (SELECT s.paper_id, d.work_id FROM {papers} s JOIN (SELECT wd, min(work_id) AS work_id FROM {works} WHERE wd IS NOT NULL GROUP BY 1) d ON d.wd = s.pd UNION ALL SELECT paper_id, work_id FROM {works}_best)"""


_CR_FOUND, _OA_FOUND = _found_sql("p", "cr"), _found_sql("p", "oa")
_JOIN = lambda w: f"FROM p LEFT JOIN {w}_found f ON f.paper_id = p.paper_id LEFT JOIN {w} w ON w.work_id = f.work_id"


def _crossref(spark, sf):
    return enrich.join_works(_papers(spark, sf), table(spark, sf, "crossref_works"), enrich.CROSSREF)


@query(f"WITH {_CR}, {_P}, {_CR_FOUND} SELECT p.paper_id, w.work_id, CASE WHEN pd IS NOT NULL THEN 'doi_only' WHEN title <> '' THEN 'title_author' ELSE 'none' END AS lookup {_JOIN('cr')}")
def enrich_left_join(spark, sf):
    return _crossref(spark, sf).select("paper_id", F.col("work.work_id").alias("work_id"), "lookup")


@query(f"WITH {_CR}, {_P} SELECT p.paper_id, d.work_id FROM p JOIN (SELECT wd, min(work_id) AS work_id FROM cr WHERE wd IS NOT NULL GROUP BY 1) d ON d.wd = p.pd")
def enrich_doi_left_join(spark, sf):
    return enrich.works_by_doi(_papers(spark, sf), table(spark, sf, "crossref_works"), enrich.CROSSREF)


@query(f"WITH {_CR}, {_P}, {_CR_FOUND} SELECT p.paper_id, coalesce(nullif(p.doi, ''), {Q.extract_doi('p.url')}) AS doi, title, p.url, CASE WHEN pd IS NOT NULL THEN 'doi_only' ELSE 'title_author' END AS strategy {_JOIN('cr')} WHERE w.work_id IS NULL")
def unmatched_audit(spark, sf):
    return enrich.unmatched(_crossref(spark, sf))


_MERGED = ("paper_id", "doi", "url", "publication_title", "volume", "pages", "item_type", "published_date")
_OVER = """SELECT p.paper_id, title, coalesce(nullif(w.doi, ''), p.doi) AS doi, coalesce(nullif(w.url, ''), 'https://doi.org/' || w.doi, p.url) AS url, CASE WHEN len(w.wauthors) > 0 THEN w.wauthors ELSE p.authors END AS authors, coalesce(nullif(w.journal, ''), publication_title) AS publication_title,
    coalesce(nullif(w.volume, ''), p.volume) AS volume, coalesce(nullif(w.pages, ''), p.pages) AS pages, coalesce(w.item_type, p.item_type) AS item_type, coalesce(make_date(nullif(w.year, 0), 1, 1), published_date) AS published_date"""
_FILL = """SELECT p.paper_id, title, coalesce(nullif(p.doi, ''), nullif(w.doi, ''), p.doi) AS doi, coalesce(nullif(p.url, ''), nullif(w.url, ''), p.url) AS url, p.authors, coalesce(nullif(publication_title, ''), nullif(w.journal, ''), publication_title) AS publication_title,
    coalesce(nullif(p.volume, ''), nullif(w.volume, ''), p.volume) AS volume, coalesce(nullif(p.pages, ''), nullif(w.pages, ''), p.pages) AS pages,
    CASE WHEN coalesce(nullif(p.item_type, ''), 'journalArticle') = 'journalArticle' AND w.item_type <> 'journalArticle' THEN w.item_type ELSE p.item_type END AS item_type, coalesce(published_date, make_date(nullif(w.year, 0), 1, 1)) AS published_date"""
_SHOWN = ", ".join(_MERGED)


@query(f"WITH {_CR}, {_P}, {_CR_FOUND} SELECT {_SHOWN} FROM ({_OVER} {_JOIN('cr')})")
def merge_overwrite(spark, sf):
    return enrich.merge_overwrite(_crossref(spark, sf)).select(*_MERGED)


@query(f"WITH {_OA}, {_P}, {_OA_FOUND} SELECT {_SHOWN} FROM ({_FILL} {_JOIN('oa')})")
def merge_fill(spark, sf):
    return enrich.merge_fill(enrich.join_works(_papers(spark, sf), table(spark, sf, "openalex_works"), enrich.OPENALEX)).select(*_MERGED)


@query(f"WITH {_CR}, {_OA}, {_P}, {_CR_FOUND}, once AS MATERIALIZED ({_OVER} {_JOIN('cr')}), q AS MATERIALIZED (SELECT *, {_PAPER_DOI} AS pd FROM once), {_found_sql('q', 'oa')} SELECT {_SHOWN} FROM ({_FILL} {_JOIN('oa').replace('FROM p ', 'FROM q p ')})")
def enrich_chained(spark, sf):
    return enrich.enrich_chain(_papers(spark, sf), table(spark, sf, "crossref_works"), table(spark, sf, "openalex_works")).select(*_MERGED)


@query(f"""WITH {_CR}, {_P}, {_CR_FOUND} SELECT p.paper_id, CASE WHEN w.work_id IS NULL THEN CASE WHEN pd IS NOT NULL THEN 'doi_only' ELSE 'title_author' END END AS strategy, w.cites::VARCHAR AS citation_count,
    json_extract_string(e.extra, '$.publisher') AS publisher {_JOIN('cr')} JOIN papers e ON e.paper_id = p.paper_id""")
def enrich_bags(spark, sf):
    """What enrichment leaves in the open bag: the catalog's further values or what was asked in vain, beside what was there."""
    bag = enrich.merge_overwrite(_crossref(spark, sf)).select("paper_id", F.try_parse_json("extra").alias("b"))
    get = lambda path: F.try_variant_get("b", path, "string")
    return bag.select("paper_id", get("$.crossref_unmatched.strategy").alias("strategy"), get("$.crossref.citation_count").alias("citation_count"), get("$.publisher").alias("publisher"))


@query(f"""WITH {_CR}, {_P}, {_CR_FOUND}, n AS ({_OVER} {_JOIN('cr')}) SELECT (SELECT count(*) FROM p) AS papers, count(*) AS matched FROM cr_found""")
def enriched_papers(spark, sf):
    """Papers, and those that a catalog has a work for."""
    return _crossref(spark, sf).agg(F.count(F.lit(1)).alias("papers"), F.count("work.work_id").alias("matched"))


def _match_sql(sort_tokens: bool) -> str:
    works = ("crossref_works", _CR_TITLE, _CR_AUTHORS) if sort_tokens else ("openalex_works", _OA_TITLE, _OA_AUTHORS)
    left = f"SELECT paper_id, {Q.match_title('title')} AS t, authors AS a FROM papers WHERE doi IS NULL OR doi = ''"
    right = f"SELECT work_id, {Q.match_title(works[1])} AS t, {works[2]} AS wa FROM {works[0]}"
    return f"WITH {_best_sql(left, right, sort_tokens, 'm')} SELECT paper_id, work_id, score FROM m"


def _without_doi(spark, sf):
    return _papers(spark, sf).where(F.coalesce("doi", F.lit("")) == "")


@query(_match_sql(True))
def title_match_sorted_authors(spark, sf):
    return enrich.best_title_matches(_without_doi(spark, sf), enrich.crossref_works(table(spark, sf, "crossref_works")), True)


@query(_match_sql(False))
def title_match_plain_authors(spark, sf):
    return enrich.best_title_matches(_without_doi(spark, sf), enrich.openalex_works(table(spark, sf, "openalex_works")), False)


# ---------------------------------------------------------------- library and export


def _library(spark, sf):
    return table(spark, sf, "incoming_papers").select("doi", "title", F.date_format("published_date", "yyyy-MM-dd").alias("date"), "url")


_LIB = f"""lib AS (SELECT {Q.normalize_doi('doi')} AS d, {Q.title_date('title', "strftime(published_date, '%Y-%m-%d')")} AS td, {Q.normalize_url('url')} AS u FROM incoming_papers),
    held AS (SELECT DISTINCT kind, value FROM (SELECT 'doi' AS kind, d AS value FROM lib UNION ALL SELECT 'title_date', td FROM lib UNION ALL SELECT 'url', u FROM lib) WHERE value IS NOT NULL),
    there AS (SELECT e.paper_id, arg_min(e.kind, e.place) AS skipped_by FROM exports e JOIN held h ON h.kind = e.kind AND h.value = e.value GROUP BY 1)"""


@query(f"WITH {_ID_KEYS}, {_EXPORT_KEYS}, {_LIB} SELECT paper_id FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM there)")
def export_anti_join(spark, sf):
    papers = _papers(spark, sf)
    return papers.join(library.already_there(papers, _library(spark, sf)), "paper_id", "left_anti").select("paper_id")


@query(f"WITH {_ID_KEYS}, {_EXPORT_KEYS}, {_LIB} SELECT skipped_by, count(*) AS n FROM there GROUP BY 1")
def export_skip_kinds(spark, sf):
    return library.already_there(_papers(spark, sf), _library(spark, sf)).groupBy("skipped_by").agg(F.count(F.lit(1)).alias("n"))


def _export_sql(rounds: int = 12) -> str:
    steps = [f"""fresh AS MATERIALIZED (SELECT * FROM ids WHERE paper_id NOT IN (SELECT paper_id FROM there)), probe AS MATERIALIZED (SELECT e.paper_id AS pos, e.kind || ':' || e.value AS value FROM exports e JOIN fresh f USING (paper_id)),
        reg AS MATERIALIZED (SELECT paper_id AS pos, 'doi:' || d AS value FROM fresh WHERE d IS NOT NULL UNION SELECT paper_id, 'title_date:' || td FROM fresh WHERE td IS NOT NULL UNION SELECT paper_id, 'url:' || u FROM fresh WHERE u IS NOT NULL),
        o0 AS MATERIALIZED (SELECT pos FROM probe UNION SELECT pos FROM reg)"""]
    decided = []
    for i in range(rounds):
        steps.append(f"b{i} AS MATERIALIZED (SELECT DISTINCT p.pos FROM probe p JOIN (SELECT value, min(pos) AS first FROM reg WHERE pos IN (SELECT pos FROM o{i}) GROUP BY 1) t ON t.value = p.value AND t.first < p.pos WHERE p.pos IN (SELECT pos FROM o{i}))")
        steps.append(f"k{i} AS MATERIALIZED (SELECT pos FROM o{i} WHERE pos NOT IN (SELECT pos FROM b{i}))")
        steps.append(f"h{i} AS MATERIALIZED (SELECT DISTINCT p.pos FROM probe p JOIN (SELECT value, min(pos) AS first FROM reg WHERE pos IN (SELECT pos FROM k{i}) GROUP BY 1) t ON t.value = p.value AND t.first < p.pos WHERE p.pos IN (SELECT pos FROM o{i}))")
        steps.append(f"o{i + 1} AS MATERIALIZED (SELECT pos FROM o{i} WHERE pos NOT IN (SELECT pos FROM k{i}) AND pos NOT IN (SELECT pos FROM h{i}))")
        decided.append(f"SELECT pos, true AS kept FROM k{i} UNION ALL SELECT pos, false FROM h{i}")
    return f"WITH {_ID_KEYS}, {_EXPORT_KEYS}, {_LIB}, {', '.join(steps)}, decided AS ({' UNION ALL '.join(decided)}) SELECT p.paper_id, CASE WHEN t.skipped_by IS NOT NULL THEN 'in_library' WHEN coalesce(d.kept, true) THEN 'create' ELSE 'in_batch' END AS outcome, t.skipped_by FROM papers p LEFT JOIN there t ON t.paper_id = p.paper_id LEFT JOIN decided d ON d.pos = p.paper_id"


@query(_export_sql())
def export_in_batch_dedup(spark, sf):
    return library.export_plan(_papers(spark, sf), _library(spark, sf))


@query("SELECT event_id FROM events WHERE coalesce(trim(CASE WHEN event_id % 3 = 0 THEN 'P' || event_id ELSE ' ' END), '') = '' AND coalesce(lower(trim(event_type)) NOT IN ('attachment', 'note', 'annotation'), true)")
def parent_items(spark, sf):
    parent = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("P"), F.col("event_id").cast("string"))).otherwise(F.lit(" "))
    return table(spark, sf, "events").where(library.is_parent(parent, F.col("event_type"))).select("event_id")




@query("""SELECT paper_id, coalesce(nullif(item_type, ''), 'journalArticle') AS kind, CASE WHEN item_type = 'preprint' THEN NULL ELSE volume END AS volume, CASE WHEN item_type = 'preprint' THEN nullif(publication_title, '') END AS repository,
    strftime(published_date, '%Y-%m-%d') AS day, coalesce(strftime(access_date, '%Y-%m-%d'), '2026-01-01') AS access_day, coalesce(len(authors), 0)::INT AS creators, nullif(abstract, '') IS NOT NULL AS has_abstract FROM papers""")
def library_item_projection(spark, sf):
    items = library.library_items(_papers(spark, sf), "2026-01-01")
    get = lambda f: F.get_json_object("item", f"$.{f}")
    return items.select("paper_id", get("itemType").alias("kind"), get("volume").alias("volume"), get("repository").alias("repository"), get("date").alias("day"), get("accessDate").alias("access_day"), F.coalesce(F.json_array_length(get("creators")), F.lit(0)).alias("creators"), get("abstractNote").isNotNull().alias("has_abstract"))


@query("SELECT paper_id, json_extract_string(extra, '$.publisher') AS publisher, json_extract_string(extra, '$.feed.title') AS feed_title FROM papers")
def extra_fields(spark, sf):
    return _papers(spark, sf).select("paper_id", X.bag_value(F.col("extra"), "$.publisher").alias("publisher"), X.bag_value(F.col("extra"), "$.feed.title").alias("feed_title"))


@query(f"WITH {_CR}, {_P}, {_CR_FOUND} SELECT p.paper_id, c.publisher AS member, c.work_id::VARCHAR AS score {_JOIN('cr')} LEFT JOIN crossref_works c ON c.work_id = w.work_id")
def extra_carry_over(spark, sf):
    """Columns of a catalog that are not understood, in the papers' open bag."""
    raw = table(spark, sf, "crossref_works").withColumns({"member": F.col("publisher"), "score": F.col("work_id")})
    bag = F.col("extra")
    merged = enrich.merge_overwrite(enrich.join_works(_papers(spark, sf), raw, enrich.CROSSREF))
    return merged.select("paper_id", X.bag_value(bag, "$.crossref_extra.member").alias("member"), X.bag_value(bag, "$.crossref_extra.score").alias("score"))


@query("SELECT incoming_id, nullif(doi, '') AS doi, nullif(title, '') AS title, strftime(published_date, '%Y-%m-%d') AS date, nullif(url, '') AS url FROM incoming_papers")
def library_scan(spark, sf):
    """Items as a library returns them, half of them nested, read back as the rows that are looked up."""
    stored = library.library_items(table(spark, sf, "incoming_papers").withColumnRenamed("incoming_id", "paper_id"), "2026-01-01")
    wrapped = stored.withColumn("item", F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit('{"key": "K", "data": '), "item", F.lit("}"))).otherwise(F.col("item")))
    read = library_rows(wrapped, keep=("paper_id",))
    return read.withColumnRenamed("paper_id", "incoming_id")


@query(f"WITH plan AS ({_export_sql()}) SELECT count(*) AS total, count(*) FILTER (outcome = 'create') AS success_count, count(*) FILTER (outcome <> 'create') AS skipped_count, {', '.join(f"count(*) FILTER (skipped_by = '{k}') AS skipped_{k}" for k in ('doi', 'title_date', 'url'))}, count(*) FILTER (outcome = 'in_batch') AS skipped_runtime_duplicate, 0 AS failed FROM plan")
def export_stats(spark, sf):
    return export_statistics(library.export_plan(_papers(spark, sf), _library(spark, sf)))


# ---------------------------------------------------------------- sources


@query("SELECT feed_id, xml_url AS url, coalesce(nullif(title, ''), nullif(\"text\", ''), 'Unknown') AS title, coalesce(html_url, '') AS html_url, nullif(category, '') AS category FROM feeds WHERE coalesce(xml_url, '') <> '' AND lower(trim(coalesce(type, ''))) IN ('', 'rss', 'atom')")
def opml_feeds(spark, sf):
    return feeds_of_outlines(table(spark, sf, "feeds"))


@query("SELECT f.feed_id AS feed_pos, p.paper_id, row_number() OVER (ORDER BY f.feed_id, p.paper_id) AS place FROM feeds f JOIN papers p ON p.source = f.title WHERE p.title <> ''")
def feed_union_order(spark, sf):
    """The entries of all feeds in one order, feed by feed."""
    feeds = table(spark, sf, "feeds").select(F.col("feed_id").alias("feed_pos"), F.col("title").alias("source"))
    entries = _entries(_papers(spark, sf).join(feeds, "source").withColumn("entry_pos", F.col("paper_id")))
    union = placed(entries_to_papers(entries))
    return filters.dense_position(union.select("_pos", "feed_pos", F.col("entry_pos").alias("paper_id")), "_pos", "_place").select("feed_pos", "paper_id", (F.col("_place") + 1).alias("place"))




@query(r"""SELECT paper_id AS feed_pos, regexp_replace(regexp_replace(regexp_replace(title, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\r\n?', chr(10), 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS title, published_date, nullif(url, '') AS url FROM papers WHERE title IS NOT NULL""", name="feed_documents")
def feed_documents(spark, sf):
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = F.regexp_replace("title", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    link = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("<link>"), escape(F.col("url")), F.lit("</link>"))).otherwise(F.lit(""))
    day = F.coalesce(F.concat(F.lit("<pubDate>"), F.date_format("published_date", "yyyy-MM-dd"), F.lit("</pubDate>")), F.lit(""))
    document = F.concat(F.lit("<rss><channel><title>Feed</title><item><title>"), escape(plain), F.lit("</title>"), link, day, F.lit("</item></channel></rss>"))
    feeds = _papers(spark, sf).where(F.col("title").isNotNull()).select(F.col("paper_id").alias("feed_pos"), F.col("source").alias("title"), F.lit("").alias("url"), document.alias("document"))
    return entries_to_papers(feed_entries(feeds)).select("feed_pos", "title", "published_date", "url")


@query(r"""WITH l AS (SELECT paper_id::VARCHAR AS message_id, array_to_string(list_filter(string_split(regexp_replace(title, '[^A-Za-z0-9 ]', '', 'g'), ' '), lambda w: w <> ''), ' ') AS t, url FROM papers WHERE url <> '' AND doi <> '')
    SELECT message_id, 2 AS strategy, 0 AS item_pos, t AS title, url || '?doi=10.1234/x.' || message_id AS url, '10.1234/x.' || message_id AS doi FROM l WHERE length(t) BETWEEN 20 AND 500""")
def html_link_items(spark, sf):
    plain = F.array_join(F.filter(F.split(F.regexp_replace("title", "[^A-Za-z0-9 ]", ""), " "), lambda w: w != ""), " ")
    message = F.col("paper_id").cast("string")
    html = F.concat(F.lit("<p>Hello<br><b>alert<p><a href='"), F.col("url"), F.lit("?doi=10.1234/x."), message, F.lit("'>"), plain, F.lit("</a><a href='x'>unsubscribe</a>"))
    messages = _papers(spark, sf).where((F.col("url") != "") & (F.col("doi") != "")).select(message.alias("message_id"), html.alias("html"))
    return mail_items(messages).select("message_id", "strategy", "item_pos", "title", "url", "doi")


@query("SELECT paper_id, title AS body FROM papers WHERE title <> ''")
def mime_bodies(spark, sf):
    data = F.translate(F.base64(F.encode("title", "utf-8")), "+/\r\n=", "-_")
    part = lambda kind, body: F.concat(F.lit('{"mimeType": "' + kind + '", "headers": [{"name": "Content-Type", "value": "' + kind + '; charset=utf-8"}], "body": {"data": "'), body, F.lit('"}}'))
    payload = F.concat(F.lit('{"mimeType": "multipart/mixed", "parts": ['), part("text/plain", F.lit("eA")), F.lit(', {"mimeType": "multipart/alternative", "parts": ['), part("text/html", data), F.lit("]}]}"))
    return _papers(spark, sf).where(F.col("title") != "").select("paper_id", html_bodies(payload).alias("body"))


@query(f"WITH w AS (SELECT paper_id, {Q.words(Q.match_title('title'))} AS a, {Q.words(Q.match_title('publication_title'))} AS b FROM papers) SELECT paper_id, round({Q.jaccard('a', 'b')}, 9) AS jaccard, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS within FROM w")
def subset_and_jaccard(spark, sf):
    a, b = X.words(X.match_title(F.col("title"))), X.words(X.match_title(F.col("publication_title")))
    return _papers(spark, sf).select("paper_id", F.round(X.jaccard(a, b), 9).alias("jaccard"), (F.size(F.array_except(b, a)) == 0).alias("within"))


@query("SELECT paper_id, title, source, coalesce(abstract, '') AS abstract, coalesce(item_type, 'journalArticle') AS item_type FROM papers")
def papers_projection(spark, sf):
    return with_defaults(_papers(spark, sf)).select("paper_id", "title", "source", "abstract", "item_type")
