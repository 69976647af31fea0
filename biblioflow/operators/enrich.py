"""Catalog records as works, and enrichment of papers: exact DOI joins, best title matches, and merges."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.functions.text import DOI, author_key, blank_to_null, clean_abstract, extract_doi, jaccard, match_title, normalize_doi, strip, words
from biblioflow.session import cut_lineage

#: Item types of the two catalogs (fixed values); anything else is a journal article.
CROSSREF_TYPES = {"journal-article": "journalArticle", "proceedings-article": "conferencePaper", "book-chapter": "bookSection", "book": "book", "report": "report", "dataset": "dataset", "dissertation": "thesis", "posted-content": "preprint"}
OPENALEX_TYPES = {"article": "journalArticle", "book": "book", "book-chapter": "bookSection", "dissertation": "thesis", "proceedings": "conferencePaper", "proceedings-article": "conferencePaper", "report": "report", "dataset": "dataset"}
#: Candidates of a title search, weight of the title in a score, and the least score of a match.
CANDIDATES, TITLE_WEIGHT, LEAST_SCORE = 5, 0.75, 0.8
#: Words of titles that are looked up by two of their words; longer ones by one.
PAIRED_WORDS = 24
#: Buckets of words whose occurrences are counted to put words in order.
WORD_BUCKETS = 1 << 15


def _mapped(c: Column, names: dict[str, str]) -> Column:
    out = F.lit("journalArticle")
    for source, target in names.items():
        out = F.when(c == source, F.lit(target)).otherwise(out)
    return out


def _clean_doi(c: Column) -> Column:
    """The normalized DOI, or the stripped value where there is none in it."""
    return F.coalesce(normalize_doi(c), blank_to_null(strip(c)))


def crossref_authors(author: Column) -> Column:
    """``Family, Given``, a family alone or a group name; people with a given name only are left out."""
    one = lambda a: F.when((a["family"] != "") & (a["given"] != ""), F.concat(a["family"], F.lit(", "), a["given"])).when(a["family"] != "", a["family"]).when(a["name"] != "", a["name"])
    return F.coalesce(F.array_compact(F.transform(author, one)), F.array().cast("array<string>"))


def crossref_works(df: DataFrame) -> DataFrame:
    """Works of the one catalog: first title and journal, authors, year, pages, type, funders, references, PDF link."""
    year = lambda c: F.try_element_at(F.try_element_at(F.col(f"{c}.date_parts"), F.lit(1)), F.lit(1))
    doi = _clean_doi(F.col("doi"))
    awards = lambda f: F.concat(f["name"], F.lit(" (Awards: "), F.array_join(F.slice(f["award"], 1, 3), ", "), F.lit(")"))
    funders = F.transform(F.filter("funder", lambda f: f["name"] != ""), lambda f: F.when(F.size(f["award"]) > 0, awards(f)).otherwise(f["name"]))
    references = F.size("reference")
    return df.select(
        "work_id",
        doi.alias("doi"),
        F.coalesce(F.try_element_at("title", F.lit(1)), F.lit("")).alias("title"),
        crossref_authors(F.col("author")).alias("authors"),
        F.try_element_at("container_title", F.lit(1)).alias("journal"),
        F.coalesce(year("published"), year("published_print"), year("published_online")).alias("year"),
        "volume",
        "issue",
        F.col("page").alias("pages"),
        clean_abstract(F.col("abstract")).alias("abstract"),
        F.coalesce(blank_to_null(F.col("url")), F.concat(F.lit("https://doi.org/"), doi)).alias("url"),
        "publisher",
        _mapped(F.col("type"), CROSSREF_TYPES).alias("item_type"),
        F.coalesce(F.col("subject"), F.array().cast("array<string>")).alias("subjects"),
        F.coalesce(funders, F.array().cast("array<string>")).alias("funders"),
        F.when(references > 0, references).alias("citation_count"),
        F.try_element_at(F.filter("link", lambda x: x["content_type"] == "application/pdf"), F.lit(1))["url"].alias("pdf_url"),
        F.try_element_at("issn", F.lit(1)).alias("issn"),
        "language",
    )


def rebuilt_abstract(index: Column) -> Column:
    """The text of an inverted index: words by position, cleaned; NULL for NULL and empty maps."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(index) > 0, clean_abstract(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")))


def openalex_works(df: DataFrame) -> DataFrame:
    """Works of the other catalog: DOI after the resolver, page range, rebuilt abstract, concepts over 0.3."""
    raw = F.col("doi")
    first, last = F.col("biblio.first_page"), F.col("biblio.last_page")
    return df.select(
        "work_id",
        F.when(raw.contains("doi.org/"), F.substring_index(raw, "doi.org/", -1)).alias("doi"),
        F.coalesce(blank_to_null(F.col("title")), blank_to_null(F.col("display_name")), F.lit("")).alias("title"),
        F.coalesce(F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n != "", F.lit(False))), F.array().cast("array<string>")).alias("authors"),
        F.col("primary_location.source.display_name").alias("journal"),
        F.col("publication_year").alias("year"),
        F.col("biblio.volume").alias("volume"),
        F.col("biblio.issue").alias("issue"),
        F.when((first != "") & (last != ""), F.concat(first, F.lit("-"), last)).when(first != "", first).alias("pages"),
        rebuilt_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.coalesce(blank_to_null(raw), blank_to_null(F.col("id"))).alias("url"),
        F.col("primary_location.source.host_organization_name").alias("publisher"),
        _mapped(F.col("type"), OPENALEX_TYPES).alias("item_type"),
        F.nullif(F.col("cited_by_count"), F.lit(0)).alias("cited_by_count"),
        F.coalesce(F.transform(F.filter("concepts", lambda c: (c["score"] > 0.3) & (c["display_name"] != "")), lambda c: c["display_name"]), F.array().cast("array<string>")).alias("concepts"),
        F.col("primary_location.pdf_url").alias("pdf_url"),
    )


def doi_candidate(df: DataFrame) -> Column:
    """The DOI a paper is looked up by: its own, or one in its URL."""
    return _clean_doi(F.coalesce(blank_to_null(df["doi"]), extract_doi(df["url"])))


def has_doi(df: DataFrame) -> Column:
    """Whether ``doi_candidate`` finds anything, without normalizing it."""
    return F.coalesce(F.when(df["doi"] != "", df["doi"].rlike(r"\S")).otherwise(df["url"].rlike(DOI)), F.lit(False))


@dataclass(frozen=True)
class Catalog:
    """A table of raw works: how it is projected, where its DOI stands, and which of its columns are understood."""

    name: str
    works: Callable[[DataFrame], DataFrame]
    doi: Callable[[], Column]
    sort_author_tokens: bool
    mapped: frozenset[str]


CROSSREF = Catalog(
    "crossref", crossref_works, lambda: F.col("doi"), True,
    frozenset("work_id doi title author authors container_title published published_print published_online volume issue page abstract url publisher type subject funder reference link issn language".split()),
)
OPENALEX = Catalog(
    "openalex", openalex_works, lambda: F.when(F.col("doi").contains("doi.org/"), F.substring_index("doi", "doi.org/", -1)), False,
    frozenset("work_id id doi title display_name authorships authors primary_location publication_year biblio abstract_inverted_index type cited_by_count concepts".split()),
)


def one_per_doi(raw: DataFrame, catalog: Catalog) -> DataFrame:
    """``(_doi, work_id)``: the smallest id for each normalized DOI, one narrow row per key."""
    return raw.select(F.lower(_clean_doi(catalog.doi())).alias("_doi"), "work_id").where(F.col("_doi").isNotNull()).groupBy("_doi").agg(F.min("work_id").alias("work_id"))


def works_by_doi(papers: DataFrame, raw: DataFrame, catalog: Catalog, key: str = "paper_id") -> DataFrame:
    """``(key, work_id)``: the work of a paper's DOI."""
    asked = papers.select(key, F.lower(doi_candidate(papers)).alias("_doi")).where(F.col("_doi").isNotNull())
    return asked.join(one_per_doi(raw, catalog), "_doi").select(key, "work_id")


def find_works(papers: DataFrame, raw: DataFrame, catalog: Catalog, key: str = "paper_id", least: float = LEAST_SCORE) -> DataFrame:
    """``(key, work_id)``: the work of a paper's DOI; for papers without one, the best match of title and authors.

    A DOI that the catalog does not know is no reason to look for the title.
    """
    titled = papers.where(~has_doi(papers) & (F.col("title") != "")).select(key, "title", "authors")
    by_title = best_title_matches(titled, catalog.works(raw).select("work_id", "title", "authors"), catalog.sort_author_tokens, key, least)
    return works_by_doi(papers, raw, catalog, key).unionByName(by_title.select(key, "work_id"))


def join_works(papers: DataFrame, raw: DataFrame, catalog: Catalog, key: str = "paper_id") -> DataFrame:
    """``papers`` with the ``work`` found for them, its fields NULL where there is none, and ``lookup``: how it was asked for.

    Ids are found first, over narrow columns; only works that a paper has are projected, and ``work`` is put together
    after the join, so that fields which nobody reads are neither computed nor moved. ``work_other`` holds
    the columns of the catalog that are not understood, as JSON.
    """
    found = cut_lineage(find_works(papers, raw, catalog, key))  # narrow, and used twice
    needed = raw.join(found.select("work_id").distinct(), "work_id", "left_semi").dropDuplicates(["work_id"])
    projected = catalog.works(needed)
    works = projected.select(*[F.col(c).alias(f"_work_{c}") for c in projected.columns])
    other = [c for c in raw.columns if c not in catalog.mapped]
    if other:
        works = works.join(needed.select(F.col("work_id").alias("_work_work_id"), F.to_json(F.struct(*other)).alias("work_other")), "_work_work_id")
    else:
        works = works.withColumn("work_other", F.lit(None).cast("string"))
    asked = papers.withColumn("lookup", F.when(has_doi(papers), F.lit("doi_only")).when(F.col("title") != "", F.lit("title_author")).otherwise(F.lit("none")))
    joined = asked.join(found.withColumnRenamed("work_id", "_work_work_id"), key, "left").join(works, "_work_work_id", "left")
    return joined.select(*papers.columns, "lookup", "work_other", F.struct(*[F.col(f"_work_{c}").alias(c) for c in projected.columns]).alias("work"))


def best_title_matches(papers: DataFrame, works: DataFrame, sort_author_tokens: bool, key: str = "paper_id", least: float = LEAST_SCORE) -> DataFrame:
    """``(key, work_id, score)``: for each paper the work of highest score among its ``CANDIDATES`` nearest titles.

    Candidates are ranked by shared words, then by id, so a title has the same ones on every row, and a title of
    many works offers those of smallest id. Distinct titles are matched, by ``_similar_titles``, with the
    least title similarity that a score of ``least`` allows; rows meet no more than ``CANDIDATES`` works.
    """
    floor_j = max((least - (1 - TITLE_WEIGHT)) / TITLE_WEIGHT, 1e-6)
    # narrow, and used several times
    left = cut_lineage(papers.select(F.col(key), match_title(F.col("title")).alias("_t"), F.coalesce(F.col("authors"), F.array().cast("array<string>")).alias("_a"))).where(F.col("_t") != "")
    right = cut_lineage(works.select("work_id", match_title(F.col("title")).alias("_t"), F.coalesce(F.col("authors"), F.array().cast("array<string>")).alias("_wa"))).where(F.col("_t") != "")
    similar = _similar_titles(left.select("_t").distinct(), right.select("_t").distinct(), floor_j)
    first = right.withColumn("_place", F.row_number().over(Window.partitionBy("_t").orderBy("work_id"))).where(F.col("_place") <= CANDIDATES)
    offered = similar.join(first, F.col("_tb") == first["_t"]).select("_ta", "work_id", "_j", "_shared", "_wa")
    near = offered.withColumn("_rank", F.row_number().over(Window.partitionBy("_ta").orderBy(F.desc("_shared"), F.asc("work_id")))).where(F.col("_rank") <= CANDIDATES)
    normal = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: author_key(x, sort_author_tokens)), lambda x: x != ""))
    pairs = left.join(near, left["_t"] == near["_ta"]).select(key, "work_id", "_rank", "_j", F.size("_a").alias("_n"), normal(F.col("_a")).alias("_a"), normal(F.col("_wa")).alias("_wa"))
    score = F.when(F.col("_n") > 0, TITLE_WEIGHT * F.col("_j") + (1 - TITLE_WEIGHT) * jaccard(F.col("_a"), F.col("_wa"))).otherwise(F.col("_j"))
    best = pairs.withColumn("score", F.round(score, 9)).withColumn("_best", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.asc("_rank")))).where(F.col("_best") == 1)
    return best.where(F.col("score") >= least).select(key, "work_id", "score")


def _similar_titles(left: DataFrame, right: DataFrame, floor_j: float) -> DataFrame:
    """``(_ta, _tb, _shared, _j)``: distinct titles ``_t`` of two sides whose words have a Jaccard of ``floor_j`` at least.

    Sizes ``a`` and ``b`` ask for ``o`` shared words, so with words in one order the ``k`` first shared ones stand
    among the first ``a - o + k`` and ``b - o + k``. The order is by how often a word's bucket occurs, so rare words come
    first. Titles up to ``PAIRED_WORDS`` meet by two of them, or by one where one shared word is enough; longer ones
    by one. Each word sets one of 64 bits, twice: titles whose bits differ in more places than their words may are
    told apart before their words are read.
    """
    titles = _hashed_titles(left, right)
    keys = _title_keys(titles, floor_j)
    a, b = (keys.where(F.col("_side") == s).select("_key", *[F.col(c).alias(c + n) for c in ("_id", "_size", "_bits", "_more")]) for s, n in ((0, "a"), (1, "b")))
    sizes = (F.col("_sizea") >= floor_j * F.col("_sizeb") - 1e-9) & (F.col("_sizeb") >= floor_j * F.col("_sizea") - 1e-9)
    apart = (F.col("_sizea") + F.col("_sizeb")) * ((1 - floor_j) / (1 + floor_j)) + 1e-6
    near = [F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) <= apart for c in ("_bits", "_more")]
    met = a.hint("merge").join(b, "_key").where(sizes & near[0] & near[1]).select("_ida", "_idb").distinct()  # keys are too many to broadcast, however well they are packed
    text = lambda side, n: titles.where(F.col("_side") == side).select(F.col("_id").alias("_id" + n), F.col("_t").alias("_t" + n))
    split = met.join(text(0, "a"), "_ida").join(text(1, "b"), "_idb").withColumn("_x", words(F.col("_ta"))).withColumn("_y", words(F.col("_tb"))).withColumn("_shared", F.size(F.array_intersect("_x", "_y")))
    return split.withColumn("_j", F.col("_shared") / (F.size("_x") + F.size("_y") - F.col("_shared"))).where(F.col("_j") >= floor_j - 1e-9).select("_ta", "_tb", "_shared", "_j").distinct()


def _hashed_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(_t, _id, _side, _h)``: the titles of both sides with the hashes of their words; read several times."""
    named = lambda df, side: df.select("_t", F.xxhash64("_t").alias("_id"), F.lit(side).alias("_side"), F.transform(words(F.col("_t")), lambda w: F.xxhash64(w)).alias("_h"))
    return cut_lineage(named(left, 0).unionByName(named(right, 1)))


def _title_keys(titles: DataFrame, floor_j: float) -> DataFrame:
    """``(_id, _side, _size, _bits, _more, _key)``: what titles meet by, a row for each key."""
    ranks = F.lit(_bucket_ranks(titles))
    rank = lambda h: F.substring(ranks, F.pmod(h, F.lit(WORD_BUCKETS)).cast("int") + 1, F.lit(1))
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    bits = lambda of: F.aggregate("_h", F.lit(0).cast("long"), lambda seen, h: seen.bitwiseOR(one(of(h))))
    ordered = F.transform(F.array_sort(F.transform("_h", lambda h: F.struct(rank(h).alias("n"), h.alias("h")))), lambda x: x["h"])
    about = titles.select("_id", "_side", F.size("_h").alias("_size"), bits(lambda h: h).alias("_bits"), bits(lambda h: F.shiftright(h, 6)).alias("_more"), ordered.alias("_o"))

    size, none = F.col("_size"), F.array().cast("array<bigint>")
    smallest = F.greatest(F.ceil(floor_j * size - 1e-6), F.lit(1))
    shared = F.greatest(F.ceil(floor_j / (1 + floor_j) * (size + smallest) - 1e-6), F.lit(1)).cast("int")  # by the smallest other title: larger ones ask for more
    last = F.col("_size") - F.greatest("_least", F.lit(2)) + 1
    by_two = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda n: F.xxhash64(F.get("_o", i), F.get("_o", n)))))
    rarest = F.transform(F.slice("_o", F.lit(1), (F.floor((1 - floor_j) * size + 1e-6) + 1).cast("int")), lambda h: F.xxhash64(h))
    kinds = (
        F.when((size >= 2) & (size <= PAIRED_WORDS), by_two).otherwise(none),
        F.when((F.col("_least") == 1) & (size <= PAIRED_WORDS), F.transform("_o", lambda h: F.xxhash64(h))).otherwise(none),
        F.when(size > floor_j * PAIRED_WORDS - 1e-6, rarest).otherwise(none),
    )
    return about.withColumn("_least", shared).select("_id", "_side", "_size", "_bits", "_more", F.explode(F.concat(*kinds)).alias("_key"))


def _bucket_ranks(titles: DataFrame) -> bytearray:
    """For each of ``WORD_BUCKETS`` buckets of word hashes ``_h`` a byte that grows with the occurrences of its words."""
    bucket = titles.select(F.explode("_h").alias("h")).select(F.pmod("h", F.lit(WORD_BUCKETS)).cast("int").alias("b"))
    ranks = bytearray(WORD_BUCKETS)
    for b, n in bucket.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        ranks[b] = min(255, int(6 * math.log2(n)))
    return ranks


def _truthy(c: Column) -> Column:
    return blank_to_null(c)


#: Fields of a paper and of a work that correspond (fixed values).
PAIRED = {"abstract": "abstract", "doi": "doi", "url": "url", "publication_title": "journal", "volume": "volume", "issue": "issue", "pages": "pages"}


def with_bags(extra: Column, bags: dict[str, Column]) -> Column:
    """The JSON object ``extra`` with each name set to its value, itself JSON; NULL values set nothing. What is no object counts as empty."""
    held = F.coalesce(F.from_json(extra, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    said = F.map_filter(F.create_map(*[x for name, value in bags.items() for x in (F.lit(name), value)]), lambda _, v: v.isNotNull())
    new = F.transform_values(said, lambda _, v: F.try_parse_json(v))
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: ~k.isin(*bags)), new))


def _bags(joined: DataFrame, name: str, kept: tuple[str, ...]) -> Column:
    """``extra`` with what a catalog says beyond a paper's fields, or with what was asked in vain."""
    says = F.when(F.col("work.work_id").isNotNull(), F.to_json(F.struct(*[F.col(f"work.{f}").alias(f) for f in kept])))
    asked = F.struct(_asked_doi().alias("doi"), F.col("title").alias("title"), F.col("authors").alias("authors"), F.col("url").alias("url"), _strategy().alias("strategy"))
    in_vain = F.when(F.col("work.work_id").isNull(), F.to_json(asked))
    return with_bags(F.col("extra"), {name: says, f"{name}_extra": F.nullif(F.col("work_other"), F.lit("{}")), f"{name}_unmatched": in_vain})


def _asked_doi() -> Column:
    return F.coalesce(blank_to_null(F.col("doi")), extract_doi(F.col("url")))


def _strategy() -> Column:
    return F.when(F.col("lookup") == "doi_only", F.lit("doi_only")).otherwise(F.lit("title_author"))


def merge_overwrite(joined: DataFrame) -> DataFrame:
    """Papers with every value that their ``work`` has put over their own; the date becomes the first day of the year."""
    w = lambda f: F.col(f"work.{f}")
    pairs = PAIRED | {"pdf_url": "pdf_url", "publisher": "publisher", "issn": "issn", "language": "language"}
    new = {p: F.coalesce(_truthy(w(f)), F.col(p)) for p, f in pairs.items()}
    new["authors"] = F.when(F.size(w("authors")) > 0, w("authors")).otherwise(F.col("authors"))
    new["published_date"] = F.coalesce(F.when(w("year") != 0, F.make_date(w("year"), F.lit(1), F.lit(1))), F.col("published_date"))
    new["item_type"] = F.coalesce(_truthy(w("item_type")), F.col("item_type"))
    if "extra" in joined.columns:
        new["extra"] = _bags(joined, "crossref", ("funders", "citation_count", "subjects"))
    return joined.withColumns(new)


def merge_fill(joined: DataFrame) -> DataFrame:
    """Papers whose absent values are taken from their ``work``; the type changes only from journal article to a special one."""
    w = lambda f: F.col(f"work.{f}")
    new = {p: F.coalesce(_truthy(F.col(p)), _truthy(w(f)), F.col(p)) for p, f in PAIRED.items()}
    new["authors"] = F.when((F.coalesce(F.size("authors"), F.lit(0)) <= 0) & (F.size(w("authors")) > 0), w("authors")).otherwise(F.col("authors"))
    new["published_date"] = F.coalesce(F.col("published_date"), F.when(w("year") != 0, F.make_date(w("year"), F.lit(1), F.lit(1))))
    plain = F.coalesce(_truthy(F.col("item_type")), F.lit("journalArticle")) == "journalArticle"
    new["item_type"] = F.when(plain & (w("item_type") != "") & (w("item_type") != "journalArticle"), w("item_type")).otherwise(F.col("item_type"))
    if "extra" in joined.columns:
        new["extra"] = _bags(joined, "openalex", ("cited_by_count", "concepts"))
    return joined.withColumns(new)


def unmatched(joined: DataFrame, key: str = "paper_id") -> DataFrame:
    """``(key, doi, title, url, strategy)`` of the papers without a work."""
    return joined.where(F.col("work.work_id").isNull()).select(key, _asked_doi().alias("doi"), "title", "url", _strategy().alias("strategy"))


def enrich_from(papers: DataFrame, raw: DataFrame, catalog: Catalog, key: str = "paper_id") -> DataFrame:
    """Papers enriched from one catalog by its rule: the first one's values win, the second one's fill gaps."""
    merge = merge_overwrite if catalog is CROSSREF else merge_fill
    return merge(join_works(papers, raw, catalog, key)).select(*papers.columns)


def enrich_chain(papers: DataFrame, first: DataFrame, second: DataFrame, key: str = "paper_id") -> DataFrame:
    """Papers enriched from one catalog and then from the other, whose lookup sees what the first one gave."""
    return enrich_from(enrich_from(papers, first, CROSSREF, key), second, OPENALEX, key)


def enriched_count(papers: DataFrame, enriched: DataFrame, key: str = "paper_id") -> DataFrame:
    """One row: papers, and how many of them a catalog changed in any column."""
    digest = lambda df: df.select(key, F.xxhash64(*[F.col(c).cast("string") if t.startswith(("map", "variant")) else F.col(c) for c, t in df.dtypes if c not in (key, "extra")]).alias("_h"))
    both = digest(papers).join(digest(enriched).withColumnRenamed("_h", "_g"), key)
    return both.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("_h") != F.col("_g")).alias("enriched"))
