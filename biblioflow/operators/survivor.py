"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.functions.canonical import doi_canonical, title_canonical
from biblioflow.functions.damage import charset_suspect, looks_cut, visible_length

#: Values that stand for an absent one, formatting aside (fixed values).
PLACEHOLDERS = ("na", "none", "null", "nil", "unknown", "tbd", "tba", "asap", "inpress", "forthcoming", "ahead", "aheadofprint", "online", "undefined", "notavailable", "unavailable")


def is_placeholder(c: Column) -> Column:
    """True for NULL, blank, dashes and words such as ``n/a``, ``tbd`` and ``in press``."""
    bare = F.regexp_replace(F.lower(c), r"[\p{P}\p{Z}\p{C}]+", "")
    return F.coalesce((bare == "") | bare.isin(*PLACEHOLDERS), F.lit(True))


def _sound_name(c: Column) -> Column:
    """A name in full: no placeholder, no word cut to a stem with a full stop, no charset damage."""
    return ~is_placeholder(c) & ~c.rlike(r"\p{L}\.(\s|$)") & ~charset_suspect(c)


def _sound_pages(c: Column) -> Column:
    """A whole page range: a first page alone or a shortened last page (``871-91``) is abbreviated."""
    first, last = F.regexp_extract(c, r"(\d+)\D*[-–—]\D*\d+\D*$", 1), F.regexp_extract(c, r"\d+\D*[-–—]\D*(\d+)\D*$", 1)
    return ~is_placeholder(c) & F.coalesce(last.try_cast("decimal(38,0)") >= first.try_cast("decimal(38,0)"), F.lit(False))


def _sound_volume(c: Column) -> Column:
    return ~is_placeholder(c) & ~charset_suspect(c)


def _sound_abstract(c: Column) -> Column:
    return (F.trim(c) != "") & ~looks_cut(c) & ~charset_suspect(c)


#: Per field: when a value may survive, and what it is ranked by before recency.
FIELDS = {
    "abstract": (_sound_abstract, visible_length),
    "publication_title": (_sound_name, None),
    "volume": (_sound_volume, None),
    "pages": (_sound_pages, None),
}


def group_keys(df: DataFrame, key: str = "paper_id", doi: str = "doi", title: str = "title") -> DataFrame:
    """``(_key, _group)``: the work of each row that has a DOI or a title.

    A row with a DOI belongs to that DOI. A row without one joins the DOI that its title is known under, if
    that is exactly one, and else the other rows of its title: different DOIs are never united. Titles are
    counted before they are joined, so a title on many rows is one row of the lookup.
    """
    rows = df.select(F.col(key).alias("_key"), doi_canonical(F.col(doi)).alias("_doi"), title_canonical(F.col(title)).alias("_title"))
    with_doi = rows.where(F.col("_doi").isNotNull())
    known = with_doi.where(F.col("_title").isNotNull()).groupBy("_title").agg(F.min("_doi").alias("_lo"), F.max("_doi").alias("_hi"))
    known = known.where(F.col("_lo") == F.col("_hi")).select("_title", F.col("_lo").alias("_title_doi"))
    without = rows.where(F.col("_doi").isNull() & F.col("_title").isNotNull()).drop("_doi").join(known, "_title", "left")
    by_title = without.select("_key", F.coalesce(F.concat(F.lit("d:"), "_title_doi"), F.concat(F.lit("t:"), "_title")).alias("_group"))
    return with_doi.select("_key", F.concat(F.lit("d:"), "_doi").alias("_group")).unionByName(by_title)


def _values(df: DataFrame, key: str, fetched: str, source: str, trust: dict[str, int] | None) -> DataFrame:
    """``(_key, _field, _value, _size, _trust, _seen)``: one narrow row per row and sound value; values as 64-bit keys.

    A value key only has to tell the values of one group and field apart.
    """
    entries = []
    for name, (sound, size) in FIELDS.items():
        c = F.col(name)
        ok = F.coalesce(sound(c), F.lit(False))
        entries.append(F.struct(F.lit(name).alias("_field"), F.when(ok, F.xxhash64(c, F.length(c))).alias("_value"), (size(c) if size else F.lit(0)).alias("_size")))
    trusted = F.coalesce(F.create_map(*[x for s, n in trust.items() for x in (F.lit(s), F.lit(n))])[F.col(source)], F.lit(0)) if trust else F.lit(0)
    return df.select(F.col(key).alias("_key"), F.col(fetched).alias("_seen"), trusted.alias("_trust"), F.explode(F.array(*entries)).alias("_e")).where(F.col("_e._value").isNotNull()).select("_key", "_seen", "_trust", "_e.*")


def best_values(df: DataFrame, key: str = "paper_id", fetched: str = "fetched_at", source: str = "source", trust: dict[str, int] | None = None) -> DataFrame:
    """``(group_id, field_name, key)``: for each group of two or more rows and each field, the row to take it from.

    Only complete values compete: absent, cut, damaged, abbreviated and placeholder ones never win, and a field
    with no other value has no row. They are ranked by completeness (the length of an abstract as shown; a
    name, volume or page range is whole or out), then by the trust in the source that delivered them
    (``trust``: source to number, 0 where it says nothing), then by the time of their latest delivery; NULL
    times are the oldest. Ties go to the smallest key, which is also the row that stands for a value several
    rows share. Deliveries of one value are combined before the ranking window, and its rank limit is applied
    ahead of the shuffle, so a group holding a third of all rows is no single task's work.
    """
    groups = group_keys(df, key)
    sizes = groups.groupBy("_group").agg(F.min("_key").alias("group_id"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    grouped = groups.join(sizes, "_group").select("_key", "group_id")
    held = _values(df, key, fetched, source, trust).join(grouped, "_key").groupBy("group_id", "_field", "_value").agg(F.min("_key").alias("_first"), F.max("_seen").alias("_seen"), F.max("_size").alias("_size"), F.max("_trust").alias("_trust"))
    order = Window.partitionBy("group_id", "_field").orderBy(F.desc("_size"), F.desc("_trust"), F.desc_nulls_last("_seen"), F.asc("_first"))
    best = held.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1)
    return best.select("group_id", F.col("_field").alias("field_name"), F.col("_first").alias(key))


def surviving_records(df: DataFrame, key: str = "paper_id", fetched: str = "fetched_at", source: str = "source", trust: dict[str, int] | None = None) -> DataFrame:
    """One built record per group of two or more rows: ``group_id, members`` and the four best values.

    The winning rows are known before any value is moved: only their texts are shuffled, each to its group.
    """
    groups = group_keys(df, key)
    sizes = groups.groupBy("_group").agg(F.min("_key").alias("group_id"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1).select("group_id", "members")
    winners = best_values(df, key, fetched, source, trust).groupBy(key).agg(F.min("group_id").alias("group_id"), F.collect_set("field_name").alias("_won"))  # four fields at most
    shown = [F.when(F.array_contains("_won", f), F.col(f)).alias(f) for f in FIELDS]
    values = df.select(key, *FIELDS).join(winners, key).select("group_id", *shown)
    wide = values.groupBy("group_id").agg(*[F.max(f).alias(f) for f in FIELDS])
    return sizes.join(wide, "group_id", "left")
