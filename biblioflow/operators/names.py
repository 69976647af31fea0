"""Variant spellings of names: merge-and-rematch resolution over the distinct names of all tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioflow.functions.names import ORGANISATION, parse_name
from biblioflow.session import cut_lineage

#: A family joins another that is one slip away only if it has at most this share of the other's spellings (or both have one).
MINOR_SHARE = 0.5
#: Letters from which a word can be one slip away from another, and from which it can be the stem of a longer one.
SLIP_LETTERS, STEM_LETTERS = 4, 3
#: Word stems that only say what kind of organisation it is.
ORGANISATION_STEMS = sorted({w[:3] for w in ORGANISATION} | {"cen"})

_PARSED = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "kind", "family", "given", "rest", "other_family", "other_given")] + [T.StructField("n", T.LongType())])


def distinct_names(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """``(name, n)``: every stored string of the given array columns once, with its number of uses."""
    each = [df.select(F.explode(F.col(c)).alias("name")).where(F.col("name").isNotNull()) for df, c in columns]
    return reduce(DataFrame.unionByName, each).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, n in zip(batch["name"], batch["n"].tolist()):
            parsed = parse_name(name)
            if parsed is None:
                continue
            turned = parsed.kind == "person" and "," not in name and parsed.given and not parsed.rest and " " not in parsed.given
            other = parse_name(f"{name.split()[0]}, {' '.join(name.split()[1:])}") if turned else None
            rows.append((name, parsed.kind, parsed.family, parsed.given, parsed.rest, other.family if other else None, other.given if other else None, n))
        yield pd.DataFrame(rows, columns=[f.name for f in _PARSED])


def _settle_order(parsed: DataFrame) -> DataFrame:
    """Names of two words without a comma are family first if only that reading gives a family known from comma forms."""
    families = parsed.where((F.col("kind") == "person") & F.col("name").contains(",")).select("family").distinct()
    as_is = families.select(F.col("family"), F.lit(True).alias("_known"))
    turned = families.select(F.col("family").alias("other_family"), F.lit(True).alias("_known_turned"))
    seen = parsed.join(as_is, "family", "left").join(turned, "other_family", "left")
    turn = F.col("_known").isNull() & F.col("_known_turned").isNotNull()
    given = F.when(turn, F.col("other_given")).otherwise(F.col("given"))
    person = F.col("kind") == "person"
    return seen.select(
        "name", "n", "kind", F.when(turn, F.col("other_family")).otherwise(F.col("family")).alias("family"),
        F.when(person, F.substring_index(given, " ", 1)).otherwise(given).alias("token"), F.when(person & given.contains(" "), F.substring(F.substring_index(given, " ", -1), 1, 1)).otherwise("").alias("second"),
        F.when(turn, F.lit("")).otherwise(F.col("rest")).alias("rest"),
    )


# ---------------------------------------------------------------- words that may be one


def _deletions(word: Column) -> Column:
    """The word and the word without each one letter: two words one slip apart share one of them."""
    n = F.length(word)
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, n)))))


def _one_slip(a: Column, b: Column) -> Column:
    """One letter inserted, left out, replaced or swapped with its neighbour."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2, F.length(a))) == b)
    return (a != b) & ((F.levenshtein(a, b, 1) == 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped))


def _prefixes(word: Column) -> Column:
    """The word, and its beginnings of ``STEM_LETTERS`` or more."""
    n = F.length(word)
    return F.when(n <= STEM_LETTERS, F.array(word)).otherwise(F.transform(F.sequence(F.lit(STEM_LETTERS), n), lambda i: F.substr(word, F.lit(1), i)))


def _rarer_half(token: Column) -> Column:
    """Stems of an organisation's words such that two that share half of the longer one's stems share one of these.

    Any fixed order of stems serves; those that say what kind of organisation it is come last.
    """
    stems = F.array_distinct(F.split(token, " "))
    usual = list(ORGANISATION_STEMS)
    ordered = F.array_sort(F.transform(stems, lambda w: F.struct(w.isin(usual).alias("u"), w.alias("w"))))
    return F.slice(F.transform(ordered, lambda x: x["w"]), F.lit(1), F.size(stems) - F.ceil(F.size(stems) / 2).cast("int") + 1)


def _keys(side: str) -> Column:
    """What two words that may be one have in common, one side's keys meeting the other's.

    ``<`` meets where the left word begins the right one, ``>`` where it is the other way round, ``~`` where both
    are the same with one letter less, ``#`` where organisations share a rarer stem.
    """
    token = F.col("token")
    tagged = lambda tag, words: F.transform(words, lambda w: F.concat(F.lit(tag), w))
    own, longer = F.array(token), _prefixes(token)
    stems = F.concat(tagged("<", own), tagged(">", longer)) if side == "l" else F.concat(tagged("<", longer), tagged(">", own))
    less = F.when(F.length(token) >= SLIP_LETTERS, tagged("~", _deletions(token))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("kind") == "person", F.concat(stems, less)).otherwise(tagged("#", _rarer_half(token)))


def _related(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l, r)``: what of ``left`` and ``right``, both ``(kind, root, token, second, ...)``, may be one within a root.

    Given names: equal, a stem of three letters or more, or one slip between longer ones, unless second
    names begin differently. Organisations: half of the longer one's word stems. Every relation is one
    equality of keys first, so no root is compared all with all.
    """
    keyed = lambda df, side: df.select("kind", "root", F.explode(_keys(side)).alias("_key"), F.struct(*df.columns).alias(side))
    met = keyed(left, "l").join(keyed(right, "r"), ["kind", "root", "_key"])
    l, r = F.col("l.token"), F.col("r.token")
    seconds = (F.col("l.second") == "") | (F.col("r.second") == "") | (F.col("l.second") == F.col("r.second"))
    stems = lambda c: F.array_distinct(F.split(c, " "))
    half = 2 * F.size(F.array_intersect(stems(l), stems(r))) >= F.greatest(F.size(stems(l)), F.size(stems(r)))
    fits = F.when(F.col("kind") == "organisation", half).otherwise(seconds & (~F.col("_key").startswith("~") | _one_slip(l, r)))
    return met.where(fits).select("l", "r").distinct()


# ---------------------------------------------------------------- members of a family


def _heads(given: DataFrame) -> DataFrame:
    """``(kind, root, token, second, head)``: each given name of a root with the best supported one that it is linked to.

    A name points to the best supported of those it may be one with; pointers are followed to their end,
    so a spelling that only resembles an absorbed spelling comes along.
    """
    node = ["kind", "root", "token", "second"]
    counted = cut_lineage(given.groupBy(*node).agg(F.sum("n").alias("support")))
    rank = lambda s: F.struct(F.col(f"{s}.support"), F.col(f"{s}.token"), F.col(f"{s}.second"))
    up = _related(counted, counted).where(rank("r") > rank("l"))
    name = lambda s: F.concat_ws("|", f"{s}.token", f"{s}.second")
    points = up.groupBy(F.col("l.kind").alias("kind"), F.col("l.root").alias("root"), name("l").alias("at")).agg(F.max_by(name("r"), rank("r")).alias("head"))
    points = cut_lineage(points)
    while True:
        ends = points.select("kind", "root", F.col("at").alias("head"), F.col("head").alias("_next"))
        moved = cut_lineage(points.join(ends, ["kind", "root", "head"], "left"))
        points = moved.select("kind", "root", "at", F.coalesce("_next", "head").alias("head"))
        if moved.where(F.col("_next").isNotNull()).isEmpty():
            break
    here = counted.withColumn("at", F.concat_ws("|", "token", "second"))
    return here.join(points, ["kind", "root", "at"], "left").select(*node, F.coalesce("head", "at").alias("head"))


def _entities(state: DataFrame) -> DataFrame:
    """``state(name, n, kind, root, token, second, rest)`` with ``member``: whom of its root each name means.

    Full names are linked first. Initials belong to the one full name they fit, in any of its spellings and
    with its middle initials; where none or several fit, they are a member of their own. Only counts per
    letter are compared, so a family of any size is the work of many tasks.
    """
    root, full = ["kind", "root"], state.where("token <> ''")
    linked = cut_lineage(full.join(_heads(full), [*root, "token", "second"]).withColumn("member", F.concat(F.lit("f:"), "head")).drop("head"))
    known = linked.groupBy(*root, "member").agg(F.collect_set(F.substring("token", 1, 1)).alias("letters"), F.array_remove(F.array_union(F.collect_set("second"), F.collect_set(F.substring("rest", 1, 1))), "").alias("middles"))
    # what initials may ask of a full name: the letter alone, the letter with no middle initial known, the letter with a known one
    asked = F.concat(F.array(F.lit("")), F.when(F.size("middles") == 0, F.array(F.lit("*"))).otherwise(F.col("middles")))
    fits = known.select(*root, "member", F.explode("letters").alias("_a"), asked.alias("_k")).withColumn("_k", F.explode("_k")).groupBy(*root, "_a", "_k").agg(F.count(F.lit(1)).alias("c"), F.min("member").alias("m"))
    short = state.where("token = ''").withColumn("_a", F.substring("rest", 1, 1)).withColumn("_b", F.substring("rest", 2, 1))
    keys = F.when(F.col("_b") == "", F.array(F.lit(""))).otherwise(F.array(F.lit("*"), F.col("_b")))
    met = short.select("*", F.explode(keys).alias("_k")).join(fits, [*root, "_a", "_k"], "left")
    seen = cut_lineage(met.groupBy(*state.columns, "_a", "_b").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.min("m").alias("m")))
    own = F.concat(F.lit("i:"), "_a", "_b")
    two = seen.where("_b <> ''").withColumn("member", F.when(F.col("c") == 1, F.col("m")).otherwise(own))
    alone = two.where(F.col("member").startswith("i:")).groupBy(*root, "_a").agg(F.count_distinct("member").alias("c_own"), F.min("member").alias("m_own"))
    one = seen.where("_b = ''").join(alone, [*root, "_a"], "left").fillna(0, ["c_own"])
    one = one.withColumn("member", F.when(F.col("c") + F.col("c_own") == 1, F.coalesce("m", "m_own")).otherwise(own))
    shown = [*state.columns, "member"]
    return linked.select(*shown).unionByName(two.select(*shown)).unionByName(one.select(*shown))


# ---------------------------------------------------------------- families one slip apart


def _near_families(state: DataFrame) -> DataFrame:
    """``(kind, family, other)``: spellings of families, both ways, that are one slip apart."""
    families = state.select("kind", "family").distinct().where(F.length("family") >= SLIP_LETTERS)
    keyed = families.withColumn("_key", F.explode(_deletions(F.col("family"))))
    met = keyed.join(keyed.select("kind", F.col("family").alias("other"), "_key"), ["kind", "_key"]).where(_one_slip(F.col("family"), F.col("other")))
    return met.select("kind", "family", "other").distinct()


def _merges(state: DataFrame, near: DataFrame, roots: DataFrame) -> DataFrame:
    """``(kind, root, into)``: roots all of whose members can be members of a larger root with a spelling one slip away."""
    letter = F.when(F.col("kind") != "person", "").when(F.col("token") == "", F.substring("rest", 1, 1)).otherwise(F.substring("token", 1, 1))
    members = cut_lineage(state.join(roots, ["kind", "family"]).groupBy("kind", "root", "token", "second", letter.alias("letter")).agg(F.count(F.lit(1)).alias("names")))
    sized = roots.join(members.groupBy("kind", "root").agg(F.sum("names").alias("names")), ["kind", "root"])
    other = sized.select("kind", F.col("family").alias("other"), F.col("root").alias("into"), F.col("names").alias("into_names"))
    met = near.join(sized, ["kind", "family"]).join(other, ["kind", "other"])
    minor = (F.col("names") <= MINOR_SHARE * F.col("into_names")) | ((F.col("names") == 1) & (F.col("into_names") == 1) & (F.col("root") < F.col("into")))
    met = cut_lineage(met.where((F.col("root") != F.col("into")) & minor).select("kind", "root", "into", "into_names").distinct())
    members = members.drop("names")
    asked = met.select("kind", "root", "into").join(members, ["kind", "root"])
    asked = asked.select("kind", F.col("root").alias("small"), F.col("into").alias("root"), "token", "second", "letter").distinct()
    full, letters = members.where("token <> ''"), members.groupBy("kind", "root", "letter").agg(F.bool_or(F.col("token") == "").alias("short"), F.bool_or(F.col("token") != "").alias("full"))
    by_name = _related(asked.where("token <> ''"), full).select("l.*")
    by_letter = asked.join(letters, ["kind", "root", "letter"]).where((F.col("kind") == "person") & ((F.col("token") == "") | (F.col("short") & ~F.col("full")))).select(asked.columns)
    covered = by_name.unionByName(by_letter)
    missing = asked.join(covered, asked.columns, "left_anti").select("kind", F.col("small").alias("root"), F.col("root").alias("into")).distinct()
    whole = met.join(missing, ["kind", "root", "into"], "left_anti")
    return whole.groupBy("kind", "root").agg(F.max_by("into", F.struct("into_names", "into")).alias("into"))


def resolve_names(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """``(name, kind, root, entity)``: every distinct name that names somebody, with the entity it belongs to.

    Names are parsed once. Families with a spelling one slip apart are compared by their members: one with
    fewer names, all of whose members the other has, is merged into it. A merged family brings all its
    spellings, given names and initials into the next round, where they meet families that only resemble
    an absorbed spelling; rounds go on until nothing merges, each leaves fewer families. Then members are
    told apart within each family (short forms, initials, reordered parts, slips). ``entity`` is the
    smallest spelling. NULL, blank and filler names have no row; initials that fit several members stay
    on their own.

    Everything after ``distinct_names`` works on distinct strings and joins by keys finer than the family,
    so neither a name nor a family on a third of all rows is the work of one task.
    """
    parsed = distinct_names(columns).mapInPandas(_parse_batches, _PARSED)
    state = cut_lineage(_settle_order(parsed))
    near = cut_lineage(_near_families(state))
    involved = near.select("kind", "family").distinct()
    some = cut_lineage(state.join(involved, ["kind", "family"], "left_semi"))
    roots = involved.withColumn("root", F.col("family"))
    while True:
        merges = cut_lineage(_merges(some, near, roots))
        settled = merges.join(merges.select("kind", F.col("root").alias("into")), ["kind", "into"], "left_anti").select("kind", "root", "into")
        if settled.isEmpty():
            break
        roots = cut_lineage(roots.join(settled, ["kind", "root"], "left").select("kind", "family", F.coalesce("into", "root").alias("root")))
    rooted = cut_lineage(state.join(roots, ["kind", "family"], "left").withColumn("root", F.coalesce("root", "family")))
    members = _entities(rooted)
    return cut_lineage(members.select("name", "kind", "root", F.min("name").over(Window.partitionBy("kind", "root", "member")).alias("entity")))


def variant_pairs(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """``(name_a, name_b)``: two different stored strings of one entity, the smaller by code point first.

    Every pair of spellings is a row, as many as the spellings of one person or organisation allow;
    ``variant_links`` and ``name_members`` say the same in as many rows as there are spellings.
    """
    linked = resolve_names(columns).select("name", "entity")
    left, right = linked.withColumnRenamed("name", "name_a"), linked.withColumnRenamed("name", "name_b")
    return left.join(right, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")


def name_members(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """``(name, entity)``: the membership of every name; a name without variants is its own entity."""
    return resolve_names(columns).select("name", "entity")


def variant_links(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """``(entity, name)``: each further spelling with the entity's smallest one, V - 1 rows for V spellings."""
    return name_members(columns).where(F.col("name") != F.col("entity")).select("entity", "name")


def name_entities(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """One row per entity: ``entity, kind, spellings`` (their number) and ``uses`` in all tables."""
    linked = resolve_names(columns)
    return linked.join(distinct_names(columns), "name").groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("uses"))
