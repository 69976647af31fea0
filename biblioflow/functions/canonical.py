"""Canonical forms of DOIs and titles: what is left once formatting is put aside (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation, separators and control characters; ASCII symbols that titles are decorated with.
_ASIDE = r"[\p{P}\p{Z}\p{C}`^~|<>]+"
_MARKUP = r"</?[A-Za-z][A-Za-z0-9:]{0,15}( [^<>]*)?/?>"


def not_blank(c: Column) -> Column:
    """The text, or NULL for ''; names its argument once, so that it is computed once."""
    return F.get(F.regexp_extract_all(c, F.lit(r"(?s).+"), F.lit(0)), F.lit(0))


def fold_case(c: Column) -> Column:
    """Case folding that also unites what differs only after upper-casing (micro sign and mu, final sigma, sharp s)."""
    return F.translate(F.lower(F.upper(c)), "ς", "σ")


def doi_canonical(c: Column) -> Column:
    """A DOI without resolver, ``doi:`` prefix, case, white space and punctuation; NULL and blank give NULL.

    A value without a recognisable ``10.prefix/suffix`` keeps all of its letters and digits, so that
    unequal malformed values never fall together.
    """
    squeezed = F.regexp_replace(F.lower(c), r"[\p{Z}\p{C}]+", "")
    bare = F.regexp_replace(squeezed, r"^.*doi\.org/+", "")
    bare = F.regexp_replace(bare, r"^[\p{P}<>]*(doi[:=]?)?", "")
    return not_blank(F.regexp_replace(bare, r"[\p{P}`^~|<>]+", ""))


def title_canonical(c: Column) -> Column:
    """A title without markup, case, white space and punctuation; NULL when nothing is left."""
    kept = F.regexp_replace(fold_case(F.regexp_replace(c, _MARKUP, " ")), _ASIDE, "")
    return F.when(kept != "", kept)
