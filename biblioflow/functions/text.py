"""Scalar text, URL, DOI and date functions (Column -> Column)."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A DOI as it stands in text (fixed pattern).
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
#: The first DOI after the last resolver or ``doi:``, without closing marks, in one pass.
BARE_DOI = r"(?is)^(?:.*doi\.org/|\s*doi:)?+.*?(10\.\d{4,9}(?=/[-._;()/:A-Z0-9])[-._;()/:A-Z0-9]*[-_(/:A-Z0-9])"
#: Words that announce a provisional publication (fixed values).
TITLE_NOISE = ("asap", "just accepted", "early access", "ahead of print", "in press")
#: Query keys that only track a click (fixed values; ``utm_*`` besides).
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "mkt_tok", "ref", "source")
#: What is neither letter, number, underscore nor white space.
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))  # only blanks are left to strip


def extract_doi(c: Column) -> Column:
    """The first DOI in a text as written; NULL without one."""
    return F.get(F.regexp_extract_all(c, F.lit(DOI), F.lit(0)), F.lit(0))  # names its argument once, so that nested calls do not multiply


def extract_bounded_doi(c: Column) -> Column:
    """The first DOI that ends at a word border, so closing punctuation stays outside."""
    return F.nullif(F.regexp_extract(c, rf"(?i)\b10\.\d{{4,9}}/[-._;()/:A-Z0-9]+\b", 0), F.lit(""))


def normalize_doi(c: Column) -> Column:
    """Lower-case bare DOI of a value with or without resolver or ``doi:``; NULL without one."""
    return F.lower(F.get(F.regexp_extract_all(c, F.lit(BARE_DOI), F.lit(1)), F.lit(0)))


def normalize_title(c: Column) -> Column:
    """Lower case without status words and punctuation; '' for NULL."""
    noise = "|".join(TITLE_NOISE)
    bare = F.regexp_replace(strip(F.lower(c)), rf"\b({noise})\b", "")
    return F.coalesce(collapse_space(F.regexp_replace(bare, NOT_WORD, " ")), F.lit(""))


def clean_title(c: Column) -> Column:
    """Without one leading ``[...]`` mark."""
    return strip(F.regexp_replace(c, r"^\[.*?\]\s*", ""))


def clean_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<.*?>", "")


#: The standard library's table of named entities, with and without their closing semicolon, and the longest of the latter.
_ENTITIES = dict(sorted(html5.items()))
_LONGEST_OPEN = max(len(name) for name in html5 if not name.endswith(";"))


def _numbered() -> dict[str, str]:
    """What numbers of the C0 and C1 ranges stand for: the characters of cp1252 where it has one, else nothing."""
    shown = {n: "" for n in (*range(1, 9), 0xB, *range(0xE, 0x20), *range(0x7F, 0xA0))} | {0: "\ufffd", 0xD: "\r"}
    for n in range(0x80, 0xA0):
        try:
            shown[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            shown[n] = chr(n)
    return {str(n): text for n, text in shown.items()}


_NUMBERED = _numbered()


def _literal_map(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")  # folded to one literal


def _of_number(number: Column) -> Column:
    """The character of a code point; the replacement character for what is none, nothing for noncharacters."""
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    none = number.between(0xFDD0, 0xFDEF) | ((number.bitwiseAND(0xFFFE) == 0xFFFE) & (number <= 0x10FFFF))
    wrong = number.isNull() | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return F.coalesce(F.try_element_at(_literal_map(_NUMBERED), number.cast("string")), F.when(wrong, F.lit("\ufffd")).when(none, F.lit("")).otherwise(character))


def _of_name(name: Column) -> Column:
    """What a name stands for, else the longest of its beginnings that stands for something, and the rest; else as it is."""
    table, old = _literal_map(_ENTITIES), _literal_map({n: t for n, t in _ENTITIES.items() if not n.endswith(";")})
    begins = [F.try_element_at(old, F.substring(name, 1, k)) for k in range(_LONGEST_OPEN, 1, -1)]
    shorter = [F.when(F.length(name) > k, F.concat(found, F.substr(name, F.lit(k + 1), F.length(name)))) for k, found in zip(range(_LONGEST_OPEN, 1, -1), begins)]
    return F.coalesce(F.try_element_at(table, name), *shorter, F.concat(F.lit("&"), name))


def _resolved(piece: Column) -> Column:
    """What an entity stands for; any other piece of text is itself."""
    decimal, hexadecimal = F.nullif(F.regexp_extract(piece, r"^&#([0-9]+);?$", 1), F.lit("")), F.nullif(F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]+);?$", 1), F.lit(""))
    value = F.coalesce(decimal.try_cast("bigint"), F.when(F.length(F.ltrim(hexadecimal, F.lit("0"))) <= 12, F.conv(hexadecimal, 16, 10).try_cast("bigint")))
    return F.when(~piece.startswith("&") | (F.length(piece) < 2), piece).when(decimal.isNotNull() | hexadecimal.isNotNull(), _of_number(value)).when(piece.startswith("&#"), piece).otherwise(_of_name(F.substr(piece, F.lit(2), F.length(piece))))


def unescape(c: Column) -> Column:
    """HTML entities, named or numbered, with or without their semicolon, resolved in one pass as browsers do."""
    pieces = F.regexp_extract_all(c, F.lit(r"(&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&)"), F.lit(1))
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, _resolved), "")).otherwise(c)


def clean_abstract(c: Column) -> Column:
    """Entities resolved first, then without tags, DOI links and labels, white space collapsed; NULL when nothing is left."""
    bare = F.regexp_replace(unescape(c), r"<[^>]+>", "")
    bare = F.regexp_replace(bare, r"https?://doi\.org/\S+", "")
    return blank_to_null(collapse_space(F.regexp_replace(bare, r"DOI:\s*\S+", "")))


def normalize_url(c: Column) -> Column:
    """Scheme and host in lower case, no tracking keys, sorted query, no fragment and closing slash; DOI links by DOI.

    Values that have no host come back without closing slashes; NULL and blank give NULL.
    """
    raw = blank_to_null(strip(c))
    doi = F.when(F.lower(raw).contains("doi.org/"), normalize_doi(raw))
    scheme = F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r";[^/]*$", ""), r"/+$", "")
    query = F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("low"), F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, r"^[^=]*=(.*)$", 1).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["low"].startswith("utm_") & ~p["low"].isin(*TRACKING)), lambda a, b: F.when(a["low"] < b["low"], -1).when(a["low"] > b["low"], 1).when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(F.lower(F.when(scheme != "", scheme).otherwise(F.lit("https"))), F.lit("://"), F.lower(host), path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))
    return F.when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi)).when(host == "", F.regexp_replace(raw, r"/+$", "")).otherwise(whole)


def date_text(c: Column) -> Column:
    """``yyyy-mm-dd``, ``yyyy-mm`` or ``yyyy`` found first in a text, without a check of ranges; NULL without a year."""
    plain = F.regexp_replace(strip(c), r"[./]", "-")
    ymd, ym, y = r"\b((?:19|20)\d{2})-(\d{1,2})-(\d{1,2})\b", r"\b((?:19|20)\d{2})-(\d{1,2})\b", r"\b((?:19|20)\d{2})\b"
    part = lambda p, i: F.regexp_extract(plain, p, i)
    two = lambda p, i: F.lpad(part(p, i), 2, "0")
    return F.when(plain.rlike(ymd), F.concat_ws("-", part(ymd, 1), two(ymd, 2), two(ymd, 3))).when(plain.rlike(ym), F.concat_ws("-", part(ym, 1), two(ym, 2))).when(plain.rlike(y), part(y, 1))


def title_date_key(title: Column, when: Column) -> Column:
    """``title|date`` of the normalized title; NULL if either is missing."""
    name = blank_to_null(normalize_title(title))
    return F.when(name.isNotNull() & when.isNotNull(), F.concat(name, F.lit("|"), when))


def norm_text(c: Column) -> Column:
    """Lower case, hyphens, underscores and punctuation as spaces."""
    return collapse_space(F.regexp_replace(F.regexp_replace(F.lower(c), r"[-_]", " "), NOT_WORD, " "))


def match_title(c: Column) -> Column:
    """Lower case with punctuation deleted: the form in which catalog titles are compared."""
    return collapse_space(F.regexp_replace(F.lower(c), NOT_WORD, ""))


def words(c: Column) -> Column:
    """The distinct words of a normalized text; an empty array for '' and NULL."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def author_key(c: Column, sort_tokens: bool) -> Column:
    """An author as compared with catalogs; sorted tokens make ``Doe, John`` and ``John Doe`` one."""
    plain = match_title(c)
    return F.array_join(F.array_sort(F.split(plain, " ")), " ") if sort_tokens else plain


def sender_email(c: Column) -> Column:
    """The address in ``Name <address>`` or the value itself, in lower case; NULL when blank."""
    inner = F.regexp_extract(c, r"<([^>]+)>", 1)
    return blank_to_null(F.lower(strip(F.when(inner != "", inner).otherwise(c))))


def bag_value(extra: Column, path: str) -> Column:
    """A value of the open bag as text; NULL where the bag is no JSON or has none."""
    return F.try_variant_get(F.try_parse_json(extra), path, "string")


#: Parts of host names and the source they belong to, in order of precedence (fixed values).
KNOWN_HOSTS = (
    ("arxiv.org", "arXiv"), ("biorxiv.org", "bioRxiv"), ("medrxiv.org", "medRxiv"), ("nature.com", "Nature"), ("science.org", "Science"), ("pnas.org", "PNAS"), ("acs.org", "ACS"), ("rsc.org", "RSC"),
    ("springer.com", "Springer"), ("springernature.com", "Springer"), ("wiley.com", "Wiley"), ("elsevier.com", "Elsevier"), ("cell.com", "Cell"), ("sciencedirect.com", "ScienceDirect"),
)


def source_from_url(c: Column) -> Column:
    """The known source of a host, else the first label of the host, capitalized."""
    host = F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    label = F.substring_index(F.replace(host, F.lit("www."), F.lit("")), ".", 1)
    known = F.lit(None).cast("string")
    for part, name in reversed(KNOWN_HOSTS):
        known = F.when(host.contains(part), F.lit(name)).otherwise(known)
    return F.coalesce(known, F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 1_000_000))))


def source_from_sender(sender: Column, names: dict[str, str], allowed: list[str]) -> Column:
    """The mapped name of an address; else, for allowed ones, its local part in title case; else NULL."""
    address = sender_email(sender)
    mapped = F.lit(None).cast("string")
    for email, name in names.items():
        mapped = F.when(address == email.lower(), F.lit(name)).otherwise(mapped)
    local = F.regexp_replace(F.substring_index(address, "@", 1), "[-_]", " ")
    # upper case after anything that is no letter, as in title case
    pieces = F.regexp_extract_all(local, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    titled = F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")
    return F.coalesce(mapped, F.when(address.isin(*[a.lower() for a in allowed]) if allowed else F.lit(False), titled))


def identity_keys(doi: Column, url: Column, title: Column) -> Column:
    """``array<struct<kind, value>>``: DOI, URL and, only without a DOI, the title."""
    d, u, t = normalize_doi(doi), normalize_url(url), blank_to_null(normalize_title(title))
    entry = lambda kind, value, when: F.when(when, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    return F.array_compact(F.array(entry("doi", d, d.isNotNull()), entry("url", u, u.isNotNull()), entry("title", t, d.isNull() & t.isNotNull())))


def export_keys(doi: Column, title: Column, day: Column, url: Column) -> Column:
    """The keys a record is looked up by in a library: the DOI alone, else title with date and URL."""
    d, td, u = normalize_doi(doi), title_date_key(title, F.date_format(day, "yyyy-MM-dd")), normalize_url(url)
    entry = lambda kind, value, when: F.when(when, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    return F.when(d.isNotNull(), F.array(F.struct(F.lit("doi").alias("kind"), d.alias("value")))).otherwise(F.array_compact(F.array(entry("title_date", td, td.isNotNull()), entry("url", u, u.isNotNull()))))


def library_keys(doi: Column, title: Column, day: Column, url: Column) -> Column:
    """All keys a library item is registered under: DOI, title with date, URL."""
    d, td, u = normalize_doi(doi), title_date_key(title, day), normalize_url(url)
    entry = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    return F.array_compact(F.array(entry("doi", d), entry("title_date", td), entry("url", u)))
