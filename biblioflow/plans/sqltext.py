"""DuckDB expressions equal to the scalar functions; the correctness queries are built from them."""

from __future__ import annotations

from html.entities import html5

from biblioflow.functions.text import KNOWN_HOSTS, TITLE_NOISE, TRACKING
from biblioflow.operators.keywords import SYNONYMS

DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def extract_doi(x: str) -> str:
    return f"nullif(regexp_extract({x}, '{DOI}'), '')"


def normalize_doi(x: str) -> str:
    raw = strip(x)
    bare = rf"CASE WHEN contains(lower({raw}), 'doi.org/') THEN regexp_replace({raw}, '(?is)^.*doi\.org/', '') ELSE regexp_replace({raw}, '(?i)^doi:', '') END"
    return f"nullif(lower(regexp_replace({extract_doi(bare)}, '[).,;]+$', '')), '')"


def normalize_title(x: str) -> str:
    bare = rf"regexp_replace({strip(f'lower({x})')}, '\b({'|'.join(TITLE_NOISE)})\b', '', 'g')"
    return f"coalesce({collapse(f"regexp_replace({bare}, '{NOT_WORD}', ' ', 'g')")}, '')"


def clean_title(x: str) -> str:
    return strip(rf"regexp_replace({x}, '^\[.*?\]\s*', '')")


def _sql_map(table: dict, quote_keys: bool = True) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(k) if quote_keys else k}: {quoted(v)}" for k, v in table.items()) + "}"


def unescape(x: str) -> str:
    """Entities as browsers resolve them, piece by piece: numbers, names with a semicolon, and old names without."""
    c1 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    number = f"coalesce(({_sql_map(c1, False)})[n], CASE WHEN n IS NULL OR n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN n BETWEEN 1 AND 8 OR n IN (11, 127) OR n BETWEEN 14 AND 31 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END)"
    old = {k: v for k, v in html5.items() if not k.endswith(";")}
    begins = " ".join(f"WHEN ({_sql_map({k: v for k, v in old.items() if len(k) == n})})[name[1:{n}]] IS NOT NULL THEN ({_sql_map({k: v for k, v in old.items() if len(k) == n})})[name[1:{n}]] || name[{n + 1}:]" for n in sorted({len(k) for k in old}, reverse=True))
    named = f"CASE WHEN ({_sql_map(html5)})[name] IS NOT NULL THEN ({_sql_map(html5)})[name] {begins} ELSE '&' || name END"
    value = "CASE WHEN regexp_matches(p, '^&#[0-9]') THEN try_cast(regexp_extract(p, '[0-9]+') AS BIGINT) ELSE try_cast('0x' || regexp_extract(p, '[xX]([0-9A-Fa-f]+)', 1) AS BIGINT) END"
    piece = rf"CASE WHEN regexp_matches(p, '^&#([0-9]+|[xX][0-9A-Fa-f]+);?$') THEN list_transform([{value}], lambda n: {number})[1] WHEN regexp_matches(p, '^&[^#]') THEN list_transform([p[2:]], lambda name: {named})[1] ELSE p END"
    return rf"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(regexp_extract_all({x}, '&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[^\t\n\f <&#;]{{1,32}};?|[^&]+|&'), lambda p: {piece}), '') ELSE {x} END"


def clean_abstract(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({unescape(x)}, '<[^>]+>', '', 'g'), 'https?://doi\.org/\S+', '', 'g')"
    return f"nullif({collapse(rf"regexp_replace({bare}, 'DOI:\s*\S+', '', 'g')")}, '')"


def normalize_url(x: str) -> str:
    raw = f"nullif({strip(x)}, '')"
    host = rf"regexp_extract({raw}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
    scheme = rf"coalesce(nullif(regexp_extract({raw}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), ''), 'https')"
    path = rf"regexp_replace(regexp_replace(regexp_extract({raw}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '')"
    query = rf"regexp_extract({raw}, '^[^?#]*\?([^#]*)', 1)"
    pairs = f"list_transform(list_filter(string_split({query}, '&'), lambda p: p <> ''), lambda p: {{'low': lower(split_part(p, '=', 1)), 'v': regexp_extract(p, '^[^=]*=(.*)$', 1), 'k': split_part(p, '=', 1)}})"
    kept = f"list_sort(list_filter({pairs}, lambda p: NOT starts_with(p.low, 'utm_') AND p.low NOT IN ({quoted(*TRACKING)})))"
    joined = f"array_to_string(list_transform({kept}, lambda p: p.k || '=' || p.v), '&')"
    doi = f"CASE WHEN contains(lower({raw}), 'doi.org/') THEN {normalize_doi(raw)} END"
    return f"CASE WHEN {doi} IS NOT NULL THEN 'https://doi.org/' || {doi} WHEN {host} = '' THEN regexp_replace({raw}, '/+$', '') ELSE lower({scheme}) || '://' || lower({host}) || {path} || CASE WHEN {joined} <> '' THEN '?' || {joined} ELSE '' END END"


def date_text(x: str) -> str:
    plain = f"regexp_replace({strip(x)}, '[./]', '-', 'g')"
    ymd, ym, y = r"\b((?:19|20)\d{2})-(\d{1,2})-(\d{1,2})\b", r"\b((?:19|20)\d{2})-(\d{1,2})\b", r"\b((?:19|20)\d{2})\b"
    part = lambda p, i: f"regexp_extract({plain}, '{p}', {i})"
    two = lambda p, i: f"lpad({part(p, i)}, 2, '0')"
    return f"CASE WHEN regexp_matches({plain}, '{ymd}') THEN {part(ymd, 1)} || '-' || {two(ymd, 2)} || '-' || {two(ymd, 3)} WHEN regexp_matches({plain}, '{ym}') THEN {part(ym, 1)} || '-' || {two(ym, 2)} WHEN regexp_matches({plain}, '{y}') THEN {part(y, 1)} END"


def title_date(title: str, day: str) -> str:
    name = f"nullif({normalize_title(title)}, '')"
    return f"{name} || '|' || {day}"


def norm_text(x: str) -> str:
    return collapse(f"regexp_replace(regexp_replace(lower({x}), '[-_]', ' ', 'g'), '{NOT_WORD}', ' ', 'g')")


def match_title(x: str) -> str:
    return collapse(f"regexp_replace(lower({x}), '{NOT_WORD}', '', 'g')")


def words(x: str) -> str:
    return f"list_distinct(list_filter(string_split(coalesce({x}, ''), ' '), lambda w: w <> ''))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {both}::DOUBLE / (len({a}) + len({b}) - {both}) ELSE 0.0 END"


def stem(w: str) -> str:
    cut = lambda k: f"{w}[:-{k + 1}]"
    n = f"length({w})"
    return f"CASE WHEN {w} LIKE '%ies' AND {n} > 3 THEN {cut(3)} || 'y' WHEN {w} LIKE '%es' AND {n} > 2 THEN {cut(2)} WHEN {w} LIKE '%s' AND {n} > 2 AND {w} NOT LIKE '%ss' THEN {cut(1)} WHEN {w} LIKE '%ed' AND {n} > 2 THEN {cut(2)} WHEN {w} LIKE '%ing' AND {n} > 3 THEN {cut(3)} ELSE {w} END"


def stems(x: str) -> str:
    return f"list_distinct(list_transform({words(x)}, lambda w: {stem('w')}))"


def with_synonyms(x: str) -> str:
    table = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SYNONYMS.items()) + "}"
    return f"list_distinct(list_concat({words(x)}, list_filter(list_transform({words(x)}, lambda w: {table}[w]), lambda s: s IS NOT NULL)))"


def source_from_url(x: str) -> str:
    host = rf"lower(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
    label = f"split_part(replace({host}, 'www.', ''), '.', 1)"
    known = " ".join(f"WHEN contains({host}, '{part}') THEN '{name}'" for part, name in KNOWN_HOSTS)
    return f"CASE {known} ELSE upper({label}[1:1]) || lower({label}[2:]) END"


def mapped(x: str, names: dict[str, str]) -> str:
    return f"CASE {' '.join(f"WHEN {x} = '{a}' THEN '{b}'" for a, b in names.items())} ELSE 'journalArticle' END"
