"""Visually identical text: one consistent form, made by DuckDB inside Arrow partitions, and the documents it unites."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflow.session import cut_lineage

#: Letters that are displayed alike (fixed values): Cyrillic, Greek and Armenian letters and their Latin looks.
LOOKALIKES = (
    ("асԁеһіјӏоԛрѕԝхуүёїѐѝ", "acdehijloqpswxyyëïèì"),
    ("АВСЕԌНІЈКМОРԚЅТԜХУҮЁЇЀЍ", "ABCEGHIJKMOPQSTWXYYËÏÈÌ"),
    ("ονϳ", "ovj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺͿ", "ABEZHIKMNOPTYXCMJ"),
    ("օ", "o"),
    ("µ∆∑∏ÐƉ", "μΔΣΠĐĐ"),
    ("‐‑", "--"),
)
#: Characters that are displayed as nothing (fixed ranges).
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0001}-\x{E007F}\x{E0100}-\x{E01EF}]"
#: Spaces other than the ordinary one, and letters and patterns that are displayed as a blank (fixed values).
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u115f\u1160\u3164\uffa0\u2800"
#: Compatibility forms that look like what they stand for: wide and narrow forms, type faces of letters, forms of a letter by its place.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Blocks whose other compatibility forms do so as well: degree signs, Roman numerals, numbers with a full stop, leaders, ligatures (fixed values).
_SAME_LOOK_RANGES = ((0x2024, 0x2026), (0x2103, 0x2103), (0x2109, 0x2109), (0x2160, 0x217F), (0x2488, 0x249B), (0xFB00, 0xFB06), (0xFB13, 0xFB17))


@lru_cache(maxsize=1)
def compatibility_forms() -> dict[str, str]:
    """Characters and what they look like, by rule from the Unicode data. Raised, lowered and circled forms and fractions are visibly others."""
    forms: dict[str, str] = {}
    for o in range(0xA0, 0x20000):
        tag, _, _ = unicodedata.decomposition(chr(o)).partition(" ")
        if tag in _SAME_LOOK or any(lo <= o <= hi for lo, hi in _SAME_LOOK_RANGES):
            plain = unicodedata.normalize("NFKC", chr(o))
            # joined letters of scripts that join them look otherwise than the letters one by one
            if plain != chr(o) and (len(plain) == 1 or any(lo <= o <= hi for lo, hi in _SAME_LOOK_RANGES)):
                forms[chr(o)] = plain
    return forms


@lru_cache(maxsize=1)
def translation() -> tuple[tuple[str, str], tuple[str, str]]:
    """Arguments of ``translate``: what texts often have (wide forms, spaces, look-alikes), and rare compatibility forms."""
    look = {c: plain for strange, shown in LOOKALIKES for c, plain in zip(strange, shown, strict=True)}
    forms = {c: look.get(plain, plain) for c, plain in compatibility_forms().items() if len(plain) == 1}
    usual = {c: p for c, p in forms.items() if 0xFF00 <= ord(c) <= 0xFFEF} | {c: " " for c in SPACES} | look
    rare = {c: p for c, p in forms.items() if c not in usual}
    return ("".join(usual), "".join(usual.values())), ("".join(rare), "".join(rare.values()))


@lru_cache(maxsize=1)
def translation_table() -> dict[int, str]:
    """The same for Python's own ``translate``, forms of several letters included."""
    (a, b), (c, d) = translation()
    return str.maketrans(dict(zip(a + c, b + d)) | longer_forms())


@lru_cache(maxsize=1)
def longer_forms() -> dict[str, str]:
    """Compatibility forms of several letters in one character."""
    return {c: plain for c, plain in compatibility_forms().items() if len(plain) > 1 and c not in SPACES}


def _ranges(chars: str) -> str:
    """The characters as ranges of a regular-expression class."""
    codes, out = sorted(set(map(ord, chars))), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The DuckDB expression for the consistent form of ``column``.

    Invisible characters go first, so that a base letter meets its combining accent; full-width forms and
    look-alikes become ordinary letters; composition comes last. Case, accents, digits and raised or
    lowered signs stay as they are.
    """
    usual, rare = translation()
    expr = f"regexp_replace({column}, {_quoted(INVISIBLE)}, '', 'g')"
    expr = f"translate({expr}, {_quoted(usual[0])}, {_quoted(usual[1])})"
    few = f"translate(x, {_quoted(rare[0])}, {_quoted(rare[1])})"
    for one, many in longer_forms().items():
        few = f"replace({few}, {_quoted(one)}, {_quoted(many)})"
    some = "[" + _ranges("".join(longer_forms()) + rare[0]) + "]"  # few texts have any: only these go through the long tables
    expr = f"list_transform([{expr}], lambda x: CASE WHEN regexp_matches(x, {_quoted(some)}) THEN {few} ELSE x END)[1]"
    expr = f"regexp_replace(replace({expr}, chr(13) || chr(10), chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g')"
    return f"nfc_normalize(trim({expr}, chr(32) || chr(9) || chr(10)))"


def _duckdb():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def _each_batch(batches: Iterator[pa.RecordBatch], sql: str) -> Iterator[pa.RecordBatch]:
    """``sql`` over each Arrow batch, registered as ``batch``, in one embedded database per task."""
    connection = _duckdb()
    try:
        for batch in batches:
            connection.register("batch", pa.Table.from_batches([batch]))
            yield from connection.sql(sql).to_arrow_table().to_batches()
            connection.unregister("batch")
    finally:
        connection.close()


def consistent_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, form, changed)``: the consistent form of every text, and whether it differs from the stored one.

    NULL text has a NULL form and counts as unchanged; blank text has an empty form.
    """
    sql = f"SELECT _key, form, coalesce(form <> _text, false) AS changed FROM (SELECT _key, _text, {form_sql('_text')} AS form FROM batch)"
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    return rows.mapInArrow(lambda it: _each_batch(it, sql), f"_key {kind}, form string, changed boolean").withColumnRenamed("_key", key)


def text_hashes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(_key, _text_hash, _form_hash)`` of each non-NULL text; only these 128-bit digests are kept and shuffled later on."""
    sql = f"SELECT _key, md5(_text) AS _text_hash, md5({form_sql('_text')}) AS _form_hash FROM batch"
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    return rows.mapInArrow(lambda it: _each_batch(it, sql), f"_key {kind}, _text_hash string, _form_hash string")


def _variants(hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per stored text its smallest key and count; and those texts whose form is stored in more than one way."""
    texts = hashes.groupBy("_form_hash", "_text_hash").agg(F.min("_key").alias("_rep"), F.count(F.lit(1)).alias("_n"))
    forms = texts.groupBy("_form_hash").agg(F.count(F.lit(1)).alias("_ways"), F.min("_rep").alias("_class"), F.sum("_n").alias("_docs"))
    return texts, forms


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, class_id, variant_id, copies, variants)``: one row per document with text.

    ``class_id`` is the smallest key that looks the same, ``variant_id`` the smallest key with the same stored
    text, ``copies`` the documents and ``variants`` the stored texts of the class. Hot classes are combined
    before the shuffle.
    """
    hashes = cut_lineage(text_hashes(df, key, text))
    texts, forms = _variants(hashes)
    known = texts.join(forms, "_form_hash").select("_text_hash", F.col("_class").alias("class_id"), F.col("_rep").alias("variant_id"), F.col("_docs").alias("copies"), F.col("_ways").alias("variants"))
    return hashes.select("_key", "_text_hash").join(known, "_text_hash").select(F.col("_key").alias(key), "class_id", "variant_id", "copies", "variants")


def lookalike_links(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(class_id, variant_id)``: each further stored text of a class, by its first holder, with the class's first holder: V - 1 rows for V texts."""
    texts, forms = _variants(cut_lineage(text_hashes(df, key, text)))
    return texts.join(forms.where(F.col("_ways") > 1), "_form_hash").where(F.col("_rep") != F.col("_class")).select(F.col("_class").alias("class_id"), F.col("_rep").alias("variant_id"))


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key_a, key_b)``, smaller first: documents whose stored texts differ but look the same.

    Each document is paired with the first holder of every other stored text of its class, so exact copies
    add rows in proportion to their number, not to its square. Every two different texts of a class are a
    pair, by their first holders; ``lookalike_links`` and ``lookalike_classes`` say the same in as many rows
    as there are texts and documents. Documents whose form is stored one way only are left out before the join.
    """
    hashes = cut_lineage(text_hashes(df, key, text))
    texts, forms = _variants(hashes)
    several = texts.join(forms.where(F.col("_ways") > 1).select("_form_hash"), "_form_hash")
    members = hashes.join(several.select("_text_hash"), "_text_hash", "left_semi")
    others = several.select(F.col("_form_hash").alias("_f"), F.col("_text_hash").alias("_t"), F.col("_rep"))
    met = members.join(others, (F.col("_form_hash") == F.col("_f")) & (F.col("_text_hash") != F.col("_t")))
    return met.select(F.least("_key", "_rep").alias(f"{key}_a"), F.greatest("_key", "_rep").alias(f"{key}_b")).distinct()
