"""Queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm import leakage, lookalike, mixing, mojibake, truncation
from biblioflow.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "papers"))


def p1_sources(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf, "papers"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled_values(table(spark, sf, "papers")).select("paper_id", "field_name")


def p2_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled_values(table(spark, sf, "papers"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_documents(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.removal_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leak_report(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_blocks(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf, "documents"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, sf, "documents"))


def p9_links(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalike_links(table(spark, sf, "documents"))


def p9_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every text, as its digest and length."""
    return lookalike.consistent_text(table(spark, sf, "documents")).select("doc_id", F.md5("form").alias("form_md5"), F.length("form").cast("long").alias("form_chars"), "changed")


QUERIES = {q.__name__: q for q in (p1_found, p1_sources, p2_found, p2_repaired, p7_found, p7_spans, p7_items, p8_mix, p8_blocks, p8_shares, p9_found, p9_links, p9_classes, p9_forms)}

#: The consistent form written another way, to check the operator's: character by character through a map. What a character
#: becomes is listed here by code points for letters that look alike, and taken from NFKC for compatibility forms.
_SAME = "0430 a 0441 c 0501 d 0435 e 04BB h 0456 i 0458 j 04CF l 043E o 051B q 0440 p 0455 s 051D w 0445 x 0443 y 04AF y 0451 EB 0457 EF 0450 E8 045D EC " \
    "0410 A 0412 B 0421 C 0415 E 050C G 041D H 0406 I 0408 J 041A K 041C M 041E O 0420 P 051A Q 0405 S 0422 T 051C W 0425 X 0423 Y 04AE Y 0401 CB 0407 CF 0400 C8 040D CC " \
    "03BF o 03BD v 03F3 j 0391 A 0392 B 0395 E 0396 Z 0397 H 0399 I 039A K 039C M 039D N 039F O 03A1 P 03A4 T 03A5 Y 03A7 X 03F9 C 03FA M 037F J 0585 o 00B5 3BC 2206 394 2211 3A3 220F 3A0 00D0 110 0189 110 2010 - 2011 -"
_BLANK = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x2800]
_NOTHING = [0xAD, 0x34F, 0x61C, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0001, 0xE0080), *range(0xE0100, 0xE01F0)]


def _character_map() -> dict[str, str]:
    import unicodedata

    shown = _SAME.split()
    same = {chr(int(a, 16)): b if len(b) == 1 else chr(int(b, 16)) for a, b in zip(shown[::2], shown[1::2])}
    joined = [*range(0x2024, 0x2027), 0x2103, 0x2109, *range(0x2160, 0x2180), *range(0x2488, 0x249C), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18)]
    out = {}
    for o in range(0xA0, 0x20000):
        kind, plain = unicodedata.decomposition(chr(o)).split(" ")[0], unicodedata.normalize("NFKC", chr(o))
        if plain != chr(o) and (o in joined or len(plain) == 1 and kind in ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")):
            out[chr(o)] = same.get(plain, plain)
    return out | same | {chr(o): " " for o in _BLANK} | {chr(o): "" for o in _NOTHING}


def _form_by_characters(column: str) -> str:
    quoted = lambda c: "'" + c.replace("'", "''") + "'"
    table = _character_map()
    literal = f"MAP {{{', '.join(f'{quoted(a)}: {quoted(b)}' for a, b in table.items())}}}"
    whole = f"array_to_string(list_transform(regexp_split_to_array({column}, ''), lambda c: CASE WHEN c < chr(160) THEN c ELSE coalesce(({literal})[c], c) END), '')"
    lines = f"array_to_string(list_transform(string_split(replace({whole}, chr(13) || chr(10), chr(10)), chr(10)), lambda l: rtrim(l, ' ' || chr(9))), chr(10))"
    return f"nfc_normalize(trim({lines}, ' ' || chr(9) || chr(10)))"


_FORM = "form"
_FORMS = f"forms AS MATERIALIZED (SELECT doc_id, text, {_form_by_characters('text')} AS form FROM documents)"

_WORDS = r"list_filter(list_transform(string_split_regex(lower({}), '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]+', '', 'g')), lambda w: w <> '')"
_GRAMS = "SELECT {0}, array_to_string(w[i:i+11], ' ') AS p FROM {1}, unnest(range(1, len(w) - 10)) AS t(i)"

ORACLES = {
    "p7_found": f"""WITH {_FORMS}, items AS (SELECT item_id, {_WORDS.format("string_split(text, chr(10) || chr(10))[2]")} AS w FROM eval_items), docs AS (SELECT doc_id, {_WORDS.format(_FORM)} AS w FROM forms),
        a AS ({_GRAMS.format("item_id", "items")}), b AS ({_GRAMS.format("doc_id", "docs")}) SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (p)""",
    "p9_classes": f"""WITH {_FORMS}, f AS (SELECT * FROM forms WHERE text IS NOT NULL), v AS (SELECT form, count(DISTINCT text) AS variants FROM f GROUP BY form)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY f.form) AS class_id, min(doc_id) OVER (PARTITION BY f.form, text) AS variant_id, count(*) OVER (PARTITION BY f.form) AS copies, variants FROM f JOIN v ON v.form = f.form""",
    "p9_forms": f"WITH {_FORMS} SELECT doc_id, md5(form) AS form_md5, length(form)::BIGINT AS form_chars, coalesce(form <> text, false) AS changed FROM forms",
    "p9_links": f"WITH {_FORMS}, v AS (SELECT form, text, min(doc_id) AS variant_id FROM forms WHERE text IS NOT NULL GROUP BY form, text), c AS (SELECT variant_id, min(variant_id) OVER (PARTITION BY form) AS class_id FROM v) SELECT class_id, variant_id FROM c WHERE class_id <> variant_id",
    "p9_found": f"""WITH {_FORMS}, f AS (SELECT * FROM forms WHERE text IS NOT NULL), v AS (SELECT form, text, min(doc_id) AS rep FROM f GROUP BY form, text)
        SELECT DISTINCT least(f.doc_id, v.rep) AS doc_id_a, greatest(f.doc_id, v.rep) AS doc_id_b FROM f JOIN v ON f.form = v.form AND f.text <> v.text""",
}
