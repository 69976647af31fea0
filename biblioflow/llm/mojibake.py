"""Garbled text from a wrong charset: round-trip repair, layer by layer, accepted when a garbling cost drops."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioflow.functions.damage import LEGACY_CHARSETS, byte_table, charset_suspect, is_single_byte

#: Most layers of wrong decoding that are undone.
MAX_LAYERS = 4

_COMMON = set("°±²³¹µ·«»¿¡©®§–—‐‑“”‘’‚„…•™€£№ 　。，、：；（）！？《》「」″′×÷≈≤≥→∞−")


@lru_cache(maxsize=32)
def _machinery(charset: str) -> tuple[dict[str, int], re.Pattern[str]]:
    """The byte table of a charset and the pattern of UTF-8 sequences misread under it."""
    table = byte_table(charset)
    pick = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b < hi) + "]"
    tail = pick(0x80, 0xC0)
    return table, re.compile(f"(?:{pick(0xC2, 0xE0)}{tail}|{pick(0xE0, 0xF0)}{tail}{{2}}|{pick(0xF0, 0xF5)}{tail}{{3}})+")


def _weight(c: str) -> float:
    """What a character costs: nothing in ASCII, little where texts commonly have it, much where only wrong charsets put it."""
    o = ord(c)
    if o < 0x80:
        return 0.0
    if o == 0xFFFD or o < 0xA0:
        return 4.0
    if c in _COMMON:
        return 1.0
    if c.isalpha():
        if 0xC0 <= o <= 0x17F or 0x391 <= o <= 0x3C9 or 0x400 <= o <= 0x45F or o >= 0x3040 and o < 0xD7B0 or 0x1E00 <= o < 0x2000:
            return 1.0
        return 1.0 if 0x2070 <= o <= 0x209C or 0x2100 <= o < 0x2150 or 0xFF21 <= o <= 0xFF5A else 4.0
    if 0x2070 <= o <= 0x209C or 0x3000 <= o < 0x3040 or 0xFF01 <= o <= 0xFF65:
        return 1.0
    return 2.0


#: Latin and Cyrillic or Greek and Cyrillic in one word, or box drawing and mathematics between letters.
_MIXED = re.compile(r"[A-Za-zÀ-ſ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ſ]|[A-Za-zÀ-ſ][─-▟√∂∏∫≈◊]|[─-▟√∂∏∫≈◊][A-Za-zÀ-ſ]|[α-ω][Ѐ-ӿ]|[Ѐ-ӿ][α-ω]")


def garbling_cost(text: str) -> float:
    """The cost that an accepted repair has to lower."""
    return sum(map(_weight, text)) + 3.0 * len(_MIXED.findall(text))


#: A stretch of foreign characters, and the character after it, whose byte a charset of two bytes may have taken in.
_FOREIGN = re.compile(r"[^\x00-\x7f]+[\x40-\x7e]?")


def _undo(text: str, charset: str) -> str:
    """``text`` with every stretch that is strict UTF-8 under ``charset`` decoded as such."""
    if not is_single_byte(charset):

        def encoded(match: re.Match[str]) -> str:
            for stretch, rest in ((match.group(), ""), (match.group()[:-1], match.group()[-1:])):
                try:
                    return stretch.encode(charset).decode("utf-8") + rest
                except UnicodeError:
                    continue
            return match.group()

        return _FOREIGN.sub(encoded, text)
    table, pattern = _machinery(charset)

    def decode(match: re.Match[str]) -> str:
        if "\xa0\xa0" in match.group():  # a foreign letter before non-breaking spaces
            return match.group()
        try:
            return bytes(table[c] for c in match.group()).decode("utf-8")
        except UnicodeDecodeError:
            return match.group()

    return pattern.sub(decode, text)


#: What remains where bytes were lost before the text came here (control characters count too).
_LOST = re.compile(r"[�\x80-\x9f]|â[€‚»]|[a-zà-ÿ][ÃÂ](?=[ ,.;:]|$)")


def repair(text: str | None, charsets: tuple[str, ...] = LEGACY_CHARSETS) -> tuple[str | None, int, bool]:
    """``(text, layers, damaged)``: the best reading, how many layers were undone, and whether bytes stay lost.

    Each round tries every charset and keeps the reading of least cost, if that is below the cost before.
    Entities of garbled letters are resolved first and count only if a repair follows or bytes are lost.
    NULL stays NULL, sound text comes back as it is.
    """
    if not text or text.isascii() and "&" not in text:
        return text, 0, False
    current = html.unescape(text) if "&" in text else text
    start, layers, cost = current, 0, garbling_cost(current)
    while layers < MAX_LAYERS and not current.isascii():
        options = [(garbling_cost(t), t) for t in (_undo(current, c) for c in charsets) if t != current]
        if not options or (best := min(options))[0] >= cost:
            break
        (cost, current), layers = best, layers + 1
    damaged = bool(_LOST.search(current))
    return (current if layers else start if damaged else text), layers, damaged


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("layers", T.IntegerType()), T.StructField("damaged", T.BooleanType())])


def _repairing(charsets: tuple[str, ...]):
    @F.pandas_udf(_RESULT)
    def repair_batch(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(v, charsets) for v in values], columns=["text", "layers", "damaged"])

    return repair_batch


def garbled_values(df: DataFrame, key: str = "paper_id", fields: tuple[str, ...] = ("title", "abstract"), charsets: tuple[str, ...] = LEGACY_CHARSETS, wide: bool = False) -> DataFrame:
    """``(key, field_name, original, repaired, layers, recovered)``: one row per garbled value.

    ``charsets`` are those that text may have been misread under, of one byte a character or more. Only values in
    which the JVM sees a misread sequence of Latin, Greek, Cyrillic or CJK letters, or with ``wide`` of any, reach Python. ``recovered`` is false where
    bytes were lost, ``repaired`` then holds what could be restored. Absent and sound values give no row.
    """
    values = df.select(F.col(key).alias("_key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(charset_suspect(F.col(f), charsets, wide), F.col(f)).alias("original")) for f in fields])).alias("_v"))
    suspects = values.where(F.col("_v.original").isNotNull()).select("_key", "_v.field_name", "_v.original")
    fixed = suspects.withColumn("_r", _repairing(charsets)("original")).where((F.col("_r.layers") > 0) | F.col("_r.damaged"))
    return fixed.select(F.col("_key").alias(key), "field_name", "original", F.col("_r.text").alias("repaired"), F.col("_r.layers").alias("layers"), (~F.col("_r.damaged")).alias("recovered"))


def repair_columns(df: DataFrame, fields: tuple[str, ...] = ("title", "abstract"), charsets: tuple[str, ...] = LEGACY_CHARSETS, wide: bool = False) -> DataFrame:
    """``df`` with garbled values of ``fields`` replaced by their best reading; every other value is kept as stored."""
    out = df
    for f in fields:
        suspect = charset_suspect(F.col(f), charsets, wide)
        out = out.withColumn(f, F.when(suspect, _repairing(charsets)(F.when(suspect, F.col(f)))["text"]).otherwise(F.col(f)))
    return out
