"""Evidence of damage in stored text: endings left by a cut, sequences left by a wrong charset.

Everything here is ``Column -> Column`` and stays in generated JVM code. Operators that repair text or
fit models build on these signals.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- charsets

#: Legacy charsets under which UTF-8 text is commonly misread (fixed values).
LEGACY_CHARSETS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437")


def byte_table(charset: str) -> dict[str, int]:
    """Character -> byte of the upper half of ``charset``.

    Bytes that the charset leaves undefined stand for the control character of the same number, as
    lenient decoders write them; for ``cp1252`` so does every byte below 0xA0, which makes the table
    cover ISO 8859-1 as well.
    """
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if charset == "cp1252":
        out.update({chr(b): b for b in range(0x80, 0xA0)})
    return out


def _char_class(chars) -> str:
    """A regular-expression class of the characters, as few ranges as possible."""
    codes, ranges = sorted({ord(c) for c in chars}), []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in ranges) + "]"


def _utf8_sequences(charset: str, two: range, three: range, four: range = range(0xF0, 0xF5)) -> str:
    table = byte_table(charset)
    pick = lambda bytes_: _char_class(c for c, b in table.items() if b in bytes_)
    tail = pick(range(0x80, 0xC0))
    return f"{pick(two)}{tail}|{pick(three)}{tail}{{2}}|{pick(four)}{tail}{{3}}"


#: Lead bytes of two and three byte sequences that text in Latin, Greek, Cyrillic and CJK letters has, by charset; under the others of
#: these charsets more leads would match ordinary foreign words. ``wide`` takes every lead that UTF-8 has.
_USUAL_LEADS = {"cp1252": (range(0xC2, 0xD4), range(0xE0, 0xF0)), "cp1250": (range(0xC2, 0xD4), range(0xE0, 0xF0))}
_OTHER_LEADS, _ALL_LEADS = (range(0xC2, 0xD4), range(0xE2, 0xEA)), (range(0xC2, 0xE0), range(0xE0, 0xF0))


def is_single_byte(charset: str) -> bool:
    """Whether every byte of a charset is a character of its own."""
    return all(len(bytes([b, b]).decode(charset, "replace")) == 2 for b in range(0x80, 0x100))


def _misread_as(charset: str, wide: bool) -> str:
    """UTF-8 sequences as a charset shows them; where characters have two bytes, any character beyond Latin, Greek and Cyrillic."""
    if not is_single_byte(charset):
        return r"[\x{3000}-\x{9fff}\x{ac00}-\x{d7a3}\x{ff61}-\x{ff9f}]"
    return _utf8_sequences(charset, *(_ALL_LEADS if wide else _USUAL_LEADS.get(charset, _OTHER_LEADS)))


#: What no charset gives for sound text: replacement and C1 control characters, a misread letter whose
#: second byte was lost, and entities of such letters.
_BROKEN = r"[\x{fffd}\x{80}-\x{9f}]|(?<=[a-z])[\x{c3}\x{c2}](?=[ ,.;:]|$)|\x{e2}[\x{20ac}\x{201a}\x{bb}]"
_BROKEN_ENTITIES = r"&(?:ETH|Ntilde|Atilde|Acirc|acirc|Aring|aring|ccedil|euro|Icirc|eth|AElig|aelig|egrave|eacute|#(?:19[4-9]|2[0-4][0-9]|[38][0-9]{2,3}));(?:&#?[A-Za-z0-9]+;|[\x{80}-\x{bf}])"
@lru_cache(maxsize=8)
def _suspects(charsets: tuple[str, ...], wide: bool) -> str:
    """ASCII characters fail the first test, so the alternatives are tried at foreign characters only."""
    return rf"(?=[^\x{{0}}-\x{{7f}}])(?:{_BROKEN}|{'|'.join(_misread_as(c, wide) for c in charsets)})"


def charset_suspect(c: Column, charsets: tuple[str, ...] = LEGACY_CHARSETS, wide: bool = False) -> Column:
    """True where the text may hold characters of a wrong charset; NULL gives false.

    With ``wide`` it is a superset of what repair confirms, and also meets ordinary words of some languages; without, it
    is narrow enough to judge values by.
    """
    return F.coalesce(c.rlike(_suspects(tuple(charsets), wide)) | (c.contains(";") & c.rlike(_BROKEN_ENTITIES)), F.lit(False))


# ---------------------------------------------------------------- endings

#: Marks of omission (fixed values).
_OMISSION = r"(?:…|\.\.\.|&#8230;|&hellip;|\[\s*(?:…|\.\.\.|&#8230;|&hellip;)\s*\])(?:\s*\(?(?:[Rr]ead|[Ss]ee|[Ss]how|[Ll]earn) [Mm]ore\)?|\s*\(?more\)?)?"
#: Notes that follow the last sentence (fixed values).
_NOTES = r"(?:©|\x{fffd} ?(?:19|20)[0-9]{2}\b|\(c\)|&copy;|[Cc]opyright|[Kk]ey ?words?\b|[Gg]raphical [Aa]bstract|[Tt]his (?:article|work) is|[Pp]ublished (?:by|under|online)|[Ss]upplementary|[Ss]upporting [Ii]nformation|\((?:[Pp]art of|[Ii]n |[Ff]rom |[Tt]ranslat))"
_STOP = r"[.!?。！？｡]"
_CLOSERS = r"[)\]\x{201d}\x{2019}\x{bb}\"'*]*"


def _misread(sign: str) -> list[str]:
    """How wrong charsets show a sign, once or twice over."""
    once = [sign.encode("utf-8").decode(e, "replace") for e in (*LEGACY_CHARSETS, "latin-1")]
    return sorted({*once, *(shown.encode("utf-8").decode(e, "replace") for shown, e in zip(once, (*LEGACY_CHARSETS, "latin-1")))})


#: The full stop of Chinese and Japanese, and the copyright sign that begins a note, as wrong charsets show them.
_MISREAD_STOPS = _misread("。")
_MISREAD_NOTE = "|".join(re.escape(s) for s in _misread("©"))
_ENTITY_STOPS = "|".join([re.escape("&atilde;&euro;&sbquo;"), re.escape("&atilde;\x80\x82")])

#: Ending classes; ``whole`` and ``note`` speak for a complete text, the others for a cut.
WHOLE, NOTE, OMITTED, OPEN = "whole", "note", "omitted", "open"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` needs it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without_tail(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:\s|\x{a0}|</[A-Za-z][A-Za-z0-9:]*>|<br ?/?>)+$", "")


#: Characters that an ending is looked for in first, and that must be left of them without closing markup and white space.
_WINDOW, _WINDOW_LEAST = 600, 300


def ending_text(c: Column) -> Column:
    """The end of a text without closing markup and white space; where a long tail of these fills the window, of the whole text."""
    whole = lambda near: F.when((F.length(near) >= _WINDOW_LEAST) | (F.length(c) <= _WINDOW), near).otherwise(F.substring(_without_tail(c), -_WINDOW, _WINDOW))
    return let(_without_tail(F.substring(c, -_WINDOW, _WINDOW)), whole)


_MISREAD_STOP = "|".join(re.escape(s) for s in _MISREAD_STOPS)
_NOTE_END = rf"(?s)(?:{_STOP}{_CLOSERS}|{_MISREAD_STOP}|{_ENTITY_STOPS})\s*(?:{_NOTES}|{_MISREAD_NOTE}|&Acirc;&copy;)(?:(?!{_STOP}\s).)*$"


def ends_in_stop(t: Column) -> Column:
    """Whether a text ends in the full stop, question or exclamation mark of a sentence, closing quotes and brackets aside."""
    return F.substring(t, -40, 40).rlike(rf"{_STOP}{_CLOSERS}$")


def class_of(t: Column, whole: Column) -> Column:
    """The ending class of ``whole``, whose ``ending_text`` is ``t``; NULL where that is empty."""
    last = lambda n: F.substring(t, -n, n)
    omitted = last(60).rlike(rf"{_OMISSION}$")
    before = F.regexp_replace(last(80), rf"\s*{_OMISSION}$", "")
    # a note longer than the window leaves no sentence end in it: only then the whole text is searched for its start
    long_note = (F.length(whole) > _WINDOW) & ~t.rlike(rf"{_STOP}\s") & _without_tail(whole).rlike(_NOTE_END)
    return (
        F.when(t == "", F.lit(None).cast("string"))
        .when(last(6).rlike(rf"(?:^|[^.]){_STOP}{_CLOSERS}$"), F.lit(WHOLE))
        .when(omitted, F.when(before.rlike(rf"{_STOP}{_CLOSERS}$"), F.lit(WHOLE)).otherwise(F.lit(OMITTED)))
        .when(last(40).rlike(rf"(?:{_STOP}{_CLOSERS}|{_MISREAD_STOP}|{_ENTITY_STOPS})$"), F.lit(WHOLE))
        .when(t.rlike(_NOTE_END) | long_note, F.lit(NOTE))
        .otherwise(F.lit(OPEN))
    )


def ending_class(c: Column) -> Column:
    """``whole``, ``note``, ``omitted`` or ``open``; NULL for absent and blank text."""
    return F.when(c.isNotNull(), let(ending_text(c), lambda t: class_of(t, c)))


def looks_cut(c: Column) -> Column:
    """True where the ending alone shows a cut in mid-word or mid-sentence; NULL and blank give false."""
    return F.coalesce(ending_class(c).isin(OMITTED, OPEN), F.lit(False))


def visible_length(c: Column) -> Column:
    """Characters of a text as displayed: markup does not count, entities count as one. NULL gives 0."""
    shown = F.regexp_replace(F.regexp_replace(c, r"</?[A-Za-z][^<>]*>", ""), r"&[A-Za-z]+;", "x")
    return F.coalesce(F.length(F.trim(F.when(c.contains("<") | c.contains("&"), shown).otherwise(c))), F.lit(0))
