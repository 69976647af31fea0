"""Names as typed by people: parts, nicknames, abbreviations and slips (plain Python, used inside Arrow batches)."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

#: Everyday short forms of given names (fixed values, without accents).
NICKNAMES = {
    "al": "albert", "alex": "alexander", "andy": "andrew", "tony": "anthony", "toni": "anthony", "ben": "benjamin", "benny": "benjamin", "bella": "isabella", "izzy": "isabella",
    "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "bill": "william", "billy": "william", "will": "william",
    "bob": "robert", "bobby": "robert", "rob": "robert", "cathy": "katherine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "charlie": "charles", "chuck": "charles", "chris": "christopher", "kit": "christopher",
    "dan": "daniel", "danny": "daniel", "dave": "david", "dick": "richard", "rick": "richard", "rich": "richard", "dima": "dmitri", "mitya": "dmitri", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward",
    "ellie": "eleanor", "nell": "eleanor", "nora": "eleanor", "etta": "henrietta", "hettie": "henrietta", "fati": "fatima", "fran": "francisco", "paco": "francisco", "pancho": "francisco", "fred": "frederick", "freddie": "frederick", "fritz": "frederick",
    "gabi": "gabriela", "gaby": "gabriela", "greg": "gregory", "hans": "johannes", "jan": "johannes", "hannes": "johannes", "harry": "henry", "hank": "henry", "jack": "john", "johnny": "john", "jackie": "jacqueline", "jacqui": "jacqueline",
    "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "kolya": "nikolai", "leo": "leonardo", "lotte": "charlotte", "lottie": "charlotte", "charly": "charlotte", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret",
    "matt": "matthew", "mike": "michael", "mick": "michael", "misha": "mikhail", "nick": "nicholas", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "pete": "peter", "raj": "rajesh", "ron": "ronald", "sam": "samuel", "sammy": "samuel",
    "sandy": "alexandra", "sasha": "alexandra", "lexi": "alexandra", "steve": "stephen", "sue": "susan", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "uli": "ulrich", "vitya": "viktor", "vic": "viktor", "vlad": "vladislav", "slava": "vladislav", "zhenya": "yevgenia",
}
#: Honorifics before and suffixes after a name (fixed values).
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "herr", "frau", "mme", "ing", "dipl", "phd", "md", "jr", "sr", "ii", "iii"}
#: Filler in author lists that names nobody (fixed values).
FILLER = {"", "et al", "and others", "others", "anonymous", "anon", "unknown", "na", "none", "author", "authors", "various", "staff"}
#: Stems of words that make a name an organisation's (fixed values).
ORGANISATION = ("univ", "inst", "labor", "consort", "cent", "ctr", "dept", "depart", "school", "academ", "college", "societ", "compan", "hospital", "faculty", "team", "group", "network", "collab", "agency", "council", "ministr", "foundation")
_SHORT_ORGANISATION = {"lab", "labs", "inst", "univ", "ctr", "dept", "gmbh", "inc", "ltd", "llc"}
#: Words that organisations are written with or without, and other spellings of the same stem (fixed values).
_LOOSE = {"of", "for", "the", "and", "de", "da", "do", "del", "der", "fur", "für", "in", "at", "on"}
_STEMS = {"ctr": "cen", "center": "cen", "centre": "cen"}

_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents, single spaces."""
    plain = unicodedata.normalize("NFKD", text.lower().translate(_PLAIN))
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())


@dataclass(frozen=True)
class Name:
    """``family`` and ``given`` of a person, or place and field stems of an organisation; ``rest`` holds further initials."""

    kind: str
    family: str
    given: str
    rest: str


def _organisation(words: list[str]) -> Name | None:
    keyword = [w in _SHORT_ORGANISATION or any(w.startswith(s) for s in ORGANISATION) for w in words]
    if len(words) < 3 or not any(keyword):
        return None
    place = len(words) - 1 if keyword[0] else 0
    stems = sorted({_STEMS.get(w, w[:3]) for i, w in enumerate(words) if i != place})
    return Name("organisation", words[place], " ".join(stems), "")


def parse_name(text: str | None) -> Name | None:
    """The parts of a stored name; None for filler, blank text and names of a single word.

    Understands ``Given Family``, ``Family, Given``, ``Family Given`` (settled later, by what is known of
    the family), initials with or without points and hyphens, honorifics, capitals and lost accents.
    """
    folded = fold(text or "")
    bare = re.sub(r"[^\w,\-' ]+", " ", folded.replace("’", "'"))
    words = [w for w in re.split(r"[ ,]+", bare) if w.strip("-'_")]
    if " ".join(words).strip() in FILLER or not words:
        return None
    if organisation := _organisation([w for w in words if w not in _LOOSE]):
        return organisation
    if "," in bare:
        family, _, given = bare.partition(",")
        family, given = family.split(), given.replace(",", " ").split()
    else:
        plain = bare.split()
        while len(plain) > 2 and plain[0] in TITLES:
            plain = plain[1:]
        if len(plain) >= 2 and len(plain[-1]) <= 2 and len(plain[0]) > 2 and plain[-1] not in TITLES and not re.search(r"\w\.", folded):
            family, given = plain[:1], list(plain[-1])
        else:
            family, given = plain[-1:], plain[:-1]
    family = [w for w in family if w not in TITLES]
    given = [w for w in given if w not in TITLES]
    if not family or not given:
        return None
    parts = [p for w in given for p in w.split("-") if p]
    first = parts[0]
    if len(first) > 1:
        first = NICKNAMES.get(first, first)
        joined = len(parts) > 1 and len(parts[1]) > 1
        return Name("person", " ".join(family), first + (" " + parts[1] if joined else ""), "".join(p[0] for p in parts[2 if joined else 1 :]))
    return Name("person", " ".join(family), "", "".join(p[0] for p in parts))


def slip(a: str, b: str) -> bool:
    """True if one letter inserted, left out, replaced or swapped with its neighbour turns one string into the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def deletions(word: str) -> list[str]:
    """The word and the word without each one letter: two words one slip apart share one of them."""
    return sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})
