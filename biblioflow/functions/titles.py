"""Titles as they are compared: forms for search, vectors, and the exact test of a pair (plain Python and numpy)."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

from biblioflow.functions.names import slip

#: Status marks that titles carry before and after publication (fixed values).
_STATUS = r"(?:asap|just accepted|in press|early access|ahead of print|accepted manuscript|revised version|revised|preprint|online first|corrected proof|revisiting)"
_STATUS_HEAD = re.compile(rf"^\W*{_STATUS}\b\W*", re.I)
_STATUS_TAIL = re.compile(rf"[\s\-–—:,.]*[\[(]?\b{_STATUS}\b[\])]?\W*$", re.I)
_MAY_HAVE_STATUS = re.compile(r"asap|accept|press|early|ahead|revis|preprint|online|proof")
_MARKUP = re.compile(r"</?[A-Za-z][A-Za-z0-9:]{0,15}(?: [^<>]*)?/?>")
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
_CJK = r"぀-ヿ㐀-鿿가-힯"
_TOKEN = re.compile(rf"[{_CJK}]|(?:(?![{_CJK}_])\w)+")
_SUBTITLE = re.compile(r"\s*(?::|：|\s[–—-]\s|\. )")
#: Words that make a title another work's: notices and numbered parts (fixed values).
NOTICES = {"erratum", "errata", "correction", "corrigendum", "corrigenda", "retraction", "addendum", "expression", "editorial", "comment", "commentary", "reply", "response", "withdrawal", "withdrawn"}
#: Words that link what a title is about; replacing or dropping them alone makes no other work (fixed values).
LINKS = frozenset(
    "a an the of in on at by for from to with within via as and or its using through under into upon during over between among toward towards revealed studied based "
    "der die das den dem des ein eine einer von vom zu zur zum im in mit durch für aus bei und mittels le la les un une du de des d l en dans par pour avec sur et au aux "
    "el los las una unos del con por para y sobre mediante o os as um uma do da dos das no na em com e и в во на с со по для из от при методом".split()
)
_PART = re.compile(r"\b(?:part|teil|parte|partie|часть|pt|volume|vol|no|supplement)\W{0,2}([0-9]+|[ivx]+)\b")

BUCKETS, DIMENSIONS = 1 << 16, 128


def match_form(title: str | None) -> str:
    """A title without markup and status marks, compatibility forms and case made one, single spaces."""
    text = _MARKUP.sub(" ", title) if title and "<" in title else title or ""
    if not text.isascii():
        text = _CONTROL.sub(" ", unicodedata.normalize("NFKC", text))
    text = " ".join(text.upper().lower().replace("ς", "σ").split())
    while _MAY_HAVE_STATUS.search(text) and (shorter := _STATUS_TAIL.sub("", _STATUS_HEAD.sub("", text))) != text and shorter:
        text = shorter
    return text.strip(" .*…'\"“”«»‘’")


def head_of(form: str) -> str | None:
    """The main title of a form with a subtitle, if it has at least four tokens of its own."""
    cut = _SUBTITLE.search(form)
    head = form[: cut.start()] if cut else None
    return head if head and len(_TOKEN.findall(head)) >= 4 else None


@lru_cache(maxsize=50_000)
def tokens(form: str) -> tuple[str, ...]:
    """Words of letters and digits; each CJK character is a token."""
    return tuple(_TOKEN.findall(form))


def trigram_buckets(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of every letter trigram of the given forms, word borders included."""
    padded = [" " + re.sub(r"[\W_]+", " ", f) + " " for f in forms]
    lengths = np.array([len(p) for p in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFFFFFF)
    mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x2545F491)
    bucket = ((mixed >> np.uint64(13)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    rows = np.repeat(np.arange(len(padded)), lengths)[:-2]
    inside = np.repeat(np.cumsum(lengths), lengths)[:-2] - np.arange(len(codes) - 2) >= 3
    return rows[inside], bucket[inside]


def trigram_weights(forms: list[str]) -> np.ndarray:
    """Inverse document frequencies of trigram buckets in a sample of forms."""
    rows, buckets = trigram_buckets(forms)
    pairs = np.unique(rows * BUCKETS + buckets)
    df = np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    return np.log((len(forms) + 5) / (df + 5)).clip(0.1).astype(np.float32)  # unseen ones, slips mostly, weigh as rare ones


_PLACE = ((np.arange(BUCKETS, dtype=np.uint64) * np.uint64(2654435761)) >> np.uint64(7)) & np.uint64(2 * DIMENSIONS - 1)


def vectors(forms: list[str], weights: np.ndarray) -> np.ndarray:
    """Unit vectors of weighted trigram counts, folded into ``DIMENSIONS`` signed places."""
    rows, buckets = trigram_buckets(forms)
    place = _PLACE[buckets].astype(np.int64)
    sign = np.where(place & 1, 1.0, -1.0)
    out = np.bincount(rows * DIMENSIONS + (place >> 1), weights=sign * weights[buckets], minlength=len(forms) * DIMENSIONS)
    out = out[: len(forms) * DIMENSIONS].reshape(len(forms), DIMENSIONS).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _kind(form: str, words: tuple[str, ...]) -> tuple[frozenset[str], frozenset[str]]:
    return frozenset(w for w in words[:3] if w in NOTICES), frozenset(_PART.findall(form))


def _near(a: str, b: str) -> bool:
    """Equal, or slips that keep most of a word: one for each five letters."""
    if a == b or slip(a, b):
        return a == b or min(len(a), len(b)) >= 3
    return min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 2 and _edit_distance(a, b, 2) <= 2


def _edit_distance(a: str, b: str, limit: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours; ``limit + 1`` where there are more."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1]


def title_changes(a: tuple[str, ...], b: tuple[str, ...], rare) -> tuple[int, int, int, bool] | None:
    """``(slips, rewordings, omissions, whether those are of linking words only)`` between two token lists; None where they tell different works.

    A replaced word is a slip if its letters are near, else a rewording; a rewording of one rare word by
    another, or of anything by a number or formula, means different works.
    """
    slips = reworded = omitted = 0
    linking = True
    for op, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        left, right = a[i1:i2], b[j1:j2]
        if op != "replace":
            omitted += len(left) + len(right)
            linking &= LINKS.issuperset(left + right)
            continue
        if "".join(left) == "".join(right):
            continue
        numbers = any(c.isdigit() for c in "".join(left)), any(c.isdigit() for c in "".join(right))
        if not any(numbers) and _near("".join(left), "".join(right)):
            slips += 1
            continue
        if all(numbers):
            return None
        pairs = list(zip(left, right)) if len(left) == len(right) else ()
        if pairs and all(_near(x, y) and not (x != y and any(c.isdigit() for c in x + y)) for x, y in pairs):
            slips += sum(x != y for x, y in pairs)
            continue
        # words of the longer side that have a near one opposite are slips; what remains was reworded or left out
        rest_left = [x for x in left if not any(_near(x, y) for y in right)]
        rest_right = [y for y in right if not any(_near(x, y) for x in left)]
        slips += min(len(left) - len(rest_left), len(right) - len(rest_right))
        if rest_left and rest_right and (any(map(rare, rest_left)) and any(map(rare, rest_right)) or any(c.isdigit() for c in "".join(rest_left + rest_right))):
            return None
        reworded += min(len(rest_left), len(rest_right))
        omitted += abs(len(rest_left) - len(rest_right))
        linking &= LINKS.issuperset(rest_left + rest_right)
    return slips, reworded, omitted, linking


@lru_cache(maxsize=50_000)
def _numbers(words: tuple[str, ...]) -> frozenset[str]:
    return frozenset(w for w in words if w.isdigit())


@lru_cache(maxsize=50_000)
def _rare_words(words: tuple[str, ...], rare) -> frozenset[str]:
    return frozenset(w for w in words if rare(w))


def _may_match(a: tuple[str, ...], b: tuple[str, ...], rare) -> bool:
    """False where the numbers, or all the rare words, of two titles are different ones."""
    left, right = _numbers(a), _numbers(b)
    if left and right and not left <= right and not right <= left:
        return False
    left, right = _rare_words(a, rare), _rare_words(b, rare)
    return not left or not right or not left.isdisjoint(right) or any(_near(x, y) for x in left for y in right)


def same_title(a: str, b: str, rare) -> int:
    """0: different works. 1: the same title. 2: the same title only if the dates agree as well.

    Both are match forms. Slips and one rewording or omission leave a title the same, and so does a lost
    subtitle; up to two more such changes need the dates, unless they are of linking words only.
    """
    if a == b:
        return 1
    ta, tb = tokens(a), tokens(b)
    small = min(len(ta), len(tb))
    if not _may_match(ta, tb, rare):
        return 0
    if small < 3 or 5 * len(set(ta) & set(tb)) < 2 * min(len(set(ta)), len(set(tb))) or _kind(a, ta) != _kind(b, tb):
        return 0
    best = 0
    for x, y, lost in ((a, b, False), (head_of(a), b, True), (a, head_of(b), True)):
        if x is None or y is None:
            continue
        tx, ty = (ta if x is a else tokens(x)), (tb if y is b else tokens(y))
        if lost and not any(map(rare, tx)):
            continue
        changes = title_changes(tx, ty, rare)
        if changes is None:
            continue
        slips, reworded, omitted, linking = changes
        size = min(len(tx), len(ty))
        if slips > max(2, size // 4) or slips + reworded + omitted > size // 2:
            continue
        if reworded + omitted <= (0 if lost else 1):
            best = 1
        elif reworded <= 2 and omitted <= 2 and reworded + omitted <= 3:
            best = 1 if linking else best or 2
    return best
