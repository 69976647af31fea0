"""The keyword matcher of five strategies, and what keyword generation needs around a model call."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions.text import norm_text, words

#: Names and symbols of elements that stand for each other, one way each (fixed values).
SYNONYMS = {
    "zinc": "zn", "zn": "zinc", "lithium": "li", "li": "lithium", "sodium": "na", "na": "sodium", "potassium": "k", "k": "potassium", "manganese": "mn", "mn": "manganese", "iron": "fe", "fe": "iron",
    "cobalt": "co", "co": "cobalt", "nickel": "ni", "ni": "nickel", "copper": "cu", "cu": "copper", "aluminum": "al", "al": "aluminum", "aluminium": "al", "titanium": "ti", "ti": "titanium",
    "vanadium": "v", "v": "vanadium", "oxygen": "o", "o": "oxygen", "sulfur": "s", "s": "sulfur", "sulphur": "s", "carbon": "c", "c": "carbon", "silicon": "si", "si": "silicon",
    "phosphorus": "p", "p": "phosphorus", "magnesium": "mg", "mg": "magnesium", "calcium": "ca", "ca": "calcium",
}
#: Terms that match on their own when both sides have them (fixed values).
CORE_TERMS = ("operando", "in-situ", "insitu", "in situ", "synchrotron", "xas", "xanes", "exafs", "xrd")
#: Keywords kept at most.
MOST_KEYWORDS = 10


#: Endings, tried in this order, the letters a word must have more than, the letters that go, and what takes their place (fixed values).
ENDINGS = (("ies", 3, 3, "y"), ("es", 2, 2, ""), ("s", 2, 1, ""), ("ed", 2, 2, ""), ("ing", 3, 3, ""))


def stem(w: Column) -> Column:
    """A word without its first fitting ending; a double s is none."""
    out = w
    for ending, least, drop, instead in reversed(ENDINGS):
        fits = w.endswith(ending) & (F.length(w) > least) & (~w.endswith("ss") if ending == "s" else F.lit(True))
        out = F.when(fits, F.concat(F.substring(w, F.lit(1), F.length(w) - drop), F.lit(instead))).otherwise(out)
    return out


def stem_of(word: str) -> str:
    """The same of a word on the driver."""
    fitting = (word[:-drop] + instead for ending, least, drop, instead in ENDINGS if word.endswith(ending) and len(word) > least and not (ending == "s" and word.endswith("ss")))
    return next(fitting, word)


def stems(normal: Column) -> Column:
    return F.array_distinct(F.transform(words(normal), stem))


def _wider(held: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(SYNONYMS)), "map<string,string>")  # folded to one literal
    return F.array_union(held, F.array_compact(F.transform(held, lambda w: F.try_element_at(table, w))))


def with_synonyms(normal: Column) -> Column:
    """The words of a normalized text and one step of synonyms."""
    return _wider(words(normal))


def _keyword_forms(keyword: str) -> tuple[str, list[str], list[str], list[str]]:
    """The same forms of a keyword, on the driver: normalized text, words, stems, words with synonyms."""
    normal = " ".join(re.sub(r"[^\w\s]", " ", re.sub(r"[-_]", " ", keyword.lower())).split())
    each = list(dict.fromkeys(normal.split()))
    return normal, each, sorted({stem_of(w) for w in each}), sorted({*each, *(SYNONYMS[w] for w in each if w in SYNONYMS)})


def _holds_all(wanted: list[str], held: Column) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), held)) == 0 if wanted else F.lit(False)


def _words_match(normal: Column, forms: list[tuple[str, list[str], list[str], list[str]]]) -> Column:
    """All words, all stems or all words with synonyms of some keyword, or a core term on both sides; each form of the text is made once."""

    def tests(held: Column, stemmed: Column, wide: Column) -> Column:
        out = []
        for shown, each, stems_, synonyms in forms:
            out += [_holds_all(each, held), _holds_all(stems_, stemmed), _holds_all(synonyms, wide)]
            for term in sorted({t.replace("-", " ") for t in CORE_TERMS}):
                if set(term.split()) <= set(each) or term in shown:
                    out.append(_holds_all(term.split(), held))
        return reduce(lambda a, b: a | b, out)

    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return once(words(normal), lambda held: tests(held, F.array_distinct(F.transform(held, stem)), _wider(held)))


def with_relevance(df: DataFrame, keywords: list[str], text: Column | None = None) -> DataFrame:
    """``df`` with ``relevant``: whether any keyword matches title and abstract.

    A keyword, or a core term it has, as a part of the text is looked for first; words, stems and synonyms are
    derived only for texts without one.
    """
    if not keywords:
        raise ValueError("keywords must not be empty")
    whole = F.concat_ws(" ", "title", "abstract") if text is None else text
    forms = [_keyword_forms(k) for k in keywords]
    parts = {shown for shown, *_ in forms} | {t for t in {c.replace("-", " ") for c in CORE_TERMS} for shown, each, *_ in forms if set(t.split()) <= set(each) or t in shown}
    normal = df.withColumn("_normal", norm_text(F.coalesce(whole, F.lit(""))))
    inside = reduce(lambda a, b: a | b, [F.col("_normal").contains(p) for p in sorted(parts)])
    return normal.withColumn("relevant", F.when(inside, F.lit(True)).otherwise(_words_match(F.col("_normal"), forms))).drop("_normal")


def filter_by_prompt(papers: DataFrame, prompt: str, generate: Callable[..., str], **options) -> DataFrame:
    """``papers`` with ``relevant`` by the keywords of a research prompt; without any keyword nothing is relevant."""
    found = extract_keywords(prompt, generate, **options)
    return with_relevance(papers, found) if found else papers.withColumn("relevant", F.lit(False))


def parse_keywords(reply: str) -> list[str]:
    """The strings of a JSON array or of ``keywords`` in an object; fenced or inside prose; else quoted strings; else nothing."""
    reply = (reply or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", reply, re.S)
    bare = re.search(r"\[.*?\]", reply, re.S)
    for text in filter(None, (reply, fenced and fenced.group(1), bare and bare.group(0))):
        try:
            data = json.loads(text)
        except json.JSONDecodeError:
            continue
        if isinstance(data, dict):
            data = data.get("keywords", [])
        if isinstance(data, list):
            return [str(k).strip() for k in data if str(k).strip()]
    return [k.strip() for k in re.findall(r'"([^"]+)"', reply) if k.strip()]


#: What a model is asked for, once for candidates and once for a choice among too many; replies are JSON.
CANDIDATES_ASKED = 'Name search keywords for this research interest. Reply with JSON {"keywords": ["...", ...]} and nothing else.'
CHOICE_ASKED = 'Choose the ten keywords of this list that are most specific and differ most from each other. Reply with JSON {"keywords": ["...", ...]} and nothing else.'


def prompt_hash(prompt: Column) -> Column:
    """The key under which the keywords of a prompt are kept."""
    return F.sha2(prompt, 256)


def choose_keywords(candidates: list[str], generate: Callable[..., str], **options) -> list[str]:
    """At most ``MOST_KEYWORDS`` of the candidates: all if they are so few, else a model's choice, else the first ones."""
    different = list(dict.fromkeys(candidates))
    if len(different) <= MOST_KEYWORDS:
        return different
    try:
        return parse_keywords(generate(f"{CHOICE_ASKED}\n\n{json.dumps(different)}", **options))[:MOST_KEYWORDS]
    except Exception:
        return different[:MOST_KEYWORDS]


def extract_keywords(prompt: str, generate: Callable[..., str], calls: int = 3, cache: str | None = None, **options) -> list[str]:
    """The keywords of a research prompt: several replies at a time, their union in order, a choice among too many.

    ``options`` (temperature, most tokens) go to every call. Failing calls contribute nothing. ``cache`` names a
    file that keeps the last prompt's keywords under its hash; one that cannot be read or written is passed over.
    """
    if not (prompt or "").strip():
        raise ValueError("no research prompt")
    digest = hashlib.sha256(prompt.encode("utf-8")).hexdigest()
    try:
        with open(cache or "", encoding="utf-8") as file:
            kept = json.load(file)
        if kept.get("hash") == digest and kept.get("keywords"):
            return kept["keywords"]
    except (OSError, ValueError, AttributeError):
        pass

    def ask(_: int) -> list[str]:
        try:
            return parse_keywords(generate(f"{CANDIDATES_ASKED}\n\n{prompt}", **options))
        except Exception:
            return []

    with ThreadPoolExecutor(max(calls, 1)) as pool:
        candidates = sorted({k for reply in pool.map(ask, range(max(calls, 1))) for k in reply})
    chosen = choose_keywords(candidates, generate, **options)
    if cache and chosen:
        try:
            os.makedirs(os.path.dirname(os.path.abspath(cache)), exist_ok=True)
            with open(cache, "w", encoding="utf-8") as file:
                json.dump({"hash": digest, "keywords": chosen}, file)
        except OSError:
            pass
    return chosen
