"""Mailbox alerts: MIME bodies, items in their HTML, DOIs in plain text."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioflow.functions.text import DOI, sender_email

#: Link texts that are no titles, and domains whose links are articles (fixed values).
BOILERPLATE = {"read more", "view", "click here"}
PUBLISHERS = ("doi.org", "nature.com", "science.org", "wiley.com", "springer.com", "acs.org", "rsc.org", "elsevier.com", "cell.com", "pnas.org", "sciencedirect.com", "arxiv.org", "biorxiv.org", "medrxiv.org")
ITEM_SCHEMA = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("strategy", T.IntegerType()), T.StructField("item_pos", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType()))])

_DOI = re.compile(DOI)
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "wbr"}
_BLOCKS, _HEADS = ("div", "article", "section"), ("h1", "h2", "h3", "h4")


class _Node:
    def __init__(self, tag: str, attributes: dict[str, str | None]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def all(self, *tags: str) -> Iterator[_Node]:
        for child in self.children:
            if isinstance(child, _Node):
                if child.tag in tags:
                    yield child
                yield from child.all(*tags)

    def text(self) -> str:
        return " ".join("".join(c if isinstance(c, str) else " " + c.text() + " " for c in self.children).split())


class _Tree(HTMLParser):
    """A lenient tree: unknown end tags are ignored, open ones close with their parent."""

    def __init__(self, html: str):
        super().__init__()
        self.root = _Node("root", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _doi_in(*texts: str | None) -> str:
    return next((m.group(0) for t in texts if t and (m := _DOI.search(t))), "")


def _from_row(row: _Node):
    links = [(a.text(), a.attributes.get("href")) for a in row.all("a") if a.attributes.get("href")]
    titled = [x for x in links if len(x[0]) >= 10 and x[0].lower() not in BOILERPLATE]
    cells = [c.text() for c in row.all("td", "th")]
    title, url = max(titled, key=lambda x: len(x[0])) if titled else (next((c for c in cells if 20 < len(c) < 500), ""), None)
    if len(title) < 10:
        return None
    people = next((c for c in cells if "," in c and len(c) < 200 and title not in c), None)
    return title, url, _doi_in(url, row.text()), [p.strip() for p in people.split(",") if p.strip()] if people else []


def _from_block(block: _Node):
    link = next((a for a in block.all("a") if a.attributes.get("href")), None)
    if link is None:
        return None
    title = link.text()
    if len(title) < 15:
        title = next((h.text() for h in block.all(*_HEADS)), "")
    return (title, link.attributes["href"], _doi_in(link.attributes["href"], block.text()), []) if 15 <= len(title) <= 500 else None


def _from_link(link: _Node):
    title, url = link.text(), link.attributes.get("href") or ""
    fits = 20 <= len(title) <= 500 and title.lower() not in BOILERPLATE and (any(p in url for p in PUBLISHERS) or _DOI.search(url))
    return (title, url, _doi_in(url), []) if fits else None


def html_items(html: str | None) -> list[tuple[int, int, str, str | None, str, list[str]]]:
    """``(strategy, position, title, url, doi, authors)`` of table rows (0), blocks (1) and links (2)."""
    if not html:
        return []
    root = _Tree(html).root
    found = []
    for strategy, (tags, read) in enumerate(((("tr",), _from_row), (_BLOCKS, _from_block), (("a",), _from_link))):
        items = [item for node in root.all(*tags) if (item := read(node))]
        found += [(strategy, i, *item) for i, item in enumerate(items)]
    return found


def mail_items(messages: DataFrame) -> DataFrame:
    """Items of ``messages(message_id, html)``, all strategies, in order of strategy and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(m, *item) for m, html in zip(batch["message_id"], batch["html"]) for item in html_items(html)], columns=[f.name for f in ITEM_SCHEMA])

    return messages.select("message_id", "html").mapInPandas(run, ITEM_SCHEMA)


def item_quality(item_doi: Column, url: Column, abstract: Column, authors: Column) -> Column:
    """DOI 4, URL 2, abstract 1, and one for each author up to three."""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(there(item_doi), 4).otherwise(0) + F.when(there(url), 2).otherwise(0) + F.when(there(abstract), 1).otherwise(0) + F.least(F.greatest(F.coalesce(F.size(authors), F.lit(0)), F.lit(0)), F.lit(3))


def _part_body(part: dict) -> str | None:
    kind = next((h["value"] for h in part.get("headers", []) if h.get("name", "").lower() == "content-type"), "")
    charset = (re.search(r"charset=\"?([\w-]+)", kind) or [None, "utf-8"])[1]
    data = (part.get("body") or {}).get("data") or ""
    raw = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
    for name in (charset, "utf-8", "latin-1"):
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return None


def body_of(payload: str | dict | None, kind: str) -> str | None:
    """The first non-empty part of a kind in a MIME tree, depth first; base64 padding and charsets are repaired."""
    tree = json.loads(payload) if isinstance(payload, str) else payload
    if not tree:
        return None
    if tree.get("mimeType") == kind and (body := _part_body(tree)):
        return body
    return next((body for part in tree.get("parts") or [] if (body := body_of(part, kind))), None)


def html_body(payload: str | dict | None) -> str | None:
    return body_of(payload, "text/html")


@F.pandas_udf(T.StringType())
def html_bodies(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: html_body(p) if p else None)


@F.pandas_udf(T.StringType())
def plain_bodies(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: body_of(p, "text/plain") if p else None)


def parse_sender_map(text: str | None) -> dict[str, str]:
    """Names by address in lower case, from a JSON object; anything else, and values that are no text, name nobody."""
    try:
        data = json.loads(text or "")
    except json.JSONDecodeError:
        return {}
    return {k.strip().lower(): v for k, v in data.items() if isinstance(v, str)} if isinstance(data, dict) else {}


def message_items(messages: DataFrame) -> DataFrame:
    """Items of ``messages(message_id, payload_json)``: those of the HTML part, else the DOIs of the plain text."""
    read = messages.select("message_id", html_bodies(F.col("payload_json")).alias("html"), plain_bodies(F.col("payload_json")).alias("body"))
    plain = plain_text_dois(read.where(F.coalesce("html", F.lit("")) == ""))
    listed = plain.select("message_id", F.lit(3).alias("strategy"), F.col("doi_pos").alias("item_pos"), "title", "url", "doi", F.array().cast("array<string>").alias("authors"))
    return mail_items(read.where(F.coalesce("html", F.lit("")) != "")).unionByName(listed)


def plain_text_dois(messages: DataFrame, text: str = "body") -> DataFrame:
    """``(message_id, doi_pos, doi, title, url)``: each DOI of a plain text once, by lower case, in order."""
    found = messages.select("message_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(DOI), F.lit(0))).alias("doi_pos", "doi"))
    first = found.groupBy("message_id", F.lower("doi").alias("_low")).agg(F.min(F.struct("doi_pos", "doi")).alias("f"))
    return first.select("message_id", "f.doi_pos", "f.doi", F.concat(F.lit("Paper (DOI: "), "f.doi", F.lit(")")).alias("title"), F.concat(F.lit("https://doi.org/"), "f.doi").alias("url"))


def allowed_senders(messages: DataFrame, allowed: str) -> DataFrame:
    """Messages of the senders in a list separated by commas or semicolons; an empty list lets all pass, unknown senders never."""
    wanted = [a.strip().lower() for a in re.split(r"[;,]", allowed) if a.strip()]
    return messages.where(sender_email(F.col("sender")).isin(*wanted)) if wanted else messages


def search_query(senders: list[str], trash: bool = False) -> str:
    """The mailbox query for alerts of some senders, or the same for the trash."""
    query = "in:inbox" + (f" ({' OR '.join('from:' + s for s in sorted(senders))})" if senders else "")
    if not trash or "in:trash" in query:
        return query
    return query.replace("in:inbox", "in:trash")
