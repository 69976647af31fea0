"""The filter chain: criteria as one reason column, statistics, and batched relevance judging."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.session import cut_lineage


@dataclass(frozen=True)
class Criteria:
    """What a record must meet; empty criteria let everything pass."""

    keywords: list[str] = field(default_factory=list)
    exclude_keywords: list[str] = field(default_factory=list)
    min_date: date | None = None
    authors: list[str] = field(default_factory=list)
    has_pdf: bool = False

    @property
    def applicable(self) -> bool:
        return bool(self.keywords or self.exclude_keywords or self.authors or self.min_date or self.has_pdf)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def searchable_text(title: Column, abstract: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether a lower-case text contains one of the keywords; the empty keyword is in every text."""
    return _any([text.contains(k.lower()) for k in keywords])


def has_author(authors: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.exists(authors, lambda a: _any([F.lower(a).contains(w.lower()) for w in wanted])), F.lit(False))


def reject_reason(criteria: Criteria) -> Column:
    """The first criterion a record fails, in the order exclude, keyword, author, pdf, date; NULL if it passes all."""
    text = searchable_text(F.col("title"), F.col("abstract"))
    reason = F.lit(None).cast("string")
    checks = [
        ("exclude", criteria.exclude_keywords, lambda: contains_any(text, criteria.exclude_keywords)),
        ("keyword", criteria.keywords, lambda: ~contains_any(text, criteria.keywords)),
        ("author", criteria.authors, lambda: ~has_author(F.col("authors"), criteria.authors)),
        ("pdf", criteria.has_pdf, lambda: F.col("pdf_url").isNull()),
        ("date", criteria.min_date, lambda: F.coalesce(F.col("published_date") < F.lit(criteria.min_date), F.lit(False))),
    ]
    for name, wanted, fails in reversed(checks):
        if wanted:
            reason = F.when(fails(), F.lit(name)).otherwise(reason)
    return reason


def with_reason(df: DataFrame, criteria: Criteria) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(criteria))


def keep_matching(df: DataFrame, criteria: Criteria) -> DataFrame:
    """The records that meet all criteria; NULL dates pass a minimum date."""
    return with_reason(df, criteria).where(F.col("reject_reason").isNull()).drop("reject_reason") if criteria.applicable else df


def rejection_messages(df: DataFrame, criteria: Criteria) -> DataFrame:
    """``(paper_id, reject_reason, message)`` of what the chain drops; titles are shortened to 50 characters."""
    dropped = with_reason(df, criteria).where(F.col("reject_reason").isNotNull())
    return dropped.select("paper_id", "reject_reason", F.concat(F.lit("Rejected by "), "reject_reason", F.lit(": "), F.substring("title", 1, 50), F.lit("...")).alias("message"))


def filter_statistics(df: DataFrame, criteria: Criteria) -> DataFrame:
    """One row: input, passed and rejected, and how many each criterion rejected."""
    reasons = ("exclude", "keyword", "author", "pdf", "date")
    judged = with_reason(df, criteria)
    return judged.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reject_reason").isNull()).alias("passed"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), *[F.count_if(F.col("reject_reason") == r).alias(f"rejected_{r}") for r in reasons])


def pipeline_statistics(df: DataFrame, criteria: Criteria, judged: DataFrame | None = None, why_not_judged: str = "") -> DataFrame:
    """One row per stage (``keyword``, ``judge``): input, passed, rejected, and why a stage was skipped, NULL where it ran."""
    counted = lambda d: F.count(F.lit(1)).alias("n")
    kept = keep_matching(df, criteria)
    sizes = {name: d.agg(counted(d)) for name, d in (("all", df), ("kept", kept), ("judged", kept if judged is None else judged))}
    row = lambda stage, before, after, skipped: before.withColumnRenamed("n", "input").join(after.withColumnRenamed("n", "passed")).select(F.lit(stage).alias("stage"), "input", "passed", (F.col("input") - F.col("passed")).alias("rejected"), F.lit(skipped).cast("string").alias("skipped"))
    first = row("keyword", sizes["all"], sizes["kept"], None if criteria.applicable else "no criteria")
    return first.unionByName(row("judge", sizes["kept"], sizes["judged"], (why_not_judged or "no judge") if judged is None else None))


# ------------------------------------------------------------- judging in batches

#: Records of one call, and characters of an abstract that a prompt shows.
BATCH, SHOWN = 50, 500


def papers_prompt(titles: list[str], abstracts: list[str]) -> str:
    """The numbered list of records that a judge is shown."""
    cut = [a if len(a) <= SHOWN else a[:SHOWN] + "..." for a in abstracts]
    return "\n\n".join(f"### [{i}] {t}\n{a}" for i, (t, a) in enumerate(zip(titles, cut)))


def json_objects(text: str) -> Iterator[dict]:
    """The JSON objects in a text, whatever stands around them, outermost and first ones first."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            yield value
        except json.JSONDecodeError:
            pass
        at = text.find("{", at + 1)


def _index(value: object) -> int:
    """A number in a reply as an index; -1 for what is none."""
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return -1


def parse_reply(reply: str, size: int) -> set[int]:
    """The indices under ``relevant`` in the first JSON object of a reply that has it; empty if there is none."""
    named = next((found["relevant"] for found in json_objects(reply) if "relevant" in found), None)
    return {i for i in map(_index, named) if 0 <= i < size} if isinstance(named, list) else set()


def judge_in_batches(df: DataFrame, judge: Callable[[str], str], key: str = "paper_id", batch: int = BATCH) -> DataFrame:
    """The records a judge finds relevant, ``batch`` at a time in key order.

    A failing call keeps its whole batch, an unreadable reply drops it, and if nothing at all is relevant
    everything is kept. NULL keys come first.
    """
    placed = dense_position(df.select(key, "title", "abstract"), key).withColumn("_batch", F.floor(F.col("_pos") / batch))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        try:
            kept = sorted(parse_reply(judge(papers_prompt(pdf["title"].fillna("").tolist(), pdf["abstract"].fillna("").tolist())), len(pdf)))
        except Exception:
            kept = range(len(pdf))
        return pdf.iloc[list(kept)][[key]]

    relevant = cut_lineage(placed.groupBy("_batch").applyInPandas(run, df.select(key).schema))
    return df if relevant.isEmpty() else df.join(relevant, key, "left_semi")


def dense_position(df: DataFrame, key: str, name: str = "_pos") -> DataFrame:
    """``name``: the rank of each row by ``key`` from 0: its place in its range of keys, and the rows in ranges before.

    Ranges are cut by the distribution of the keys, so they hold like numbers of rows whatever the keys are,
    and grow in number with the table; no window spans them.
    """
    ranged = df.repartitionByRange(key).sortWithinPartitions(key)
    placed = cut_lineage(ranged.withColumns({"_range": F.spark_partition_id(), "_inside": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")
