"""Ordered greedy deduplication on several keys: a row stays iff no earlier row that stayed has one of its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.functions.text import normalize_title
from biblioflow.session import cut_lineage


def greedy_keep(keys: DataFrame) -> DataFrame:
    """``(pos, kept)`` for every row in ``keys(pos, value)``, decided as if rows came one by one in order of ``pos``.

    Each round keeps the rows that come first on all of their keys among the undecided, and drops those that
    share a key with a row just kept. Rows dropped register nothing, so this is neither a distinct nor a
    connected component. Every round decides the earliest undecided row at least, so they end; they are few in
    practice, about half the length of the longest chain of keys, and work on undecided rows only.
    """
    undecided = cut_lineage(keys.select("pos", "value").distinct())
    decided = None
    while True:
        first = undecided.groupBy("value").agg(F.min("pos").alias("first"))
        state = undecided.join(first, "value").groupBy("pos").agg(F.bool_and(F.col("pos") == F.col("first")).alias("kept"))
        kept = state.where("kept").select("pos")
        taken = undecided.join(kept, "pos", "left_semi").select("value").distinct()
        hit = undecided.join(taken, "value", "left_semi").select("pos").distinct()
        settled = cut_lineage(hit.join(kept.withColumn("kept", F.lit(True)), "pos", "left").select("pos", F.coalesce("kept", F.lit(False)).alias("kept")))
        decided = settled if decided is None else decided.unionByName(settled)
        undecided = cut_lineage(undecided.join(settled.select("pos"), "pos", "left_anti"))
        if undecided.isEmpty():
            return decided


def deduplicate(df: DataFrame, keys, pos: str = "paper_id") -> DataFrame:
    """``df`` with ``kept`` and ``matched_kind``: the first key kind under which a dropped row met an earlier kept one.

    ``keys`` is an ``array<struct<kind, value>>`` expression; rows without keys are always kept.
    """
    exploded = df.select(F.col(pos).alias("pos"), F.posexplode(keys).alias("place", "key")).select("pos", "place", F.col("key.kind").alias("kind"), F.concat_ws(":", "key.kind", "key.value").alias("value"))
    exploded = cut_lineage(exploded)
    decided = greedy_keep(exploded)
    owners = exploded.join(decided.where("kept").select("pos"), "pos", "left_semi").select("value", F.col("pos").alias("owner"))
    dropped = exploded.join(decided.where(~F.col("kept")).select("pos"), "pos", "left_semi")
    kinds = dropped.join(owners, "value").where(F.col("owner") < F.col("pos")).groupBy("pos").agg(F.min_by("kind", "place").alias("matched_kind"))
    marked = df.join(decided.withColumnRenamed("pos", pos), pos, "left").join(kinds.withColumnRenamed("pos", pos), pos, "left")
    return marked.withColumn("kept", F.coalesce("kept", F.lit(True)))


def deduplication_statistics(marked: DataFrame, keys) -> DataFrame:
    """One row: input, unique, dropped, drops by kind of key, and rows kept for want of any key."""
    return marked.agg(
        F.count(F.lit(1)).alias("input"),
        F.count_if("kept").alias("unique"),
        F.count_if(~F.col("kept")).alias("dropped"),
        *[F.count_if(F.col("matched_kind") == k).alias(f"by_{k}") for k in ("doi", "url", "title")],
        F.count_if(F.size(keys) == 0).alias("kept_without_key"),
    )


def best_per_title(df: DataFrame, quality, title: str = "title", pos: str = "paper_id") -> DataFrame:
    """Per normalized title the row of highest quality, earliest on ties, at the place of the title's first row.

    Rows with a blank title all stay. Adds ``place``.
    """
    keyed = df.withColumn("_title", normalize_title(F.col(title))).withColumn("_quality", quality)
    same = Window.partitionBy("_title")
    ranked = keyed.where(F.col("_title") != "").withColumn("place", F.min(pos).over(same)).withColumn("_rank", F.row_number().over(same.orderBy(F.desc("_quality"), F.asc(pos))))
    best = ranked.where(F.col("_rank") == 1).drop("_rank")
    return best.unionByName(keyed.where(F.col("_title") == "").withColumn("place", F.col(pos))).drop("_title", "_quality")


def export_in_batch(probe: DataFrame, register: DataFrame) -> DataFrame:
    """``(pos, kept)`` where rows look up ``probe`` keys but leave ``register`` keys behind when they are kept.

    A row is dropped if an earlier kept row registered one of its probe keys, and kept once all earlier rows
    that could register one are decided otherwise.
    """
    probe, register = cut_lineage(probe.select("pos", "value").distinct()), cut_lineage(register.select("pos", "value").distinct())
    everyone = probe.select("pos").unionByName(register.select("pos")).distinct()
    open_, decided = cut_lineage(everyone), None
    while True:
        threats = register.join(open_, "pos", "left_semi").groupBy("value").agg(F.min("pos").alias("first"))
        blocked = probe.join(open_, "pos", "left_semi").join(threats, "value").where(F.col("first") < F.col("pos")).select("pos").distinct()
        kept = cut_lineage(open_.join(blocked, "pos", "left_anti"))
        names = register.join(kept, "pos").groupBy("value").agg(F.min("pos").alias("first"))
        hit = probe.join(open_, "pos", "left_semi").join(names, "value").where(F.col("first") < F.col("pos")).select("pos").distinct()
        settled = cut_lineage(kept.withColumn("kept", F.lit(True)).unionByName(hit.withColumn("kept", F.lit(False))))
        decided = settled if decided is None else decided.unionByName(settled)
        open_ = cut_lineage(open_.join(settled.select("pos"), "pos", "left_anti"))
        if open_.isEmpty():
            return decided
