"""Exact duplicates hidden by formatting: dictionary-encoded records, grouped as compact integer tuples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.functions.canonical import doi_canonical, title_canonical
from biblioflow.session import cut_lineage

#: The identifying fields of a paper with their canonical forms.
PAPER_FIELDS: dict[str, Callable[[Column], Column]] = {"doi": doi_canonical, "title": title_canonical}


def _dictionary(df: DataFrame, key: str, field: str, canonical: Callable[[Column], Column]) -> DataFrame:
    """``(_raw_f, _code_f)``: each distinct stored value once, with the integer of its canonical form.

    The integer is the smallest row id that holds the canonical form: unique for it, the same on every
    run and on every retry of a task, and found without a global counter. Repeated values are combined
    before the shuffle; the window holds the distinct spellings of one canonical form.
    """
    raw = df.select(F.col(field).alias(f"_raw_{field}"), F.col(key).alias("_key")).where(F.col(f"_raw_{field}").isNotNull()).groupBy(f"_raw_{field}").agg(F.min("_key").alias("_first"))
    raw = raw.withColumn("_canon", canonical(F.col(f"_raw_{field}"))).where(F.col("_canon").isNotNull())
    return raw.select(f"_raw_{field}", F.min("_first").over(Window.partitionBy("_canon")).alias(f"_code_{field}"))


def encode_records(df: DataFrame, key: str, fields: dict[str, Callable[[Column], Column]] = PAPER_FIELDS) -> DataFrame:
    """``(key, _tuple)``: every row as a sorted array of ``(field number, integer)``; absent values have no entry.

    The integers are materialised once. A value on a third of all rows makes its lookup join skewed on
    one side only, against a dictionary of distinct values, where adaptive execution splits it.
    """
    rows = df.select(F.col(key).alias(key), *[F.col(f).alias(f"_raw_{f}") for f in fields])
    for f, canonical in fields.items():
        rows = rows.join(_dictionary(df, key, f, canonical), f"_raw_{f}", "left").drop(f"_raw_{f}")
    codes = cut_lineage(rows)
    entries = [F.when(F.col(f"_code_{f}").isNotNull(), F.struct(F.lit(i).alias("f"), F.col(f"_code_{f}").alias("v"))) for i, f in enumerate(fields)]
    return codes.select(key, F.array_sort(F.array_compact(F.array(*entries))).alias("_tuple"))


def collapse_records(df: DataFrame, key: str = "paper_id", fields: dict[str, Callable[[Column], Column]] = PAPER_FIELDS) -> DataFrame:
    """One row per record: ``keep_id`` (its smallest key) and ``copies``.

    Rows whose identifying fields are all absent carry no evidence of being copies: each stays a
    record of its own. Other columns of ``df`` are ignored, whatever their names; an empty table
    gives an empty result.
    """
    coded = encode_records(df, key, fields)
    known = coded.where(F.size("_tuple") > 0).groupBy("_tuple").agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("copies")).drop("_tuple")
    return known.unionByName(coded.where(F.size("_tuple") == 0).select(F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("copies")))


def further_copies(df: DataFrame, key: str = "paper_id", fields: dict[str, Callable[[Column], Column]] = PAPER_FIELDS) -> DataFrame:
    """``(keep_id, key)``: one row for each copy beyond the record's smallest key.

    Only the integer tuples are grouped and joined; records of one row drop out before the join.
    """
    coded = encode_records(df, key, fields).where(F.size("_tuple") > 0)
    records = coded.groupBy("_tuple").agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1)
    return coded.join(records, "_tuple").where(F.col(key) > F.col("keep_id")).select("keep_id", key)
