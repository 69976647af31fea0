"""Streaming deduplication: each micro-batch against the keys that earlier ones registered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.operators.greedy import deduplicate
from biblioflow.session import cut_lineage


def deduplicate_stream(stream: DataFrame, keys: Column, key_table: str, sink: str, checkpoint: str, pos: str = "paper_id"):
    """Start a query that appends the new papers of each micro-batch to ``sink`` and their keys to ``key_table`` (Parquet).

    A row is new if none of its keys stands in the key table and the ordered greedy rule keeps it within
    its batch. Both outputs are written under the batch number, so a batch that is run again after a
    failure replaces its own files.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch
        text = lambda k: F.concat_ws(":", k["kind"], k["value"])
        earlier = _earlier_keys(spark, key_table, number)
        if earlier is not None:
            known = batch.select(pos, F.explode(F.transform(keys, text)).alias("value")).join(earlier, "value", "left_semi").select(pos).distinct()
            fresh = batch.join(known, pos, "left_anti")
        kept = cut_lineage(deduplicate(fresh, keys, pos).where("kept").drop("kept", "matched_kind"))
        kept.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        kept.select(F.explode(F.transform(keys, text)).alias("value")).distinct().write.mode("overwrite").parquet(f"{key_table}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def _earlier_keys(spark, key_table: str, number: int) -> DataFrame | None:
    """The keys of earlier batches; None before the first. Any failure to read them is an error, never an empty history."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(key_table)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("value string, batch long").parquet(key_table).where(F.col("batch") < number).select("value")
