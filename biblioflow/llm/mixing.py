"""Mixing sources to target weights: whole documents, dealt to output shards in fixed-length token blocks."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioflow.session import cut_lineage

#: The public tokenizer that sizes are counted in (byte-level BPE of 50,256 ranks), and its pattern (fixed values).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block, blocks of an output shard, shards that are drawn by one task at least, documents of a bucket of a source's line.
BLOCK_TOKENS, SHARD_BLOCKS, CHUNK_SHARDS, BUCKET_DOCS = 2048, 64, 1000, 2048
SEED = 20_240


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, source, tokens)`` of every row with text and source; NULL text or source belongs to no mix."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in batch], dtype="int64")

    counted = F.pandas_udf(count, T.LongType())
    rows = df.where(F.col(text).isNotNull() & F.col(source).isNotNull())
    return rows.select(F.col(key).alias(key), F.col(source).alias("source"), counted(F.col(text)).alias("tokens")).where(F.col("tokens") > 0)


def source_lines(counts: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``counts`` with ``start``: where each document begins in its source's line of tokens.

    The line holds the source's documents in the order of a keyed hash, a pseudorandom permutation that
    no row has to wait for. Starts are prefix sums in two steps, over hash buckets and inside them, so a
    source with a third of all documents is the work of as many tasks as it has buckets.
    """
    sized = counts.groupBy("source").agg(F.count(F.lit(1)).alias("_docs")).withColumn("_buckets", F.ceil(F.col("_docs") / BUCKET_DOCS)).select(F.col("source"), "_buckets")
    hashed = counts.withColumn("_u", F.xxhash64(F.col(key), F.lit(seed)))
    placed = hashed.join(sized, "source").withColumn("_bucket", F.least(F.floor((F.col("_u") / F.lit(2.0**64) + 0.5) * F.col("_buckets")), F.col("_buckets") - 1))
    sums = placed.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_t"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_u", key).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return within.join(offsets, ["source", "_bucket"]).select(key, "source", "tokens", (F.col("_offset") + F.col("_inside")).alias("start"))


def quotas(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: tokens held and wanted, whole passes over the source, and tokens of the last, partial pass.

    The size of a mix is ``budget_ratio`` of the tokens of its listed sources. A source never gives more
    than ``max_repeats`` passes; what it then lacks is not made up by others, whose sizes stay on target.
    """
    held = counts.groupBy("source").agg(F.sum("tokens").alias("held"))
    listed = targets.select("mix_name", "source", "target_share", "max_repeats", "budget_ratio").join(held, "source", "left").fillna({"held": 0})
    mix = Window.partitionBy("mix_name")
    sized = listed.withColumn("mix_size", F.floor(F.sum("held").over(mix) * F.col("budget_ratio"))).withColumn("wanted", F.round(F.col("mix_size") * F.col("target_share")).cast("long"))
    capped = F.least(F.col("wanted"), F.col("held") * F.col("max_repeats"))
    passes = F.when(F.col("held") > 0, F.floor(capped / F.col("held"))).otherwise(F.lit(0))
    return sized.withColumn("passes", passes.cast("long")).withColumn("rest", capped - F.col("passes") * F.col("held"))


_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _scrambled(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A keyed 64-bit hash of each number (the finalizer of a splittable generator)."""
    with np.errstate(over="ignore"):
        z = (x.astype(np.uint64) + key) * np.uint64(0x9E3779B97F4A7C15) & _MASK
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) & _MASK
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) & _MASK
    return z ^ (z >> np.uint64(31))


def permuted(slots: np.ndarray, n: np.ndarray, keys: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A keyed pseudorandom permutation of ``0 .. n - 1`` applied to each slot, without a table.

    A Feistel network over two digits whose bases are near the square root of ``n``; what falls outside is sent
    through again until it falls inside, which few need, as the digits hold hardly more than ``n``.
    """
    n = n.astype(np.int64)
    low = np.ceil(np.sqrt(n)).astype(np.int64).clip(1)
    high = -(-n // low)
    out = slots.astype(np.int64)
    open_ = np.arange(len(out))
    while len(open_):
        a, b = high[open_].astype(np.uint64), low[open_].astype(np.uint64)
        left, right = out[open_].astype(np.uint64) // b, out[open_].astype(np.uint64) % b
        for r in range(rounds):
            key = _scrambled(keys[open_], np.uint64(r + 1))
            if r % 2:
                right = (right + _scrambled(left, key) % b) % b
            else:
                left = (left + _scrambled(right, key) % a) % a
        out[open_] = (left * b + right).astype(np.int64)
        open_ = open_[out[open_] >= n[open_]]
    return out


def _chunked(mixes: DataFrame) -> DataFrame:
    """``mixes(mix_name, total, ...)`` with one row per output shard: ``chunk``, ``shard_no`` and its ``size`` in blocks."""
    shards = F.ceil(F.col("total") / SHARD_BLOCKS)
    chunks = mixes.withColumn("_shards", shards).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_shards") / CHUNK_SHARDS) - 1)))
    spread = chunks.repartition("mix_name", "chunk")
    each = spread.withColumn("shard_no", F.explode(F.sequence(F.col("chunk") * CHUNK_SHARDS, F.least((F.col("chunk") + 1) * CHUNK_SHARDS, F.col("_shards")) - 1)))
    return each.withColumn("size", F.least(F.lit(SHARD_BLOCKS), F.col("total") - F.col("shard_no") * SHARD_BLOCKS).cast("int"))


def _draw(seed: int):
    """Multinomial source counts of each output shard, from a generator seeded by mix and shard: shards are independent of each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for mix, chunk, shard, size, sources, blocks in batch[["mix_name", "chunk", "shard_no", "size", "sources", "blocks"]].itertuples(index=False, name=None):
                weights = np.asarray(blocks, float)
                drawn = np.random.default_rng([seed, shard, *mix.encode()]).multinomial(size, weights / weights.sum())
                rows += [(mix, chunk, shard, sources[k], int(drawn[k])) for k in np.flatnonzero(drawn)]
            yield pd.DataFrame(rows, columns=["mix_name", "chunk", "shard_no", "source", "slots"])

    return run


def _before(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before, in order of ``chunk`` and ``order``; sums of chunks first, so no window spans all shards."""
    sums = df.groupBy(*by, "chunk").agg(F.sum(value).alias("_c"))
    chunks = sums.select(*by, "chunk", F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*by, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(chunks, [*by, "chunk"]).withColumn(name, F.col("_i") + F.col("_o")).drop("_i", "_o")


def dealt_slots(blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """``(mix_name, source, shard_no, first_slot, slots, blocks)``: which slots of each source's blocks every output shard holds.

    ``blocks(mix_name, source, blocks)`` says how many blocks each source gives. Every shard draws its source
    counts from the multinomial distribution of these. Independent draws miss the numbers of blocks by
    about their square root: what a source is drawn too often goes, in order, to sources drawn too seldom, so
    every block stands in one shard.
    """
    whole = blocks.where("blocks > 0")
    mixes = whole.groupBy("mix_name").agg(F.sum("blocks").alias("total"), F.array_sort(F.collect_list(F.struct("source", "blocks"))).alias("_s"))
    mixes = mixes.select("mix_name", "total", F.col("_s.source").alias("sources"), F.col("_s.blocks").alias("blocks"))
    drawn = _chunked(mixes).select("mix_name", "chunk", "shard_no", "size", "sources", "blocks").mapInPandas(_draw(seed), "mix_name string, chunk long, shard_no long, source string, slots long")
    placed = _before(cut_lineage(drawn), ["mix_name", "source"], ["shard_no"], "slots", "first_slot").join(whole, ["mix_name", "source"])
    placed = cut_lineage(placed)
    kept = placed.withColumn("slots", F.least(F.col("slots"), F.greatest(F.col("blocks") - F.col("first_slot"), F.lit(0)))).where("slots > 0")
    shown = ["mix_name", "source", "shard_no", "first_slot", "slots", "blocks"]
    excess = placed.withColumn("_over", F.col("slots") - F.least(F.col("slots"), F.greatest(F.col("blocks") - F.col("first_slot"), F.lit(0)))).where("_over > 0").select("mix_name", "chunk", "shard_no", "source", "_over")
    excess = _before(excess, ["mix_name"], ["shard_no", "source"], "_over", "_at").select("mix_name", "shard_no", "_at", "_over")
    taken = placed.groupBy("mix_name", "source").agg(F.sum("slots").alias("_drawn"))
    lack = whole.join(taken, ["mix_name", "source"], "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0))).withColumn("_lack", F.greatest(F.col("blocks") - F.col("_drawn"), F.lit(0)))
    lack = lack.withColumn("_to", F.sum("_lack").over(Window.partitionBy("mix_name").orderBy("source"))).withColumn("_from", F.col("_to") - F.col("_lack")).where("_lack > 0")
    start, end = F.greatest("_at", "_from"), F.least(F.col("_at") + F.col("_over"), F.col("_to"))
    moved = excess.join(lack, "mix_name").where(start < end)
    moved = moved.select("mix_name", "source", "shard_no", (F.col("_drawn") + start - F.col("_from")).alias("first_slot"), (end - start).alias("slots"), "blocks")
    return kept.select(shown).unionByName(moved.select(shown))


def _line(documents_counts: DataFrame, targets: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """The chosen copies with their place ``at`` in the line of their source's copies, and the number of blocks of each line."""
    quota = quotas(documents_counts, targets)
    wanted = quota.select("mix_name", "source", "held", "passes", "rest")
    met = source_lines(documents_counts, key, seed).join(wanted, "source")
    taken = F.col("passes") + F.when(F.col("start") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    copies = met.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(taken, F.lit(1).cast("long"))))).where(taken > 0)
    copies = copies.withColumn("at", (F.col("copy_no") - 1) * F.col("held") + F.col("start")).select("mix_name", "source", key, "copy_no", "tokens", "at")
    copies = cut_lineage(copies)
    ends = copies.groupBy("mix_name", "source").agg(F.max(F.col("at") + F.col("tokens")).alias("_end"))
    return copies, ends.select("mix_name", "source", F.ceil(F.col("_end") / BLOCK_TOKENS).alias("blocks"))


def _dealt_blocks(blocks: DataFrame, seed: int) -> DataFrame:
    """``(mix_name, source, block, shard_no)``: the output shard of every block, through its source's permutation of block numbers."""

    @F.pandas_udf(T.LongType())
    def through(slots: pd.Series, n: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(permuted(slots.to_numpy(), n.to_numpy(), keys.to_numpy().astype(np.uint64)))

    slots = dealt_slots(blocks, seed).withColumn("_slot", F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("slots") - 1)))
    return slots.select("mix_name", "source", "shard_no", through("_slot", "blocks", F.xxhash64("mix_name", "source", F.lit(seed))).alias("block"))


def mix_documents(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, seed: int = SEED, counts: DataFrame | None = None) -> DataFrame:
    """``(mix_name, source, key, copy_no, shard_no, tokens)``: one row per copy of a chosen document.

    Whole passes take every document, the last one those whose middle lies within the rest of the quota,
    so the tokens of a source miss its target by half a document at most. The copies of a source are one
    line of blocks of ``BLOCK_TOKENS``; a document is listed with the shard of the block it begins in. Each
    output shard draws how many blocks of each source it gets, its slots go through the source's
    permutation of block numbers, and documents join their block by number. Empty tables give no rows.
    """
    counts = cut_lineage(token_counts(documents, key, text, source, vocabulary)) if counts is None else counts
    copies, blocks = _line(counts, targets, key, seed)
    placed = copies.withColumn("block", F.floor(F.col("at") / BLOCK_TOKENS))
    return placed.join(_dealt_blocks(blocks, seed), ["mix_name", "source", "block"]).select("mix_name", "source", key, "copy_no", "shard_no", "tokens")


def mix_blocks(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """``(mix_name, source, block, shard_no, offset, key, copy_no, from_token, to_token)``: what stands in every block.

    Blocks are full: each has ``BLOCK_TOKENS`` tokens but for the last one of a source's line. A document that does
    not fit is carried over into the next block, so one row is one stretch of a document, ``to_token`` exclusive.
    """
    counts = cut_lineage(token_counts(documents, key, text, source, vocabulary))
    copies, blocks = _line(counts, targets, key, seed)
    first, last = F.floor(F.col("at") / BLOCK_TOKENS), F.floor((F.col("at") + F.col("tokens") - 1) / BLOCK_TOKENS)
    pieces = copies.withColumn("block", F.explode(F.sequence(first, last))).withColumn("_begin", F.col("block") * BLOCK_TOKENS)
    pieces = pieces.withColumn("from_token", F.greatest(F.col("_begin") - F.col("at"), F.lit(0))).withColumn("to_token", F.least(F.col("_begin") + BLOCK_TOKENS - F.col("at"), F.col("tokens")))
    pieces = pieces.withColumn("offset", F.col("at") + F.col("from_token") - F.col("_begin"))
    return pieces.join(_dealt_blocks(blocks, seed), ["mix_name", "source", "block"]).select("mix_name", "source", "block", "shard_no", "offset", key, "copy_no", "from_token", "to_token")


def mix_report(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """Per mix and source: target and actual share of the mix's size, tokens wanted and chosen, and the most copies of a document."""
    counts = cut_lineage(token_counts(documents, key, text, source, vocabulary))
    quota = quotas(counts, targets)
    chosen = mix_documents(documents, targets, key, text, source, vocabulary, seed, counts)
    got = chosen.groupBy("mix_name", "source").agg(F.sum("tokens").alias("chosen"), F.max("copy_no").alias("most_copies"), F.count(F.lit(1)).alias("rows"))
    joined = quota.join(got, ["mix_name", "source"], "left").fillna({"chosen": 0, "most_copies": 0, "rows": 0})
    whole = F.sum("chosen").over(Window.partitionBy("mix_name"))
    return joined.select("mix_name", "source", "target_share", F.round(F.col("chosen") / F.col("mix_size"), 6).alias("actual_share"), F.round(F.col("chosen") / whole, 6).alias("share_of_chosen"), "mix_size", "held", "wanted", "chosen", "max_repeats", "most_copies", "rows")
