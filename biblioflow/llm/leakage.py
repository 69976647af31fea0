"""Evaluation passages in training text: an FM-index per shard of documents, searched backward for test phrases."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioflow.llm.lookalike import INVISIBLE, translation_table
from biblioflow.session import cut_lineage, shared_folder

#: Consecutive words of a passage that make a leak.
LEAK_WORDS = 12
#: Characters of text per FM-index, and the share of suffix positions that are kept (one in so many).
SHARD_CHARS, SAMPLE = 3_000_000, 16
#: Bytes of test phrases that go to the executors at once; larger sets are searched block by block.
BLOCK_BYTES = 32_000_000

_PARTS = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", INVISIBLE))
_GAP, _END = 1, 0


def _plain(text: str) -> str:
    """Lower case in one consistent form; look-alike letters and invisible characters do not hide a passage."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text).translate(translation_table()))
    return text.lower()


def split_words(text: str) -> list[list[str]]:
    """The words of a text between white space, each as its runs of letters and digits; words without any are left out."""
    return [parts for word in _plain(text).split() if (parts := _PARTS.findall(word))]


def passage_of(item: str) -> str:
    """What stands between the instruction and the question; items of fewer paragraphs count whole."""
    paragraphs = [p for p in re.split(r"\n\s*\n", item) if p.strip()]
    return "\n\n".join(paragraphs[1:-1]) if len(paragraphs) >= 3 else item


@dataclass
class Phrases:
    """A block of test phrases of ``LEAK_WORDS`` words: their words as numbers of the block's vocabulary, right-aligned, -1 before."""

    vocabulary: list[str]
    tokens: np.ndarray
    items: list[list[int]]

    @classmethod
    def of(cls, rows: list[tuple[list[str], list[int]]]) -> Phrases:
        vocabulary = sorted({w for phrase, _ in rows for w in phrase})
        number = {w: k for k, w in enumerate(vocabulary)}
        width = max((len(phrase) for phrase, _ in rows), default=1)
        tokens = np.full((len(rows), width), -1, np.int32)
        for r, (phrase, _) in enumerate(rows):
            tokens[r, width - len(phrase) :] = [number[w] for w in phrase]
        return cls(vocabulary, tokens, [list(items) for _, items in rows])


class WaveletMatrix:
    """Ranks of every symbol in a sequence: one bit vector with running counts per bit of the alphabet."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            ones = (sequence >> level) & 1
            counts = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((level, counts, len(sequence) - int(counts[-1])))
            sequence = np.concatenate([sequence[ones == 0], sequence[ones == 1]])

    def rank(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start, end = np.zeros_like(positions), positions
        for level, counts, zeros in self.levels:
            one = ((symbols >> level) & 1) == 1
            start = np.where(one, zeros + counts[start], start - counts[start])
            end = np.where(one, zeros + counts[end], end - counts[end])
        return end - start


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; the last symbol must be the only smallest one."""
    n = len(sequence)
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        if step < n:
            following[:-step] = rank[step:] + 1
        keys = rank * (n + 1) + following
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= 2 * n:
            return order


class FMIndex:
    """Backward search over one shard's words, and the places of what it finds."""

    def __init__(self, bwt: np.ndarray, kept: np.ndarray, positions: np.ndarray, alphabet: int):
        self.size, self.bwt, self.kept, self.positions = len(bwt), bwt, kept, positions
        self.before = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=alphabet))])
        self.ranks = WaveletMatrix(bwt, max(int(alphabet - 1).bit_length(), 1))
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])

    @classmethod
    def over(cls, sequence: np.ndarray, alphabet: int, sample: int = SAMPLE) -> FMIndex:
        """The index of a sequence whose last symbol is its only smallest one."""
        order = suffix_array(sequence)
        kept = order % sample == 0
        return cls(sequence[order - 1], kept, order[kept], alphabet)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """What is stored: the transformed sequence in as few bytes a symbol as hold it, kept rows, their positions."""
        small = np.uint16 if len(self.before) <= 1 << 16 else np.uint32
        return self.bwt.astype(small).tobytes(), np.packbits(self.kept).tobytes(), self.positions.astype(np.uint32).tobytes()

    @classmethod
    def restore(cls, packed: tuple[bytes, bytes, bytes], alphabet: int) -> FMIndex:
        small = np.uint16 if alphabet < 1 << 16 else np.uint32
        bwt = np.frombuffer(packed[0], small).astype(np.int32)
        return cls(bwt, np.unpackbits(np.frombuffer(packed[1], np.uint8), count=len(bwt)).astype(bool), np.frombuffer(packed[2], np.uint32).astype(np.int64), alphabet)

    def search(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, low, high)``: the interval of suffixes that begin with each right-aligned row of symbols that occurs; 0 pads."""
        alive = np.arange(len(tokens))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.size, np.int64)
        for column in range(tokens.shape[1] - 1, -1, -1):
            symbols = tokens[alive, column]
            going = symbols > 0
            both = self.ranks.rank(np.concatenate([symbols[going]] * 2), np.concatenate([low[going], high[going]]))
            first = self.before[symbols[going]]
            low[going], high[going] = first + both[: len(first)], first + both[len(first) :]
            keep = high > low
            alive, low, high = alive[keep], low[keep], high[keep]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row of the suffix order: step back to a kept one and count the steps."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.kept[rows[open_]]
            hit = open_[done]
            found[hit] = self.positions[self.kept_before[rows[hit]]] + steps[hit]
            open_ = open_[~done]
            symbols = self.bwt[rows[open_]]
            rows[open_] = self.before[symbols] + self.ranks.rank(symbols, rows[open_])
            steps[open_] += 1
        return found % self.size


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching ``[start, end)`` spans as few disjoint ones, in order."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(zip(starts.tolist(), ends.tolist())):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(merged[-1][1], end)
        else:
            merged.append((start, end))
    return merged


# ---------------------------------------------------------------- the index of a corpus

_SHARD = "keys array<long>, starts array<long>, first_parts array<long>, vocabulary string, bwt binary, kept binary, positions binary"
_SPANS = T.StructType([T.StructField("_key", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType())])


def _pieces(text: str, words: int) -> Iterator[tuple[int, list[str]]]:
    """``(number of the first part, parts)`` of a text; one longer than a shard comes in stretches that share ``words - 1`` words."""
    split = split_words(text)
    first = at = 0
    while at < len(split):
        end, size = at, 0
        while end < len(split) and (size < SHARD_CHARS or end - at < 2 * words):
            size += sum(map(len, split[end])) + 1
            end += 1
        yield first, [part for word in split[at:end] for part in word]
        if end == len(split):
            return
        following = end - words + 1
        first += sum(len(word) for word in split[at:following])
        at = following


def _index_shard(entries: list[tuple[int, int, list[str]]]) -> tuple:
    """The stored form of one shard: an FM-index over all of its words, each document after a gap symbol."""
    vocabulary = sorted({part for _, _, parts in entries for part in parts})
    number = {w: k + 2 for k, w in enumerate(vocabulary)}
    symbols, starts = [], []
    for _, _, parts in entries:
        symbols.append(_GAP)
        starts.append(len(symbols))
        symbols.extend([number[p] for p in parts])
    symbols.append(_END)
    index = FMIndex.over(np.array(symbols, np.int32), len(vocabulary) + 2)
    return [k for k, _, _ in entries], starts, [f for _, f, _ in entries], "\n".join(vocabulary), *index.packed()


def _search_shard(shard, phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """``(key, item, start, end)`` of one shard: spans in runs of letters and digits of the document, merged per item."""
    number = {w: k + 2 for k, w in enumerate(shard.vocabulary.split("\n"))}
    here = np.array([number.get(w, -1) for w in phrases.vocabulary] + [0], np.int64)
    tokens = here[phrases.tokens]  # -1 pads the left and takes the last entry, 0
    possible = np.flatnonzero((tokens >= 0).all(1))
    if not len(possible):
        return []
    index = FMIndex.restore((shard.bwt, shard.kept, shard.positions), len(number) + 2)
    which, low, high = index.search(tokens[possible])
    if not len(which):
        return []
    counts = high - low
    phrase = np.repeat(possible[which], counts)
    rows = np.repeat(low, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    at = index.locate(rows)
    starts, lengths = np.array(shard.starts), (phrases.tokens >= 0).sum(1)
    document = np.searchsorted(starts, at, side="right") - 1
    start = at - starts[document] + np.array(shard.first_parts)[document]
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, d, s in zip(phrase.tolist(), document.tolist(), start.tolist()):
        for item in phrases.items[p]:
            found.setdefault((d, item), []).append((s, s + int(lengths[p])))
    return [(shard.keys[d], item, s, e) for (d, item), spans in found.items() for s, e in merge_spans(*map(np.array, zip(*spans)))]


def phrases_of(items: DataFrame, key: str = "item_id", text: str = "text", words: int = LEAK_WORDS) -> DataFrame:
    """``(phrase, items)``: every ``words`` consecutive words of the items' passages once, with the items they stand in."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, body in zip(batch["_item"].tolist(), batch["_text"]):
                split = split_words(passage_of(body))
                rows += [([p for word in split[i : i + words] for p in word], item) for i in range(len(split) - words + 1)]
            yield pd.DataFrame(rows, columns=["phrase", "item"])

    held = items.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("_item"), F.col(text).alias("_text"))
    return held.mapInPandas(cut, "phrase array<string>, item long").groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


class CorpusIndex:
    """FM-indexes of a corpus in a folder on shared storage, one per shard of ``SHARD_CHARS`` characters.

    Each index covers all words of its shard, so any test set can be searched later without the corpus.
    New documents are added as further runs; a run that is written again replaces its own files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, documents: DataFrame, run: str = "0", key: str = "doc_id", text: str = "text", words: int = LEAK_WORDS) -> None:
        """Index documents where they are: every task packs its own rows into shards, no row is shuffled.

        NULL texts and texts without a word are in no index; documents longer than a shard are split into
        stretches that share ``words - 1`` words, so no phrase of ``words`` words is lost between them.
        """
        rows = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [c.split()[0] for c in _SHARD.split(", ")]
            entries: list[tuple[int, int, list[str]]] = []
            size = 0
            for batch in batches:
                for k, body in zip(batch["_key"].tolist(), batch["_text"]):
                    for first, parts in _pieces(body, words):
                        entries.append((k, first, parts))
                        size += sum(map(len, parts)) + len(parts)
                        if size >= SHARD_CHARS:
                            yield pd.DataFrame([_index_shard(entries)], columns=names)
                            entries, size = [], 0
            if entries:
                yield pd.DataFrame([_index_shard(entries)], columns=names)

        rows.mapInPandas(build, _SHARD).write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def search(self, items: DataFrame, key: str = "item_id", text: str = "text", words: int = LEAK_WORDS) -> DataFrame:
        """``(_key, item_id, span_start, span_end)``: the stretches of indexed documents that hold phrases of the items.

        Phrases go to the executors in blocks of about ``BLOCK_BYTES`` by their hash, so what is broadcast is
        bounded however large the test set is; every block reads the index once.
        """
        phrases = cut_lineage(phrases_of(items, key, text, words))
        total = phrases.agg(F.sum(F.length(F.array_join("phrase", " ")) + 8 * F.size("items"))).first()[0] or 0
        blocks = max(-(-total // BLOCK_BYTES), 1)
        shards = self.spark.read.schema(_SHARD).parquet(self.path)
        found = []
        for block in range(blocks if total else 0):
            some = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).select("phrase", "items")
            held = self.spark.sparkContext.broadcast(Phrases.of([(r.phrase, r["items"]) for r in some.collect()]))

            def look(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    rows = [row for shard in batch.itertuples(index=False) for row in _search_shard(shard, held.value)]
                    yield pd.DataFrame(rows, columns=[f.name for f in _SPANS])

            found.append(shards.mapInPandas(look, _SPANS))
        if not found:
            return self.spark.createDataFrame([], _SPANS)
        return _merged_spans(reduce(DataFrame.unionByName, found))


def _merged_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document and item as one: phrases of several blocks, stretches of long documents."""
    ordered = F.array_sort(F.collect_set(F.struct("span_start", "span_end")))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    grown = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["span_start"].alias("span_start"), F.greatest(last(acc)["span_end"], s["span_end"]).alias("span_end"))))
    merged = F.aggregate("_s", F.expr("cast(array() as array<struct<span_start: bigint, span_end: bigint>>)"), lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["span_end"] >= s["span_start"]), grown(acc, s)).otherwise(F.concat(acc, F.array(s))))
    return spans.groupBy("_key", "item_id").agg(ordered.alias("_s")).select("_key", "item_id", F.explode(merged).alias("_m")).select("_key", "item_id", "_m.span_start", "_m.span_end")


def leaked_spans(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = LEAK_WORDS, index_path: str | None = None) -> DataFrame:
    """``(key, item_id, span_start, span_end)``: the stretches of each document that quote ``words`` or more words of an item's passage.

    Positions count runs of letters and digits from 0, ``span_end`` is exclusive; overlapping finds of one
    item are one span. The documents are indexed into ``index_path``, where ``CorpusIndex.search`` asks it again
    for other items; without a path the index is made in the shared folder. NULL and short texts, passages of
    fewer words and empty tables give no rows.
    """
    spark = documents.sparkSession
    index = CorpusIndex(spark, index_path or f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}")
    index.add(documents, key=key, text=text, words=words)
    return index.search(items, item_key, item_text, words).withColumnRenamed("_key", key)


def leaked_documents(documents: DataFrame, items: DataFrame, key: str = "doc_id", **columns) -> DataFrame:
    """``(key, item_id)``: every document that contains a passage, fully or in part, with each item it leaks."""
    return leaked_spans(documents, items, key, **columns).select(key, "item_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame, key: str = "doc_id", **columns) -> DataFrame:
    """``(key, span_start, span_end, items)``: what to cut from each document, spans of different items merged."""
    spans = leaked_spans(documents, items, key, **columns)
    ordered = F.array_sort(F.collect_set(F.struct("span_start", "span_end", "item_id")))
    grouped = spans.groupBy(key).agg(ordered.alias("_s"))
    merged = F.aggregate(
        "_s",
        F.expr("cast(array() as array<struct<span_start: bigint, span_end: bigint, items: array<bigint>>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["span_end"] >= s["span_start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["span_start"].alias("span_start"), F.greatest(F.try_element_at(acc, F.lit(-1))["span_end"], s["span_end"]).alias("span_end"), F.array_sort(F.array_union(F.try_element_at(acc, F.lit(-1))["items"], F.array(s["item_id"]))).alias("items"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["span_start"].alias("span_start"), s["span_end"].alias("span_end"), F.array(s["item_id"]).alias("items"))))),
    )
    return grouped.select(key, F.explode(merged).alias("_m")).select(key, "_m.span_start", "_m.span_end", F.array_join(F.transform("_m.items", lambda i: i.cast("string")), ",").alias("items"))


def leak_report(documents: DataFrame, items: DataFrame, key: str = "doc_id", **columns) -> DataFrame:
    """``(item_id, documents)``: for every test item with a leak, in how many documents it stands."""
    return leaked_documents(documents, items, key, **columns).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
