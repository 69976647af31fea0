"""The title index: a folder of small-world graph shards per cell, searched and extended without a pass over history."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioflow.functions.graph import GRAPH_NODES, Graph
from biblioflow.functions.titles import DIMENSIONS, LINKS, head_of, same_title, trigram_weights, vectors
from biblioflow.session import cut_lineage

#: Titles that weights and cell centres are fitted on: this share of all, but neither fewer nor more than these numbers. Every title is indexed.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 0.02, 20_000, 400_000
#: Titles a cell should hold, and cells up to which centres are fitted at once; more are fitted zone by zone.
CELL_TITLES, FLAT_CELLS = 1500, 256
#: Nearest cells that a query looks into at least, and the least similarity of a candidate.
PROBE_CELLS, LEAST_SIMILARITY = 3, 0.55
#: A query looks into every cell that is less similar than its nearest by this much at most, so their number grows with the cells.
PROBE_MARGIN = 0.2
#: Similarities of asking titles to centres that are held at a time.
SPREAD_VALUES = 1_000_000
#: Runs of single batches that are merged into one when there are more.
COMPACT_OVER = 4
#: Days between publication dates of one work, at most.
DATE_SLACK = 7
#: A word that stands in more than this share of all titles identifies none.
COMMON_SHARE = 0.004
#: Step of the stored vectors: one byte for each of a vector's places.
_STEP = 1 / 254

_LISTS = {"nodes": T.LongType(), "forms": T.StringType(), "batches": T.IntegerType(), "first_days": T.IntegerType(), "last_days": T.IntegerType(), "bare": T.BooleanType(), "heads": T.BooleanType()}
_SHARD = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType())] + [T.StructField(n, T.ArrayType(t)) for n, t in _LISTS.items()] + [T.StructField("vectors", T.BinaryType()), T.StructField("links", T.BinaryType()), T.StructField("beam", T.IntegerType())])
_ENTRY = T.StructType(
    [T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("form", T.StringType()), T.StructField("batch", T.IntegerType())]
    + [T.StructField("first_day", T.IntegerType()), T.StructField("last_day", T.IntegerType()), T.StructField("is_bare", T.BooleanType()), T.StructField("head", T.BooleanType()), T.StructField("vector", T.BinaryType())]
)
_PAIR = T.StructType([T.StructField("ask_node", T.LongType()), T.StructField("node", T.LongType()), T.StructField("how", T.IntegerType())])


def packed(points: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes; places over a half are cut, which the length of one makes good again."""
    return np.clip(np.rint(points / _STEP), -127, 127).astype(np.int8)


def unpacked(data: bytes) -> np.ndarray:
    points = np.frombuffer(data, np.int8).reshape(-1, DIMENSIONS).astype(np.float32)
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)


def _centres(points: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """``k`` mean directions of unit vectors, from evenly spaced ones."""
    centres = points[np.linspace(0, max(len(points) - 1, 0), k).astype(int)] if len(points) else np.zeros((1, DIMENSIONS), np.float32)
    for _ in range(rounds if k > 1 else 0):
        at = (points @ centres.T).argmax(1)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(k), side="left")
        filled = np.bincount(at, minlength=k) > 0
        sums = np.add.reduceat(points[order], np.minimum(ends, len(points) - 1), axis=0)
        centres = np.where(filled[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9), centres).astype(np.float32)
    return centres


@dataclass(eq=False)
class TitleModel:
    """What all tasks share: trigram weights, cell centres and their zones, parts per cell, and the words too common to identify."""

    weights: np.ndarray
    centres: np.ndarray
    zones: np.ndarray
    parts: np.ndarray
    common: frozenset[str]
    margin: float = PROBE_MARGIN

    @classmethod
    def fit(cls, sample: list[str], total: int, cell_titles: int = CELL_TITLES, common: frozenset[str] = frozenset()) -> TitleModel:
        """Cells in proportion to ``total``: few are fitted at once, many in two levels, zones first and then the cells of each zone."""
        weights = trigram_weights(sample)
        entries = sample + [h for h in map(head_of, sample) if h]
        points, stored = vectors(entries, weights), total * len(entries) / max(len(sample), 1)
        k = int(np.clip(round(stored / cell_titles), 1, max(len(sample) // 8, 1)))
        n_zones = max(round(k**0.5), 1)
        if k <= FLAT_CELLS:
            centres = _centres(points, k)
            zones = (centres @ _centres(centres, n_zones).T).argmax(1)
        else:
            top = _centres(points, n_zones)
            at = (points @ top.T).argmax(1)
            share = np.maximum(np.rint(np.bincount(at, minlength=n_zones) * k / max(len(points), 1)), 1).astype(int)
            each = [_centres(points[at == z], min(share[z], max(int((at == z).sum()), 1))) if (at == z).any() else top[z : z + 1] for z in range(n_zones)]
            centres, zones = np.concatenate(each), np.repeat(np.arange(n_zones), [len(e) for e in each])
        order = np.argsort(zones, kind="stable")  # cells of a zone follow each other
        centres, zones = centres[order], zones[order]
        held = np.zeros(len(centres))
        for some in np.array_split(np.arange(len(points)), max(len(points) * len(centres) // 20_000_000, 1)):
            held += np.bincount((points[some] @ centres.T).argmax(1), minlength=len(centres))
        parts = np.ceil(held / max(len(entries), 1) * stored / GRAPH_NODES).clip(1).astype(np.int64)
        return cls(weights, centres.astype(np.float32), zones.astype(np.int32), parts, common)

    def rare(self, word: str) -> bool:
        return len(word) >= 5 and word not in self.common and word not in LINKS and not any(c.isdigit() for c in word)

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The nearest cell of each vector: where it is stored."""
        return (points @ self.centres.T).argmax(1)

    def probes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)`` of the cells that queries look into: all within the margin of the nearest, ``PROBE_CELLS`` at least."""
        near = points @ self.centres.T
        m = min(PROBE_CELLS, len(self.centres))
        least = np.partition(near, -m, axis=1)[:, -m]
        return np.nonzero(near >= np.minimum(near.max(1) - self.margin, least)[:, None])


def common_words(titles: DataFrame, total: int) -> frozenset[str]:
    """The words in more than ``COMMON_SHARE`` of all titles, counted over all of them; titles are short, so these are few thousand at most."""
    words = F.filter(F.regexp_extract_all("form", F.lit(r"[\p{L}\p{M}\p{N}]{5,}"), F.lit(0)), lambda w: ~w.rlike(r"\p{N}"))
    counted = titles.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return frozenset(r.w for r in counted.where(F.col("n") > max(COMMON_SHARE * total, 2)).select("w").collect())


def fit_title_model(titles: DataFrame, total: int) -> TitleModel:
    """The model fitted on titles of smallest hash, a number that has a lower and an upper bound; common words are those of all titles."""
    wanted = min(max(SAMPLE_LEAST, int(SAMPLE_SHARE * total)), SAMPLE_MOST)
    share = min(1.0, wanted / max(total, 1))
    sample = titles.where(F.xxhash64("form") / F.lit(2.0**64) + 0.5 <= share).select("form").toPandas()["form"]
    return TitleModel.fit(sorted(sample), total, common=common_words(titles, total))


def with_heads(titles: pd.DataFrame) -> pd.DataFrame:
    """Titles, and once more those with a subtitle, where ``look`` is the main title: a title that lost its subtitle lies near that."""
    heads = titles["form"].map(head_of)
    short = heads.notna()
    return pd.concat([titles.assign(look=titles["form"], head=False), titles[short].assign(look=heads[short], head=True)], ignore_index=True)


def _spread(model, probe: bool):
    """Titles with the cells they are stored in, or that a query looks into, and their vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: TitleModel = model.value
        names = [f.name for f in _ENTRY]
        step = max(SPREAD_VALUES // len(m.centres), 16) if probe else max(20 * SPREAD_VALUES // len(m.centres), 16)
        for batch in batches:
            if not len(batch):
                continue
            entries = with_heads(batch)
            points = vectors(entries["look"].tolist(), m.weights)
            entries["vector"] = [v.tobytes() for v in packed(points)]
            for at in range(0, len(entries), step):
                some = entries.iloc[at : at + step]
                if probe:
                    row, cell = m.probes(points[at : at + step])
                    parts = m.parts[cell]
                    yield some.iloc[np.repeat(row, parts)].assign(cell=np.repeat(cell, parts), part=np.concatenate([np.arange(n) for n in parts]))[names]
                else:
                    cell = m.cells(points[at : at + step])
                    yield some.assign(cell=cell, part=some["node"].to_numpy() % m.parts[cell])[names]

    return run


def _shards(cell: int, part: int, rows: pd.DataFrame) -> list[tuple]:
    """Graphs over the entries of one part of a cell; GRAPH_NODES bounds each."""
    out = []
    for at in range(0, len(rows), GRAPH_NODES):
        some = rows.iloc[at : at + GRAPH_NODES]
        stored = np.frombuffer(b"".join(some["vector"]), np.int8).reshape(-1, DIMENSIONS)
        links, beam = Graph(unpacked(stored.tobytes()), LEAST_SIMILARITY).links_and_beam()
        out.append((cell, part, *(some[c].tolist() for c in ("node", "form", "batch", "first_day", "last_day", "is_bare", "head")), stored.tobytes(), links, beam))
    return out


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards of entries that arrive sorted by cell and part; at most one part is held."""
    names = [f.name for f in _SHARD]
    held: list[pd.DataFrame] = []
    current = None

    def flush():
        rows = pd.concat(held).sort_values(["node", "head"])
        return pd.DataFrame(_shards(*current, rows), columns=names)

    for batch in batches:
        for key, rows in batch.groupby(["cell", "part"], sort=False):
            if key != current and held:
                yield flush()
                held.clear()
            current = key
            held.append(rows)
    if held:
        yield flush()


class _OpenShard:
    def __init__(self, row):
        self.graph = Graph.of(unpacked(row.vectors), row.links, row.beam, LEAST_SIMILARITY)
        self.nodes, self.forms = row.nodes, row.forms
        self.batches, self.first, self.last, self.bare, self.head = (np.array(c) for c in (row.batches, row.first_days, row.last_days, row.bare, row.heads))

    def pairs(self, asking: pd.DataFrame, points: np.ndarray, rare) -> Iterator[tuple[int, int, int]]:
        q, node = self.graph.search(points)
        batch, since, until, bare, head = (asking[c].to_numpy() for c in ("batch", "first_day", "last_day", "is_bare", "head"))
        may = (self.batches[node] <= batch[q]) & (since[q] - DATE_SLACK <= self.last[node]) & (self.first[node] - DATE_SLACK <= until[q])
        may &= (bare[q] | self.bare[node]) & ~(head[q] & self.head[node])  # two main titles say nothing of two titles
        nodes, forms = asking["node"].to_numpy(), asking["form"].to_numpy()
        for i, j in zip(q[may].tolist(), node[may].tolist()):
            if nodes[i] != self.nodes[j] and (how := same_title(forms[i], self.forms[j], rare)):
                yield int(nodes[i]), int(self.nodes[j]), how


def _search(model):
    """Pairs of rows that arrive sorted by cell, part and role: a part's shards are opened, then its queries pass in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare = model.value.rare
        current, shards = None, []
        for batch in batches:
            pairs: set[tuple[int, int, int]] = set()
            for key, rows in batch.groupby(["cell", "part"], sort=False):
                if key != current:
                    current, shards = key, []
                for row in rows[rows["role"] == 0].itertuples(index=False):
                    shards.append(_OpenShard(row))
                asking = rows[rows["role"] == 1]
                for at in range(0, len(asking) if shards else 0, 512):
                    some = asking.iloc[at : at + 512]
                    points = unpacked(b"".join(some["vector"]))
                    for shard in shards:
                        pairs.update(shard.pairs(some, points, rare))
            yield pd.DataFrame(sorted(pairs), columns=[f.name for f in _PAIR])

    return run


class TitleIndex:
    """A folder of graph shards on shared storage: ``model``, and ``shards/<first>-<last>/zone=<z>`` for runs of batches.

    A batch is searched against the cells it looks into and then added as a run of its own, which touches
    no other shard. Cells number in proportion to the titles the model was fitted for, so a title meets the
    same number of others in a cell at every size; files are laid out by zone and cell, and only those of
    the cells that a batch looks into are read. When more than ``COMPACT_OVER`` single runs have gathered,
    ``extend`` merges their shards cell by cell; history (batch 0) stays as it is. A run that was not
    written to its end has no success mark and is ignored; writing it again replaces it. When titles have
    outgrown the model several times over, ``create`` fits a new one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._model = spark, path.rstrip("/"), None

    def create(self, history: DataFrame, total: int | None = None, margin: float = PROBE_MARGIN) -> None:
        """Fit the model and index all of ``history(node, form, first_day, last_day, bare)``."""
        model = fit_title_model(history, history.count() if total is None else total)
        row = (model.weights.astype(np.float32).tobytes(), model.centres.astype(np.float32).tobytes(), model.zones.tolist(), model.parts.tolist(), json.dumps(sorted(model.common)), margin)
        self.spark.createDataFrame([row], "weights binary, centres binary, zones array<int>, parts array<long>, common string, margin double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")
        self._model = None
        self.add(history, 0)

    @property
    def model(self):
        if self._model is None:
            row = self.spark.read.parquet(f"{self.path}/model").first()
            centres = np.frombuffer(row.centres, np.float32).reshape(-1, DIMENSIONS)
            self._model = self.spark.sparkContext.broadcast(TitleModel(np.frombuffer(row.weights, np.float32), centres, np.array(row.zones), np.array(row.parts), frozenset(json.loads(row.common)), row.margin))
        return self._model

    def add(self, titles: DataFrame, batch: int, last: int | None = None) -> None:
        """Write the shards of a batch, or of the batches up to ``last`` that ``titles.batch`` tells apart, as one run."""
        numbered = titles if "batch" in titles.columns else titles.withColumn("batch", F.lit(batch))
        self._write(self._entries(numbered, False), batch, batch if last is None else last)

    def extend(self, titles: DataFrame, batch: int) -> None:
        """``add``, and the compaction that is due."""
        self.add(titles, batch)
        self.compact()

    def _entries(self, titles: DataFrame, probe: bool) -> DataFrame:
        shown = titles.select("node", "form", F.col("batch").cast("int").alias("batch"), "first_day", "last_day", F.col("bare").alias("is_bare"))
        return shown.mapInPandas(_spread(self.model, probe), _ENTRY)

    def _write(self, entries: DataFrame, first: int, last: int) -> None:
        """One shuffle: neighbouring cells come to one task, which writes few files for the zones they belong to."""
        model = self.model
        cells = len(model.value.centres)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        neighbours = F.floor(F.col("cell") * F.lit(min(3 * tasks, cells)) / F.lit(cells))
        gathered = entries.repartition(tasks, neighbours).sortWithinPartitions("cell", "part")

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for shards in _build(batches):
                yield shards.assign(zone=model.value.zones[shards["cell"].to_numpy(dtype=int)])

        laid_out = gathered.mapInPandas(build, T.StructType([*_SHARD.fields, T.StructField("zone", T.IntegerType())]))
        laid_out.write.mode("overwrite").option("parquet.block.size", 1 << 20).partitionBy("zone").parquet(f"{self.path}/shards/{first}-{last}")

    def runs(self) -> list[tuple[int, int]]:
        """The runs that together hold every batch once, longer ones before what they were merged from."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/shards")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = []
        for status in files.listStatus(folder):
            name = re.fullmatch(r"(\d+)-(\d+)", status.getPath().getName())
            if name and files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append((int(name[1]), int(name[2])))
        found.sort(key=lambda r: (r[0] - r[1], r))
        chosen: list[tuple[int, int]] = []
        for run in found:
            if all(run[1] < other[0] or run[0] > other[1] for other in chosen):
                chosen.append(run)
        return sorted(chosen)

    def shards(self, runs: list[tuple[int, int]], cells: list[int] | None = None) -> DataFrame:
        """The shards of some runs; with ``cells``, those of their zones' files whose row groups hold one of them."""
        schema = T.StructType([*_SHARD.fields, T.StructField("zone", T.IntegerType())])
        read = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/shards/{a}-{b}") for a, b in runs])
        if cells is not None:
            zones = sorted({int(self.model.value.zones[c]) for c in cells})
            read = read.where(F.col("zone").isin(zones) & F.col("cell").isin(cells))
        return read.drop("zone")

    def search(self, titles: DataFrame) -> DataFrame:
        """``(ask_node, node, how)``: indexed titles that are the same, of batches up to the asking title's ``batch`` if it has one.

        What reaches the driver are the numbers of the cells to read, at most all cells of the model.
        """
        numbered = titles if "batch" in titles.columns else titles.withColumn("batch", F.lit(2**31 - 1))
        asking = cut_lineage(self._entries(numbered, True))
        cells = sorted(r.cell for r in asking.select("cell").distinct().collect())
        runs = self.runs()
        if not cells or not runs:
            return self.spark.createDataFrame([], _PAIR)
        held = self.shards(runs, cells).withColumns({"role": F.lit(0), "node": F.lit(0).cast("long"), "batch": F.lit(0), "first_day": F.lit(0), "last_day": F.lit(0), "is_bare": F.lit(False), "head": F.lit(False)})
        both = held.unionByName(asking.withColumns({"role": F.lit(1), "beam": F.lit(0)}), allowMissingColumns=True)
        met = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "role").mapInPandas(_search(self.model), _PAIR)
        return met.groupBy("ask_node", "node").agg(F.min("how").alias("how"))

    def compact(self) -> bool:
        """Merge the runs of single batches into one if there are more than ``COMPACT_OVER``; true if it did.

        Batch numbers may have gaps; the merged run spans from the first to the last of them.
        """
        single = [r for r in self.runs() if r[0] == r[1] and r[0] > 0]
        if len(single) <= COMPACT_OVER:
            return False
        within = [r for r in self.runs() if single[0][0] <= r[0] and r[1] <= single[-1][1]]
        zipped = F.explode(F.arrays_zip(*_LISTS, F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.substring(F.col("vectors"), i * DIMENSIONS + 1, F.lit(DIMENSIONS))).alias("vector"))).alias("e")
        one = {"nodes": "node", "forms": "form", "batches": "batch", "first_days": "first_day", "last_days": "last_day", "bare": "is_bare", "heads": "head", "vector": "vector"}
        entries = self.shards(within).select("cell", "part", zipped).select("cell", "part", *[F.col(f"e.{a}").alias(b) for a, b in one.items()])
        self._write(entries, within[0][0], within[-1][1])
        return True

