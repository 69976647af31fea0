"""The extension point: papers as a Python data source that ``spark.read.format`` and ``write.format`` know by name.

A source of papers is a function that lists partitions and one that reads a partition; a target is a function that
takes records. ``register`` gives both a name.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from biblioflow.schema import PAPER_SCHEMA


class _Reader(DataSourceReader):
    def __init__(self, options: dict, list_partitions, read_partition):
        self.options, self.list_partitions, self.read_partition = options, list_partitions, read_partition

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.list_partitions(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for paper in self.read_partition(partition.value, self.options):
            yield tuple(_value(f.name, paper.get(f.name)) for f in PAPER_SCHEMA.fields)


def _value(name: str, value):
    return datetime.date.fromisoformat(value) if name.endswith("_date") and isinstance(value, str) else value


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, write_records):
        self.options, self.write_records = options, write_records

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        self.write_records((row.asDict(recursive=True) for row in rows), self.options)
        return WriterCommitMessage()


def register(spark: SparkSession, name: str, list_partitions: Callable[[dict], list] | None = None, read_partition: Callable[[object, dict], Iterator[dict]] | None = None, write_records: Callable[[Iterator[dict], dict], None] | None = None) -> None:
    """Make ``name`` a format of the session: partitions are listed on the driver, read and written on the executors."""

    class Papers(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return PAPER_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), list_partitions, read_partition)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(dict(self.options), write_records)

    spark.dataSource.register(Papers)
