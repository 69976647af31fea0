"""Papers in JSON documents, read and written as arrays."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.schema import PAPER_SCHEMA, REQUIRED


def with_defaults(papers: DataFrame) -> DataFrame:
    """Papers with the model's defaults in place of NULL."""
    defaults = {"authors": F.array().cast("array<string>"), "abstract": F.lit(""), "item_type": F.lit("journalArticle"), "extra": F.lit("{}")}
    return papers.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in papers.columns})


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """The papers of a JSON array document with model defaults; a missing required field fails the load.

    A document with one record a line, as ``write_papers`` leaves it, is read line by line, in as many tasks
    as its size asks for; any other document is one task.
    """
    if is_line_by_line(spark, path):
        lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^,|,$", "").alias("j")).where(F.col("j").startswith("{"))
        papers = lines.select(F.from_json("j", PAPER_SCHEMA, {"mode": "FAILFAST"}).alias("p")).select("p.*")
    else:
        papers = spark.read.schema(PAPER_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    for name in REQUIRED:
        papers = papers.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"paper without {name}"))).otherwise(F.col(name)))
    return with_defaults(papers)


def is_line_by_line(spark: SparkSession, path: str) -> bool:
    """Whether a document begins with a bracket on a line of its own and a record on the next."""
    first = [r.value.strip() for r in spark.read.text(path).limit(2).collect()]
    return len(first) == 2 and first[0] == "[" and first[1].startswith("{") and first[1].endswith(("}", "},"))


def write_papers(papers: DataFrame, path: str, order: str | None = None, include_metadata: bool = True) -> dict:
    """Write a JSON array, one record a line, in ``order``.

    Executors write the records as parts beside ``path``; the parts are then joined in order within the
    file system, block by block, so no record passes the driver as a row.
    """
    spark = papers.sparkSession
    shown = papers if include_metadata else papers.drop("extra")
    rows = (shown.orderBy(order) if order else shown).select(F.concat(F.lit(","), F.to_json(F.struct(*[c for c in shown.columns if c != order or order in PAPER_SCHEMA.names]))).alias("value"))
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    rows.write.text(parts)
    count = spark.read.text(parts).count()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    files = folder.getFileSystem(conf)
    held = sorted((f for f in files.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
    out = files.create(jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        out.write(bytearray(b"[\n"))
        for status in held:
            source = files.open(status.getPath())
            source.skip(1 if status is held[0] else 0)  # no comma before the first record
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
        out.write(bytearray(b"]\n"))
    finally:
        out.close()
        files.delete(folder, True)
    return {"count": count, "filepath": path, "success": True}


def papers_from_text(spark: SparkSession, text: str) -> DataFrame:
    """Papers of a JSON array given as text; anything but an array is an error."""
    data = json.loads(text)
    if not isinstance(data, list):
        raise ValueError("papers must be a JSON array")
    for paper in data:
        for name in REQUIRED:
            if not isinstance(paper, dict) or paper.get(name) is None:
                raise ValueError(f"paper without {name}")
    lines = [(json.dumps(p if isinstance(p.get("extra"), str | None) else p | {"extra": json.dumps(p["extra"])}),) for p in data]
    return spark.createDataFrame(lines, "j string").select(F.from_json("j", PAPER_SCHEMA).alias("p")).select("p.*")
