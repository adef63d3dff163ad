"""Sources: fetched pages, the target catalogue, JSON files, landed binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum import schemas
from lyceum.operators import layout


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html)."""
    return spark.read.parquet(path)


def targets(spark: SparkSession, path: str) -> DataFrame:
    """The target catalogue of a JSON file (a list of objects), with its ordinal from 1 as written. A whole-file JSON document is
    read by one task, so the numbers have no gaps; path must name one file."""
    rows = spark.read.schema(schemas.TARGET).option("multiLine", True).json(path)
    return rows.select((F.monotonically_increasing_id() + 1).alias("ordinal"), "*")


def json_file(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Whole-file JSON, or an object a line as save_json writes it; broken files give a row of nulls, not an error."""
    reader = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Landed files (path, modificationTime, length, content); content is read only if asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def pdf_lines(files: DataFrame, reader=None) -> DataFrame:
    """(path, page, lines) of PDF files by a reader: bytes -> iterable of (page number, lines of spans). None is installed by
    default, so the caller brings one."""
    if reader is None:
        raise NotImplementedError("no PDF reader is installed: pass reader(bytes) -> [(page, lines)]")

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, n, lines) for p, c in zip(frame["path"], frame["content"], strict=True) for n, lines in reader(c)]
            yield pd.DataFrame(rows, columns=["path", "page", "lines"])

    return files.select("path", "content").mapInPandas(run, f"path string, page int, lines {schemas.SPAN_LINES}")


def span_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, blocks) of landed dumps of positioned text: an object a line for each page of a PDF file, its blocks as PDF libraries
    give them (type 0 for text, lines, spans with their origin). Files are split by size; broken lines give a row of nulls."""
    rows = spark.read.schema(schemas.SPAN_PAGE).option("mode", "PERMISSIVE").json(path)
    return rows.select("path", "page", layout.text_blocks(F.col("blocks")).alias("blocks"))
