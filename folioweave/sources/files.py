"""Reading landing tables, pages and block lists; writing citations and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioweave.config import CAPABILITIES, Config
from folioweave.functions.cite import formatter
from folioweave.operators.documents import parse_blocks
from folioweave.sources.records import parse


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """A table of records with ``ord``, their order of arrival."""
    return spark.read.parquet(path).withColumn("ord", F.col("paper_id"))


def read_landing(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Payloads, one JSON text a line, as canonical records of ``source`` in no order but their ids."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("paper_id"), F.lit(source).alias("source"), F.col("value").alias("raw_data"))
    return parse(lines, source)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, page): web pages, a file each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page_id"), F.col("value").alias("page"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of documents from JSON block lists, a file each."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("content"))
    return parse_blocks(files, "doc", "content")


def scan_all(records: DataFrame, source: str, most: int | None = None, config: Config | None = None, ord: str = "ord") -> DataFrame:
    """The first records of a source, as many as asked for and as its limit allows; beyond its largest offset only with cursors."""
    limit = (config or Config()).scan_limit(source)
    limit = min(most, limit) if most is not None else limit
    _, reach, cursors = CAPABILITIES[source]
    return records.orderBy(ord).limit(limit if cursors or reach is None else min(limit, reach))


def after(records: DataFrame, cursor: int | None, size: int, ord: str = "ord") -> DataFrame:
    """The page behind a cursor, the last ``ord`` seen; None for the first."""
    rows = records if cursor is None else records.filter(F.col(ord) > cursor)
    return rows.orderBy(ord).limit(size)


def offset_page(records: DataFrame, source: str, offset: int, limit: int, ord: str = "ord") -> DataFrame:
    """A page by offset, clamped to what the source allows."""
    size, most, _ = CAPABILITIES[source]
    if most is not None:
        offset = min(offset, max(0, most - limit))
    return records.orderBy(ord).offset(offset).limit(min(limit, size))


def numbered_page(records: DataFrame, offset: int, limit: int, ord: str = "ord") -> DataFrame:
    """The page that holds the row at ``offset``, for services that count pages of ``limit`` rows instead of rows."""
    size = max(limit, 1)
    return records.orderBy(ord).offset(offset // size * size).limit(limit)


def citations(records: DataFrame, form: str, ord: str = "ord") -> DataFrame:
    """(ord, entry): each record in a citation format; an unknown format is an error."""
    return records.select(ord, formatter(form)(F.col).alias("entry"))


def write_citations(records: DataFrame, form: str, path: str, ord: str = "ord") -> None:
    """Entries in order, a blank line between them; EndNote entries in one document.

    The files are written by many tasks in ranges of ``ord``: read in order of their names
    they are one text.  ``form`` endnote puts its head and foot in files of their own.
    """
    entries = citations(records, form, ord)
    rows = entries.repartitionByRange(F.col(ord)).sortWithinPartitions(ord)
    xml = form.lower() in ("endnote", "xml")
    rows.select(F.col("entry") if xml else F.concat("entry", F.lit("\n"))).write.mode("overwrite").text(f"{path}/entries" if xml else path)
    if xml:
        spark = records.sparkSession
        spark.createDataFrame([('<?xml version="1.0" encoding="UTF-8"?>\n<xml>\n<records>',)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_head")
        spark.createDataFrame([("</records>\n</xml>",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/~foot")


def write_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)
