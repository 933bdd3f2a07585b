"""Sources of documents: raw files, HTML, Markdown, tagged text, and a hook for page parsers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.exprs import byte_size, pdf_date, pdf_version
from ..operators.export import markdown_html


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path).withColumnRenamed("text", "html")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path).select("path", markdown_html(F.col("text")).alias("html"))


def tagged_files(spark: SparkSession, path: str) -> DataFrame:
    """path, raw of files with tagged markup."""
    return whole_texts(spark, path).withColumnRenamed("text", "raw")


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, version, size and readable size of files with page content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", pdf_version(F.col("content")).alias("version"), F.col("length").alias("size"), byte_size(F.col("length")).alias("size_text"))


def metadata(info: DataFrame) -> DataFrame:
    """Document metadata with empty defaults and plain dates."""
    plain = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "author", "subject", "creator", "producer")]
    return info.select("doc_id", *plain, *[pdf_date(F.col(c)).alias(c) for c in ("created", "modified")], F.coalesce("encrypted", F.lit(False)).alias("encrypted"))


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict, parser: type):
        self.options, self.parser = options, parser

    def partitions(self) -> list[InputPartition]:
        step = int(self.options.get("pages_per_partition", 50))
        parser, out = self.parser(), []
        for path in self.options["paths"].split(","):
            n = parser.count_pages(path)
            out += [_Range(path, k, min(k + step, n)) for k in range(0, n, step)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        parser = self.parser()
        for page in range(partition.first, partition.last):
            yield from parser.read_page(partition.path, page)


def page_source(name: str, schema: str, parser: type) -> type[DataSource]:
    """A Python data source over a page parser: a class with count_pages(path) and read_page(path, page), which yields rows of the schema.

    One partition holds a range of pages of one file, so a long file is read by many tasks. Register it with
    ``spark.dataSource.register`` and load it with the options paths (comma-separated) and pages_per_partition.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:
            return _Reader(self.options, parser)

    return Source


def stored_images(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """image_id, png, pw, ph of a stored table; only those of wanted (image_id), if given."""
    images = spark.read.parquet(path)
    return images.join(wanted.select("image_id").distinct(), "image_id", "left_semi") if wanted is not None else images


