"""Where files come from: folders, columns, a ranged reader, and a stream of arrivals."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_folder(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, path, length, content) of a folder's files; the id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def from_column(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(doc_id, path, length, content) out of a BINARY column of any table."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.lit(None).cast("string").alias("path"),
        F.octet_length(content_col).cast("long").alias("length"),
        F.col(content_col).alias("content"),
    )


def stream_folder(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """The same of a folder that files arrive in, as a stream; each file is one row, so
    whatever reads it further is stateless."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def header_by_sql(files: DataFrame) -> DataFrame:
    """(doc_id, header_pos, header_version, startxref) by expressions alone: the header
    in the first 4,096 bytes, the last startxref in the last 4,096."""
    head = F.expr("decode(substring(content, 1, 4096), 'ISO-8859-1')")
    tail = F.expr("decode(substring(content, -4096), 'ISO-8859-1')")
    at = F.instr(head, "%PDF-")
    found = F.regexp_extract_all(tail, F.lit(r"startxref[\x00\t\n\f\r ]*([+-]?\d+)"), F.lit(1))
    return files.select(
        "doc_id",
        F.when(at > 0, at - 1).cast("long").alias("header_pos"),
        F.nullif(F.regexp_extract(head, r"%PDF-(\d\.\d)(?=[\x00\t\n\f\r %]|$)", 1), F.lit("")).alias("header_version"),
        F.try_element_at(found, F.lit(-1)).cast("long").alias("startxref"),
    )


class _Range(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class RangedReader(DataSourceReader):
    """Reads only the ends of each file: what header and tail need of any length."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("bytes", 4096))
        self.per_task = int(options.get("filesPerTask", 256))

    def partitions(self) -> list[InputPartition]:
        paths = sorted(glob.glob(os.path.join(self.path, "**", "*.pdf"), recursive=True))
        return [_Range(paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)] or [_Range([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            with open(path, "rb") as f:
                length = f.seek(0, os.SEEK_END)
                f.seek(0)
                head = f.read(self.bytes)
                f.seek(max(0, length - self.bytes))
                yield path, length, head, f.read(self.bytes)


class PdfEnds(DataSource):
    """``spark.read.format("pdf_ends").option("path", ...)``: (path, length, head, tail)."""

    @classmethod
    def name(cls) -> str:
        return "pdf_ends"

    def schema(self) -> str:
        return "path string, length long, head binary, tail binary"

    def reader(self, schema) -> DataSourceReader:
        return RangedReader(self.options)
