"""Readers for exported tables, feeds, text folders and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAD_ROW = "_bad_row"
BREAKS = (("\\e", "\\"), ("\\n", "\n"), ("\\r", "\r"))  # in this order when written


def _with_bad_row(schema: str) -> str:
    return f"{schema}, {BAD_ROW} string"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", escaped: bool = False,
             multi_line: bool = False) -> DataFrame:
    """Exported CSV or TAB table with header; rows that do not fit land in ``_bad_row``.

    ``escaped`` undoes the line break marks of ``sinks.write_csv``. ``multi_line`` reads quoted
    cells with line breaks from other tools; such files are not split, so one task reads each.
    """
    rows = spark.read.schema(_with_bad_row(schema)).csv(
        path, header=True, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW,
        enforceSchema=True, escape='"', multiLine=multi_line)
    if not escaped:
        return rows
    texts = {n for n, kind in rows.dtypes if kind == "string" and n != BAD_ROW}
    return rows.select(*[unescape_breaks(F.col(n)).alias(n) if n in texts else F.col(n) for n in rows.columns])


def unescape_breaks(cell: Column) -> Column:
    """The cell before ``escape_breaks``."""
    for mark, plain in reversed(BREAKS):
        cell = F.replace(cell, F.lit(mark), F.lit(plain))
    return cell


def escape_breaks(cell: Column) -> Column:
    r"""The cell on one line: backslash, line end and carriage return as ``\e``, ``\n`` and ``\r``."""
    for mark, plain in BREAKS:
        cell = F.replace(cell, F.lit(plain), F.lit(mark))
    return cell


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exported chats, comments or history as JSON lines, with a bad-row column."""
    return spark.read.schema(_with_bad_row(schema)).json(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW)


def read_xml_items(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Items of a feed, one row per ``row_tag`` element."""
    return spark.read.schema(schema).format("xml").option("rowTag", row_tag).load(path)


def read_text_corpus(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """A folder of text files, one row per line or per file, with the file path."""
    return spark.read.text(folder, wholetext=whole, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), "value")


def file_inventory(spark: SparkSession, folder: str, block_mb: int = 4) -> DataFrame:
    """Name, extension, size, time and digest per file, whatever its size.

    Files are listed without their content and read block by block in the tasks,
    through the filesystem that the path names, so that a task holds one block.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        "path", "length", "modificationTime")
    size = block_mb << 20

    def digests(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with store.open_input_stream(inner) as stream:
                    while block := stream.read(size):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "digest"])

    rows = listed.mapInArrow(digests, "path string, length bigint, modificationTime timestamp, digest string")
    name = F.substring_index("path", "/", -1)
    return rows.select(
        name.alias("name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("extension"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "digest")


def inventory_totals(files: DataFrame) -> DataFrame:
    """Files, bytes and distinct contents by type."""
    return files.groupBy("extension").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_distinct("digest").alias("contents"))
