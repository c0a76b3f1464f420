"""All report files of a folder in one scan, each in its own dialect, as a table of cells or as a stream of them.

Spark's file source lists the folder and packs files into partitions by their size; no path passes through a collected row
and there is no branch of the plan for a header. A stream remembers the files it has read in its checkpoint.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import cells
from .snapshots import header_names, plain_path, stem

#: What one file gives: its dialect, a row's place in it, the row's cells by header, or why the file can't be read.
CELLS = "path string, encoding string, delimiter string, headers array<string>, row_ix long, cells map<string,string>, error string"
#: Characters of a cell beyond which its file counts as broken: a quote that never ends would swallow the rest.
LONGEST_CELL = 1 << 30
#: Rows and characters of an Arrow batch that a task gives.
BATCH_ROWS, BATCH_CHARS = 4_096, 8 << 20
_FILES = "path string, modificationTime timestamp, length long, content binary"


def dialect(data: bytes) -> tuple[str, str]:
    """(encoding, delimiter) of a file: UTF-8 if it all is, else windows-1252, whose five undefined bytes stand for themselves;
    the most frequent of `;`, `,` and tab in the header line outside quotes, in this order where they are equal."""
    try:
        data.decode("utf-8")
        encoding = "UTF-8"
    except UnicodeDecodeError:
        encoding = "windows-1252"
    line = re.sub(rb'"[^"]*"', b"", data.removeprefix(b"\xef\xbb\xbf").split(b"\n", 1)[0])
    n = {d: line.count(d.encode()) for d in ";,\t"}
    if n["\t"] > max(n[";"], n[","]):
        return encoding, "\t"
    return encoding, ";" if n[";"] >= n[","] and n[";"] else ","


def decode(data: bytes, encoding: str) -> str:
    if encoding == "UTF-8":
        return data.decode("utf-8").removeprefix("﻿")
    try:
        return data.decode("cp1252")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)


def rows_of(data: bytes) -> tuple[str, str, list[str], Iterator[dict[str, str]]]:
    """(encoding, delimiter, headers, rows) of a file: trimmed cells by header. Short rows give '', cells beyond the header are
    left out, lines without a character are no rows; of equal headers the last one counts and blank ones are numbered."""
    encoding, delimiter = dialect(data)
    records = csv.reader(io.StringIO(decode(data, encoding), newline=""), delimiter=delimiter)
    first = next(records, [])
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter).writerow(first)
    names, kept = header_names(out.getvalue().rstrip("\r\n"), delimiter) if first else ([], [])
    places = [(n, names.index(n)) for n in kept]

    def every() -> Iterator[dict[str, str]]:
        for record in records:
            if record:
                yield {n: record[i].strip() if i < len(record) else "" for n, i in places}

    return encoding, delimiter, kept, every()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files as Arrow batches of cells; a file that can't be read, or has no row, gives one row without a number."""
    csv.field_size_limit(LONGEST_CELL)
    schema = pa.schema([("path", pa.string()), ("encoding", pa.string()), ("delimiter", pa.string()), ("headers", pa.list_(pa.string())), ("row_ix", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
    held: list[tuple] = []
    chars = 0
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            about, ix = (path, None, None, None), 0
            try:
                encoding, delimiter, headers, rows = rows_of(content.as_py() or b"")
                about = (path, encoding, delimiter, headers)
                for row in rows:
                    held.append((*about, ix, list(row.items()), None))
                    chars += sum(map(len, row.values())) + 32 * len(row)
                    ix += 1
                    if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema=schema)
                        held, chars = [], 0
                if not ix:
                    held.append((*about, None, None, None))
            except (csv.Error, ValueError) as e:
                held.append((*about, None, None, str(e)))
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema=schema)


def _named(scanned: DataFrame) -> DataFrame:
    name = stem("path")
    return scanned.select(plain_path("path").alias("path"), cells.family_of(name).alias("family"), cells.stamp_of(name).alias("captured_at"), "encoding", "delimiter", "headers", "row_ix", "cells", "error")


def _bounded(spark: SparkSession) -> None:
    """Few files a batch on their way into Python, as each may be large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_CHARS))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """path, family, captured_at, encoding, delimiter, headers, row_ix, cells, error: all rows of all stamped CSV files below a folder.

    A column that a file does not have is no cell; a blank one is ''. A file without rows gives one row whose row_ix and cells
    are null, so its headers are known; one that can't be parsed keeps the rows before the fault and gives such a row with its
    error. Files without a stamp in their names are left out before they are read; files without a byte are none to Spark. A file is one task's work and is held as a
    whole, up to the 2 GB of one value.
    """
    _bounded(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(folder)
    return _named(files.select("path", "content").filter(cells.stamp_of(stem("path")).isNotNull()).mapInArrow(_scan, CELLS))


def stream_reports(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """The same rows as a stream of the folder: each file once, when it comes."""
    _bounded(spark)
    files = spark.readStream.schema(_FILES).format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return _named(files.select("path", "content").filter(cells.stamp_of(stem("path")).isNotNull()).mapInArrow(_scan, CELLS))


def land(reports: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of rows as Parquet by family; stops when all files that are there have been read."""
    return reports.writeStream.format("parquet").partitionBy("family").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def family_rows(reports: DataFrame, family: str, columns: list[str]) -> DataFrame:
    """Rows of a family with the given columns, whatever their case in a file; null where the file lacks one."""
    low = F.transform_keys("cells", lambda k, _: F.lower(F.trim(k)))
    get = lambda c: F.try_element_at("_cells", F.lit(c.lower()))
    own = reports.filter((F.col("family") == family) & F.col("row_ix").isNotNull()).withColumn("_cells", low)
    return own.select("path", "captured_at", "row_ix", *(get(c).alias(c) for c in columns))


def family_table(reports: DataFrame, family: str) -> DataFrame:
    """Rows of a family under all headers that any of its files has, in the order of their first sight; only those names are collected."""
    own = reports.filter(F.col("family") == family)
    seen = own.select("captured_at", F.posexplode("headers").alias("place", "name")).groupBy(F.lower("name").alias("low")).agg(F.min_by("name", F.struct("captured_at", "place")).alias("name"), F.min(F.struct("captured_at", "place")).alias("at"))
    return family_rows(own, family, [r.name for r in seen.orderBy("at", "low").collect()])


def header_table(reports: DataFrame) -> DataFrame:
    """path, family, captured_at, headers, row_count, error: one row a file."""
    return reports.groupBy("path", "family", "captured_at").agg(F.first("headers", ignorenulls=True).alias("headers"), F.count("row_ix").alias("row_count"), F.max("error").alias("error"))
