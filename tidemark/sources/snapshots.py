"""Folders of dated CSV reports: catalogue, tolerant reading, sinks."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells

# Fixed value: families whose histories are one for entities. Comparison folds other ones, for their rules alone, in plans.families.
ENTITY_FAMILIES = {"Entra_Users_AuthenticationMethods_Hybrid": "Entra_Users_AuthenticationMethods"}
#: The code points of ISO-8859-1 that windows-1252 gives other characters; Spark reads the former alone.
WINDOWS = tuple(zip(*((chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)), strict=True))
WINDOWS = "".join(WINDOWS[0]), "".join(WINDOWS[1])
CHANGE_COLUMNS = ("Change", "Identity", "Property", "Before", "After")


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(cells.col(path), "/"), -1), r"(?i)\.csv$", "")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """path, family, captured_at, size, modified, seq of every stamped CSV file; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    named = files.select("path", cells.family_of(stem("path")).alias("family"), cells.stamp_of(stem("path")).alias("captured_at"), "size", "modified").filter("captured_at is not null")
    return named.withColumn("seq", F.row_number().over(Window.partitionBy("family").orderBy("captured_at", "path")))


def canonical_family(family: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ENTITY_FAMILIES.items() for x in kv]), cells.col(family)), cells.col(family))


def merged_histories(snapshots: DataFrame) -> DataFrame:
    """Snapshots under their entity family, numbered anew by capture time."""
    own = snapshots.withColumn("family", canonical_family("family"))
    return own.withColumn("seq", F.row_number().over(Window.partitionBy("family").orderBy("captured_at", "path")))


def plain_path(c: str, encoded: bool = False) -> Column:
    """A path without the local scheme; encoded: as Spark's file metadata give it, with escapes."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))) if encoded else F.col(c), "^file:/+", "/")


def dialects(spark: SparkSession, folder: str) -> DataFrame:
    """path, encoding (UTF-8 or windows-1252), delimiter and header of each file; files without a byte are none to Spark.

    Files are read line by line, never as a whole: the encoding is UTF-8 if all lines are, the delimiter is the most frequent
    of `;`, `,` and tab in the header line outside quotes.
    """
    rows = spark.read.option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    heads = rows.groupBy("path").agg(F.min_by(F.col("value").cast("binary"), "place").alias("head"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    head = files.join(heads.select(plain_path("path", True).alias("_p"), "head", "utf8"), plain_path("path") == F.col("_p"), "left")
    utf8 = F.coalesce("utf8", F.lit(True))
    line = F.regexp_replace(F.coalesce(F.when(utf8, F.make_valid_utf8(F.col("head").cast("string"))).otherwise(F.decode("head", "ISO-8859-1")), F.lit("")), "^\ufeff|\r$", "")
    bare = F.regexp_replace(line, '"[^"]*"', "")
    n = lambda d: F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))
    best = F.when((n("\t") > n(";")) & (n("\t") > n(",")), "\t").when(n(";") >= n(","), F.when(n(";") > 0, ";").otherwise(",")).otherwise(",")
    return head.select("path", F.when(utf8, "UTF-8").otherwise("windows-1252").alias("encoding"), best.alias("delimiter"), line.alias("header"))


def header_names(header: str, delimiter: str) -> tuple[list[str], list[str]]:
    """(a name for each field of a header line, the names that are kept): quotes are read, blanks are numbered, and of equal names the last one counts."""
    fields = [h.strip() for h in next(csv.reader([header], delimiter=delimiter), [])]
    low = [h.lower() for h in fields]
    names = [f"column{i}" if not h else h if h.lower() not in low[i + 1 :] else f"_repeated{i}" for i, h in enumerate(fields)]
    return names, [n for n, h in zip(names, fields, strict=True) if n == h or not h]


def read_family(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """All rows of a family as text cells, with path, captured_at, seq and row_ix (order in the file).

    Files are classed by encoding, delimiter and header; each class is one CSV scan with its schema given, and classes are
    joined by name, so a column that a file does not have stays null while a blank cell is ''.
    """
    files = catalogue(spark, folder).filter(F.col("family") == family)
    classes = files.join(dialects(spark, folder), "path").groupBy("encoding", "delimiter", "header").agg(F.collect_list("path").alias("paths")).collect()
    out = None
    for c in classes:
        every, names = header_names(c.header, c.delimiter)
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in every)
        rows = spark.read.schema(schema).option("header", True).option("sep", c.delimiter).option("encoding", "UTF-8" if c.encoding == "UTF-8" else "ISO-8859-1").option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(c.paths)
        fix = (lambda x: x) if c.encoding == "UTF-8" else lambda x: F.translate(x, *WINDOWS)
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row_ix"), *(F.coalesce(F.trim(fix(F.col(f"`{n.replace('`', '``')}`"))), F.lit("")).alias(n) for n in names))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"{folder} has no file of {family}")
    return out.withColumn("_p", plain_path("path", True)).join(files.select(plain_path("path").alias("_p"), "captured_at", "seq"), "_p").drop("_p")


def with_headers(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """Snapshots with row_count; headers come from dialects()."""
    return snapshots.join(rows.groupBy("path").agg(F.count(F.lit(1)).alias("row_count")), "path", "left").fillna(0, ["row_count"])


def write_view(df: DataFrame, path: str, sep: str = ",") -> None:
    """Rows as CSV with a byte order mark in front of each file's header."""
    df.toDF(*("\ufeff" * (i == 0) + c for i, c in enumerate(df.columns))).write.option("header", True).option("sep", sep).csv(path)


def write_changes(details: DataFrame, path: str) -> None:
    """All change details, without a cap. Identity is the label where the details have one, else the key."""
    identity = F.coalesce("identity", "key") if "identity" in details.columns else F.col("key")
    details.select(F.col("change").alias("Change"), identity.alias("Identity"), F.col("property").alias("Property"), F.col("before").alias("Before"), F.col("after").alias("After")).write.option("header", True).csv(path)


def write_inventory(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Fixed column order, null as '', a header even for no rows."""
    have = {c.lower(): c for c in df.columns}
    df.select(*(F.coalesce(F.col(f"`{have[c.lower()]}`").cast("string"), F.lit("")).alias(c) if c.lower() in have else F.lit("").alias(c) for c in columns)).write.option("header", True).option("emptyValue", "").csv(path)


def write_comparison(diff: DataFrame, path: str) -> None:
    """A JSON object a line, keys sorted at every level."""
    diff.select(cells.canonical_json(F.to_json(F.struct(*diff.columns))).alias("value")).write.text(path)


def write_occurrences(occurrences: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    """Replace the partitions (family, day, file) that the rows belong to and leave all others.

    columns: cells that are kept as `payload`, canonical JSON without blanks, with its SHA-256 as `row_hash`.
    """
    if columns:
        payload = cells.canonical_json(F.to_json(F.struct(*(F.nullif(cells.text(f"`{c}`"), F.lit("")).alias(c) for c in columns))))
        occurrences = occurrences.withColumn("payload", payload).withColumn("row_hash", F.sha2("payload", 256))
    occurrences.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("family", "captured_date", "file").parquet(path)
