"""Keeping derived tables up with a folder: what to parse, what to drop, what to recompute; and the same as a stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.identity import Adapter


def fingerprint(adapter: Adapter) -> str:
    """16 hex digits of an adapter's specification: a changed one re-indexes its family alone."""
    return hashlib.sha256(json.dumps(asdict(adapter), sort_keys=True).encode()).hexdigest()[:16]


def classify(listing: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """path, action: new, changed (size, time or fingerprint differ), failed_before, reused, deleted.

    One full outer join of the folder's listing and the stored manifest.
    """
    now = listing.select(key, F.struct("size", "modified", "fingerprint").alias("_n"))
    old = manifest.select(key, F.struct("size", "modified", "fingerprint").alias("_o"), "status")
    action = F.when(F.col("_n").isNull(), "deleted").when(F.col("_o").isNull(), "new").when(F.col("status") == "error", "failed_before").when(F.col("_n") != F.col("_o"), "changed").otherwise("reused")
    return now.join(old, key, "full_outer").select(key, action.alias("action"))


def to_parse(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("action").isin("new", "changed", "failed_before"))


def affected(occurrences: DataFrame, classified: DataFrame, entity: str = "entity", key: str = "path") -> DataFrame:
    """Entities that occur in files which changed or went: the only ones to recompute."""
    touched = classified.filter(F.col("action").isin("changed", "deleted")).select(key)
    return occurrences.join(touched, key, "left_semi").select(entity).distinct()


def orphans(entities: DataFrame, occurrences: DataFrame, entity: str = "entity") -> DataFrame:
    """Entities that are left without an occurrence."""
    return entities.join(occurrences.select(entity).distinct(), entity, "left_anti")


def accounting(classified: DataFrame, outcomes: DataFrame, key: str = "path") -> DataFrame:
    """discovered, parsed, reused, failed, deleted and the run's status; with a column `unresolved` in outcomes, rows without an entity, their sum."""
    counts = [c for c in ("unresolved",) if c in outcomes.columns]
    j = classified.join(outcomes.select(key, "ok", *counts), key, "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = j.agg(n(F.col("action") != "deleted").alias("discovered"), n(F.col("ok")).alias("parsed"), n(F.col("action") == "reused").alias("reused"), n(~F.col("ok")).alias("failed"), n(F.col("action") == "deleted").alias("deleted"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))
    return out.withColumn("status", F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))


def unsupported(listing: DataFrame, families: list[str]) -> DataFrame:
    """Files of unknown families: registered, not failed."""
    return listing.filter(~F.col("family").isin(*families))


def follow(spark: SparkSession, folder: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """The folder as a stream of its files' rows: each micro-batch holds new files, with their path, and goes to `sink`.

    Runs until what is there has been read; the checkpoint remembers files across runs, so a rerun parses none twice.
    """
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder).select("*", F.col("_metadata.file_path").alias("path"))
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bundle_signature(snapshot_id: Column, modified: Column, size: Column) -> Column:
    """Whether a bundle is still the one that was read: its id, and its manifest's time and size; the id alone without a manifest."""
    return F.concat_ws(":", snapshot_id, modified.cast("string"), size.cast("string"))


def parse_order(classified: DataFrame, families: DataFrame, identity_families: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first, rest) of the files to parse: those of the families that bind aliases to identities come first, as all others are bound by what they say."""
    own = to_parse(classified).join(families, "path", "left")
    first = F.coalesce(F.col("family").isin(*identity_families), F.lit(False))
    return own.filter(first), own.filter(~first)


def next_rows(old: DataFrame, parsed: DataFrame, classified: DataFrame, failed: DataFrame, key: str = "path") -> DataFrame:
    """The derived table after a run: rows of files that went or were parsed anew are left out, rows of failed files stay as they were, parsed rows come in.

    Anti joins on file paths, so a store that is partitioned by file drops and rewrites partitions only.
    """
    bad = failed.select(key).distinct()
    gone = classified.filter(F.col("action").isin("deleted", "changed", "new", "failed_before")).join(bad, key, "left_anti").select(key)
    return old.join(gone, key, "left_anti").unionByName(parsed.join(bad, key, "left_anti"))


def file_status(classified: DataFrame, failed: DataFrame, key: str = "path") -> DataFrame:
    """path, status (ok, error, deleted), message of each file after a run: a failed file keeps its rows and tells why."""
    out = classified.join(failed.select(key, "message").dropDuplicates([key]), key, "left")
    return out.select(key, F.when(F.col("action") == "deleted", "deleted").when(F.col("message").isNotNull(), "error").otherwise("ok").alias("status"), "message")
