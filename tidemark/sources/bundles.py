"""Bundles: a folder with a manifest, an inventory and one JSON document for each policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import policy


def _whole(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("path"), "value")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """bundle, snapshot_id, captured_at, export_status, inventory, issues of every bundle below root; one that is no JSON, or no object, has that issue alone."""
    raw = _whole(spark, f"{root}/*/snapshot_manifest.json").withColumn("v", F.try_parse_json("value"))
    g = lambda p, t="string": policy.get("v", p, t)
    out = raw.select(F.regexp_replace("path", "/[^/]*$", "").alias("bundle"), g("$.snapshotId").alias("snapshot_id"), g("$.capturedAtUtc").alias("captured_text"), g("$.exportStatus").alias("export_status"), g("$.inventoryRelativePath").alias("inventory"), g("$.snapshotSchemaVersion", "int").alias("sv"), g("$.policyExportSchemaVersion", "int").alias("ev"), "v")
    issues = F.when(F.col("v").isNull(), F.array(F.lit("manifest_unreadable"))).when(~F.schema_of_variant("v").startswith("OBJECT"), F.array(F.lit("manifest_invalid"))).otherwise(policy.manifest_issues(F.col("sv"), F.col("ev"), F.col("snapshot_id"), F.col("captured_text"), F.col("inventory")))
    return out.withColumn("issues", issues).withColumn("captured_at", cells.timestamp("captured_text")).drop("sv", "ev")


def source_status(found: DataFrame) -> DataFrame:
    """bundle, source, status, listed, exported, errors, accounting of each source that a manifest covers."""
    each = found.lateralJoin(found.sparkSession.tvf.variant_explode(policy.get("v", "$.sourceCoverage", "variant").outer()).select(F.col("key").alias("source"), F.col("value").alias("c")))
    n = lambda p: F.coalesce(policy.get("c", p, "int"), F.lit(0))
    return each.select("bundle", "source", policy.get("c", "$.status").alias("status"), n("$.count").alias("listed"), n("$.exportedCount").alias("exported"), n("$.processingErrors").alias("errors"), policy.source_accounting(n("$.count"), n("$.exportedCount"), n("$.processingErrors")).alias("accounting"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """bundle, path (relative), doc (VARIANT) of every JSON document but manifests."""
    raw = _whole(spark, f"{root}/*/*/*.json")
    rel = F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1))
    return raw.select(F.regexp_replace("path", "/[^/]*/[^/]*$", "").alias("bundle"), rel.alias("path"), F.try_parse_json("value").alias("doc"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{root}/*/inventory.csv")
    return rows.withColumn("bundle", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def discover(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests as (bundles to use, by captured text and id; bundle and issue of the others, one row an issue)."""
    good = found.filter(F.size("issues") == 0).orderBy("captured_text", "snapshot_id")
    return good, found.select("bundle", F.explode("issues").alias("issue"))


def filters(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """bundle, filter (VARIANT) of the assignment filters of every bundle: the members of its file's list, or of the list under `value`.

    The file lies beside the manifest, which may name it. A bundle without the file, or with one that holds no list, has none.
    """
    name = F.coalesce(cells.filled(policy.get("v", "$.assignmentFiltersRelativePath")), F.lit("assignment_filters.json"))
    raw = _whole(spark, f"{root}/*/*.json").select(F.regexp_replace("path", "/[^/]*$", "").alias("bundle"), F.element_at(F.split("path", "/"), -1).alias("name"), F.try_parse_json("value").alias("f"))
    own = raw.join(found.select("bundle", name.alias("name")), ["bundle", "name"])
    own = own.select("bundle", F.when(F.schema_of_variant("f").startswith("ARRAY"), F.col("f")).otherwise(policy.get("f", "$.value", "variant")).alias("l")).filter(F.schema_of_variant("l").startswith("ARRAY"))
    return own.lateralJoin(spark.tvf.variant_explode(F.col("l").outer()).select(F.col("value").alias("filter"))).select("bundle", "filter")


def load(spark: SparkSession, root: str) -> DataFrame:
    """Inventory rows with their documents; rows without a path or a document drop out (contract_issues names them)."""
    own = inventory(spark, root).withColumn("path", cells.filled("JsonRelativePath")).filter("path is not null")
    return own.join(documents(spark, root), ["bundle", "path"])


def anchors(catalogue: DataFrame, found: DataFrame, stem: str = "stem") -> DataFrame:
    """Anchor files with their bundle: usable, and why not (no bundle, issues, integrity error)."""
    j = catalogue.join(found.select(F.col("snapshot_id").alias(stem), "bundle", "issues", "export_status"), stem, "left")
    reason = F.when(F.col("bundle").isNull(), "no bundle").when(F.size("issues") > 0, "invalid manifest").when(F.col("export_status") == "integrity_error", "integrity error")
    return j.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())


def legacy_exports(listing: DataFrame) -> DataFrame:
    """Folders with the file names of the old export and no manifest: for diagnostics alone."""
    name = F.element_at(F.split("path", "/"), -1)
    return listing.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.bool_or(name == "snapshot_manifest.json").alias("modern"), F.bool_or(name == "manifest.json").alias("old"), F.bool_or(name.rlike("(?i)inventory")).alias("inv")).filter("old and inv and not modern").select("folder")
