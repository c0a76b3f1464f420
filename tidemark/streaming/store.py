"""A store of derived rows that a run changes file by file, in two phases.

Rows lie below `data/batch=<id>`, one folder a run. A manifest, one row a source file, says which batch holds its rows, and
in which state the file is. A run first writes the rows of the files it parsed, then a new manifest, whose `_SUCCESS` mark is
the commit: readers take the highest marked version, so they see the store before the run or after it, never between. What
a lost run left behind is an unmarked folder or a batch that no manifest names; the next run with its id replaces it. A
batch id that the manifest already has is not applied again, so a stream may repeat its last batch.

A run writes what it parsed and the manifest, not the store: rows of deleted and changed files stay in their old batch,
where the manifest no longer finds them, until `vacuum` drops batches that nobody names or rewrites those mostly dead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, batch string, status string, message string, rows long, commits array<string>"
#: Batch ids that a manifest remembers, latest last.
REMEMBERED = 1000


class Store:
    """Rows by source file below a folder that all executors share. `schema`: DDL of the rows, with a column path."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- reading

    def versions(self) -> list[int]:
        """Committed versions in order."""
        top = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(self._path(f"{self.folder}/manifests/{n}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, batch (null: no rows), status (ok, error), message, rows and commits of each file in a version, by default the latest; none before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/v{version}").filter("path is not null")

    def commits(self, version: int | None = None) -> list[str]:
        """Ids of the batches that led to a version, latest last."""
        version = version or max(self.versions(), default=0)
        if not version:
            return []
        first = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/v{version}").filter("path is null").first()
        return list(first.commits)

    def rows(self, version: int | None = None) -> DataFrame:
        """The live rows of a version: batches that it names are pruned by folder, dead rows within by a join with the manifest."""
        live = self.manifest(version).filter("batch is not null").select("batch", "path")
        batches = [r.batch for r in live.select("batch").distinct().collect()]  # as many as uncompacted runs
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        data = self._all().filter(F.col("batch").isin(batches))
        return data.join(live, ["batch", "path"], "left_semi").drop("batch")

    def _batch(self, batch: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/batch={batch}").withColumn("batch", F.lit(batch))

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch string").parquet(f"{self.folder}/data")

    # --- runs

    def write_rows(self, batch: str, parsed: DataFrame) -> None:
        """Phase 1: the rows of the files that a run parsed; an unfinished earlier try is replaced."""
        names = self.spark.createDataFrame([], self.schema).columns
        parsed.select(*names).write.mode("overwrite").parquet(f"{self.folder}/data/batch={batch}")

    def commit(self, batch: str, classified: DataFrame, parsed: DataFrame, failed: DataFrame) -> int:
        """Apply a run and give the version that has it; one whose batch id is known changes nothing.

        classified: path, action, as `incremental.classify` says. parsed: rows of the files that were read, with their path.
        failed: path, message of those that could not be. Deleted files go, failed ones keep the rows they had, files that
        were read and hold no row have none, and files that the run does not speak of stay as they are.
        """
        if batch in (done := self.commits()):
            return max(self.versions())
        bad = failed.select("path", "message").dropDuplicates(["path"])
        self.write_rows(batch, parsed.join(bad, "path", "left_anti"))
        version = max(self.versions(), default=0) + 1
        counts = self._batch(batch).groupBy("path").agg(F.count(F.lit(1)).alias("_rows"))
        old = self.manifest().select("path", F.col("batch").alias("_batch"), F.col("rows").alias("_had"), F.col("status").alias("_status"), F.col("message").alias("_message"))
        said = classified.select("path", "action").dropDuplicates(["path"])
        j = said.join(old, "path", "full_outer").join(bad, "path", "left").join(counts, "path", "left")
        read = F.col("action").isin("new", "changed", "failed_before")
        fail, kept = F.coalesce(read & F.col("message").isNotNull(), F.lit(False)), F.col("action").isNull() | (F.col("action") == "reused")
        stays = fail | kept
        out = j.filter(F.coalesce(F.col("action") != "deleted", F.lit(True))).select(
            "path",
            F.when(stays, F.col("_batch")).otherwise(F.when(F.col("_rows").isNotNull(), F.lit(batch))).alias("batch"),
            F.when(fail, "error").when(kept, F.coalesce("_status", F.lit("ok"))).otherwise("ok").alias("status"),
            F.when(fail, F.col("message")).when(kept, F.col("_message")).alias("message"),
            F.when(stays, F.coalesce("_had", F.lit(0))).otherwise(F.coalesce("_rows", F.lit(0))).alias("rows"),
            F.lit(None).cast("array<string>").alias("commits"),
        )
        self._publish(version, out, [*done, batch])
        return version

    def _publish(self, version: int, rows: DataFrame, commits: list[str]) -> None:
        """Phase 2: a marked version is never overwritten, so of two runs at once one fails; an unmarked one is what a lost run left."""
        head = self.spark.createDataFrame([(None, None, None, None, None, commits[-REMEMBERED:])], MANIFEST)
        to = f"{self.folder}/manifests/v{version}"
        if self._fs.exists(self._path(f"{to}/_SUCCESS")):
            raise RuntimeError(f"version {version} was committed by another run")
        rows.unionByName(head).write.mode("overwrite").parquet(to)

    def vacuum(self, keep: int = 1, live_share: float = 0.5) -> int:
        """Rewrite batches of which less than live_share is live, drop versions but the latest `keep`, and batches that none of these names; how many batches went.

        Readers of an older version than those kept lose their files.
        """
        versions = self.versions()
        if not versions:
            return 0
        now, written = self.manifest(), self._all().groupBy("batch").agg(F.count(F.lit(1)).alias("all"))
        use = now.groupBy("batch").agg(F.sum("rows").alias("live")).join(written, "batch")
        thin = [r.batch for r in use.filter(F.col("live") < live_share * F.col("all")).collect()]
        if thin:
            batch, moved = f"compact-{versions[-1] + 1}", now.filter(F.col("batch").isin(thin))
            self.write_rows(batch, self._all().filter(F.col("batch").isin(thin)).join(moved.select("batch", "path"), ["batch", "path"], "left_semi"))
            self._publish(versions[-1] + 1, now.withColumn("batch", F.when(F.col("batch").isin(thin), batch).otherwise(F.col("batch"))), [*self.commits(), batch])
            versions.append(versions[-1] + 1)
        stay, go = versions[-keep:], versions[:-keep]
        for v in go:
            self._fs.delete(self._path(f"{self.folder}/manifests/v{v}"), True)
        named = {r.batch for v in stay for r in self.manifest(v).select("batch").distinct().collect()}
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.folder}/data")) if s.getPath().getName().partition("=")[2] not in named]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def sink(store: Store, name: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch of files' rows is one run of the store, named by the stream and the batch number.

    parse: the rows to keep and (path, message) of the files that failed. A batch that Spark repeats after a loss is known.
    """

    def run(df: DataFrame, epoch: int) -> None:
        parsed, failed = parse(df)
        store.commit(f"{name}-{epoch}", df.select("path").distinct().withColumn("action", F.lit("new")), parsed, failed)

    return run
