"""An inverted index of names by runs of characters, kept up with the files that the names come from.

Names lie in a `Store`, by source file. Postings (run, id of the name's text) are written once for each distinct name,
however many files repeat it, in parts that are clustered by run, so that a search reads the row groups of its runs alone;
beside each part lie the counts of its runs, whose `_SUCCESS` mark says that the part is whole. A run of the index writes
its new postings before it commits its names: every live name has postings, whatever is lost in between. Postings of names
that went are no harm, as what meets a needle is joined with the live names; `vacuum` writes postings anew without them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grams, identity
from .store import Store

NAMES = "path string, entity string, alias string, display string"
_POSTINGS, _COUNTS = "gram string, id long, text string", "gram string, n long"


class SearchIndex:
    """Names (path, entity, alias, display) below a folder that all executors share, and ranked search in them.

    Nulls are names without that part; a name without any text is kept and never found. Repeated names count once.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.names = Store(spark, f"{self.folder}/names", NAMES)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def id() -> Column:
        """What stands for a name's text in postings; unlike texts with one id are both posted and both looked at."""
        return F.xxhash64(identity.searched())

    # --- parts

    def parts(self) -> list[str]:
        """Whole parts, as many as runs since the last vacuum."""
        top = self._path(f"{self.folder}/counts")
        found = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(n for n in found if self._fs.exists(self._path(f"{self.folder}/counts/{n}/_SUCCESS")))

    def _read(self, what: str, schema: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{what}/{p}" for p in parts))

    def postings(self) -> DataFrame:
        """gram, id of each run of each text that was ever posted; a row with a null gram, and the text, for the text itself."""
        return self._read("postings", _POSTINGS, self.parts())

    def counts(self) -> DataFrame:
        """gram, n: names with each run, those that went since the last vacuum included."""
        return self._read("counts", _COUNTS, self.parts()).groupBy("gram").agg(F.sum("n").alias("n"))

    def _post(self, names: DataFrame) -> str:
        """Write the postings of names as a part of its own. Ranges of (run, id) cut common runs too."""
        part = uuid.uuid4().hex
        text = F.col("text")
        texts = names.select(self.id().alias("id"), identity.searched().alias("text")).distinct()
        every = F.concat(F.array(F.lit(None).cast("string")), grams.runs(text))
        rows = texts.select(F.explode(every).alias("gram"), "id", "text").withColumn("text", F.when(F.col("gram").isNull(), text))
        rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{self.folder}/postings/{part}")
        self._read("postings", _POSTINGS, [part]).filter("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.folder}/counts/{part}")
        return part

    # --- runs

    def update(self, batch: str, classified: DataFrame, parsed: DataFrame, failed: DataFrame) -> int:
        """Apply a run, as `Store.commit` does, and give its version; a batch that is known changes nothing.

        Postings are written for texts alone that no part has; of the parts, the rows of whole texts are read.
        """
        if batch in self.names.commits():
            return max(self.names.versions())
        had = self.postings().filter("gram is null").select("id", "text")
        self._post(parsed.select("entity", "alias", "display", self.id().alias("id"), identity.searched().alias("text")).join(had, ["id", "text"], "left_anti"))
        return self.names.commit(batch, classified, parsed, failed)

    def vacuum(self) -> int:
        """Write the postings of live names into one part, drop the others and dead names; how many parts went."""
        old = self.parts()
        self.names.vacuum()
        self._post(self.names.rows())
        for part in old:
            for what in ("counts", "postings"):  # without its counts a part is none
                self._fs.delete(self._path(f"{self.folder}/{what}/{part}"), True)
        return len(old)

    # --- search

    def search(self, asks: DataFrame, query: str, needle: str, k: int = 50) -> DataFrame:
        """The best k entities of each needle, as `identity.search_many` gives them for all live names.

        asks: query, needle; empty and null needles find nothing, and so do those without a query. Reads the counts, the
        postings of the runs taken, and the names that meet. Needles that would meet more postings than there are, as many
        needles do, are looked for in the names as such: that reads each name once, whatever the needles.
        """
        own = asks.select(query, F.lower(needle).alias("_n")).filter(f"_n <> '' and `{query}` is not null").distinct()
        needles, counts = own.select("_n").distinct().withColumn("_q", F.col("_n")), self.counts()
        picked = grams.picks(needles, counts, "_q", "_n")
        met, had = picked.join(counts, "gram").agg(F.sum("n")).first()[0] or 0, counts.agg(F.sum("n")).first()[0] or 0
        if met > had:
            return identity.search_many(self.names.rows().select("entity", "alias", "display"), asks, query, needle, k)
        met = grams.meet(self.postings().filter("gram is not null"), picked, "_q", "id").join(own, F.col("_q") == F.col("_n")).select(query, "_n", "id")
        names = self.names.rows().select(self.id().alias("id"), "entity", "alias", "display")
        found = names.join(met, "id").dropDuplicates([query, "entity", "alias", "display"])
        return identity.search(found, F.col("_n"), k, query)
