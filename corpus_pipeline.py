"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Toxic documents go, one document of each group of near copies stays, personal data is replaced by its kind, sources are
mixed to their target weights, and what is left is encoded. Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, pieces, pii, simhash, toxicity
from tidemark.llm.common import WRITTEN, bound_batches, drop_stored, map_rows, shared_path

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model predicts to be toxic; null and empty texts stay.

    The model learns from all labelled documents, up to its documented bound. Scoring and filtering is one pass without a
    join: repeated rows go or stay together, an empty table gives none, further columns are dropped.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bound_batches(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*DOCUMENTS).schema)

    def make(c: dict) -> dict:
        keep = model.scores([t or "" for t in c["text"]]) < 0.5
        return {n: [x for x, k in zip(v, keep, strict=True) if k] for n, v in c.items()}

    return map_rows(docs.select(*DOCUMENTS), make, schema)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies the document with the smallest doc_id, as one row.

    Near copies share 0.8 or more of their five-word shingles (Jaccard similarity, verified on the whole sets); their
    candidates come from SimHash fingerprints. Of rows with that id and unlike texts, the one whose text hash is smallest
    stays; of rows with equal id and text, the smallest by the other columns. A row without an id stays only where its
    group has no id at all. Empty documents give none.
    """
    kept = simhash.near_copies(docs).filter("stays").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")).distinct()
    own = docs.select(*DOCUMENTS).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = own.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "left_semi")
    return own.groupBy("doc_id", "mark").agg(F.min(F.struct(*DOCUMENTS[1:])).alias("row")).select("doc_id", *(f"row.{c}" for c in DOCUMENTS[1:]))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data in the text by its kind; n_chars follows the new text, null for a null one.

    Every row stays, as it is where nothing is found; repeated rows stay alike; an empty table gives none.
    """
    clean = pii.redact(docs, DOCUMENTS)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*DOCUMENTS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does: 0, 1 or 2 rows of it. Documents without words, which no mix measures, stay once.

    A null source is a source of its own. Repeated rows and equal ids are documents of their own, taken in an order of
    seeded hashes; those that tie in it are alike but for lang and text. An empty table gives none.
    """
    size = mixing.n_words(F.col("text"))
    taken = mixing.mix(docs, F.array("source"), size, keep=DOCUMENTS[1:])
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*DOCUMENTS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document as piece ids, with their scores and the check that they decode to the text.

    Null and empty texts give one without pieces; copies of a document, which share its id, give equal ones; no rows give none.
    """
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", near_dedup), ("pii", redact_pii), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]

#: Finite-state scoring, fingerprints and sampled segmentations have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; the last one's rows. What a stage stored, and what it read, goes once it has written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for name, stage in STAGES:
        path, since = shared_path(spark, name), len(WRITTEN)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_stored(spark, since, before)
        before = (path,)
    return docs
