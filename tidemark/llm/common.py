"""What the operators of this subpackage share: storage between passes, batch bounds, word rules."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

#: Arrow batches handed to Python hold at most so many rows and, where Spark supports it, so many bytes.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


#: Paths that `stored` has written and `drop_stored` has not deleted.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset a new local one, if the master is local, else an error."""
    sc = spark.sparkContext
    if set_already := sc.getCheckpointDir():
        return set_already
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; no two calls give the same."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, since: int = 0, more: tuple[str, ...] = ()) -> None:
    """Delete the tables that `stored` wrote in this process since it had written so many, and more paths, once nothing that reads them is needed."""
    gone = [*WRITTEN[since:], *more]
    del WRITTEN[since:]
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, gone):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory follows the longest text, not 10,000 of them.

    Workers on this machine also find the library where the driver has, whatever folder they are started in.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id as doc_id and the text, null read as empty; other columns, whatever their names, are pruned."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; for the driver, tasks get the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, make, schema: str, begin=None) -> DataFrame:
    """mapInArrow with make(columns: dict of lists) -> dict of lists, arrays or Arrow arrays of the column's type, once a batch.

    begin: makes what a task keeps between its batches, which make gets as a second argument; it goes with the task.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (begin(),) if begin else ()
        for b in batches:
            if b.num_rows:
                made = make({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}, *kept)
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


#: A row of a joined table that stands for more than one in so many of the other side's rows is broadcast.
HOT_SHARE = 4096


def join_by_weight(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows and the columns of table, joined on key: inner, and no key gathers its rows in a task.

    table: one row a key, stored; weight: about how many of rows have it. Keys that have over 1 / HOT_SHARE of all weights,
    so fewer than HOT_SHARE, are broadcast; the others meet by a shuffle. A table of up to HOT_SHARE rows is broadcast whole.
    rows is read twice in the other case and should be stored, too.
    """
    told = table.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("total")).first()
    if told["n"] <= HOT_SHARE:
        return rows.join(F.broadcast(table), key)
    is_hot = F.col(weight) * HOT_SHARE > told["total"]
    hot, cold = table.filter(is_hot), table.filter(~is_hot)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


class Numbered:
    """Numbers of byte strings, in the order in which they are first seen; all strings of a batch are looked up together.

    A string of up to 24 bytes is three words, which are compared as a whole with those of the last string of its slot, so
    equal numbers mean equal bytes; longer ones, and those whose slot another string took, go through a dict.
    """

    WORDS, SLOT_BITS = 3, 21
    _MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    _ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.slots = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.words = np.zeros((self.WORDS + 1, 1), np.uint64)  # of each number, and its size
        self.held = 0

    def __len__(self) -> int:
        return len(self.known)

    def numbers(self, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(number of each string data[start : start + size], the new ones in order of their numbers). Sizes are above 0."""
        view = np.ndarray(len(data) + 1, "<u8", data + bytes(8 * self.WORDS + 8), strides=(1,))
        own = [view[np.minimum(start + 8 * k, len(data))] & self._MASKS[np.clip(size - 8 * k, 0, 8)] for k in range(self.WORDS)] + [size.astype(np.uint64)]
        slot = own[0] * self._ODD[0]
        for k in range(1, self.WORDS):
            slot = (slot ^ (slot >> np.uint64(29)) ^ own[k]) * self._ODD[k]
        slot = ((slot ^ (slot >> np.uint64(32))) * self._ODD[0] >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        number = self.slots[slot].astype(np.int64)
        seen = (number >= 0) & (size <= 8 * self.WORDS)
        for k in range(self.WORDS + 1):
            seen &= self.words[k][number] == own[k]
        missed = np.flatnonzero(~seen)
        known, first = self.known, len(self.known)
        new: list[bytes] = []
        fresh, found = [], []
        for i, a, n in zip(missed.tolist(), start[missed].tolist(), size[missed].tolist(), strict=True):
            u = data[a : a + n]
            x = known.get(u)
            if x is None:
                x = known[u] = first + len(new)
                new.append(u)
                fresh.append(i)
            found.append(x)
        if new:
            end = first + len(new)
            if end > self.words.shape[1]:
                self.words = np.concatenate([self.words, np.zeros((self.WORDS + 1, max(end, 2 * self.words.shape[1]) - self.words.shape[1]), np.uint64)], axis=1)
            for k in range(self.WORDS + 1):
                self.words[k, first:end] = own[k][fresh]
            self.held += sum(map(len, new))
        number[missed] = found
        self.slots[slot[missed]] = number[missed]
        return number, new


def longer(x: np.ndarray, size: int) -> np.ndarray:
    """x if it has room for `size`, else a copy with half as much again."""
    if size <= len(x):
        return x
    out = np.empty(size + size // 2, x.dtype)
    out[: len(x)] = x
    return out
