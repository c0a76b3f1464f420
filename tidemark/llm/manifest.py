"""Merkle manifest of a dataset, with proofs by pointer jumping.

Every row is a leaf; a group's leaves (here a language's) in order make a tree, whose root is the group's subroot, and the
subroots in order make the tree above. Leaves get their place by range partitions and the counts of these; tasks build
aligned runs of 2 ** 10 leaves at once and hand on only their tops, so a tree of any size takes a shuffle for ten levels.

A proof is the path's siblings. Each node first holds one segment, its own sibling, and points to its parent; a self-join
appends to each segment that of the node it points to, so the distance doubles. Only nodes whose level is a multiple of
the distance can be met again, so a round joins all leaves with ever fewer nodes. Where few nodes are left the join would
gather all leaves at them: up to FEW of them are broadcast; where there are more, no node has over 2 / FEW of the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, join_by_weight, stored

#: Levels that a task builds at once.
STEP = 10
#: Nodes of a level that a join broadcasts; each has a segment of at most 33 bytes for each level.
FEW = 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: kind 0: a node with the segment towards its parent; 1: the top of a run that goes on above; 2: a tree's root.
_NODE = "tree string, level int, pos long, n long, kind int, segment binary, digest binary, doc_id long, changed binary"


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of the fields in their fixed order, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(columns[f]) for f in FIELDS)), 256))


def parent(digests: list[bytes]) -> bytes:
    """Digest of the children's digests as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (with a column tree) with pos, its place within its tree by `order` (nulls first), and n, the tree's leaves.

    Range partitions put rows in order; a row's place is its number in its part behind the tree's rows in the parts before.
    Rows equal in tree and order are in any order among each other; they are dealt out by where they were read.
    """
    spark = leaves.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["tree", *order, "_spread"]
    rows = leaves.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(parts, *(F.col(c).asc_nulls_first() for c in keys)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in keys))
    rows = stored(rows.drop("_spread").withColumn("_at", F.monotonically_increasing_id()), "manifest-leaves")
    part = F.shiftright("_at", 33)
    runs = rows.groupBy("tree", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part")  # a row for each part that a tree lies in
    all_of = Window.partitionBy("tree")
    runs = runs.withColumn("_ahead", F.sum("_n").over(before) - F.col("_n")).withColumn("n", F.sum("_n").over(all_of))
    own = rows.withColumn("_part", part).join(runs, ["tree", "_part"])
    return own.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_ahead")).drop("_at", "_part", "_n", "_first", "_ahead")


def _run(step: int, level: int, pos: int, n: int, digests: list[bytes], doc_ids: list, changed: list, tree: str) -> Iterator[tuple]:
    """Rows of the nodes above an aligned run of nodes at `level`, whose first is at pos; n: leaves of the tree."""
    for k in range(step + 1):
        here = level + k
        of_level = -(-n >> here)
        root = of_level == 1
        if k == step or root:
            yield tree, here, pos, n, 2 if root else 1, None, digests[0], None, None
        if k < step and (not root or here == 0):
            for i, d in enumerate(digests):
                if root:
                    segment = b""
                elif i % 2:
                    segment = b"\x01" + digests[i - 1]
                elif i + 1 < len(digests):
                    segment = b"\x02" + digests[i + 1]
                else:
                    segment = b"\x00"
                leaf = here == 0
                yield tree, here, pos + i, n, 0, segment, d if leaf else None, doc_ids[i] if leaf else None, changed[i] if leaf else None
        if root:
            return
        digests, pos = [parent(digests[i : i + 2]) for i in range(0, len(digests), 2)], pos >> 1


def _built(rows: DataFrame, level: int, step: int) -> DataFrame:
    """The nodes of `step` levels above the nodes `rows` of one level, as _NODE has them."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("run", F.shiftright("pos", step)).repartition(parts, "tree", "run").sortWithinPartitions("tree", "pos")
    schema = arrow_schema(_NODE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        run, first, n = None, 0, 0
        held: tuple[list, list, list] = ([], [], [])

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
            made.clear()
            return out

        def close() -> None:
            if run is not None:
                made.extend(_run(step, level, first, n, *held, run[0]))

        for b in batches:
            for tree, pos, size, digest, doc_id, changed in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if run != (tree, pos >> step):
                    close()
                    if len(made) >= 4096:
                        yield batch()
                    run, first, n, held = (tree, pos >> step), pos, size, ([], [], [])
                for x, v in zip(held, (digest, doc_id, changed), strict=True):
                    x.append(v)
        close()
        if made:
            yield batch()

    return dealt.select("tree", "pos", "n", "digest", "doc_id", "changed").mapInArrow(build, _NODE)


def nodes(leaves: DataFrame, step: int = STEP) -> DataFrame:
    """All nodes of all trees over placed leaves (tree, pos, n, digest, doc_id, changed)."""
    bound_batches(leaves.sparkSession)
    level, out = 0, None
    while True:
        own = stored(_built(leaves, level, step), "manifest-nodes")
        out = own if out is None else out.unionByName(own)
        leaves, level = own.filter("kind = 1"), level + step
        if leaves.isEmpty():
            return out


def paths(every: DataFrame) -> DataFrame:
    """tree, n, doc_id, digest, changed and the whole segment from leaf to root of every leaf, by doubling self-joins."""
    trees = every.filter("kind = 2").select("n")
    reach = [1 << r for r in range(6)]
    told = trees.agg(F.max("n").alias("most"), *(F.sum(F.when(F.col("n") > (1 << s), F.ceil(F.col("n") / (1 << s))).otherwise(0)).alias(f"k{s}") for s in reach)).first()
    depth = (max(1, told["most"] or 1) - 1).bit_length()
    now = every.filter("kind = 0").drop("kind")
    for s in reach:
        if s >= depth:
            break
        onward = now.filter(F.col("level") % s == 0)
        met = onward.filter((F.col("level") % (2 * s) == s)).select("tree", (F.col("level") - s).alias("level"), F.col("pos").alias("_to"), F.col("segment").alias("_more"))
        left = onward.filter(F.col("level") % (2 * s) == 0).withColumn("_to", F.shiftright("pos", s))
        joined = left.join(F.broadcast(met) if told[f"k{s}"] <= FEW else met, ["tree", "level", "_to"], "left")
        now = joined.withColumn("segment", F.concat("segment", F.coalesce("_more", F.lit(b"")))).drop("_to", "_more")
        now = stored(now, "manifest-paths")
    return now.filter("level = 0").select("tree", "n", "doc_id", "digest", "changed", "segment")


def folded(digest: bytes, segment: bytes) -> tuple[bytes, bytes]:
    """(digest of the root that a leaf's digest and its segment lead to, the segment's siblings as hexadecimal text)."""
    at, text = 0, []
    while at < len(segment):
        side = segment[at]
        sibling = segment[at + 1 : at + 33] if side else b""
        at += 33 if side else 1
        digest = parent([sibling, digest] if side == 1 else [digest, sibling] if side == 2 else [digest])
        text.append(sibling.hex())
    return digest, "".join(text).encode()


_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"


def manifest(docs: DataFrame, tampered: Column | None = None, with_proofs: bool = True, step: int = STEP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if with_proofs, the proof of every row.

    Trees are by lang (null first, then by bytes), leaves by doc_id (null first; repeated ids by digest, equal rows in any
    order, which changes no digest). tampered: rows whose n_chars is taken one larger when their proof is folded; a null
    n_chars stays, so such a row still verifies. A proof is, level by level, a byte (0: no sibling, 1: it is at the left, 2:
    at the right) and the sibling's 32 bytes. Nulls and empty texts are leaves as others are; a row alone in its tree is
    its subroot; further columns are ignored; no rows give no rows.
    """
    own = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars").cast("long"), "text": F.col("text")}
    off = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    changed = F.when(off & F.col("n_chars").isNotNull(), leaf_digest(own | {"n_chars": own["n_chars"] + 1}))
    tree = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang").cast("string")))
    leaves = docs.select(tree.alias("tree"), own["doc_id"].alias("doc_id"), leaf_digest(own).alias("digest"), changed.alias("changed"))
    every = nodes(placed(leaves, ["doc_id", "digest"]), step)

    subroots = every.filter("kind = 2").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("n").alias("leaves"), "digest")
    upper = stored(placed(subroots, ["of"]), "manifest-subroots")
    above = nodes(upper.select("tree", "pos", "n", "digest", F.col("pos").alias("doc_id"), F.lit(None).cast("binary").alias("changed")), step)
    root = above.filter("kind = 2").select("digest").first()  # None for no rows
    to_root = paths(above).select(F.col("doc_id").alias("pos"), F.col("segment").alias("up"))
    tops = upper.select(F.col("of").alias("tree"), "pos", "leaves", F.col("digest").alias("subroot")).join(to_root, "pos")
    tops = stored(tops.withColumn("root", F.lit(bytes(root["digest"]) if root else None).cast("binary")), "manifest-tops")

    own_paths = paths(every).select("tree", "doc_id", "digest", "changed", "segment")
    rows = join_by_weight(stored(own_paths, "manifest-proofs"), tops, "tree", "leaves")
    out = arrow_schema(_OUT if with_proofs else _OUT.rpartition(",")[0])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for doc_id, digest, changed, segment, up, subroot, top in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                end, text = folded(changed or digest, segment + up)
                made.append((doc_id, digest.hex(), subroot.hex(), top.hex(), hashlib.sha256(text).hexdigest(), end.hex(), end == top, segment + up))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), out, strict=False)], schema=out)

    return rows.select("doc_id", "digest", "changed", "segment", "up", "subroot", "root").mapInArrow(fold, _OUT if with_proofs else _OUT.rpartition(",")[0])
