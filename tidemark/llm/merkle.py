"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

Root equality is text equality (up to hash collisions); where roots differ, comparing the branches locates the edits,
and the share of phrases that two trees have in common, by length, is their likeness.

A text is cut without loss: sections end after a blank line, before a heading line, or after a paragraph whose hash is
divisible by 8 (so long texts without blank lines have local sections too); a paragraph is a line with its line end; a
phrase ends after a word (with the white space behind it) whose last character is one of ENDINGS, or after 8 words. All
cuts depend on nearby text only, so an edit changes the branches around it and leaves the others.

A fingerprint takes four characters a phrase, that is about a fifth of the text: hashes of 64 bits and more build the
tree, of which 24 bits a phrase are written down, and 64 a section and 128 of the root.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, map_rows, texts

SECTION_MOD, PHRASE_WORDS, ENDINGS, LEAF_CHARS = 8, 8, "dhlptxDHLPTX048,;", 4
#: Seven words at most that do not end a phrase, then any word; possessive, so linear in any text.
_PHRASE = re.compile(rf"\s*+(?:\S++(?<![{ENDINGS}])\s*+){{0,{PHRASE_WORDS - 1}}}+(?:\S++\s*+)?")
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+_", np.uint8)
#: Ranges of the text hash that rows of one repeated id, or without an id, are split into.
ID_PARTS = 64


def _h(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def phrases(paragraph: str) -> list[str]:
    """The paragraph, cut into phrases that join to it again."""
    return [p for p in _PHRASE.findall(paragraph) if p]


def _paragraphs(text: str) -> tuple[str, list[int], list[bytes], list[bool]]:
    """(all phrases as LEAF_CHARS characters each; of each paragraph its end among the phrases, hash, and whether a section begins with it)."""
    import xxhash

    lines, found, ends = text.splitlines(keepends=True), [], []
    for line in lines:
        found += phrases(line)
        ends.append(len(found))
    one = xxhash.xxh3_64_intdigest
    full = np.fromiter((one(p.encode("utf-8", "replace")) for p in found), np.uint64, len(found))
    raw, at, marks, begins, end = full.astype("<u8").tobytes(), 0, [], [], True
    for line, stop in zip(lines, ends, strict=True):
        marks.append(_h(b"p" + raw[8 * at : 8 * stop]))
        begins.append(end or line[0] == "#")
        end, at = not line.strip() or marks[-1][0] % SECTION_MOD == 0, stop
    shown = _DIGITS[(full[:, None] >> np.array([0, 6, 12, 18], np.uint64)) & np.uint64(63)]
    return shown.tobytes().decode(), ends, marks, begins


def encode(text: str) -> str:
    """The tree as text: root/section/section..., a section being hash:paragraph,paragraph..., a paragraph its phrases of
    LEAF_CHARS characters each. The root covers the whole text by its own hash too."""
    shown, ends, marks, begins = _paragraphs(text)
    paragraphs = [shown[LEAF_CHARS * a : LEAF_CHARS * b] for a, b in zip([0, *ends], ends, strict=False)]
    cuts = [i for i, b in enumerate(begins) if b] + [len(marks)]
    sections = [_h(b"s" + b"".join(marks[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    root = _h(b"r" + b"".join(sections) + _h(text.encode("utf-8", "replace"), 16), 16)
    return "/".join([root.hex(), *(f"{mark.hex()}:{','.join(paragraphs[a:b])}" for mark, a, b in zip(sections, cuts, cuts[1:], strict=False))])


def leaves(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct phrase marks, times of each)."""
    own = "".join(s.partition(":")[2] for s in fingerprint.split("/")[1:]).replace(",", "")
    return np.unique(np.frombuffer(own.encode(), "<u4"), return_counts=True)


def likeness(a: str, b: str, of_a: tuple | None = None, of_b: tuple | None = None) -> float:
    """0 to 1: phrases that both have, repeats counted, against all phrases of both; 1 for equal roots."""
    if a.partition("/")[0] == b.partition("/")[0]:
        return 1.0
    (x, n), (y, m) = of_a or leaves(a), of_b or leaves(b)
    total = int(n.sum() + m.sum())
    if not (len(x) and len(y)):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return 2.0 * float(np.minimum(n, m[at])[y[at] == x].sum()) / total


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) positions in b whose branch a has nowhere: whole equal sections are skipped by their hash."""
    old = a.split("/")[1:]
    known, have = {s.partition(":")[0] for s in old}, {p for s in old for p in s.partition(":")[2].split(",")}
    return [(i, j) for i, s in enumerate(b.split("/")[1:]) if s.partition(":")[0] not in known for j, p in enumerate(s.partition(":")[2].split(",")) if p not in have]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every row; a null text counts as empty, whose tree has no section."""
    bound_batches(docs.sparkSession)
    return map_rows(texts(docs, id_col, text_col), lambda c: {"doc_id": c["doc_id"], "n_chars": [len(t) for t in c["text"]], "fingerprint": [encode(t) for t in c["text"]]}, "doc_id long, n_chars long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs long"


def _row(doc_id, text: str, own: tuple[str, tuple], nxt: str, of_next: tuple[str, tuple]) -> tuple:
    cut = len(text) // 3
    edited = (text[: len(text) - cut] if cut else text) + nxt[:cut]
    mark = encode(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), own[0], mark, likeness(own[0], mark, own[1]), likeness(own[0], of_next[0], own[1], of_next[1]), len(edits(own[0], mark))


def _marked(text: str) -> tuple[str, tuple]:
    mark = encode(text)
    return mark, leaves(mark)


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text, of an edited text and their likeness; next to them the next document's.

    Documents are ordered by descending doc_id (null ids last; repeated ids by descending text hash, then text). The
    edit replaces the last third of a text by the beginning of the next document's; the last is followed by the first.
    Quantiles of the ids cut the order into parts; an id that takes up more than a part, and rows without an id, are cut
    further by ranges of the text hash. The head of each part is found by a partial maximum and put behind the part before
    it, so that one shuffle of the texts suffices and each task compares neighbours as they stream by. A single document
    is its own next one; empty texts have n_chars 0 and stay empty; empty input gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = 16 * n  # many to a task, so that hashing deals them evenly
    rows = texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(20_000, 4 * parts))).first()[0] or []
    known, doubled = sorted(set(cuts)), sorted({x for x, y in zip(cuts, cuts[1:], strict=False) if x == y})
    step = max(1, math.isqrt(len(known)))  # two short looks instead of one along all cuts
    told = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    upto = lambda x: F.size(F.filter(x, lambda b: b <= F.col("doc_id")))
    chunk = upto(told(known[::step], "array<bigint>"))
    within = F.element_at(told([known[i : i + step] for i in range(0, len(known), step)] or [[0]], "array<array<bigint>>"), F.greatest(chunk, F.lit(1)))
    above = len(known) - F.when(chunk == 0, 0).otherwise((chunk - 1) * step + upto(within))
    repeated = F.coalesce(F.array_contains(told(doubled, "array<bigint>"), F.col("doc_id")), F.lit(True))
    sub = F.when(repeated, ID_PARTS // 2 - 1 - F.shiftright("hash", 64 - ID_PARTS.bit_length() + 1)).otherwise(0)
    place = F.when(F.col("doc_id").isNull(), F.lit(2 * parts + 2)).otherwise(2 * above + repeated.cast("int"))
    rows = rows.withColumn("part", (place * ID_PARTS + sub).cast("int"))

    # the head of a part is its greatest (id, hash); only the texts of those few rows are moved to be heads.
    # There is a row for each part, and parts are bounded by the partitions whatever the rows, so they are broadcast
    first = rows.groupBy("part").agg(F.max(F.struct("doc_id", "hash")).alias("first")).select("part", F.col("first.doc_id").alias("first_id"), F.col("first.hash").alias("first_hash"))
    met = rows.join(F.broadcast(first), "part").filter(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")))
    heads = met.groupBy("part").agg(F.max("text").alias("text"))
    every = Window.orderBy("part")  # a row for each part
    last = F.max("part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.coalesce(F.lag("part").over(every), last).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("hash"), "text", F.lit(True).alias("behind"))
    both = rows.select("part", "doc_id", "hash", "text", F.lit(False).alias("behind")).unionByName(heads).repartition(n, "part")
    ordered = both.sortWithinPartitions("part", "behind", F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text").desc()).select("doc_id", "text", "behind")

    schema = arrow_schema(_OUT)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            made = []
            for doc_id, text, behind in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                now = doc_id, text, _marked(text)
                if before:
                    made.append(_row(*before, text, now[2]))
                before = None if behind else now
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(neighbours, _OUT)
