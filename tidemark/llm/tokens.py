"""Token ids in fixed-width bit packing.

The file format: Parquet files of blocks. A block holds whole documents, about `block_ids` ids; each id takes the minimum
number of bits that the vocabulary needs, first id first, least significant bit first, and the last byte is filled with
zeros. Beside the packed bytes a block states its part (a range of the document order), its number in the part, the
bits, the number of ids, the offset of its first id in the part, and for each document its id, offset in the block and
length. A manifest has each part's ids before it. Any document is read by one block (row-group statistics of part and
block prune the rest), and numpy unpacks any range of ids of a block at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Numbered, arrow_schema, bound_batches, longer, texts

BLOCK_IDS, END_ID = 1 << 16, 0
BLOCK = "part int, block int, bits int, n_ids long, part_start long, packed binary, doc_ids array<long>, doc_starts array<long>, doc_lens array<long>"
#: Units of text whose ids a worker remembers, and their bytes; the memory is dropped when either is full.
MEMORY, MEMORY_BYTES = 600_000, 32 << 20


def bits_for(vocabulary: int) -> int:
    """The least bits that hold every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of `bits` bits each, back to back, least significant bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids start to start + count (all, if None and the count is known from whole bytes) as uint32."""
    raw = np.frombuffer(data, np.uint8)
    count = len(raw) * 8 // bits - start if count is None else count
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}")[start : start + count].astype(np.uint32)
    first = start * bits
    own = np.unpackbits(raw[first // 8 : (first + count * bits + 7) // 8], bitorder="little")[first % 8 :][: count * bits].reshape(-1, bits)
    out = np.zeros((len(own), 32), np.uint8)
    out[:, :bits] = own
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


# Classes of bytes for cutting: white, letter, digit, other ASCII, apostrophe, unknown, white beyond ASCII.
_WHITE, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _UNKNOWN, _WIDE_WHITE = range(7)
_CLASS = np.array([_WHITE if b in b"\t\n\v\f\r " else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _APOSTROPHE if b == 39 else _SIGN for b in range(128)] + [_UNKNOWN] * 128, np.uint8)
#: UTF-8 of white-space characters beyond ASCII.
_WIDE = [c.encode() for c in "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Whether a unit ends between two classes (first * 8 + second).
_ENDS = np.zeros(64, bool)
for _a in (_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _UNKNOWN):
    _ENDS[_a * 8 + _WHITE] = True
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _SIGN), (_LETTER, _APOSTROPHE), (_DIGIT, _LETTER), (_DIGIT, _SIGN), (_DIGIT, _APOSTROPHE), (_SIGN, _LETTER), (_SIGN, _DIGIT)):
    _ENDS[_a * 8 + _b] = True


def cut(data: np.ndarray) -> np.ndarray:
    """Where units begin in UTF-8 bytes, as a mask: places that byte-level pre-tokenisation never crosses.

    It never goes from a visible character to white space, and never joins letters, digits and other signs, but for
    contractions behind an apostrophe. Latin letters beyond ASCII are letters; what is beyond them ends at white space only.
    """
    kind = _CLASS[data]
    if len(data) and data.max() >= 0x80:
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
        sign = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))
        lead = lead[~sign]
        kind[lead] = kind[lead + 1] = _LETTER
        for w in _WIDE:
            at = np.flatnonzero(data == w[-1])
            at = at[at >= len(w) - 1]
            for k, c in enumerate(reversed(w)):
                at = at[data[at - k] == c]
            kind[at] = _WIDE_WHITE
    out = np.ones(len(data), bool)
    out[1:] = _ENDS[kind[:-1] * 8 + kind[1:]]
    return out


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    A text is cut into units where byte-level pre-tokenisation never crosses, and a worker encodes a unit once. All units of
    a batch are found and looked up together, in numpy. New units that are one pre-token (letters, a space in front or not)
    go straight to the library's BPE model; others are encoded in bulk with a special token between them, which splits the
    text before anything else looks at it. Where the tokenizer's settings or a text's control characters leave any of
    this in doubt, whole texts are encoded.
    """

    def __init__(self, path: str) -> None:
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, added = told.get("pre_tokenizer") or {}, told.get("added_tokens", [])
        plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not re.search(r"\s|\w+$", t["content"]) for t in added)
        self.by_unit = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer") and not told["model"].get("dropout") and plain
        self.mark = next(((t["content"], t["id"]) for t in added if t.get("special")), None)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.odd = re.compile(b"[\x1c-\x1f]" + b"".join(b"|" + re.escape(t["content"].encode()) for t in added))
        self.one_token = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u027f]+")
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {ord(c): "".join(t for t, _ in as_bytes(c)) for c in map(chr, (*range(128), *range(0xC0, 0x280)))}  # how the model takes bytes
        self._forget()

    def _forget(self) -> None:
        self.known = Numbered()
        self.size, self.begin, self.flat, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def _add(self, new: list[bytes], first: int) -> None:
        """Encode new units, numbered from `first`."""
        texts = [u.decode("utf-8", "replace") for u in new]
        alone = [bool(self.one_token.fullmatch(t)) for t in texts]
        bpe, shown = self.tokenizer.model.tokenize, self.shown
        made = [[t.id for t in bpe(x.translate(shown))] if a else None for x, a in zip(texts, alone, strict=True)]
        rest = [i for i, a in enumerate(alone) if not a]
        for at in range(0, len(rest), 256):
            own = rest[at : at + 256]
            if self.mark:
                ids = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join([texts[i] for i in own])], add_special_tokens=False)[0].ids, np.uint32)
                each = np.split(ids, np.flatnonzero(ids == self.mark[1]))
                for i, e in zip(own, [each[0], *(e[1:] for e in each[1:])], strict=True):
                    made[i] = e.tolist()
            else:
                for i, e in zip(own, self.tokenizer.encode_batch_fast([texts[i] for i in own], add_special_tokens=False), strict=True):
                    made[i] = e.ids
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        end, total = first + len(new), self.total + int(sizes.sum())
        self.size, self.begin, self.flat = longer(self.size, end), longer(self.begin, end), longer(self.flat, total)
        self.size[first:end], self.begin[first:end] = sizes, self.total + np.cumsum(sizes) - sizes
        self.flat[self.total : total] = np.fromiter((i for ids in made for i in ids), np.uint32, total - self.total)
        self.total = total

    def __call__(self, batch: list[str]) -> list[np.ndarray]:
        if not self.by_unit:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(batch, add_special_tokens=False)]
        if len(self.known) > MEMORY or self.known.held > MEMORY_BYTES:
            self._forget()
        raw = [t.encode("utf-8", "replace") for t in batch]
        odd = {i for i, r in enumerate(raw) if self.odd.search(r)} if self.odd.search(b"".join(raw)) else ()
        data = b"".join(r for i, r in enumerate(raw) if i not in odd)
        lens = np.array([0 if i in odd else len(r) for i, r in enumerate(raw)], np.int64)
        ends = np.cumsum(lens)
        if data:
            begins = cut(np.frombuffer(data, np.uint8))
            begins[(ends - lens)[lens > 0]] = True
            start = np.flatnonzero(begins)
            first = len(self.known)
            number, new = self.known.numbers(data, start, np.diff(np.append(start, len(data))))
            if new:
                self._add(new, first)
            n = self.size[number]
            upto = np.cumsum(n)
            ids = self.flat[np.repeat(self.begin[number] - upto + n, n) + np.arange(int(upto[-1]))]
            at = np.concatenate(([0], upto))[np.searchsorted(start, np.append(ends - lens, len(data)))]
        else:
            ids, at = np.zeros(0, np.uint32), np.zeros(len(batch) + 1, np.int64)
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if i in odd else ids[at[i] : at[i + 1]] for i, t in enumerate(batch)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def blocks(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> DataFrame:
    """Packed blocks of all documents in ascending id order (null ids first; repeated ids by text hash, then text).

    tokenizer: path of a tokenizers file that exists on every executor. end_id follows each document (None: nothing does).
    A null or empty text has the end id alone. A document longer than a block has a block of its own. Repeated rows have
    equal ids, one behind the other; an empty table gives no block. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    schema = arrow_schema(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        bits, block, before = bits_for(max(enc.vocabulary, (end_id or 0) + 1)), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal block, before
            lens = np.array([len(x) for x in held], np.int64)
            ids = np.concatenate(held)
            row = {"part": [part], "block": [block], "bits": [bits], "n_ids": [len(ids)], "part_start": [before], "packed": [pack(ids, bits)], "doc_ids": [list(names)], "doc_starts": [np.cumsum(lens) - lens], "doc_lens": [lens]}
            block, before = block + 1, before + len(ids)
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in schema], schema=schema)

        waiting = 0
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc(b.column(1).to_pylist()), strict=True):
                held.append(np.concatenate([ids, tail]))
                names.append(doc_id)
                waiting += len(held[-1])
                if waiting >= block_ids:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    return ordered.mapInArrow(run, BLOCK)


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write the blocks below path/blocks and the parts' offsets, a row for each part, below path/parts."""
    spark = docs.sparkSession
    blocks(docs, tokenizer, **options).write.option("parquet.block.size", 8 << 20).parquet(f"{path}/blocks")
    sums = spark.read.schema(BLOCK).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), "ids").coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `start`, the ids of all documents before the block."""
    parts = spark.read.schema("part int, start long, ids long").parquet(f"{path}/parts")
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("part_start"))  # as many rows as the files have parts


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) and, if with_ids, the ids, unpacked from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                ids = unpack(r["packed"], r["bits"], 0, r["n_ids"])
                own = [ids[s : s + n] for s, n in zip(r["doc_starts"], r["doc_lens"], strict=True)]
                made = {"doc_id": r["doc_ids"], "start": [r["start"] + s for s in r["doc_starts"]], "n_tokens": r["doc_lens"], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in own], "ids": own}
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    bound_batches(spark)
    return read(spark, path).select("start", "bits", "n_ids", "packed", "doc_ids", "doc_starts", "doc_lens").mapInArrow(run, schema)
