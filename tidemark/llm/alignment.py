"""Links between the tokens of two tokenizers, by merging their token ends.

A text's bytes are cut by tokenizer A and by tokenizer B; where a token of each ends, a group ends, and every A token of a
group is linked with every B token of it. The ends of both are two sorted lists, whose merge is divided by the merge path:
at each multiple of PIECE steps a binary search along the diagonal says how many ends of A and of B lie before, so the
pieces are independent and of equal work, however the two lists interleave. A text of one piece is finished where it was
tokenized, all such texts of a batch at once in numpy; the pieces of longer texts travel as rows, each finds the ends it
shares and emits its whole groups and what is open at its two sides, and a text's pieces are stitched in order.

How many documents hold an id pair is counted over the stored pairs with partial sums. Counts then meet the pairs again:
pairs that have over 1 / HOT_PAIRS of all rows are broadcast, the others meet by a shuffle, which no pair can dominate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbered, arrow_schema, bound_batches, longer, stored
from .pieces import Held, Vocabulary
from .tokens import Encoder

#: Ends of A and B that a piece merges; bytes of texts that are merged at once; pairs that are made at once.
PIECE, HELD_BYTES, HELD_PAIRS = 1 << 15, 1 << 19, 1 << 22
#: Units that a worker remembers of each tokenizer, and their bytes; the memory is dropped when either is full.
MEMORY, MEMORY_BYTES = 250_000, 16 << 20
#: Groups with more links than this are linked by distinct ids and their counts.
LARGE_GROUP = 256
#: Fewer than so many pairs are broadcast.
HOT_PAIRS = 65_536
_DONE = "row long, part int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<long>"
_PIECE = "piece int, a_ids array<int>, b_ids array<int>, a_ends array<long>, b_ends array<long>"


# --- the two tokenizers


def _byte_of() -> dict[str, int]:
    """How byte-level vocabularies show bytes: visible ones as themselves, the others from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelled:
    """The bytes of each id, flat."""

    def __init__(self, raw: list[bytes]) -> None:
        self.size = np.array([len(r) for r in raw], np.int64)
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.begin[ids] - upto + size, size) + np.arange(int(upto[-1]) if len(ids) else 0)]


class UnitPieces:
    """Ids of whole texts by a SentencePiece BPE model, which a worker asks for each new unit once.

    Two characters that are neighbours in no piece are never merged, so units between such places are encoded apart. Texts of
    models whose normal form changes more than spaces, or that are no BPE, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        told = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            told.ParseFromString(f.read())
        spec = told.normalizer_spec
        self.by_unit = told.trainer_spec.model_type == told.trainer_spec.BPE and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not told.trainer_spec.treat_whitespace_as_suffix
        if self.by_unit:
            told.normalizer_spec.add_dummy_prefix = False  # the text comes with it
        self.model, self.v = SentencePieceProcessor(model_proto=told.SerializeToString()), Vocabulary(path)
        self.spelled = Spelled([r if k == "byte" else r.replace("▁".encode(), b" ") for r, k in zip(self.v.raw, self.v.kind, strict=True)])
        self.cutter = Held(self.v)
        self._forget()

    def _forget(self) -> None:
        self.known = Numbered()
        self.size, self.begin, self.flat, self.good, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool), 0

    def _add(self, new: list[bytes], first: int) -> None:
        texts = [u.decode().replace("▁", " ") for u in new]
        made = self.model.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        end, total = first + len(new), self.total + int(sizes.sum())
        self.size, self.begin, self.good, self.flat = longer(self.size, end), longer(self.begin, end), longer(self.good, end), longer(self.flat, total)
        self.size[first:end], self.begin[first:end] = sizes, self.total + np.cumsum(sizes) - sizes
        self.flat[self.total : total] = np.fromiter((i for ids in made for i in ids), np.int32, total - self.total)
        self.good[first:end] = self._spell(self.flat[self.total : total], sizes, [t.encode() for t in texts])
        self.total = total

    def _spell(self, ids: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each unit's ids (flat, `sizes` of each) spell its bytes."""
        upto = np.append(0, np.cumsum(self.spelled.size[ids]))
        ends = np.cumsum(sizes)
        size, want = upto[ends] - upto[ends - sizes], np.fromiter(map(len, raw), np.int64, len(raw))
        good = size == want
        made, told = self.spelled.of(ids)[np.repeat(good, size)], np.frombuffer(b"".join(raw), np.uint8)[np.repeat(good, want)]
        good[np.repeat(np.flatnonzero(good), size[good])[made != told]] = False
        return good

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, none where they do not spell a space and the text."""
        none = np.zeros(0, np.int64)
        if not self.by_unit:
            made = [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]
            return [x if self.spelled.of(x).tobytes() == b" " + t.encode() else none for x, t in zip(made, texts, strict=True)]
        if len(self.known) > MEMORY or self.known.held > MEMORY_BYTES:
            self._forget()
        data, start, n_units = self.cutter._cut([self.v.normalised(t) for t in texts])
        number, new = self.known.numbers(data, start, np.diff(np.append(start, len(data))))
        if new:
            self._add(new, len(self.known) - len(new))
        n = self.size[number]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.begin[number] - upto + n, n) + np.arange(int(upto[-1]))].astype(np.int64)
        ends = np.cumsum(n_units)
        at = np.append(0, upto)[np.append(0, ends)].tolist()
        bad = np.append(0, np.cumsum(~self.good[number]))[np.append(0, ends)]
        return [ids[at[i] : at[i + 1]] if bad[i] == bad[i + 1] and "▁" not in t else none for i, t in enumerate(texts)]


class Pair:
    """Both tokenizers of a worker. Strings of special tokens in a text are plain text to both."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.encoder = Encoder(a_path)
        byte_of, vocabulary = _byte_of(), self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        raw = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            raw[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.a = Spelled(raw)
        self.encode_b = UnitPieces(b_path)
        self.b = self.encode_b.spelled

    def whole(self, text: str) -> np.ndarray:
        """Ids of A with special tokens read as plain text."""
        tokenizer = self.encoder.tokenizer
        tokenizer.encode_special_tokens = True
        try:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
        finally:
            tokenizer.encode_special_tokens = False

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text."""
        enc, own = self.encoder, [f" {t}" for t in texts]
        if len(enc.known) > MEMORY or enc.known.held > MEMORY_BYTES:
            enc._forget()
        odd = [not enc.by_unit or bool(enc.odd.search(t.encode("utf-8", "replace"))) for t in own] if not enc.by_unit or enc.odd.search("".join(own).encode("utf-8", "replace")) else [False] * len(own)
        quick = iter(enc([t for t, o in zip(own, odd, strict=True) if not o]) if not all(odd) else ())
        return [self.whole(t) if o else next(quick).astype(np.int64) for t, o in zip(own, odd, strict=True)]


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One for each worker and files."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


# --- merging


def merge_path(a: np.ndarray, b: np.ndarray, piece: int) -> np.ndarray:
    """(ends of a, ends of b) before each cut, from (0, 0) to (len(a), len(b)): two sorted lists in runs of `piece` merge steps.

    Equal ends are never parted: where a diagonal would, the end of b goes before the cut.
    """
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = np.zeros(len(d), bool)
        before[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    i, j = low, d - low
    same = (i > 0) & (j < len(b))
    same[same] = a[i[same] - 1] == b[j[same]]
    return np.stack([i, j + same])


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both have: each marks its own, the other looks."""
    if not (len(a) and len(b)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, size = min(a[0], b[0]), max(a[-1], b[-1]) - min(a[0], b[0]) + 1
    of_a, of_b = np.zeros(size, bool), np.zeros(size, bool)
    of_a[a - first] = of_b[b - first] = True
    return np.flatnonzero(of_b[a - first]), np.flatnonzero(of_a[b - first])


def groups_of(hit: np.ndarray, size: int) -> np.ndarray:
    """The group of each of `size` tokens, given the places of those that end one."""
    mark = np.zeros(size, np.int64)
    mark[hit] = 1
    return np.cumsum(mark) - mark


_DIGITS = Spelled([])


def _digits(most: int) -> Spelled:
    """Decimal ids with a separator behind, as far as they have been asked for."""
    global _DIGITS
    if most >= len(_DIGITS.size):
        _DIGITS = Spelled([b"%d," % i for i in range(max(most + 1, 2 * len(_DIGITS.size)))])
    return _DIGITS


def spell_groups(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all groups as `a1,a2|b1;`, where the text of each group ends): ga and gb are the groups of the tokens, from 0, none empty."""
    n = int(ga[-1]) + 1 if len(ga) else 0
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    place_a, place_b = np.arange(len(a)) + (np.cumsum(nb) - nb)[ga], np.arange(len(b)) + np.cumsum(na)[gb]
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    last = np.cumsum(na + nb) - 1
    sign[last], sign[last - nb] = ord(";"), ord("|")
    digits = _digits(int(ids.max(initial=0)))
    out, upto = digits.of(ids), np.cumsum(digits.size[ids])
    out[upto - 1] = sign
    return out, upto[last]


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, times
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(times, first)


def link_pairs(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, scope: np.ndarray, n_b: int, n_a: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, times) of the distinct linked id pairs in each scope; key = (scope * n_a + a) * n_b + b. scope: of each group."""
    n = len(scope)
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    wa, wb = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    if (na * nb > LARGE_GROUP).any():  # fewer rows for large groups: distinct ids and their counts
        big = na * nb > LARGE_GROUP

        def fewer(ids, g, w, size):
            of = big[g]
            key, times = _summed(g[of] * size + ids[of], w[of])
            order = np.argsort(np.concatenate([g[~of], key // size]), kind="stable")
            return np.concatenate([ids[~of], key % size])[order], np.concatenate([g[~of], key // size])[order], np.concatenate([w[~of], times])[order]

        (a, ga, wa), (b, gb, wb) = fewer(a, ga, wa, n_a), fewer(b, gb, wb, n_b)
        nb = np.bincount(gb, minlength=n)
    repeat = nb[ga]
    upto = np.cumsum(repeat)
    with_b = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat((np.cumsum(nb) - nb)[ga] - upto + repeat, repeat)
    return _summed(np.repeat((scope[ga] * n_a + a) * n_b, repeat) + b[with_b], np.repeat(wa, repeat) * wb[with_b])


def parts_of_pairs(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, scope: np.ndarray, n_b: int, n_a: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """link_pairs in parts without a common pair, each of about HELD_PAIRS rows at most: by the remainder of the A ids."""
    n = len(scope)
    most = int((np.bincount(ga, minlength=n) * np.bincount(gb, minlength=n)).sum())
    if most > HELD_PAIRS:
        kinds = lambda ids, g, size: np.bincount(np.unique(g * size + ids) // size, minlength=n)
        most = int((kinds(a, ga, n_a) * kinds(b, gb, n_b)).sum())
    k = 1 + most // HELD_PAIRS
    for r in range(k):
        of = a % k == r if k > 1 else slice(None)
        yield link_pairs(a[of], b, ga[of], gb, scope, n_b, n_a)


# --- the operator


class _Rows:
    """Finished rows, column by column."""

    def __init__(self) -> None:
        self.c: dict[str, list] = {f.split()[0]: [] for f in _DONE.split(", ")}

    def add(self, row: int, doc_id, counts: tuple[int, int, int, int], sha: str, pairs: list[tuple[np.ndarray, np.ndarray]], n_b: int, part: int = 0) -> None:
        """Of one document: the first row has its counts, further ones more of its pairs."""
        for p, (key, times) in enumerate(pairs or [(np.zeros(0, np.int64),) * 2], part):
            own = (row, p, doc_id, *counts, sha) if p == 0 else (row, p, *[None] * 6)
            for n, v in zip(self.c, (*own, (key // n_b).astype(np.int32), (key % n_b).astype(np.int32), times), strict=True):
                self.c[n].append(v)


def _tokenized(tok: Pair, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of A and B of each text; none for a text whose bytes either does not spell."""
    if not texts:
        return [], []
    none = np.zeros(0, np.int64)
    a, b = tok.encode_a(texts), tok.encode_b(texts)
    for i, t in enumerate(texts):
        if not len(b[i]) or tok.a.of(a[i]).tobytes() != b" " + t.encode("utf-8", "replace"):
            a[i] = b[i] = none
    return a, b


def _finish(tok: Pair, rows: list[tuple[int, object]], a: list[np.ndarray], b: list[np.ndarray], out: _Rows) -> None:
    """Documents of one piece, all at once: their ends follow one another, and each document's last end is shared."""
    n_a, n_b = len(tok.a.size), len(tok.b.size)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    hit_a, hit_b = shared_ends(np.cumsum(tok.a.size[flat_a]), np.cumsum(tok.b.size[flat_b]))
    ends_a, ends_b = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
    g_end = np.searchsorted(hit_a, ends_a)  # groups before each document's end
    g_begin = np.append(0, g_end[:-1])
    ga, gb = groups_of(hit_a, len(flat_a)), groups_of(hit_b, len(flat_b))
    scope = np.repeat(np.arange(len(a)), g_end - g_begin)
    links = np.bincount(ga, minlength=len(hit_a)) * np.bincount(gb, minlength=len(hit_b))
    linked = np.append(0, np.cumsum(links))
    text, upto = spell_groups(flat_a, flat_b, ga, gb)
    upto = np.append(0, upto)
    pairs: list[list] = [[] for _ in a]
    for key, times in parts_of_pairs(flat_a, flat_b, ga, gb, scope, n_b, n_a):
        cut = np.searchsorted(key, np.arange(len(a) + 1) * n_a * n_b)
        for i in range(len(a)):
            if cut[i] < cut[i + 1]:
                pairs[i].append((key[cut[i] : cut[i + 1]] - i * n_a * n_b, times[cut[i] : cut[i + 1]]))
    for i, (row, doc_id) in enumerate(rows):
        x, y = g_begin[i], g_end[i]
        sha = hashlib.sha256(text[upto[x] : upto[y] - 1]).hexdigest() if y > x else ""
        out.add(row, doc_id, (len(a[i]), len(b[i]), int(y - x), int(linked[y] - linked[x])), sha, pairs[i], n_b)


def tokenized(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Documents of one piece finished (piece null), the pieces of longer ones with their tokens and ends."""
    columns = f"{_DONE}, {_PIECE}"
    schema = arrow_schema(columns)
    done, open_ = [f.split()[0] for f in _DONE.split(", ")], [f.split()[0] for f in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, row = pair(a_path, b_path), TaskContext.get().partitionId() << 33
        none = np.zeros(0, np.int64)

        def batch(c: dict) -> pa.RecordBatch:
            n = len(c["row"])
            return pa.RecordBatch.from_arrays([pa.array(c[f.name], f.type) if f.name in c else pa.nulls(n, f.type) for f in schema], schema=schema)

        for got in batches:
            ids, texts = got.column(0).to_pylist(), got.column(1).to_pylist()
            at = 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and (to == at or size + len(texts[to] or "") <= HELD_BYTES):
                    size += len(texts[to] or "")
                    to += 1
                there = [i for i in range(at, to) if texts[i]]
                a, b = _tokenized(tok, [texts[i] for i in there])
                tokens = dict(zip(there, zip(a, b, strict=True), strict=True))
                whole, cut = _Rows(), {n: [] for n in ["row", "doc_id", *open_]}
                rows, own_a, own_b = [], [], []
                for i in range(at, to):
                    x, y = tokens.get(i, (none, none))
                    if len(x) + len(y) <= piece:
                        rows.append((row, ids[i]))
                        own_a.append(x)
                        own_b.append(y)
                    else:
                        ex, ey = np.cumsum(tok.a.size[x]), np.cumsum(tok.b.size[y])
                        cuts = merge_path(ex, ey, piece).T.tolist()
                        for p, ((i0, j0), (i1, j1)) in enumerate(zip(cuts, cuts[1:], strict=False)):
                            for n, v in zip(cut, (row, ids[i], p, x[i0:i1].astype(np.int32), y[j0:j1].astype(np.int32), ex[i0:i1], ey[j0:j1]), strict=True):
                                cut[n].append(v)
                    row += 1
                if rows:
                    _finish(tok, rows, own_a, own_b, whole)
                    yield batch({n: whole.c[n] for n in done})
                if cut["row"]:
                    yield batch(cut)
                at = to

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, columns)


_MERGED = "row long, piece int, doc_id long, n_a long, n_b long, n_groups long, n_links long, spelled binary, a array<int>, b array<int>, times array<long>, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"


def merged(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The groups that lie within each piece, spelled and as pairs, and its tokens before the first and behind the last shared end."""
    schema = arrow_schema(_MERGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pair(a_path, b_path)
        n_a, n_b = len(tok.a.size), len(tok.b.size)
        for got in batches:
            for r in got.to_pylist():
                a, b = np.array(r["a_ids"], np.int64), np.array(r["b_ids"], np.int64)
                hit_a, hit_b = shared_ends(np.array(r["a_ends"], np.int64), np.array(r["b_ends"], np.int64))
                out = {"row": r["row"], "piece": r["piece"], "doc_id": r["doc_id"], "n_a": len(a), "n_b": len(b), "n_groups": max(0, len(hit_a) - 1)}
                if not len(hit_a):  # all open
                    out |= {"n_groups": -1, "n_links": 0, "spelled": b"", "a": [], "b": [], "times": [], "head_a": a, "head_b": b, "tail_a": [], "tail_b": []}
                    made = [out]
                else:
                    x, y, u, v = hit_a[0] + 1, hit_a[-1] + 1, hit_b[0] + 1, hit_b[-1] + 1
                    inner_a, inner_b = a[x:y], b[u:v]
                    ga, gb = np.searchsorted(hit_a[1:], np.arange(x, y)), np.searchsorted(hit_b[1:], np.arange(u, v))
                    n = len(hit_a) - 1
                    links = int((np.bincount(ga, minlength=n) * np.bincount(gb, minlength=n)).sum())
                    spelled = spell_groups(inner_a, inner_b, ga, gb)[0].tobytes() if n else b""
                    first = {"n_links": links, "spelled": spelled, "head_a": a[:x], "head_b": b[:u], "tail_a": a[y:], "tail_b": b[v:]}
                    more = {"n_a": 0, "n_b": 0, "n_groups": None, "n_links": 0, "spelled": b"", "head_a": [], "head_b": [], "tail_a": [], "tail_b": []}
                    made = []
                    for key, times in parts_of_pairs(inner_a, inner_b, ga, gb, np.zeros(n, np.int64), n_b, n_a) if n else [(np.zeros(0, np.int64),) * 2]:
                        made.append(out | (first if not made else more) | {"a": key // n_b, "b": key % n_b, "times": times})
                yield pa.RecordBatch.from_arrays([pa.array([m[f.name] for m in made], f.type) for f in schema], schema=schema)

    return pieces.select("row", "doc_id", "piece", "a_ids", "b_ids", "a_ends", "b_ends").mapInArrow(run, _MERGED)


def stitched(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Finished rows from the merged pieces of each document: what is open behind a piece is closed by the head of a later one."""
    out = arrow_schema(_DONE)

    def run(t: pa.Table) -> pa.Table:
        tok = pair(a_path, b_path)
        n_a, n_b = len(tok.a.size), len(tok.b.size)
        rows = sorted(t.to_pylist(), key=lambda r: (r["piece"], r["n_groups"] is None))
        sha, spelled, groups, links = hashlib.sha256(), False, 0, 0
        open_a, open_b, keys, times = [], [], [], []

        def say(x: bytes) -> None:
            nonlocal spelled
            if x:
                sha.update(b";" * spelled + x[:-1])
                spelled = True

        def close(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal groups, links
            zero_a, zero_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            say(spell_groups(a, b, zero_a, zero_b)[0].tobytes())
            groups, links = groups + 1, links + len(a) * len(b)
            for key, n in parts_of_pairs(a, b, zero_a, zero_b, np.zeros(1, np.int64), n_b, n_a):
                keys.append(key)
                times.append(n)

        for r in rows:
            keys.append(np.array(r["a"], np.int64) * n_b + np.array(r["b"], np.int64))
            times.append(np.array(r["times"], np.int64))
            open_a += r["head_a"]
            open_b += r["head_b"]
            if r["n_groups"] is not None and r["n_groups"] >= 0:
                close(np.array(open_a, np.int64), np.array(open_b, np.int64))
                open_a, open_b = r["tail_a"], r["tail_b"]
                say(r["spelled"])
                groups, links = groups + r["n_groups"], links + r["n_links"]
        done = _Rows()
        key, n = _summed(np.concatenate(keys), np.concatenate(times))
        done.add(rows[0]["row"], rows[0]["doc_id"], (sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), groups, links), sha.hexdigest(), [(key[i : i + HELD_PAIRS], n[i : i + HELD_PAIRS]) for i in range(0, len(key), HELD_PAIRS)], n_b)
        return pa.Table.from_arrays([pa.array(done.c[f.name], f.type) for f in out], schema=out)

    return parts.groupBy("row").applyInArrow(run, _DONE)


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Stored: of each document (row) its counts and distinct linked id pairs with their times; documents with many pairs have further rows (part)."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    first = stored(tokenized(docs, a_path, b_path, id_col, text_col, piece), "align-tokens")
    long = first.filter(F.col("piece").isNotNull()).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "row", "piece")
    done = [f.split()[0] for f in _DONE.split(", ")]
    more = stored(stitched(merged(long, a_path, b_path), a_path, b_path), "align-long")
    return first.filter(F.col("piece").isNull()).select(*done).unionByName(more)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, documents (that hold the pair linked) and best (whether no other pair of its a has more)."""
    counts = stored(rows.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents")), "align-counts")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))  # as many rows as A has ids


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A: a byte-level BPE file of the tokenizers library, given a space and the text; B: a SentencePiece model, which adds the
    space. Null and empty texts, and those whose bytes a tokenizer does not give back (normal forms, a literal ▁), have no
    tokens: zeros and ''. A text is tokenized whole, so a task's memory follows the longest one. Repeated rows are documents
    of their own, which count; further columns are ignored; no rows give none.
    """
    rows = linked(docs, a_path, b_path, id_col, text_col, piece)
    counts = stored(pair_counts(rows), "align-best")
    total = counts.agg(F.sum("documents")).first()[0] or 0
    is_hot = F.col("documents") * HOT_PAIRS > total
    hot = counts.filter(is_hot)
    each = rows.filter(F.size("a") > 0).select("row", F.inline(F.arrays_zip("a", "b", "times")))
    met = each.join(F.broadcast(hot), ["a", "b"]).groupBy("row")
    rare = each.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(counts.filter(~is_hot), ["a", "b"]).groupBy("row")
    sums = lambda g: g.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    both = sums(met).unionByName(sums(rare)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    told = rows.filter("part = 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
