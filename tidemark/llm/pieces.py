"""SentencePiece encoding by sampling segmentations without replacement, and decoding.

The pieces of a model span a lattice over a text. Perturbed A* search visits it from the top: the set of all segmentations
has a Gumbel value, which is that of its best member; that member is drawn by walking the lattice forward under backward
sums, and what is left of the set is split, at each step of the walk, into "the same up to here, then another piece".
Each part gets the largest Gumbel value of its members, bounded by its parent's, and waits in a queue; the next sample is
drawn from the part on top. So k pops give the k largest perturbed log probabilities: k distinct segmentations, drawn
without replacement. The value of the next part in the queue is the threshold of the inclusion scores.

Two characters that are neighbours in no piece part any segmentation, so a text's lattice is a chain of small ones, one a
unit between such places; this holds for any model, as the pairs are those of its pieces. New units' lattices are built together and kept by the task, up to a bound; all
texts' walks take their steps together, in numpy. Random numbers are a hash of seed, row key, sample and place, and sums
never run across units or texts, so a row's samples do not depend on how rows are dealt out.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbered, arrow_schema, bound_batches, longer, map_rows

K, SEED = 2, 42
#: Characters of the texts whose lattices are held at once; a longer text is held alone.
HELD_CHARS = 200_000
#: Edges of lattices that a task keeps between texts; beyond it only those of units seen three times or more stay.
HELD_EDGES = 1_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In (0, 1), by row key and place."""
    return ((_mix(key ^ _mix(place)) >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces of a model file, their log probabilities and a trie of them.

    A unigram model states log probabilities; a BPE model states merge ranks, which count as Zipf's ranks: a piece's
    probability is in proportion to 1 / (rank + 3). Characters without a piece are spelled in byte pieces.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        told = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            told.ParseFromString(f.read())
        kinds = {1: "piece", 4: "piece", 6: "byte"}
        self.text = [p.piece for p in told.pieces]
        self.kind = [kinds.get(p.type, "") for p in told.pieces]
        self.byte_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == "byte"}
        self.raw = [bytes([int(t[3:5], 16)]) if k == "byte" else t.encode() for t, k in zip(self.text, self.kind, strict=True)]
        self.unknown = told.trainer_spec.unk_id
        self.byte_id = np.array([self.byte_ids.get(b, self.unknown) for b in range(256)], np.int64)
        self.spellings = pa.array([*self.raw, "�".encode()], pa.large_binary())  # the last one is that of ids outside
        own = np.array([p.score for p in told.pieces])
        if told.trainer_spec.model_type == told.trainer_spec.UNIGRAM:
            self.logp, self.byte_logp = own, float(own[[k == "piece" for k in self.kind]].min()) - 2.0
        else:
            rank = np.where(own > -1e8, -own, len(own))
            self.logp = -np.log(rank + 3.0)
            self.logp -= np.log(np.exp(self.logp[[k == "piece" for k in self.kind]]).sum())
            self.byte_logp = float(self.logp.min())
        self.prefix = told.normalizer_spec.add_dummy_prefix
        nodes: list[dict[str, int]] = [{}]
        ends = [-1]
        for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)):
            if k == "piece":
                at = 0
                for c in t:
                    if c not in nodes[at]:
                        nodes[at][c] = len(nodes)
                        nodes.append({})
                        ends.append(-1)
                    at = nodes[at][c]
                ends[at] = i
        arcs = sorted(((a << 21) | ord(c), b) for a, own in enumerate(nodes) for c, b in own.items())
        self.arc_key, self.arc_to, self.ends = np.array([k for k, _ in arcs]), np.array([b for _, b in arcs], np.int32), np.array(ends, np.int32)
        self.longest = max(map(len, self.text))
        pairs = {t[i : i + 2] for t, k in zip(self.text, self.kind, strict=True) if k == "piece" for i in range(len(t) - 1)}
        letters = sorted({c for p in pairs for c in p})
        self.letter = np.zeros(1 << 21, np.int32)  # of each code point; 0: in no pair
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in pairs:
            self.joined[self.letter[ord(a)], self.letter[ord(b)]] = True
        self.first = np.full(1 << 21, -1, np.int32)
        for c, b in nodes[0].items():
            self.first[ord(c)] = b

    def normalised(self, text: str) -> str:
        """Spaces as ▁ and one in front, as these models take text."""
        return ("▁" if self.prefix else "") + text.replace(" ", "▁") if text else ""

    def spell(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all pieces back to back, where each begins, and their end); an id outside the vocabulary is spelled �."""
        if not len(ids):
            return b"", np.zeros(1, np.int64)
        own = self.spellings.take(pa.array(np.where((ids >= 0) & (ids < len(self.raw)), ids, len(self.raw))))
        return own.buffers()[2].to_pybytes(), np.frombuffer(own.buffers()[1], np.int64)[: len(ids) + 1]

    def read(self, spelled: bytes) -> str:
        """The text that pieces spell: UTF-8 (bad bytes replaced), ▁ as space, without the one in front."""
        out = spelled.decode("utf-8", "replace").replace("▁", " ")
        return out[1:] if self.prefix and out[:1] == " " else out


@dataclass
class Lattices:
    """Of many units at once. Nodes are numbered through; edges are sorted by node."""

    start: np.ndarray  # first node of each unit
    last: np.ndarray  # whether a node ends its unit
    first_edge: np.ndarray  # of each node, and one more
    node: np.ndarray  # of each edge's begin
    to: np.ndarray  # node of each edge's end
    piece: np.ndarray  # of each edge; below 0: -1 - code point, spelled in bytes
    log_prob: np.ndarray  # of each edge given its node
    total: np.ndarray  # the probability up to and with each edge of its node


def build(units: list[str], v: Vocabulary) -> Lattices:
    """Match all pieces at all places by walking the trie in step, then sum backwards from the units' ends."""
    lens = np.fromiter(map(len, units), np.int64, len(units))
    code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    unit = np.repeat(np.arange(len(units), dtype=np.int32), lens)
    stop = np.cumsum(lens)
    at = np.arange(len(code), dtype=np.int32)
    node = at + unit  # each unit has one node more than characters
    left = (stop[unit] - at).astype(np.int32)  # characters from here to the unit's end
    state = v.first[code]
    starts, sizes, ids = [], [], []
    for n in range(1, v.longest + 1):
        if n > 1:
            on = left[at] >= n
            at, state = at[on], state[on]
            key = (state.astype(np.int64) << 21) | code[at + n - 1]
            i = np.minimum(np.searchsorted(v.arc_key, key), len(v.arc_key) - 1)
            state = np.where(v.arc_key[i] == key, v.arc_to[i], -1)
        on = state >= 0
        at, state = at[on], state[on]
        p = v.ends[state]
        hit = p >= 0
        starts.append(at[hit])
        sizes.append(np.full(int(hit.sum()), n, np.int32))
        ids.append(p[hit])
        if n == 1:
            spelled = np.ones(len(code), bool)
            spelled[at[hit]] = False
            bare = np.flatnonzero(spelled)
            starts.append(bare.astype(np.int32))
            sizes.append(np.ones(len(bare), np.int32))
            ids.append((-1 - code[bare]).astype(np.int32))
        if not len(at):
            break
    s, n, ids = (np.concatenate(x[::-1]) for x in (starts, sizes, ids))  # longest first: likely edges are passed to early
    order = np.argsort(s, kind="stable")  # runs that are sorted already
    s, n, ids = s[order], n[order], ids[order]
    cp = -1 - ids
    spelt = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
    score = np.where(ids >= 0, v.logp[np.maximum(ids, 0)], v.byte_logp * spelt)
    n_nodes = len(code) + len(units)
    beta = np.zeros(n_nodes)
    a = node[s]
    b, far = a + n, left[s]
    most = int(far.max()) if len(far) else 0
    order = np.argsort(far.astype(np.uint16) if most < 1 << 16 else far, kind="stable")  # nearest to the end first
    near_a, near_b, near_score = a[order], b[order], score[order]
    cuts = np.searchsorted(far[order], np.arange(1, most + 2))
    bounds = np.flatnonzero(np.concatenate(([True], near_a[1:] != near_a[:-1]))) if len(a) else np.zeros(0, np.int64)
    inner = np.searchsorted(bounds, cuts)
    for d in range(len(cuts) - 1):
        x, y = cuts[d], cuts[d + 1]
        if x < y:
            w = near_score[x:y] + beta[near_b[x:y]]
            g = bounds[inner[d] : inner[d + 1]] - x
            top = np.maximum.reduceat(w, g)
            beta[near_a[x + g]] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, np.diff(np.append(g, y - x)))), g))
    del near_a, near_b, near_score, order, bounds, far, cp, spelt
    log_prob = score + beta[b] - beta[a]
    first_edge = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=n_nodes))))
    total, more, edge = np.exp(log_prob), np.flatnonzero(np.diff(first_edge) > 1), 1
    degree = np.diff(first_edge)
    while len(more):
        at = first_edge[more] + edge
        total[at] = np.minimum(total[at] + total[at - 1], 1.0)
        edge += 1
        more = more[degree[more] > edge]
    total[first_edge[1:][degree > 0] - 1] = 1.0  # the last edge of a node takes what rounding leaves
    last = np.zeros(n_nodes, bool)
    last[stop + np.arange(len(units))] = True
    start = np.concatenate(([0], stop[:-1])) + np.arange(len(units)) if len(units) else np.zeros(0, np.int64)
    return Lattices(start, last, first_edge.astype(np.int32), a.astype(np.int32), b.astype(np.int32), ids, log_prob, total)


class Held:
    """Units by number, and their lattices, which grow with new units."""

    _KINDS = (("start", np.int32), ("last", bool), ("first_edge", np.int32), ("node", np.int32), ("to", np.int32), ("piece", np.int32), ("log_prob", np.float64), ("total", np.float64))

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self._clear()

    def _clear(self) -> None:
        self.known = Numbered()
        self.parts = {n: np.zeros(1, t) for n, t in self._KINDS}
        self.used = {n: 0 for n, _ in self._KINDS}
        self.seen = np.zeros(0, np.int64)

    def _add(self, units: list[bytes]) -> None:
        own = build([u.decode("utf-8", "surrogatepass") for u in units], self.v)
        nodes, edges = self.used["last"], self.used["node"]
        shift = {"start": nodes, "node": nodes, "to": nodes, "first_edge": edges}
        for n, _ in self._KINDS:
            x, at = getattr(own, n), nodes if n == "first_edge" else self.used[n]
            self.used[n] = at + len(x)
            self.parts[n] = longer(self.parts[n], self.used[n])
            self.parts[n][at : self.used[n]] = x + shift[n] if n in shift else x

    def _cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(UTF-8 of all texts, where in it units begin, units of each text)."""
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.v.letter[code]
        begins = np.ones(len(code), bool)
        begins[1:] = ~self.v.joined[letter[:-1], letter[1:]]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins[np.concatenate(([0], ends))[:-1][np.diff(np.concatenate(([0], ends))) > 0]] = True
        start = np.flatnonzero(begins)
        size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        n_units = np.diff(np.searchsorted(start, np.concatenate(([0], ends))))
        return whole.encode("utf-8", "surrogatepass"), (np.cumsum(size) - size)[start], n_units

    def numbers(self, texts: list[str]) -> tuple[Lattices, np.ndarray, np.ndarray]:
        """(lattices, number of each unit of all texts, units of each text)."""
        if self.used["node"] > HELD_EDGES:
            stay = [u for u, n in zip(self.known.known, self.seen.tolist(), strict=True) if n > 2][: HELD_EDGES // 64]
            self._clear()
            if stay:
                size = np.fromiter(map(len, stay), np.int64, len(stay))
                self._add(self.known.numbers(b"".join(stay), np.cumsum(size) - size, size)[1])
        data, start, n_units = self._cut(texts)
        of = np.zeros(0, np.int64)
        if data:
            of, new = self.known.numbers(data, start, np.diff(np.append(start, len(data))))
            if new:
                self._add(new)
        seen = np.bincount(of, minlength=len(self.known))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        return Lattices(**{n: self.parts[n][: self.used[n]] for n, _ in self._KINDS}), of, n_units


def walk(la: Lattices, at: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Let all walkers go from their nodes to their units' ends: (edges, walker of each), by walker in order of steps."""
    walkers, who, edges, whose, n = len(at), np.flatnonzero(~la.last[at]), [], [], 0
    at = at[who]
    while len(who):
        u = _uniform(key[who], place[who] + _U(n))
        e = la.first_edge[at]
        over = np.flatnonzero(la.total[e] < u)
        while len(over):
            e[over] += 1
            over = over[la.total[e[over]] < u[over]]
        edges.append(e)
        whose.append(who)
        at = la.to[e]
        on = ~la.last[at]
        at, who, n = at[on], who[on], n + 1
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps = np.bincount(np.concatenate(whose), minlength=walkers)
    begin, out = np.cumsum(steps) - steps, np.empty(int(steps.sum()), np.int32)
    for n, (e, who) in enumerate(zip(edges, whose, strict=True)):
        out[begin[who] + n] = e
    return out, np.repeat(np.arange(walkers), steps)


@dataclass
class Sample:
    """edges: the segmentation; log_prob: given the text; value: perturbed; inclusion: its probability to be among the k."""

    edges: np.ndarray
    log_prob: float
    value: float
    inclusion: float = 1.0


def sample_batch(texts: list[str], keys: list[int], v: Vocabulary, k: int = K, held: Held | None = None) -> tuple[Lattices, list[list[Sample]]]:
    """The k samples, best value first, of each (normalised) text; fewer where a text has fewer segmentations; none for ''."""
    la, units, n_units = (Held(v) if held is None else held).numbers(texts)
    from_unit = np.cumsum(n_units) - n_units
    out: list[list[Sample]] = [[] for _ in texts]
    key = np.array([x & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64)
    # per text: the queue of parts (value, sample, step, edges left out there), the paths so far with each edge's unit
    queue: list[list] = [[] for _ in texts]
    paths: list[list] = [[] for _ in texts]
    todo = np.flatnonzero(n_units)
    whole = -np.log(-np.log(_uniform(key, np.full(len(texts), (1 << 63) + 1, np.uint64))))
    none = np.zeros(0, np.int64)
    forced = {d: (none, none, 0, -1, float(whole[d]), ()) for d in todo.tolist()}  # prefix edges, their units, unit, node, value, left out
    for r in range(k):
        if not len(todo):
            break
        first_unit = np.array([forced[d][2] for d in todo.tolist()], np.int64)
        n = n_units[todo] - first_unit  # units that are walked
        upto = np.cumsum(n)
        unit = np.arange(int(upto[-1])) - np.repeat(upto - n, n) + np.repeat(first_unit, n)  # number in its text
        at = la.start[units[unit + np.repeat(from_unit[todo], n)]]
        if r:
            at[upto - n] = [forced[d][3] for d in todo.tolist()]
        e, w = walk(la, at, np.repeat(key[todo], n), (_U(r + 1) << _U(56)) | (unit.astype(np.uint64) << _U(20)))
        cuts = np.searchsorted(w, np.concatenate(([0], upto)))
        unit = unit[w]
        first, own_paths = np.zeros(len(todo), np.int64), []
        for j, d in enumerate(todo.tolist()):
            prefix, prefix_units, _, _, _, gone = forced[d]
            path, of_unit = e[cuts[j] : cuts[j + 1]], unit[cuts[j] : cuts[j + 1]]
            if len(prefix):
                path, of_unit = np.concatenate([prefix, path]), np.concatenate([prefix_units, of_unit])
                first[j] = len(prefix) - 1  # the forced piece's node may be split further
            paths[d].append((path, of_unit))
            own_paths.append(path)
        flat = np.concatenate(own_paths)
        lens = np.fromiter(map(len, own_paths), np.int64, len(own_paths))
        sums = np.add.reduceat(la.log_prob[flat], np.cumsum(lens) - lens)
        values = np.array([forced[d][4] for d in todo.tolist()])
        best, steps = _left_over(la, own_paths, flat, lens, first, [forced[d][5] for d in todo.tolist()], values, key[todo], r, k - r)
        for j, d in enumerate(todo.tolist()):
            path, gone = own_paths[j], forced[d][5]
            out[d].append(Sample(path, float(sums[j]), float(values[j])))
            for x, step in zip(best[j].tolist(), steps[j].tolist(), strict=True):
                if np.isfinite(x):
                    heapq.heappush(queue[d], (-x, r, step, (int(path[step]), *(gone if step == first[j] else ()))))
        if r + 1 == k:
            break
        todo = np.array([d for d in todo.tolist() if queue[d]], np.int64)
        for d in todo.tolist():
            neg, source, step, gone = heapq.heappop(queue[d])
            path, of_unit = paths[d][source]
            n = int(la.node[path[step]])
            choice = np.arange(la.first_edge[n], la.first_edge[n + 1])
            for x in gone:
                choice = choice[choice != x]
            c = np.cumsum(np.exp(la.log_prob[choice]))
            u = float(_uniform(key[d : d + 1], np.array([((r + 2) << 56) | (3 << 54) | step], np.uint64))[0])
            x = int(choice[min(int(np.searchsorted(c, u * c[-1])), len(choice) - 1)])
            forced[d] = (np.append(path[:step], x), of_unit[: step + 1], int(of_unit[step]), int(la.to[x]), -neg, gone)
    for d, own in enumerate(out):
        if queue[d]:
            threshold = -queue[d][0][0]
            for s in own:
                s.inclusion = float(-np.expm1(-np.exp(min(s.log_prob - threshold, 700.0))))
    return la, out


def _left_over(la: Lattices, paths: list[np.ndarray], flat: np.ndarray, lens: np.ndarray, first: np.ndarray, gone: list[tuple], value: np.ndarray, key: np.ndarray, r: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, steps) of the `most` best parts that each path splits off at its steps from `first` on; -inf where there are fewer.

    A value passes its part's log mass by less than 37, as no random number is below 2 ** -53; the mass never passes that
    of the path so far. So once `most` values are found, steps whose path has less mass than the least of these, less 37,
    are out of reach: a few dozen steps are looked at first, more only of paths that need them.
    """
    best, steps = np.full((len(paths), most), -np.inf), np.zeros((len(paths), most), np.int64)
    begin = np.cumsum(lens) - lens + first
    base = np.array([float(la.log_prob[p[:f]].sum()) if f else 0.0 for p, f in zip(paths, first.tolist(), strict=True)])
    left, n = np.arange(len(paths)), 128
    while len(left):
        width = int(min(n, (lens - first)[left].max()))
        step = np.arange(width)
        there = step < (lens - first)[left, None]
        own = flat[np.minimum(begin[left, None] + step, len(flat) - 1)]
        log_prob = np.where(there, la.log_prob[own], 0.0)
        run = np.cumsum(log_prob, axis=1)
        before = base[left, None] + np.concatenate([np.zeros((len(left), 1)), run[:, :-1]], axis=1)
        node = la.node[own]
        mass, others = -np.expm1(log_prob), la.first_edge[node + 1] - la.first_edge[node] - 1
        for j, x in enumerate(left.tolist()):
            if gone[x]:
                mass[j, 0] -= float(np.exp(la.log_prob[list(gone[x])]).sum())
                others[j, 0] -= len(gone[x])
        u = _uniform(np.repeat(key[left], width), ((_U(r + 1) << _U(56)) | (_U(1) << _U(55)) | (first[left, None] + step).astype(np.uint64)).ravel()).reshape(len(left), width)
        with np.errstate(divide="ignore", invalid="ignore"):
            phi = before + np.log(np.where(there & (others > 0), np.maximum(mass, 1e-18), 0.0))  # rounding must not lose the last pieces of a node
            values = np.where(np.isfinite(phi), phi - np.log(np.exp(np.minimum(phi - value[left, None], 700)) - np.log(u)), -np.inf)
        m = min(most, width)
        top = np.argpartition(-values, m - 1, axis=1)[:, :m]
        found = np.take_along_axis(values, top, axis=1)
        best[left, :m], steps[left, :m] = found, first[left, None] + top
        least = found.min(axis=1) if m == most else np.full(len(left), -np.inf)
        left = left[((lens - first)[left] > width) & (base[left] + run[:, -1] > least - 37.0)]
        n *= 4
    return best, steps


def ids_of(la: Lattices, edges: np.ndarray, lens: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids, ids of each segmentation) of segmentations back to back; characters without a piece become byte pieces."""
    p = la.piece[edges].astype(np.int64)
    bare = np.flatnonzero(p < 0)
    if not len(bare):
        return p, lens
    code = -1 - p[bare]
    sizes = np.ones(len(p), np.int64)
    sizes[bare] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    out = np.repeat(p, sizes)
    out[out < 0] = v.byte_id[np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass"), np.uint8)]
    upto = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(lens)))]
    return out, np.diff(upto)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _row_key(key, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(repr(key).encode(), seed=seed)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > HELD_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


#: What encode tells of every sample, without ids and what is kept.
SAMPLE = "doc_id long, sample int, n_pieces long, log_prob double, value double, inclusion double, ids_crc32 long, round_trip boolean"
_NAMES = tuple(c.split()[0] for c in SAMPLE.split(", "))


def _types(df: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in (df.select(*names).schema if names else ()))


def encode(docs: DataFrame, model: str, k: int = K, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """k distinct segmentations of every text: doc_id, sample (from 1, largest perturbed value first), n_pieces, log_prob
    (given the text), value (perturbed), inclusion (probability to be among the k, given the threshold), ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), round_trip (the ids decode to the text), if with_ids ids, and the
    columns to keep.

    model: path of a SentencePiece model that exists on every executor. A null or empty text has one sample without
    pieces; a text with fewer segmentations than k has fewer samples, each with inclusion 1. Repeated rows have equal
    samples, as the id seeds them. A literal ▁ reads as a space, which these models cannot tell apart. No rows, no rows.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)

    def part(names: list, plain: list[str], v: Vocabulary, held: Held) -> tuple[list[tuple], np.ndarray, list[int]]:
        texts = [v.normalised(t) for t in plain]
        la, found = sample_batch(texts, [_row_key(i, seed) for i in names], v, k, held)
        every = [(d, n, s) for d, own in enumerate(found) for n, s in enumerate(own or [Sample(np.zeros(0, np.int32), 0.0, 0.0)], 1)]
        edges = np.concatenate([s.edges for *_, s in every])
        ids, sizes = ids_of(la, edges, np.array([len(s.edges) for *_, s in every], np.int64), v)
        spelled, upto = v.spell(ids)
        ends = np.cumsum(sizes)
        begin, little, rows = ends - sizes, ids.astype("<u4"), []
        want = [t.encode("utf-8", "surrogatepass") for t in texts]
        for (d, n, s), x, y in zip(every, begin.tolist(), ends.tolist(), strict=True):
            told = spelled[upto[x] : upto[y]]
            same = told == want[d] or v.read(told) == plain[d].replace("▁", " ")
            rows.append((names[d], n, y - x, s.log_prob, s.value, s.inclusion, zlib.crc32(little[x:y]), same))
        return rows, little, [d for d, *_ in every]

    def make(c: dict, held: Held) -> dict:
        v, rows, ids, of = vocabulary(model), [], [], []
        for x, y in _parts(c["text"]):
            more, own, whose = part(c["doc_id"][x:y], c["text"][x:y], v, held)
            rows += more
            ids.append(own)
            of += [x + d for d in whose]
        out = dict(zip(_NAMES, zip(*rows, strict=True), strict=True)) | {n: [c[n][d] for d in of] for n in keep}
        if with_ids:
            ends = np.cumsum(np.array([0, *out["n_pieces"]]))
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).view("<i4")))
        return out

    return map_rows(own, make, SAMPLE + ", ids array<int>" * with_ids + _types(docs, keep), lambda: Held(vocabulary(model)))


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text", keep: tuple[str, ...] = ("doc_id", "sample")) -> DataFrame:
    """keep and the text of each row's ids; null ids give a null text, ids outside the vocabulary a replacement character
    where they stand."""
    bound_batches(rows.sparkSession)
    schema = f"{_types(rows, keep)}, `{out_col}` string".lstrip(", ")
    out, read = arrow_schema(schema), tuple(dict.fromkeys((*keep, ids_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            if b.num_rows:
                own = b.column(read.index(ids_col))
                spelled, upto = v.spell(pc.fill_null(own.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False))
                cuts = upto[np.cumsum([0, *pc.fill_null(pc.list_value_length(own), 0).to_pylist()])].tolist()
                texts = [v.read(spelled[x:y]) if there else None for x, y, there in zip(cuts, cuts[1:], own.is_valid().to_pylist(), strict=False)]
                kept = [b.column(i).cast(f.type) for i, f in enumerate(list(out)[:-1])]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], schema=out)

    return rows.select(*read).mapInArrow(run, schema)


def round_trips(docs: DataFrame, model: str, k: int = K, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode's rows with their ids, decoded anew from these: decoded_sha256 is the lower-case hex SHA-256 of the decoded
    text in UTF-8, and round_trip also tells whether it is that of the document's text (null: empty; a literal ▁: a space)."""
    plain = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("▁"), F.lit(" "))
    coded = encode(docs.select(id_col, text_col, F.sha2(plain, 256).alias("_sha256")), model, k, seed, id_col, text_col, keep=("_sha256",))
    told = decode(coded, model, out_col="_text", keep=(*_NAMES, "ids", "_sha256")).withColumn("decoded_sha256", F.sha2("_text", 256))
    return told.withColumn("round_trip", F.col("round_trip") & (F.col("decoded_sha256") == F.col("_sha256"))).drop("_sha256", "_text")
