"""Toxicity by a weighted finite-state pattern grammar.

Two lexicon transducers, of insults and of threats, read words letter by letter and write a symbol with a weight. What they
write is read by transducers of target, frame, negation and reported speech that are composed into one machine for each
direction: a clause is read forwards and backwards (a bimachine), so a target counts on either side of the word. An insult
matches if its clause aims at someone, has a frame (articles, copulas, prepositions and conjunctions, which tie it to what
else is said) or another insult; a threat matches only if it is aimed; both count little under negation or in reported
speech. A word by itself, or among words that nothing ties it to, matches nothing and scores nothing. A document's statistics are those of its matched clauses, and a logistic model turns
them into a score. Besides a fixed lexicon, the insult transducer has stems learned from labelled documents: prefixes and
words whose document counts differ significantly between the classes; they too count only inside a match.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows, stored, texts

# Lexicon: fixed values, by class, in four languages.
INSULT = "idiot idiots idiotic moron morons moronic stupid dumb scum trash loser losers pathetic worthless disgusting clown clowns imbecile filth vermin bastard jerk fool cretin dumm dummkopf idiotisch abschaum versager widerlich wertlos trottel depp arschloch mistkerl connard imbécile ordure minable dégoûtant abruti crétin salaud raclure nul idiota imbécil basura perdedor patético asqueroso payaso escoria inútil estúpido".split()
THREAT = "kill murder hurt destroy shoot stab strangle töten umbringen verletzen vernichten tuer frapper détruire égorger matar golpear destruir apuñalar".split()
TARGET = "you your yours yourself he she him her they them their these those people everyone du dich dir dein ihr euch er sie ihn ihnen alle tu te toi ton vous votre il elle ils elles eux leur tú usted ustedes vosotros él ella ellos ellas".split()
NEGATION = "not no never none nor neither without don't doesn't didn't isn't aren't wasn't won't can't cannot nicht nie kein keine keinen niemals ohne ne pas jamais aucun sans ni nunca ningún sin".split()
FRAME = "a an the is are was were be been being this that such what so as and or but of in to for with on at by from der die das den dem des ein eine einen einem einer ist sind war waren wird dieser diese dieses und oder aber von zu mit in auf für le la les un une des du est sont était ce cet cette quel quelle et ou mais de en dans que qui au aux par pour avec el los las una es son era este esta qué y o pero por para con del al".split()
REPORT = "said says say saying told tells called calls quoted quote reported alleged claimed writes wrote sagte sagt nannte nennt schrieb behauptet dit disait appelé appelle écrit prétend dijo dice llamó llama escribió afirma".split()

#: Labelled rows of each class that lexicon and model are learned from at most, by md5 of the id; weights restore the classes' shares.
MOST_PER_CLASS = 4000
#: Stems that the lexicon learns at most (the best by likelihood ratio: a bound of the model that every task holds, not of
#: rows), their lengths, and the least likelihood ratio and documents of a stem.
MOST_STEMS, STEM_LENGTHS, LEAST_G2, LEAST_DOCS = 2000, (4, 5, 6, 7), 16.0, 3
#: Words that a negation reaches.
NEGATION_SCOPE = 3
#: Words up to which sentences of a line are read as one clause if the first has one word only.
READ_ON = 6
_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@dataclass
class Transducer:
    """Deterministic weighted transducer: arcs (state, symbol) -> (symbol out, factor, next state); other symbols pass unchanged."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state: object, symbol: str) -> tuple[str, float, object]:
        out, factor, after = self.arcs.get((state, symbol)) or self.arcs.get((state, "*"), (symbol, 1.0, state))
        return (symbol if out == "*" else out), factor, after


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The machine that feeds what `first` writes to `second`; factors multiply. Only reachable states are built."""
    made, waiting = Transducer((first.start, second.start)), [(first.start, second.start)]
    seen = set(waiting)
    while waiting:
        p, q = waiting.pop()
        for s in symbols:
            out, f, p2 = first.step(p, s)
            out, g, q2 = second.step(q, out)
            made.arcs[(p, q), s] = (out, f * g, (p2, q2))
            if (p2, q2) not in seen:
                seen.add((p2, q2))
                waiting.append((p2, q2))
    return made


class Lexicon:
    """Transducer over letters: words and, ending in any letters, stems, each with a weight; what it writes at a word's end is its symbol."""

    def __init__(self, symbol: str, words: dict[str, float], stems: dict[str, float]) -> None:
        self.symbol, self.arcs, self.whole, self.begun = symbol, [{}], [0.0], [0.0]
        for own, out in ((words, self.whole), (stems, self.begun)):
            for word, weight in own.items():
                at = self._state(word)
                out[at] = max(out[at], weight)

    def _state(self, word: str) -> int:
        at = 0
        for c in word:
            if c not in self.arcs[at]:
                self.arcs[at][c] = len(self.arcs)
                self.arcs.append({})
                self.whole.append(0.0)
                self.begun.append(0.0)
            at = self.arcs[at][c]
        return at

    def read(self, word: str) -> float:
        """The word's weight; 0 if the transducer does not accept it."""
        at, best = 0, 0.0
        for c in word:
            at = self.arcs[at].get(c, -1)
            if at < 0:
                return best
            best = max(best, self.begun[at])
        return max(best, self.whole[at])


#: Symbols: Insult, threat (K), Target, Frame, Negation, Report, other; lower case once directed at a target.
SYMBOLS = "IKTFNRo"
#: What an insult counts if aimed, behind a frame, before one or beside another insult; a threat counts if aimed.
AIMED, FRAMED, BESIDE, NEGATED, TOLD = 1.5, 1.0, 0.8, 0.15, 0.25


def _direction(framed: float) -> Transducer:
    """target: insults count by what was read before them in the clause, threats only behind a target."""
    out = Transducer("open", {("open", "I"): ("I", 0.0, "beside"), ("open", "K"): ("K", 0.0, "open")})
    for state, factor in (("beside", BESIDE), ("framed", framed)):
        out.arcs |= {(state, "I"): ("I", factor, state), (state, "K"): ("K", 0.0, state)}
    for state in ("open", "beside", "framed"):
        out.arcs |= {(state, "T"): ("T", 1.0, "aimed"), (state, "F"): ("F", 1.0, "framed")}
    return Transducer("open", out.arcs | {("aimed", s): (s.lower(), AIMED, "aimed") for s in "IK"})


def grammar() -> tuple[Transducer, Transducer, Transducer]:
    """(scope: negation o report, target read forwards, target read backwards); negation and report reach what follows them."""
    negation, n = Transducer(0), NEGATION_SCOPE
    for k in range(n + 1):
        negation.arcs[k, "N"] = ("N", 1.0, n)
        for s in "IK":
            negation.arcs[k, s] = (s, NEGATED if k else 1.0, max(0, k - 1))
        negation.arcs[k, "*"] = ("*", 1.0, max(0, k - 1))
    report = Transducer("own", {("own", "R"): ("R", 1.0, "told")} | {("told", s): (s, TOLD, "told") for s in "IK"})
    scope = compose(negation, report, SYMBOLS)
    return scope, _direction(FRAMED), _direction(BESIDE)


_CLASS = {w: s for s, ws in (("F", FRAME), ("R", REPORT), ("N", NEGATION), ("T", TARGET)) for w in ws}


class Scorer:
    """Matches clauses of a text; stems: learned {prefix or word$: weight}."""

    def __init__(self, stems: dict[str, float]) -> None:
        import ahocorasick

        self.stems = stems
        scope, forwards, backwards = grammar()
        self.forwards, self.backwards, self.scope = compose(scope, forwards, SYMBOLS), backwards, scope
        self.insult = Lexicon("I", dict.fromkeys(INSULT, 1.0) | {s[:-1]: w for s, w in stems.items() if s.endswith("$") and s[:-1] not in INSULT}, {s: w for s, w in stems.items() if not s.endswith("$")})
        self.threat = Lexicon("K", dict.fromkeys(THREAT, 1.0), {})
        self.finder = ahocorasick.Automaton()
        for w in {*INSULT, *THREAT, *(s.rstrip("$") for s in stems)}:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        """What the lexicon transducers write for a word, and its weight."""
        if weight := self.threat.read(word):
            return "K", weight
        if word in _CLASS:
            return _CLASS[word], 1.0
        weight = self.insult.read(word)
        return ("I", weight) if weight else ("o", 1.0)

    def clause(self, words: list[str]) -> tuple[float, float, float]:
        """What the grammar matches in a clause: score, matches, matches with a target."""
        read = [self.symbol(w) for w in words]
        state, back = self.backwards.start, [0.0] * len(read)
        aimed_back = [False] * len(read)
        for i in range(len(read) - 1, -1, -1):
            out, back[i], state = self.backwards.step(state, read[i][0])
            aimed_back[i] = out.islower()
        state, scope, score, n, aimed = self.forwards.start, self.scope.start, 0.0, 0, 0
        for i, (symbol, weight) in enumerate(read):
            out, factor, state = self.forwards.step(state, symbol)
            _, reach, scope = self.scope.step(scope, symbol)
            if symbol in "IK":
                value = weight * max(factor, reach * back[i])
                score, n, aimed = score + value, n + (value > 0), aimed + (value > 0 and (out.islower() or aimed_back[i]))
        return score, n, aimed

    def matches(self, text: str) -> Iterator[tuple[int, int, float, int, int]]:
        """(begin, end, score, matches, aimed) of each clause, in the lower-cased text, that the grammar matches."""
        low, done = text.lower(), -1
        for end, size in self.finder.iter(low):
            begin = end - size + 1
            if begin < done or (begin and low[begin - 1].isalpha()):
                continue
            cut = _CLAUSE.search(low, end + 1)
            after = cut.start() if cut else len(low)
            before = max(done, 0, *(low.rfind(c, max(done, 0), begin) + 1 for c in ".!?;\n"))
            words = _WORD.findall(low, before, after)
            shouted = len(words) < 2  # one word is no clause: read on
            while shouted and len(words) < READ_ON and cut and "\n" not in cut.group():
                begun, cut = cut.end(), _CLAUSE.search(low, cut.end())
                after = cut.start() if cut else len(low)
                words += _WORD.findall(low, begun, after)
            score, n, aimed = self.clause(words)
            done = after
            if n:
                yield before, after, score, n, aimed

    def features(self, text: str) -> list[float]:
        """Statistics of the matched clauses; all 0 for a text that the grammar does not match."""
        found = list(self.matches(text))
        if not found:
            return [0.0] * N_FEATURES
        total, n, words = sum(m[2] for m in found), sum(m[3] for m in found), 1 + text.count(" ") + text.count("\n")
        return [1.0, math.log1p(total), math.log1p(n), math.log1p(100 * total / words), max(m[2] for m in found), math.log1p(sum(m[4] for m in found)), math.log1p(len(found)), math.log1p(words) / 10]


N_FEATURES = 8
_SCORERS: dict[tuple, Scorer] = {}


def _scorer(stems: dict[str, float]) -> Scorer:
    key = tuple(sorted(stems.items()))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(stems)
    return _SCORERS[key]


@dataclass
class Model:
    """stems: learned lexicon; weights: intercept, then one for each feature."""

    stems: dict[str, float]
    weights: list[float]

    def scores(self, batch: list[str]) -> np.ndarray:
        own = _scorer(self.stems)
        x = np.array([own.features(t) for t in batch]).reshape(-1, N_FEATURES)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Ridge logistic regression by Newton steps; the intercept is not penalised."""
    x = np.hstack([np.ones((len(x), 1)), x])
    keep, b = np.diag([1e-6] + [ridge] * (x.shape[1] - 1)), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(b)), x.T @ (w * (y - p)) - keep @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def sample(labels: DataFrame, label_col: str, learn: Column, id_col: str = "doc_id", most: int = MOST_PER_CLASS) -> DataFrame:
    """doc_id, y, w: at most `most` labelled ids of each class for which `learn` holds, and the rows that each stands for.

    Null labels and ids are left out; of repeated ids the larger label counts.
    """
    own = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    mark = F.md5(F.col("doc_id").cast("string"))
    parts = [own.filter(F.col("y") == y).orderBy(mark, "doc_id").limit(most).withColumn("w", F.lit(max(1.0, n / most))) for y, n in sorted(counts.items())]
    out = parts[0] if parts else own.withColumn("w", F.lit(1.0))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def learn_stems(rows: DataFrame, most: int = MOST_STEMS) -> dict[str, float]:
    """rows: text, y. Prefixes and words whose documents are toxic significantly more often, with weights of 0.2 to 1.5."""
    both = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = both.get(1, 0), both.get(0, 0)
    if not (n1 and n0):
        return {}

    def make(c: dict) -> dict:
        counts = Counter(), Counter()
        for text, y in zip(c["text"], c["y"], strict=True):
            words = set(_WORD.findall(text.lower()))
            counts[y].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n} | {w + "$" for w in words})
        terms = list(counts[0].keys() | counts[1].keys())
        return {"term": terms, "a": [counts[1][t] for t in terms], "b": [counts[0][t] for t in terms]}

    terms = stored(map_rows(rows.select("text", "y"), make, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "stems")
    least = max(LEAST_G2, 2 * math.log(max(1, terms.count())))
    a, b, n = F.col("a"), F.col("b"), n1 + n0
    part = lambda k, of, share: F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)
    g2 = 2 * (part(a, a + b, n1 / n) + part(b, a + b, n0 / n) + part(n1 - a, n - a - b, n1 / n) + part(n0 - b, n - a - b, n0 / n))
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    found = terms.filter((a >= LEAST_DOCS) & (a * n0 > b * n1)).select("term", g2.alias("g2"), odds.alias("odds")).filter((F.col("g2") >= least) & (F.col("odds") >= 1.5))
    chosen: dict[str, float] = {}
    for r in sorted(found.orderBy(F.desc("g2"), "term").limit(most).collect(), key=lambda r: (len(r.term.rstrip("$")), r.term)):
        word, weight = r.term.rstrip("$"), min(1.5, max(0.2, r.odds / 5))
        if not any(chosen.get(word[:n], 0) >= weight - 0.05 for n in STEM_LENGTHS if n <= len(word)):
            chosen[r.term] = weight
    return chosen


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PER_CLASS) -> Model:
    """Learn lexicon and weights from labelled documents (2 * most rows at most, a broadcast of that bound).

    Without labels of both classes the lexicon is the fixed one and any clear match scores above one half.
    """
    bound_batches(docs.sparkSession)
    chosen = sample(labels, label_col, F.lit(True) if learn is None else learn, id_col, most)
    rows = stored(texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "y", "w"), "toxicity-sample")
    stems = learn_stems(rows)

    def make(c: dict) -> dict:
        own = _scorer(stems)
        return {"x": [own.features(t) for t in c["text"]], "y": c["y"], "w": c["w"]}

    seen = map_rows(rows, make, "x array<double>, y int, w double").toArrow()
    y = np.array(seen.column("y").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        return Model(stems, [-3.0, 2.5, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    return Model(stems, logistic(np.array(seen.column("x").to_pylist()), y, np.array(seen.column("w").to_pylist())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row; a null or empty text has the score of a text without a match.

    Repeated rows have equal scores; texts are read whole, however long; an empty table gives no rows. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def make(c: dict) -> dict:
        s = model.scores(c["text"])
        return {"doc_id": c["doc_id"], "score": s, "predicted": (s >= 0.5).astype(int)}

    return map_rows(texts(docs, id_col, text_col), make, "doc_id long, score double, predicted int")


def clauses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin, end (code points of the lower-cased text), score, matches, aimed of each matched clause."""
    bound_batches(docs.sparkSession)

    def make(c: dict) -> dict:
        own = _scorer(model.stems)
        rows = [(i, *m) for i, t in zip(c["doc_id"], c["text"], strict=True) for m in own.matches(t)]
        return dict(zip(("doc_id", "begin", "end", "score", "matches", "aimed"), zip(*rows, strict=True) if rows else [[]] * 6, strict=True))

    return map_rows(texts(docs, id_col, text_col), make, "doc_id long, begin long, end long, score double, matches int, aimed int")
