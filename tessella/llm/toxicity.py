"""Toxicity by a weighted finite-state pattern grammar.

Words map to symbols: insult (a lexicon with weights), threat, target, negation, report, other. Five transducers read a
clause's symbols: insults give a hit; a threat gives one at a target within reach; targets, negations and reported speech
mark the hits that follow them. ``compose`` makes one machine of them, a table of states, and a clause is scored by one
walk through it: each hit counts its word's weight times the factors of its marks. A document's score comes from its
matched clauses, with a learned weight for each kind of hit.

The insult lexicon, of words and word beginnings, and the weights are learned from labelled rows: a bounded, hashed
sample of at most SAMPLE rows outside the held-out fold. Weights of kinds that the sample does not show stay at PRIOR.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, map_texts

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
#: Toxic rows that must have a term, and the evidence (nats, n times the log of its rate over the base rate) it needs.
SUPPORT = 4
EVIDENCE = 8.0
#: Log odds that a term must have.
ODDS = 2.5
#: Lengths of word beginnings that may be a term.
STEMS = (4, 5)
#: Words that a negation, and a target, reaches.
REACH = 3
THRESHOLD = 0.3

#: The grammar's closed word classes, in English, German, French and Spanish.
THREAT = frozenset(
    "kill hurt destroy punch stab shoot beat strangle töten schlagen umbringen verprügeln erschießen tuer tuerai frapper frapperai cogner "
    "matar mataré golpear golpearé".split()
)
TARGET = frozenset("you your yours yourself he she they them him her du dich dir dein ihr euch sie tu te toi vous votre usted ustedes ellos él ella".split())
NEGATION = frozenset("not never no nobody without isn aren wasn weren don doesn didn won nicht kein keine keiner nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split())
REPORT = frozenset("said says say called calls wrote writes quoted claimed alleged sagte sagt schrieb nannte behauptete dit écrit déclaré appelé dijo dice escribió llamó".split())

WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;\n]+")

OTHER, INSULT, THREATEN, AIM, NEGATE, TELL = SYMBOLS = range(6)
#: What a machine gives out with a word: a hit by insult or by threat, and the marks on it.
HIT, MENACE, AIMED, NEGATED, TOLD = (1 << i for i in range(5))
#: What a mark does to a hit's weight, and the weight of a threat.
FACTOR = {AIMED: 1.25, NEGATED: 0.25, TOLD: 0.6}
THREAT_WEIGHT = 2.0
#: Weights of a document's features before any row is seen: bias, sum, clauses, largest, and hits that are aimed, negated, told, threats.
PRIOR = (-5.0, 0.0, 0.0, 0.0, 0.5, -1.0, -0.5, 1.0)


@dataclass(frozen=True)
class Transducer:
    """Rows by state, columns by symbol: the next state, and what is given out; the start state is 0."""

    next: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]


def _row(usual: int, **other: int) -> tuple[int, ...]:
    """A row of a table: ``usual`` but for the named symbols."""
    named = {globals()[k]: v for k, v in other.items()}
    return tuple(named.get(s, usual) for s in SYMBOLS)


def insults() -> Transducer:
    """A hit at each insult."""
    return Transducer((_row(0),), (_row(0, INSULT=HIT),))


def threats(reach: int = REACH) -> Transducer:
    """A hit at the first target within ``reach`` + 1 words after a threat."""
    armed = range(reach + 2)
    return Transducer(tuple(_row(max(0, s - 1), THREATEN=reach + 1, AIM=0) for s in armed), tuple(_row(0, AIM=MENACE if s else 0) for s in armed))


def marks(trigger: str, mark: int, reach: int = REACH) -> Transducer:
    """The mark on the ``reach`` words after a trigger."""
    left = range(reach + 1)
    return Transducer(tuple(_row(max(0, s - 1), **{trigger: reach}) for s in left), tuple(_row(mark if s else 0, **{trigger: 0}) for s in left))


def told() -> Transducer:
    """The mark from a word of speech to the end of the clause."""
    return Transducer((_row(0, TELL=1), _row(1)), (_row(0), _row(TOLD)))


def compose(parts: Sequence[Transducer]) -> Transducer:
    """One machine that walks all parts in step and gives out what they give; the states that can be reached."""
    states, todo = {(0,) * len(parts): 0}, [(0,) * len(parts)]
    after, out = [], []
    for now in todo:
        row, given = [], []
        for symbol in SYMBOLS:
            then = tuple(p.next[s][symbol] for p, s in zip(parts, now))
            if then not in states:
                states[then] = len(states)
                todo.append(then)
            row.append(states[then])
            given.append(sum(p.out[s][symbol] for p, s in zip(parts, now)))
        after.append(tuple(row))
        out.append(tuple(given))
    return Transducer(tuple(after), tuple(out))


#: The grammar's parts by name, and all of them as one machine.
PARTS = {"insult": insults(), "threat": threats(), "target": marks("AIM", AIMED), "negation": marks("NEGATE", NEGATED), "report": told()}
MACHINE = compose(list(PARTS.values()))


def hits(symbols: list[tuple[int, float]], machine: Transducer = MACHINE) -> list[tuple[int, float]]:
    """``(what, weight)`` of each hit of a clause, from ``(symbol, weight)`` of its words."""
    state, found = 0, []
    for symbol, weight in symbols:
        given = machine.out[state][symbol]
        state = machine.next[state][symbol]
        if given & (HIT | MENACE):
            scale = math.prod(f for m, f in FACTOR.items() if given & m)
            found.append((given, ((weight if given & HIT else 0.0) + (THREAT_WEIGHT if given & MENACE else 0.0)) * scale))
    return found


def clause_score(symbols: list[tuple[int, float]], machine: Transducer = MACHINE) -> float:
    """Weight of a clause."""
    return sum(w for _, w in hits(symbols, machine))


@dataclass
class Grammar:
    """A lexicon, the machine, and the weights of a document's features."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = PRIOR
    machine: Transducer = MACHINE

    def __post_init__(self) -> None:
        self._finder, self._seen = None, {}

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "weights": self.weights, "machine": self.machine, "_finder": None, "_seen": {}}

    @property
    def finder(self):
        """An automaton of all that can give a hit, to skip clauses without any."""
        if self._finder is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for w in {t.rstrip("*") for t in self.lexicon} | THREAT:
                found.add_word(w, len(w))
            found.make_automaton()
            self._finder = found
        return self._finder

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol, and an insult's weight."""
        found = self._seen.get(word)
        if found is None:
            best = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)
            classes = ((THREAT, THREATEN), (TARGET, AIM), (NEGATION, NEGATE), (REPORT, TELL))
            found = (INSULT, best) if best > 0 else (next((s for words, s in classes if word in words), OTHER), 0.0)
            if len(self._seen) >= 1 << 16:
                self._seen.clear()
            self._seen[word] = found
        return found

    def clauses(self, text: str | None) -> Iterator[list[tuple[int, float]]]:
        """Hits of each clause that has any, in one pass: nothing is read again but the rest of a clause."""
        low = (text or "").lower()
        done = -1
        for last, n in self.finder.iter(low):
            start = last - n + 1
            if last <= done or (start and (low[start - 1].isalnum() or low[start - 1] == "_")):
                continue
            begin = max(max(low.rfind(c, done + 1, start) for c in ".!?;\n"), done) + 1
            end = CLAUSE.search(low, last)
            done = end.start() if end else len(low)
            if found := hits([self.symbol(w.group()) for w in WORD.finditer(low, begin, done)], self.machine):
                yield found

    def features(self, text: str | None) -> tuple[float, ...]:
        """Of the matched clauses: log of the sum and of the number, the largest score; log of the weight by mark and of threats."""
        scores, by = [], defaultdict(float)
        for found in self.clauses(text):
            scores.append(sum(w for _, w in found))
            for given, weight in found:
                for mark in (AIMED, NEGATED, TOLD, MENACE):
                    by[mark] += weight if given & mark else 0.0
        return math.log1p(sum(scores)), math.log1p(len(scores)), max(scores, default=0.0), *(math.log1p(by[m]) for m in (AIMED, NEGATED, TOLD, MENACE))

    def score(self, text: str | None) -> float:
        """0 to 1."""
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, z))))


def terms_of(word: str) -> list[str]:
    """A word and those of its beginnings that can be a term, marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, toxic)`` of the labelled rows to learn from: at most SAMPLE, chosen by a hash of the id.

    A document labelled more than once counts as toxic if any label says so; null labels and ids are left out.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("toxic")).limit(SAMPLE)
    once = chosen.groupBy(F.col("doc_id").alias("label_of")).agg(F.max("toxic").alias("toxic"))
    # The sample is bounded, so it goes to the tasks and the documents are read without a shuffle.
    return docs.select("doc_id", "text").join(F.broadcast(once), F.col("doc_id") == F.col("label_of")).select("text", "toxic")


def learn(rows: DataFrame) -> Grammar:
    """Lexicon and calibration from ``(text, toxic)``. Without both labels there is no lexicon and scores are constant."""
    n1, n = rows.agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    n0 = n - n1
    base = math.log((n1 + 0.5) / (n0 + 0.5))
    if not n1 or not n0:
        return Grammar({}, (base if n else PRIOR[0], *[0.0] * (len(PRIOR) - 1)))
    bounded_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for term in {x for w in set(WORD.findall((t or "").lower())) for x in terms_of(w)}:
                    seen[term][y > 0] += 1
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[w][1] for w in names], pa.int64()), pa.array([seen[w][0] for w in names], pa.int64())], ["term", "bad", "good"])

    counted = rows.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n1 + 1.0)) - F.log((F.col("good") + 0.5) / (n0 + 1.0))
    evidence = F.col("bad") * F.log(F.col("bad") / (F.col("bad") + F.col("good")) * (n / n1))
    best = (
        counted.where(F.col("bad") >= SUPPORT)
        .select("term", odds.alias("odds"), evidence.alias("evidence"))
        .where((F.col("odds") >= ODDS) & (F.col("evidence") >= EVIDENCE))
    )
    # Bounded by the terms of the sample's toxic rows.
    lexicon = {r.term: min(float(r.odds), 6.0) for r in sorted(best.collect())}
    grammar = Grammar(lexicon)
    held = rows.sparkSession.sparkContext.broadcast(grammar)

    names = [f"x{i}" for i in range(len(PRIOR) - 1)]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [held.value.features(t) for t in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in zip(*x)), pa.array([int(v > 0) for v in b.column(1).to_pylist()], pa.int32())], [*names, "y"])

    got = map_texts(rows, run, ", ".join(f"{x} double" for x in names) + ", y int", 0).toArrow().to_pandas().sort_values([*names, "y"])
    return Grammar(lexicon, logistic(got[names].to_numpy(), got["y"].to_numpy(float), PRIOR[1:]))


def logistic(x: np.ndarray, y: np.ndarray, prior: Sequence[float], ridge: float = 1.0) -> tuple[float, ...]:
    """Bias and weights by Newton's method; the penalty draws the weights to the prior and spares the bias."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    centre = np.array([0.0, *prior])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ (w - centre))
        w += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``(doc_id, score)`` of every row, from its text only; null and empty texts have the score of no match."""
    rows = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        score = [held.value.score(t) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double", 1)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    found = scored(docs, learn(sample(docs, labels)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not predicted toxic, all their columns, whatever their names; null and empty texts stay.

    Rows with equal or null ids are rows like others; without labels of both kinds all rows stay.
    """
    grammar = learn(sample(docs, labels))
    held = docs.sparkSession.sparkContext.broadcast(grammar)
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([held.value.score(t) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return map_texts(docs, run, docs.schema, at)
