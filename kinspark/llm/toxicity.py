"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, clause end, other).
Small transducers rewrite the symbol string: reported speech and negation mark what stands in
their scope, the target transducer marks what is aimed at someone.  Their composition reads a
text once and puts out matched patterns (`insult:aimed`, `threat:negated`, ...) clause by
clause.  The insult lexicon (words and stems) and the weight of every pattern are learned from
labels; closed-class words are fixed lists.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, write_table

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED, STOP = "o", "insult", "threat", "target", "negation", "reported", "|"

# Closed-class words of the grammar, in English, French, German and Spanish.
CLOSED = {
    TARGET: "you your yours you're u ur they them he she tu toi te vous ton votre du dich dir ihr euch sie dein euer tú ti usted ustedes vosotros tus".split(),
    NEGATION: "not no never isn't aren't don't wasn't ne pas jamais nicht kein keine nie nunca ni jamás".split(),
    REPORTED: "said says wrote writes claimed quoted reported called dit écrit sagte schrieb behauptete dijo escribió según".split(),
    THREAT: "kill hurt destroy murder stab beat tuer frapper töten umbringen schlagen matar golpear".split(),
}

#: Combining marks, which belong to the word that they stand in.
_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Mc"))
#: Words of the closed classes that have an apostrophe stay whole; others end at it ("l'imbécile").
_WHOLE = "|".join(sorted((re.escape(w) for words in CLOSED.values() for w in words if "'" in w), key=len, reverse=True))
_CUT = re.compile(rf"(?:{_WHOLE})(?![^\W_])|[^\W_]+(?:[{_MARKS}]+[^\W_]*)*|[.!?;:\n]")


def cut(text: str) -> Iterator[str]:
    """The words (runs of letters and digits of any script) and clause ends of a text, for learning and scoring alike."""
    lowered = unicodedata.normalize("NFC", text.lower()).replace("\u2019", "'")
    return map(re.Match.group, _CUT.finditer(lowered))


@dataclass
class Transducer:
    """Deterministic: arcs[(state, symbol)] = (next state, output, weight); other symbols pass and keep the state."""

    arcs: dict[tuple, tuple]
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def scoped(opener: str, mark: str, reach: int, weight: float) -> Transducer:
    """After `opener`, insults and threats within `reach` symbols of the clause carry `mark`."""
    arcs: dict[tuple, tuple] = {}
    for left in range(reach + 1):
        arcs[left, opener] = (reach, OTHER, 0.0)
        arcs[left, STOP] = (0, STOP, 0.0)
        for symbol in (OTHER, TARGET, NEGATION, REPORTED):
            if symbol != opener:
                arcs[left, symbol] = (max(0, left - 1), symbol, 0.0)
        for symbol in (INSULT, THREAT, f"{INSULT}:negated", f"{THREAT}:negated", f"{INSULT}:reported", f"{THREAT}:reported"):
            out = f"{symbol.split(':')[0]}:{mark}" if left else symbol
            arcs[left, symbol] = (max(0, left - 1), out, weight if left else 0.0)
    return Transducer(arcs)


def aimed(reach: int, weight: float) -> Transducer:
    """Unmarked insults and threats within `reach` symbols after a target are aimed at it."""
    arcs: dict[tuple, tuple] = {}
    for left in range(reach + 1):
        arcs[left, TARGET] = (reach, OTHER, 0.0)
        arcs[left, STOP] = (0, STOP, 0.0)
        arcs[left, OTHER] = (max(0, left - 1), OTHER, 0.0)
        for symbol in (INSULT, THREAT):
            arcs[left, symbol] = (left, f"{symbol}:aimed" if left else symbol, weight if left else 0.0)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """first's output read by second; states are pairs, weights add."""
    arcs: dict[tuple, tuple] = {}
    start = (first.start, second.start)
    todo, seen = [start], {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            a, middle, v = first.step(state[0], symbol)
            b, out, w = second.step(state[1], middle)
            arcs[state, symbol] = ((a, b), out, v + w)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(arcs, start)


SYMBOLS = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED, STOP]
PATTERNS = [f"{a}{b}" for a in (INSULT, THREAT) for b in ("", ":aimed", ":negated", ":reported")]


def grammar() -> Transducer:
    """negation, then reported speech (which holds negations too), then target."""
    marked = compose(scoped(NEGATION, "negated", 3, -0.2), scoped(REPORTED, "reported", 12, -0.2), SYMBOLS)
    return compose(marked, aimed(4, 0.3), SYMBOLS)


@dataclass(frozen=True)
class Settings:
    """positives, negatives: about so many labelled rows of each kind are learned from."""

    positives: int = 3000
    negatives: int = 9000
    stem: tuple[int, int] = (4, 9)
    terms: int = 2000
    candidates: int = 30_000
    least: float = 0.002
    purity: float = 0.9
    false_cost: float = 5.0
    cache: int = 500_000
    seed: int = 3


@dataclass
class Lexicon:
    """Learned stems with weights, and the closed classes; word symbols are kept in a bounded table."""

    stems: dict[str, float]
    cache: int
    known: dict[str, tuple[str, float] | None] = field(default_factory=dict)

    def __post_init__(self):
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.closed = {w: kind for kind, words in CLOSED.items() for w in words}

    def __getstate__(self):
        return {"stems": self.stems, "cache": self.cache, "known": {}, "lengths": self.lengths, "closed": self.closed}

    def look(self, word: str) -> tuple[str, float] | None:
        for n in self.lengths:
            weight = self.stems.get(word[:n]) if len(word) >= n else None
            if weight is not None:
                return INSULT, weight
        kind = self.closed.get(word)
        return (kind, 1.0) if kind else None

    def any_match(self, words: set[str]) -> bool:
        """Does any word read as insult or threat?"""
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
            new = words
        for w in new:
            self.known[w] = self.look(w)
        return any(x is not None and x[0] in (INSULT, THREAT) for x in map(self.known.__getitem__, words))


def matched(text: str, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    """The best clause weight of each pattern in a text, whole, clause by clause."""
    best = np.zeros(len(PATTERNS))
    if not lexicon.any_match(set(cut(text))):
        return best
    state = machine.start
    for word in cut(text):
        found = (STOP, 0.0) if word in ".!?;:\n" else lexicon.look(word) or (OTHER, 0.0)
        state, out, weight = machine.step(state, found[0])
        if out in _PLACE:
            k = _PLACE[out]
            best[k] = max(best[k], found[1] + weight)
    return best


_PLACE = {p: k for k, p in enumerate(PATTERNS)}


def terms_of(text: str, stem: tuple[int, int]) -> set[str]:
    """Words and their stems."""
    words = set(cut(text)).difference(".!?;:\n")
    return {w[:n] for w in words for n in range(stem[0], min(stem[1], len(w)) + 1) if not w[:n].isdigit()} | {w for w in words if 3 <= len(w) < stem[0]}


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """A bounded share of labelled documents, by a hash of the id: (text, toxic)."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in labels.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    spin = F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(1 << 30))
    share = {k: int(min(1.0, most / max(1, n.get(k, 0))) * (1 << 30)) for k, most in ((0, settings.negatives), (1, settings.positives))}
    chosen = labels.where(spin <= F.when(F.col("toxic") > 0, share[1]).otherwise(share[0])).select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).alias("toxic"))
    return docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("_id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def learn_stems(rows: DataFrame, positives: int, negatives: int, settings: Settings) -> dict[str, float]:
    """Stems that mark the label: greedily those that explain most positives not yet explained.

    A term that merely accompanies an insult (as in copies of one text) explains nothing new
    once the insult is taken, and so is left out.
    """
    stem = settings.stem

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                seen[toxic.as_py()].update(terms_of(text.as_py(), stem))
            terms = list(seen[True].keys() | seen[False].keys())
            yield pa.RecordBatch.from_pydict({"term": terms, "pos": [seen[True][t] for t in terms], "neg": [seen[False][t] for t in terms]}, schema=pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    least = max(2, int(settings.least * positives))
    counts = rows.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = (F.col("pos") / positives) / (F.col("pos") / positives + F.col("neg") / max(1, negatives))
    good = counts.where((F.col("pos") >= least) & (rate >= settings.purity)).orderBy(F.desc("pos"), "term").limit(settings.candidates).collect()
    if not good:
        return {}
    number = {r["term"]: k for k, r in enumerate(good)}
    held = rows.sparkSession.sparkContext.broadcast(number)

    def postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                terms = terms_of(text.as_py(), stem)
                out.append(np.array(sorted(held.value[t] for t in terms if t in held.value), dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"terms": out}, schema=pa.schema([("terms", pa.binary())]))

    docs = [np.frombuffer(r["terms"], dtype=np.int32) for r in rows.where("toxic").mapInArrow(postings, "terms binary").collect()]
    by_term: list[list[int]] = [[] for _ in good]
    for i, terms in enumerate(docs):
        for t in terms.tolist():
            by_term[t].append(i)
    gain = np.array([len(x) for x in by_term])
    cost = np.array([settings.false_cost * r["neg"] * positives / max(1, negatives) for r in good])
    weight = {k: float(np.log((r["pos"] + 0.5) / (positives + 1)) - np.log((r["neg"] + 0.5) / (negatives + 1))) for k, r in enumerate(good)}
    open_ = np.ones(len(docs), dtype=bool)
    length = np.array([len(r["term"]) for r in good])
    stems: dict[str, float] = {}
    while len(stems) < settings.terms:
        net = gain - cost
        top = net.max()
        if top < least:
            break
        at = np.flatnonzero(net == top)
        k = int(at[length[at].argmax()])
        stems[good[k]["term"]] = weight[k]
        for i in by_term[k]:
            if open_[i]:
                open_[i] = False
                gain[docs[i]] -= 1
    return stems


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression with non-negative pattern weights, by damped Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from `labels` (doc_id, toxic); rows without a label teach nothing."""
    settings = settings or Settings()
    rows = write_table(sample(docs, labels, settings), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    positives, negatives = n.get(True, 0), n.get(False, 0)
    stems = learn_stems(rows, positives, negatives, settings) if positives else {}
    lexicon = Lexicon(stems, settings.cache)
    if not positives or not negatives:
        return Model(lexicon, np.ones(len(PATTERNS)), -4.0 if not positives else 0.0)
    machine = grammar()

    def patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matched(t.as_py(), lexicon, machine).tobytes() for t in batch.column("text")], pa.binary()), batch.column("toxic")], names=["x", "toxic"])

    got = rows.mapInArrow(patterns, "x binary, toxic boolean").collect()
    x = np.stack([np.frombuffer(r["x"], dtype=np.float64) for r in got])
    weights, bias = fit_weights(x, np.array([float(r["toxic"]) for r in got]))
    # patterns that the sample never showed weigh like the plain one (or it like the best other), marked ones in part
    for a in (INSULT, THREAT):
        plain = _PLACE[a]
        if not x[:, plain].any():
            weights[plain] = max(weights[_PLACE[a + b]] for b in (":aimed", ":negated", ":reported"))
        for b, factor in ((":aimed", 1.0), (":negated", 0.5), (":reported", 0.5)):
            if not x[:, _PLACE[a + b]].any():
                weights[_PLACE[a + b]] = factor * weights[plain]
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, score, patterns) for every row: a probability from the matched patterns of the whole text.

    Null and empty texts match nothing and get the score of that; repeated rows repeat it.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, machine = held.value, grammar()
        for batch in batches:
            scores, names = [], []
            for raw in byte_rows(batch, "body"):
                x = matched(raw.decode("utf-8", "replace"), m.lexicon, machine)
                scores.append(float(1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -30, 30)))))
                names.append([PATTERNS[k] for k in np.flatnonzero(x)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "score", "patterns"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, score double, patterns array<string>")
