"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read a clause word by word and are composed into one machine:

* insult: a word of the lexicon becomes a hit of its weight class;
* threat: a word of harm and a target within ``REACH`` words, in either order, become a hit;
* negation: a hit within ``REACH`` words after a negation becomes a negated hit;
* reported speech: a hit after a verb of saying, or inside quotation marks, becomes a
  reported hit;
* target: reads the hits off as weighted arcs, and adds an arc for a hit whose clause names
  a person before or after it.

The machine is deterministic, so a clause has one path; the clause's score is the weight of
that path, or 0 if that is negative.  Negation, report and target thus change what a hit is
worth: each combination is an arc of its own.  Clauses without a lexicon word or a word of
harm have no weighted arc and are not walked.  A document's score is the logistic of learnt
weights times the sum and the largest of its clauses' scores, and its length.

Learnt from labelled rows for which ``train`` holds, at most about ``train_rows`` of them,
chosen by a hash of the id: the lexicon (whole words and word beginnings, by the log ratio
of the shares of toxic and other texts that hold them, each distinct text once), the arcs'
weights (logistic regression on arc counts, drawn towards the weights of ``PRIOR``, so that
an arc that no label speaks of keeps those, and kept to the grammar's order: a hit weighs
something, a reported one less, a negated one next to nothing, and a target adds to it) and
the document's weights.  The lexicon holds
terms of ``MIN_TEXTS`` toxic texts and a share of ``MIN_SHARE`` of them at least, with a log
ratio of ``MIN_WEIGHT`` or more, and of these the ``max_terms`` that weigh most in all.
Everything else sees whole texts of all rows; the only data broadcast are the sampled
labels and the lexicon.

Null and empty texts score as a text without any hit.  A text of any length is read whole.
Rows of the same id each get their result; several labels of one id count as the largest.
Null labels and ids are not used.  Without training rows of both classes only the fixed
words and weights count.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, worker, written
from .langid import held_out

TRAIN_ROWS = 30_000
MAX_TERMS = 5_000
MIN_SHARE, MIN_TEXTS, MIN_WEIGHT = 0.005, 6, 2.5
THRESHOLD = 0.3
REACH = 3
_WORD = re.compile(r"[^\W\d_]+|[\"“”«»„]")
_CLAUSE = re.compile(r"[^.;!?\n|()]+")
_PREFIXES = (3, 4, 5, 6)

#: Fixed words of the grammar's classes, in English, German, French and Spanish.
TARGET = set("you your yours yourself he him his she her they them their this these those du dich dir dein deine sie ihr euch er ihn tu toi te ton ta tes vous votre il elle ils elles tú ti usted ustedes él ella ellos ellas".split())
HARM = set("kill hurt destroy beat shoot stab hang burn attack smash töten umbringen schlagen zerstören tuer frapper détruire brûler matar golpear destruir quemar".split())
NEGATION = set("not no never isn aren don doesn wasn nobody nicht kein keine keinen nie niemals niemand ne pas jamais personne nunca jamás tampoco nadie".split())
SAYING = set("said says say told called calls claims claimed wrote writes quoted reported according sagte sagt schrieb behauptet behauptete nannte laut dit disait écrit selon appelé dijo dice escribió según llamó".split())
INSULT = set("idiot moron stupid scum trash loser worthless pathetic disgusting dumm trottel idiota imbécile estúpido".split())
QUOTES = set('"“”«»„')

#: Lexical weights from which on a word is of the second, third and fourth class.
CLASSES = (3.5, 4.5, 6.0)
_FLAGS = ("", "n", "r", "nr")
#: Arcs that carry weight: hits of four classes and threats, each plain, negated, reported or
#: both, and the targets of plain and of negated hits.
ARCS = tuple(f"{kind}{flag}" for kind in ("0", "1", "2", "3", "X") for flag in _FLAGS) + ("target", "target-n")
#: What the arcs weigh before any label is seen.
_PLAIN = {"0": 1.0, "1": 1.4, "2": 1.8, "3": 2.2, "X": 2.0}
_LESS = {"": 1.0, "n": -0.1, "r": 0.5, "nr": -0.1}
PRIOR = np.asarray([_PLAIN[kind] * _LESS[flag] for kind in _PLAIN for flag in _FLAGS] + [0.5, 0.0])


# ------------------------------------------------------------------------- transducers


class Transducer:
    """States 0 .. n-1, start 0; ``step(state, symbol)`` gives the next state, a symbol and arcs."""

    def __init__(self, states: int, step: Callable[[int, str], tuple[int, str, tuple[str, ...]]]):
        self.states, self.step = states, step


def _insult(state, x):
    return 0, f"H{x[1:]}" if x[0] == "I" else x, ()


def _threat(state, x):
    # 1 .. REACH: a word of harm waits for a target; beyond: a target waits for a word of harm
    harm, target = 0 < state <= REACH, state > REACH
    if x == "T":
        return (0, "HX", ()) if target else (REACH, "o", ())
    if x == "Y":
        return (0, "HX", ()) if harm else (2 * REACH, "Y", ())
    return state - 1 if state not in (0, REACH + 1) else 0, x, ()


def _negation(state, x):
    if x == "N":
        return REACH, "o", ()
    return max(0, state - 1), x + "n" if x[0] == "H" and state else x, ()


def _reported(state, x):
    # bit 0: after a verb of saying, bit 1: inside quotation marks
    if x == "R":
        return state | 1, "o", ()
    if x == "Q":
        return state ^ 2, "o", ()
    return state, x + "r" if x[0] == "H" and state else x, ()


def _target(state, x):
    # 0: nothing yet, 1: a target was named, 2 and 3: a plain or a negated hit waits for one
    if x == "Y":
        return 1, "o", () if state < 2 else ("target",) if state == 2 else ("target-n",)
    if x[0] != "H":
        return state, "o", ()
    hit, negated = x[1:], "n" in x
    if state == 1 or hit[0] == "X":
        return 1, "o", (hit, "target-n" if negated else "target") if hit[0] != "X" else (hit,)
    return 2 if state == 2 or not negated else 3, "o", (hit,)


MACHINES = (Transducer(1, _insult), Transducer(2 * REACH + 1, _threat), Transducer(REACH + 1, _negation), Transducer(4, _reported), Transducer(4, _target))
SYMBOLS = ("I0", "I1", "I2", "I3", "T", "Y", "N", "R", "Q", "o")


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that feeds a's output to b; arcs add up."""

    def step(state, x):
        i, y, u = a.step(state // b.states, x)
        j, z, v = b.step(state % b.states, y)
        return i * b.states + j, z, u + v

    return Transducer(a.states * b.states, step)


def grammar() -> dict[tuple[int, str], tuple[int, tuple[int, ...]]]:
    """The composed machine as one table: (state, symbol) -> (state, numbers of the arcs)."""
    machine = MACHINES[0]
    for m in MACHINES[1:]:
        machine = compose(machine, m)
    number = {a: i for i, a in enumerate(ARCS)}
    out: dict = {}
    todo, known = [0], {0}
    while todo:
        s = todo.pop()
        for x in SYMBOLS:
            t, _, arcs = machine.step(s, x)
            out[s, x] = t, tuple(number[a] for a in arcs)
            if t not in known:
                known.add(t)
                todo.append(t)
    return out


class Matcher:
    """Paths of clauses by a lexicon: ``terms`` maps "=word" or "^beginning" to a weight."""

    def __init__(self, terms: dict[str, float]):
        import ahocorasick

        self.terms, self.table = terms, grammar()
        self.finder = ahocorasick.Automaton()
        for t in {t[1:] for t in terms} | HARM:
            self.finder.add_word(t, t)
        self.finder.make_automaton()
        self.classes = {w: "T" for w in HARM} | {w: "R" for w in SAYING} | {w: "N" for w in NEGATION} | {w: "Y" for w in TARGET} | {w: "Q" for w in QUOTES}

    def symbol(self, word: str) -> str:
        """I and the class of the heaviest term of the lexicon that a word matches, or a fixed word's symbol."""
        get = self.terms.get
        weight = max(get("=" + word, 0.0), *(get("^" + word[:n], 0.0) for n in _PREFIXES))
        return f"I{sum(weight >= c for c in CLASSES)}" if weight > 0 else self.classes.get(word, "o")

    def clause(self, text: str) -> np.ndarray:
        """How often the path of a clause takes each arc."""
        state, counts = 0, np.zeros(len(ARCS))
        for word in _WORD.findall(text):
            state, arcs = self.table[state, self.symbol(word)]
            for a in arcs:
                counts[a] += 1
        return counts

    def paths(self, text: str | None) -> np.ndarray:
        """Arc counts of the clauses with a hit, a row for each."""
        low = (text or "").lower()
        ends = [end for end, t in self.finder.iter(low) if end < len(t) or not low[end - len(t)].isalpha()]
        out, at = [], 0
        for m in _CLAUSE.finditer(low) if ends else ():
            while at < len(ends) and ends[at] < m.start():
                at += 1
            if at == len(ends):
                break
            if ends[at] < m.end():
                out.append(self.clause(m.group()))
        return np.asarray(out).reshape(len(out), len(ARCS))

    def features(self, text: str | None, arcs: np.ndarray) -> list[float]:
        """The sum (logarithm) and the largest of the clauses' scores, and the length (logarithm)."""
        scores = np.maximum(self.paths(text) @ arcs, 0.0)
        return [float(np.log1p(scores.sum())), float(scores.max(initial=0.0)), float(np.log1p(len(text or "")))]


# ---------------------------------------------------------------------------- learning


def word_terms(text: str) -> set[str]:
    """The distinct words of a text and their beginnings, as lexicon terms."""
    words = set(_WORD.findall(text.lower())) - QUOTES
    return {"=" + w for w in words} | {"^" + w[:n] for w in words for n in _PREFIXES if len(w) >= n}


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, n: in how many texts each term is."""

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(word_terms(text))
                if len(found) > 200_000:
                    yield sent()
                    found.clear()
        yield sent()

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(sample: DataFrame, n_toxic: int, n_other: int, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """Terms and weights from ``sample(text, toxic)``, whose texts are distinct."""
    if not n_toxic or not n_other:
        return {"=" + w: 3.0 for w in INSULT}
    least = max(MIN_TEXTS, int(MIN_SHARE * n_toxic))
    toxic = _term_counts(sample.filter("toxic = 1")).filter(F.col("n") >= least)
    both = toxic.join(_term_counts(sample.filter("toxic = 0")).withColumnRenamed("n", "m"), "term", "left")
    weight = F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.coalesce("m", F.lit(0)) + 0.5) / (n_other + 1))
    top = both.select("term", "n", weight.alias("w")).filter(F.col("w") >= MIN_WEIGHT).orderBy(F.desc(F.col("w") * F.col("n")), "term").limit(max_terms)
    weights = {r["term"]: r["w"] for r in top.collect()}
    # a beginning that weighs as much makes longer terms needless
    covered = lambda t: any(weights.get("^" + t[1 : 1 + n], 0.0) >= weights[t] - 0.5 for n in _PREFIXES if n < len(t) - (t[0] == "^"))
    return {t: w for t, w in weights.items() if not covered(t)}


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, ridge: float = 0.01, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant.

    With a prior, weights are drawn to it and every step is taken back ``in_order``.
    """
    x = np.column_stack([x, np.ones(len(x))])
    scale = np.ones(x.shape[1]) if prior is not None else np.maximum(np.abs(x).max(axis=0), 1e-9)
    start = np.append(prior, 0.0) if prior is not None else np.zeros(x.shape[1])
    x, w = x / scale, start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - start)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -5, 5)
        if prior is not None:
            w[:-1] = in_order(w[:-1])
    return w / scale


def in_order(arcs: np.ndarray) -> np.ndarray:
    """The nearest arc weights that keep to the grammar's order."""
    w = dict(zip(ARCS, arcs, strict=True))
    for kind, least in _PLAIN.items():
        plain = w[kind] = max(w[kind], 0.25 * least)
        w[kind + "r"] = min(max(w[kind + "r"], 0.0), 0.8 * plain)
        w[kind + "n"] = min(max(w[kind + "n"], -plain), 0.2 * w[kind + "r"])
        w[kind + "nr"] = min(max(w[kind + "nr"], -plain), w[kind + "n"])
    w["target"] = max(w["target"], 0.1)
    w["target-n"] = min(max(w["target-n"], 0.0), 0.2 * w["target"])
    return np.asarray([w[a] for a in ARCS])


def _mapped(rows: DataFrame, carry: list[str], values: Callable[[], Callable[[str | None], list[float]]]) -> DataFrame:
    """``carry`` columns and x, the numbers that ``values()`` gives for each text."""
    schema = rows.select(*carry).schema.add("x", T.ArrayType(T.DoubleType()))

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = values()
        for batch in batches:
            x = [of(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    return rows.select(*carry, "text").mapInArrow(run, schema)


def _labelled(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """x and labels, in one order whatever the tasks' order."""
    got = rows.toPandas()
    x, y = np.vstack(got["x"]), got["toxic"].to_numpy(np.float64)
    order = np.lexsort([*x.T, y])
    return x[order], y[order]


class Model:
    """Lexicon, weights of the arcs and of a document's features."""

    def __init__(self, terms: dict[str, float], arcs: np.ndarray = PRIOR, weights: np.ndarray | None = None):
        self.terms, self.arcs = terms, arcs
        self.weights = np.asarray([1.0, 0.5, 0.0, -2.0]) if weights is None else weights


def learn(docs: DataFrame, labels: DataFrame, train: Column, train_rows: int = TRAIN_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    small_batches(docs.sparkSession)
    marked = labels.filter(train & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marked.count()
    if n > train_rows:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * train_rows / n))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    sample = written(texts.select("text", "toxic", F.xxhash64("text").alias("h")).dropDuplicates(["h"]).drop("h"), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    terms = lexicon(sample, sizes.get(1, 0), sizes.get(0, 0), max_terms)
    if not sizes.get(1) or not sizes.get(0):
        return Model(terms)
    sent = sample.sparkSession.sparkContext.broadcast(terms)

    def counts() -> Callable[[str | None], list[float]]:
        paths = Matcher(sent.value).paths
        return lambda text: paths(text).sum(axis=0).tolist()

    arcs = fit(*_labelled(_mapped(sample, ["toxic"], counts)), PRIOR, ridge=1.0)[:-1]

    def features() -> Callable[[str | None], list[float]]:
        of = Matcher(sent.value).features
        return lambda text: of(text, arcs)

    return Model(terms, arcs, fit(*_labelled(_mapped(sample, ["toxic"], features))))


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``carry`` columns, score and predicted for every row of ``docs``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores() -> Callable[[str | None], list[float]]:
        given = sent.value
        of = Matcher(given.terms).features
        return lambda text: [float(1 / (1 + np.exp(-np.clip(of(text, given.arcs) @ given.weights[:-1] + given.weights[-1], -30, 30))))]

    found = _mapped(docs, carry, scores).withColumn("score", F.col("x")[0])
    return found.select(*carry, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def rate(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, max_terms: int = MAX_TERMS) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from the rows that are not held out."""
    model = learn(docs, labels, ~held_out(F.col("doc_id")), train_rows, max_terms)
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, ["doc_id", "held_out"])
