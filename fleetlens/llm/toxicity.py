"""Toxicity as a weighted finite-state grammar over clauses.

Words get a role: insult (learned from labelled rows), threat, target, negation, report verb or other. Four
transducers read the roles of a clause from left to right: negation marks offences that follow a negation, reported
speech those that follow a report verb, target those near a person; the last one turns each marked offence into an
outcome. Their composition is a single deterministic machine. A document's score is a logistic function of
how often each outcome occurs, with outcome weights fitted to labelled rows.

Null or empty text has no outcome and gets the score of a text without offences. Clauses end at . ! ? ; : , | and
line ends. Without labels the prior weights and no learned insults remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import HashTable, bounded_labels, fold, plain_texts, slices, utf8, word_hash, word_prefixes, words, written

#: At most so many labelled rows are used for training (the bound that makes them small enough to broadcast).
TRAIN_ROWS = 20_000
#: A word is an insult if labels and word depend on each other at least so much (log-likelihood ratio) ...
LEXICON_EVIDENCE = 22.0
#: ... and it is so many times likelier in toxic documents; the strongest words are kept up to a bound.
LEXICON_RATIO = 25.0
LEXICON_WORDS = 4_096
#: Besides whole words, stems of so many letters are compared, as insults are inflected.
STEMS = (4, 5, 6)
#: Score from which a document counts as toxic.
THRESHOLD = 0.7

# Closed word classes of the four languages.
NEGATIONS = "not no never nor cannot nicht kein keine nie niemals pas jamais aucun aucune ne nunca ni tampoco jamás".split()
REPORTS = "said says called wrote quoted claims reportedly sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
TARGETS = "you your yours he she they him them du dich dir ihr euch tu toi vous te tú usted ustedes él ella ellos".split()
THREATS = "kill hurt destroy shoot stab burn töten verletzen tuer détruire matar destruir herir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: How many words after a negation, report verb or target an offence still belongs to it.
REACH = {NEGATION: 3, REPORT: 8, TARGET: 3}
#: Outcomes: kind (insult, threat) x negated x reported x targeted.
OUTCOMES = 16
_BREAK = np.isin(np.arange(256), np.frombuffer(b".!?;:,|\n\r", np.uint8))

Symbol = tuple[int, frozenset[str]]


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter transducer: arcs[state][symbol] = (next state, output symbol)."""

    arcs: tuple[dict[Symbol, tuple[int, Symbol]], ...]

    def run(self, symbols: Iterable[Symbol]) -> list[Symbol]:
        state, out = 0, []
        for symbol in symbols:
            state, mapped = self.arcs[state][symbol]
            out.append(mapped)
        return out


def marker(trigger: int, mark: str, alphabet: set[Symbol]) -> Transducer:
    """Marks offences at most REACH words after a trigger; the state counts the words left."""
    reach = REACH[trigger]
    arcs = []
    for left in range(reach + 1):
        row = {}
        for role, marks in alphabet:
            offence = role in (INSULT, THREAT)
            after = reach if role == trigger else max(left - 1, 0)
            row[(role, marks)] = (after, (role, marks | {mark} if offence and left else marks))
        arcs.append(row)
    return Transducer(tuple(arcs))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what `first` writes to `second`; only reachable pairs of states are kept."""
    numbers, queue, arcs = {(0, 0): 0}, [(0, 0)], []
    for a, b in queue:
        row = {}
        for symbol, (a_next, middle) in first.arcs[a].items():
            b_next, out = second.arcs[b][middle]
            pair = (a_next, b_next)
            if pair not in numbers:
                numbers[pair] = len(numbers)
                queue.append(pair)
            row[symbol] = (numbers[pair], out)
        arcs.append(row)
    return Transducer(tuple(arcs))


def grammar() -> Transducer:
    """Negation, then reported speech, then target, composed."""
    roles = range(6)
    marks: list[frozenset[str]] = [frozenset()]
    machine: Transducer | None = None
    for trigger, mark in ((NEGATION, "negated"), (REPORT, "reported"), (TARGET, "targeted")):
        alphabet = {(role, m) for role in roles for m in marks}
        step = marker(trigger, mark, alphabet)
        machine = step if machine is None else compose(machine, step)
        marks = marks + [m | {mark} for m in marks]
    assert machine is not None
    return machine


def outcome(symbol: Symbol) -> int:
    """Number of an offence's outcome; -1 for other words."""
    role, marks = symbol
    if role not in (INSULT, THREAT):
        return -1
    return 8 * (role == THREAT) + 4 * ("negated" in marks) + 2 * ("reported" in marks) + ("targeted" in marks)


def tables() -> tuple[np.ndarray, np.ndarray]:
    """The composed machine as arrays: next state and outcome by state and role."""
    machine = grammar()
    after = np.zeros((len(machine.arcs), 6), np.int64)
    result = np.zeros((len(machine.arcs), 6), np.int64)
    for state, row in enumerate(machine.arcs):
        for (role, _), (target, out) in row.items():
            after[state, role], result[state, role] = target, outcome(out)
    return after, result


#: Prior outcome weights and intercept: an offence counts, a targeted one more, a negated or reported one less.
def prior() -> np.ndarray:
    weights = np.zeros(OUTCOMES + 1)
    for k in range(OUTCOMES):
        weights[k] = 3.0 - 1.0 * bool(k & 8) - 1.5 * bool(k & 4) - 1.0 * bool(k & 2) + 1.0 * bool(k & 1)
    weights[OUTCOMES] = -3.5
    return weights


class Grammar:
    """Counts outcomes in texts; built once per task from the learned insults."""

    def __init__(self, insults: np.ndarray) -> None:
        fixed = [(w, r) for r, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws]
        known = {word_hash(w): r for w, r in fixed} | {int(h): INSULT for h in insults}
        self.offences = HashTable(np.array([h for h, r in known.items() if r in (INSULT, THREAT)], np.uint64))
        self.insults = HashTable(np.array(insults, np.uint64))
        self.roles = HashTable(np.array(list(known), np.uint64))
        self.role_of = np.array(list(known.values()), np.int64)
        self.after, self.result = tables()

    def count(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Outcomes by row."""
        counts = np.zeros((len(bounds) - 1, OUTCOMES))
        starts, ends, hashes, rows = words(data, bounds)
        keys, at = keyed(data, starts, ends, hashes)
        insult = np.zeros(len(hashes), bool)
        insult[at[self.insults.hits(keys)[0]]] = True
        insult[self.offences.hits(hashes)[0]] = True
        hit = np.flatnonzero(insult)
        if not len(hit):
            return counts
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (rows[1:] != rows[:-1])
        begins = np.flatnonzero(new)
        clause = np.unique(np.searchsorted(begins, hit, "right") - 1)
        first = begins[clause]
        length = np.append(begins[1:], len(starts))[clause] - first
        # All clauses with an offence advance word by word together.
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        state = np.zeros(len(first), np.int64)
        alive = len(first)
        for step in range(int(length[0])):
            while length[alive - 1] <= step:
                alive -= 1
            at = first[:alive] + step
            role = np.zeros(alive, np.int64)
            where, place = self.roles.hits(hashes[at])
            role[where] = self.role_of[place]
            role[(role == OTHER) & insult[at]] = INSULT
            got = self.result[state[:alive], role]
            some = np.flatnonzero(got >= 0)
            np.add.at(counts, (rows[at[some]], got[some]), 1)
            state[:alive] = self.after[state[:alive], role]
        return counts


def probability(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.log1p(counts) @ weights[:OUTCOMES] + weights[OUTCOMES], -30, 30)))


def fit_weights(counts: np.ndarray, label: np.ndarray, times: np.ndarray, pull: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the prior weights."""
    centre = prior()
    weights = centre.copy()
    x = np.hstack([np.log1p(counts), np.ones((len(counts), 1))])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (times * (label - p)) - pull * (weights - centre)
        curvature = (x * (times * p * (1 - p))[:, None]).T @ x + pull * np.eye(x.shape[1])
        step = np.linalg.solve(curvature, gradient)
        weights = weights + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return weights


@dataclass(frozen=True)
class Model:
    insults: tuple[int, ...]
    weights: tuple[float, ...]


def keyed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a word can be listed, itself and its stems, and the word's index."""
    parts = [(np.arange(len(hashes)), hashes), *word_prefixes(data, starts, ends, STEMS)]
    return np.concatenate([h for _, h in parts]), np.concatenate([i for i, _ in parts])


def _document_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents with each key, summed over a slice."""
    for piece in slices(batches):
        data, bounds = utf8(piece.column("text"))
        starts, ends, hashes, rows = words(data, bounds)
        keys, at = keyed(data, starts, ends, hashes)
        order = np.lexsort((keys, rows[at]))
        h, r = keys[order], rows[at][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        yield _by_label(h[new], piece.column("label").to_numpy()[r[new]] > 0)


def _by_label(keys: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
    unique, place = np.unique(keys, return_inverse=True)
    return pa.RecordBatch.from_pydict({
        "word": unique.view(np.int64), "toxic": np.bincount(place, toxic, len(unique)).astype(np.int64),
        "clean": np.bincount(place, ~toxic, len(unique)).astype(np.int64),
    })


def _singled_out(counts: DataFrame, bad: int, good: int) -> list[int]:
    """The strongest keys, at most LEXICON_WORDS, from (word, t, c): counts in toxic and in clean text."""
    ratio = ((F.col("t") + 0.5) / (bad + 1)) / ((F.col("c") + 0.5) / (good + 1))
    both, share = F.col("t") + F.col("c"), bad / (bad + good)

    def term(seen: object, expected: object) -> object:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    # Log-likelihood ratio of key and label; the terms of the texts without the key are small and left out.
    evidence = 2 * (term(F.col("t"), both * share) + term(F.col("c"), both * (1 - share)))
    strong = counts.withColumn("ratio", ratio).withColumn("evidence", evidence).filter(
        (F.col("ratio") >= LEXICON_RATIO) & (F.col("evidence") >= LEXICON_EVIDENCE)
    )
    return [r["word"] for r in strong.orderBy(F.desc("evidence"), "word").limit(LEXICON_WORDS).select("word").collect()]


def learn_insults(train: DataFrame) -> tuple[int, ...]:
    """Keys of the words and stems that labels single out as insults, from (text, label).

    Words are first compared by documents. As copies of one toxic text would single out all its words, those found
    are compared again by distinct contexts, a context being the words before and after. Stems are compared by the
    distinct words that they begin, so that one insult doesn't make a stem of its first letters.
    """
    totals = {r["label"] > 0: r["n"] for r in train.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    if not bad or not good:
        return ()
    sums = (F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = train.mapInArrow(_document_counts, "word long, toxic long, clean long").groupBy("word").agg(*sums)
    found = np.array(_singled_out(counts, bad, good), np.int64).view(np.uint64)

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(found)
        for piece in slices(batches):
            data, bounds = utf8(piece.column("text"))
            starts, ends, hashes, rows = words(data, bounds)
            keys, at = keyed(data, starts, ends, hashes)
            hit, _ = table.hits(keys)
            padded = np.concatenate([[np.uint64(0)], hashes, [np.uint64(0)]])
            whole = hit < len(hashes)
            yield pa.RecordBatch.from_pydict({
                "word": keys[hit].view(np.int64), "label": (piece.column("label").to_numpy()[rows[at[hit]]] > 0).astype(np.int32),
                "before": np.where(whole, padded[at[hit]], hashes[at[hit]]).view(np.int64), "after": np.where(whole, padded[at[hit] + 2], np.uint64(0)).view(np.int64),
            })

    distinct = train.mapInArrow(contexts, "word long, label int, before long, after long").distinct()
    again = distinct.groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    return tuple(int(np.int64(w).view(np.uint64)) for w in _singled_out(again, bad, good))


def train_model(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Insults and outcome weights from at most `most` labelled rows outside the held-out fold."""
    chosen = bounded_labels(labels, "toxic", fold("doc_id", 3) != 1, most)
    train = plain_texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "label")
    train = written(docs.sparkSession, train, "toxicity-train")
    insults = learn_insults(train)

    def outcomes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Grammar(np.array(insults, np.uint64))
        for piece in slices(batches):
            counts = machine.count(*utf8(piece.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.tolist(), pa.list_(pa.float64())), piece.column("label").cast(pa.int32())], ["counts", "label"])

    # One row per distinct vector of counts and label, at most `most`.
    vectors = train.mapInArrow(outcomes, "counts array<double>, label int").groupBy("counts", "label").agg(F.count("*").alias("n")).collect()
    if not vectors:
        return Model(insults, tuple(prior()))
    vectors.sort(key=lambda r: (r["counts"], r["label"]))
    weights = fit_weights(
        np.array([r["counts"] for r in vectors]), np.array([float(r["label"] > 0) for r in vectors]), np.array([float(r["n"]) for r in vectors])
    )
    return Model(insults, tuple(map(float, weights)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_offences for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, weights = Grammar(np.array(model.insults, np.uint64)), np.array(model.weights)
        for piece in slices(batches):
            counts = machine.count(*utf8(piece.column("text")))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(probability(counts, weights)), pa.array(counts.sum(axis=1).astype(np.int64))], ["doc_id", "score", "n_offences"])

    return plain_texts(docs).mapInArrow(run, "doc_id long, score double, n_offences long")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on) and n_offences, a row per row of `docs`."""
    scored = score(docs, train_model(docs, labels))
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), "n_offences",
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text isn't toxic; the texts are not shuffled."""
    model = train_model(docs, labels)
    limit = math.log(THRESHOLD / (1 - THRESHOLD))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, weights = Grammar(np.array(model.insults, np.uint64)), np.array(model.weights)
        for piece in slices(batches):
            text = piece.column(piece.schema.get_field_index("text"))
            counts = machine.count(*utf8(text.fill_null("")))
            logit = np.log1p(counts) @ weights[:OUTCOMES] + weights[OUTCOMES]
            yield piece.filter(pa.array(logit < limit))

    return docs.mapInArrow(run, docs.schema)
