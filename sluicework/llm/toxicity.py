"""Toxicity by a weighted finite-state pattern grammar.

Small transducers are composed into one machine that reads the word classes of
a clause: the negation and reported-speech transducers mark what stands in
their reach, and the match transducer turns marked insults and threats, with a
target up to ``REACH`` words before or after, into matches. An insult without
one is a match of a lesser kind, a threat without one is none. So clauses are
scored, not words: "you are an idiot", "idiot, that you are", "an idiot", "not
an idiot" and "he said idiot" are matches of different kinds.

The weights are learned. The insult lexicon holds words and word stems whose
presence in a labelled text makes the label likely; each match kind has a
weight, its precision on the labelled texts, drawn to the grammar's own value
where there is little evidence. A text's score is the noisy-or of its matches.

The fit reads a bounded sample, ``SAMPLE`` labelled rows of each label, taken
by the hash of doc_id; near copies count once (one row for each least 5-word
shingle, whole texts where there is none), so that a group of copies can't teach
its words. All rows are scored,
in one narrow Arrow pass that looks closer only at texts with a lexicon word.

Defined results. Null, empty or matchless text: the base score. No labels: an
empty lexicon, so only threats match. Repeated rows and equal texts get equal
scores; an empty table gives an empty result; very long texts are scored whole;
columns of the caller are kept, and one that is named like the output gets
underscores before its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import held_out
from .ngram_join import WORDS, shingles
from .shared import kept, stored, table
from .textvec import Texts, blocks
from .word_tokens import Generations

SAMPLE = 4000  # labelled rows of each label that the fit reads
STEMS = (4, 5, 6)
LEAST_PRECISION = 0.9
SIGNIFICANCE = 14.0  # an entry's evidence: by chance one stem in e**14 has as much
LEXICON = 5000
THRESHOLD = 0.3
BASE = 0.01
REACH = 3  # words that a negation or a target reaches
BLOCK_BYTES = 4 << 20

THREATS = frozenset("kill murder hurt destroy strangle tuer tuerai töten umbringen matar mataré".split())
TARGETS = frozenset("you your u he she they him her them tu toi vous du dich ihr euch sie él ella tú usted ustedes".split())
NEGATIONS = frozenset("not never no nobody isn't aren't wasn't don't doesn't didn't pas jamais nicht kein keine nie nunca jamás".split())
REPORTS = frozenset("said says say told called wrote claims claimed quoted dit disait sagte sagt nannte dijo dice llamó".split())
#: Weight of each kind of match before there is evidence.
KINDS = {"insult": 0.8, "targeted": 0.95, "negated": 0.2, "reported": 0.2, "threat": 0.8}
_EVIDENCE = 5.0

_CLAUSE = re.compile(r"[.!?;:,|\n\r]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


@dataclass
class Transducer:
    """Deterministic; (state, symbol) gives (state, output). A missing symbol takes the state's "*"; without an output the symbol passes through."""

    start: object
    moves: dict = field(default_factory=dict)

    def step(self, state, symbol):
        state, output = self.moves.get((state, symbol)) or self.moves.get((state, "*"), (state, None))
        return state, symbol if output is None else output

    def then(self, other: Transducer, symbols: Iterable[str]) -> Transducer:
        """The composition: this one's output is the other's input."""
        symbols = list(symbols)
        out = Transducer((self.start, other.start))
        todo, seen = [out.start], {out.start}
        while todo:
            a, b = state = todo.pop()
            for symbol in symbols:
                a2, middle = self.step(a, symbol)
                b2, last = other.step(b, middle)
                out.moves[state, symbol] = ((a2, b2), last)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out


#: Word classes, and the end of a clause. The negation and report transducers put a sign before those in their reach.
CLASSES = ("word", "insult", "threat", "target", "negation", "report", "end")


def negation() -> Transducer:
    """Insults and threats within REACH words after a negation become "-insult" and "-threat"."""
    t = Transducer(0)
    for left in range(REACH + 1):
        t.moves[left, "*"] = (max(0, left - 1), None)
        t.moves[left, "negation"] = (REACH, "word")
        t.moves[left, "end"] = (0, None)
        for kind in ("insult", "threat"):
            t.moves[left, kind] = (max(0, left - 1), f"-{kind}" if left else kind)
    return t


def report() -> Transducer:
    """What follows a reporting verb in a clause becomes reported."""
    t = Transducer("own", {(state, "report"): ("reported", "word") for state in ("own", "reported")})
    for kind in ("insult", "threat"):
        t.moves["reported", kind] = ("reported", f"~{kind}")
    t.moves["reported", "end"] = ("own", None)
    return t


def matches() -> Transducer:
    """Outputs tuples of (kind of match, whether it is that of the held insult and not of this word).

    A state is how many more words a target before reaches, and how many more
    words the last insult and the last threat may wait for a target after them.
    """
    t = Transducer((0, 0, 0))
    less = lambda n: max(0, n - 1)
    waits = range(REACH + 1)
    for near in waits:
        for insult in waits:
            for threat in waits:
                state, later = (near, insult, threat), (less(near), less(insult), less(threat))
                expired = (("insult", True),) * (insult == 1)
                held = (("insult", True),) * (insult > 0)
                t.moves[state, "*"] = (later, expired)
                t.moves[state, "target"] = ((REACH, 0, 0), (("targeted", True),) * (insult > 0) + (("threat", False),) * (threat > 0))
                t.moves[state, "insult"] = ((less(near), 0 if near else REACH, less(threat)), held + (("targeted", False),) * (near > 0))
                t.moves[state, "threat"] = ((less(near), less(insult), less(threat) if near else REACH), expired + (("threat", False),) * (near > 0))
                for kind in ("insult", "threat"):
                    t.moves[state, f"-{kind}"] = (later, (*expired, ("negated", False)))
                    t.moves[state, f"~{kind}"] = (later, (*expired, ("reported", False)))
                t.moves[state, "end"] = ((0, 0, 0), held)
    return t


def grammar() -> Transducer:
    first = negation().then(report(), CLASSES)
    return first.then(matches(), CLASSES)


def stems(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]


class Grammar:
    def __init__(self, lexicon: dict[str, float], weights: dict[str, float]):
        self.lexicon, self.weights, self.machine = lexicon, weights, grammar()
        self.known, self.strings = Generations(), Generations()

    def _word(self, word: str) -> float:
        """The greatest weight of the word and its stems; 2 for a threat, 0 for all others."""
        if word in THREATS:
            return 2.0
        get = self.lexicon.get
        return max(get(s, 0.0) for s in stems(word))

    def _string(self, string: str) -> bool:
        return any(self.known.all(_WORD.findall(string), self._word))

    @staticmethod
    def _class(word: str, value: float) -> str:
        if not word:
            return "end"
        if value:
            return "threat" if value == 2 else "insult"
        return "target" if word in TARGETS else "negation" if word in NEGATIONS else "report" if word in REPORTS else "word"

    def kinds(self, text: str) -> list[tuple[str, float]]:
        """kind, lexicon weight: the matches of a text."""
        low = text.lower()
        if True not in self.strings.all(list(set(low.split())), self._string):
            return []
        found = []
        for clause in _CLAUSE.split(low):
            words = _WORD.findall(clause)
            values = self.known.all(words, self._word)
            if not any(values):
                continue
            state, held = self.machine.start, 0.0
            for word, value in zip((*words, ""), (*values, 0.0), strict=True):
                symbol = self._class(word, value)
                state, out = self.machine.step(state, symbol)
                found += [(kind, held if of_held else min(value, 1.0) or 1.0) for kind, of_held in out]
                if symbol == "insult":
                    held = value
        return found

    def score(self, text: str | None) -> float:
        clean = 1 - BASE
        for kind, value in self.kinds(text or ""):
            clean *= 1 - self.weights[kind] * value
        return 1 - clean


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """text, label of about ``sample`` rows of each label, one of each family; and how many rows each label has."""
    marked = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label")).where(~held_out(F.col("doc_id")))
    size = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}  # two rows at most
    below = F.when(F.col("label") == 1, sample * 2**32 / size.get(1, 1)).otherwise(sample * 2**32 / size.get(0, 1))
    few = marked.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < below)
    few = stored(few.select(F.col("doc_id").alias("of_id"), "label"))
    rows = docs.join(few, F.col("doc_id") == F.col("of_id")).select("text", F.col("label").cast("int").alias("label"))

    def families(batches):
        for block in blocks(batches, BLOCK_BYTES):
            t = Texts(block.column(0))
            doc, value = shingles(t, WORDS)
            least = np.zeros(t.n, np.uint64)
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else doc
            if len(begin):
                least[doc[begin]] = np.minimum.reduceat(value, begin)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(least.view(np.int64))], names=["text", "label", "family"])

    named = rows.mapInArrow(families, "text string, label int, family long")
    return stored(named.groupBy("family", "label").agg(F.min("text").alias("text")).select("text", "label")), size


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Learns lexicon and weights from labelled rows that aren't held out. docs: doc_id, text; labels: doc_id, toxic."""
    rows, size = _sample(docs, labels, sample)
    total = {r.label: r["count"] for r in rows.groupBy("label").count().toLocalIterator()}
    if set(total) != {0, 1}:
        return Grammar({}, dict(KINDS))
    before = size[0] / size[1]  # sampled shares differ by label: how much more frequent a clean row is than a toxic one
    odds = lambda toxic, clean: (toxic / total[1]) / (before * clean / total[0])

    def words(batches):
        for batch in batches:
            keys, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {s for w in set(_WORD.findall((text or "").lower())) for s in stems(w)}
                keys += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(toxic, pa.int64())], names=["stem", "toxic"])

    counts = rows.select("text", "label").mapInArrow(words, "stem string, toxic long").groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    ratio = odds(F.col("t") + 0.5, F.col("c") + 0.5)
    n, share = F.col("t") + F.col("c"), total[1] / (total[0] + total[1])
    evidence = F.col("t") * F.log(F.col("t") / n / share) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / (1 - share))).otherwise(0.0)
    best = counts.where("t > 0").withColumn("p", ratio / (1 + ratio)).where((F.col("p") >= LEAST_PRECISION) & (evidence >= SIGNIFICANCE)).orderBy(F.desc("p"), "stem").limit(LEXICON)
    lexicon = {r.stem: r.p for r in best.toLocalIterator()}
    trial = docs.sparkSession.sparkContext.broadcast(Grammar(lexicon, dict(KINDS)))

    def found(batches):
        for batch in batches:
            kinds, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for k, _ in trial.value.kinds(text or "")}
                kinds += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(labels, pa.int64())], names=["kind", "label"])

    weights = dict(KINDS)
    for r in rows.select("text", "label").mapInArrow(found, "kind string, label long").groupBy("kind").agg(F.sum("label").alias("t"), F.count("*").alias("n")).toLocalIterator():
        clean = before * (r.n - r.t) * total[1] / total[0]
        weights[r.kind] = (r.t + _EVIDENCE * KINDS[r.kind]) / (r.t + clean + _EVIDENCE)
    return Grammar(lexicon, weights)


def score(docs: DataFrame, model: Grammar, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches):
        grammar = shared.value
        for block in blocks(batches, BLOCK_BYTES):
            scores = [grammar.score(x) for x in block.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns[1:], pa.array(scores, pa.float64())], names=[*names, "score"])

    renamed = docs.select(F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names)
    return renamed.mapInArrow(run, f"{schema}, score double").toDF(*kept(keep, ["score"]), "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
