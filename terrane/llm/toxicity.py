"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read a clause's words as symbols and write symbols with
marks on them: reported speech and negation mark the heads that follow, insults,
threats and targets mark the clause's end. Composed, they are one transducer
whose arcs at a clause's end name a pattern such as "insult at a target, negated"
and carry its weight. Only matched clauses count for a document's score; the
weights and the insult lexicon are learnt from labelled rows.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, held_out, id_and_text, table
from .labelled import labelled_sample

by_value(__name__)

#: Labelled rows that lexicon and weights are learnt from, about; all rows are scored.
SAMPLE = 12_000
#: Distinct texts and contexts that an entry needs at least, and the share of its texts that are toxic.
SUPPORT, CONTEXTS, PRECISION = 5, 5, 0.9
#: Lengths of the word beginnings that an entry may be.
STEMS = (4, 5, 6, 7)

# Closed classes of words in English, German, French and Spanish.
TARGETS = """you your yours yourself u he him his she her they them their we us those people everyone anybody
du dich dir dein deine euch ihr ihn sie leute
tu toi te vous votre vos ton ta tes il elle ils elles leur gens
usted ustedes tú ti vosotros ellos ellas gente"""
NEGATIONS = """not no never none neither nor without isn't aren't wasn't don't doesn't didn't cannot can't
nicht kein keine keinen keiner nie niemals ohne
ne pas jamais aucun aucune sans
nunca jamás ningún ninguna sin tampoco"""
REPORTS = """said says say saying wrote writes reported reportedly quoted quote quotes called claimed claims according told alleged
sagte sagt schrieb zitierte laut angeblich meinte behauptete
dit disait écrit selon déclaré raconte prétend
dijo dice escribió según citó llamó afirma"""
THREATS = """kill murder shoot stab hang burn destroy hurt beat die strangle
töten umbringen erschießen erstechen verprügeln vernichten
tuer frapper brûler égorger détruire
matar matarte golpear quemar destruir"""
INSULTS = """idiot idiots moron morons stupid imbecile bastard scumbag
dummkopf trottel vollidiot arschloch
imbécile connard salaud crétin
imbécil estúpido cabrón gilipollas"""

NONE, INSULT, WEAK, THREAT, TARGET, NEGATION, REPORT, END = range(8)

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")


class Transducer:
    """Arcs (state, input symbol) -> (state, output symbol) from state 0; an end of a clause goes back to it.

    A symbol is (kind, marks), marks a sorted tuple of names.
    """

    def __init__(self, arc):
        self.arc = arc

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: what this one writes is what the other reads."""

        def arc(states, symbol):
            mine, out = self.arc(states[0], symbol)
            others, out = other.arc(states[1], out)
            return (mine, others), out

        return Transducer(lambda states, symbol: arc(states or (0, 0), symbol))


def marked(symbol: tuple, *names: str) -> tuple:
    return symbol[0], tuple(sorted({*symbol[1], *names}))


HEADS = (INSULT, WEAK, THREAT)


def marks_heads(mark: int, name: str) -> Transducer:
    """Negation or reported speech: after its word, the heads of the clause bear its name."""

    def arc(seen, symbol):
        if symbol[0] == END:
            return 0, symbol
        if symbol[0] in HEADS and seen:
            return seen, marked(symbol, name)
        return int(seen or symbol[0] == mark), symbol

    return Transducer(arc)


def first_head() -> Transducer:
    """The end of a clause bears the marks of its first head."""

    def arc(first, symbol):
        if symbol[0] == END:
            return 0, marked(symbol, *(first or ()))
        return (symbol[1] if first == 0 and symbol[0] in HEADS else first), symbol

    return Transducer(arc)


def counts(kind: int, name: str, most: int) -> Transducer:
    """Insults, threats or targets: the end of a clause bears how many of them it has, up to `most`."""

    def arc(n, symbol):
        if symbol[0] == END:
            return 0, marked(symbol, f"{name}{n}") if n else symbol
        return min(most, n + (symbol[0] == kind)), symbol

    return Transducer(arc)


def meaning(marks: tuple) -> tuple | None:
    """(head, target, negated, reported) of a matched clause; threat words without a target, or no head at all, match nothing."""
    insult, weak = (sum(k * (f"{name}{k}" in marks) for k in (1, 2)) for name in ("insult", "weak"))
    threat, target = "threat1" in marks, "target1" in marks
    head = (3 if threat else insult) if insult else 3 + weak if weak else 0 if threat and target else None
    return None if head is None else (head, int(target), int("negated" in marks), int("reported" in marks))


def grammar() -> tuple[list, list]:
    """The composed transducer as tables: the next state by state and symbol, and the pattern at a state's end (-1: no match).

    Patterns: kind of head (a threat at a target, one insult, several insults,
    threat and insult, one weak insult, several weak insults) by target, and by
    negation and reported speech before the head.
    """
    parts = [marks_heads(REPORT, "reported"), marks_heads(NEGATION, "negated"), first_head(), counts(INSULT, "insult", 2), counts(WEAK, "weak", 2), counts(THREAT, "threat", 1), counts(TARGET, "target", 1)]
    machine = functools.reduce(Transducer.then, parts)
    kinds = {k: n for n, k in enumerate(itertools.product(range(KINDS), range(2), range(2), range(2)))}
    number, todo, rows, pattern = {0: 0}, [0], [], []
    for state in todo:
        row = []
        for s in range(END):
            to, _ = machine.arc(state, (s, ()))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
        pattern.append(kinds.get(meaning(machine.arc(state, (END, ()))[1][1]), -1))
    return rows, pattern


KINDS = 6
PATTERNS = KINDS * 2 * 2 * 2
#: Beside the patterns: matched clauses, their share, and whether there are several or many.
EVIDENCE = PATTERNS + 4


class Reader:
    """Counts a text's clause patterns under a lexicon: words and word beginnings (with a *) to INSULT or WEAK."""

    def __init__(self, lexicon: dict):
        self.lexicon, self.memory = lexicon, {}
        self.rows, self.pattern = grammar()
        self.closed = {}
        for symbol, text in ((THREAT, THREATS), (REPORT, REPORTS), (TARGET, TARGETS), (NEGATION, NEGATIONS)):
            self.closed |= dict.fromkeys(text.split(), symbol)

    def symbol(self, word: str) -> int:
        found = self.memory.get(word)
        if found is None:
            if word in ".!?;:\n":
                found = END
            else:
                own = [k for k in (word, *(word[:n] + "*" for n in STEMS if len(word) >= n)) if k in self.lexicon]
                found = min(map(self.lexicon.get, own)) if own else self.closed.get(word.replace("’", "'"), NONE)
            if len(self.memory) > 500_000:
                self.memory.clear()
            self.memory[word] = found
        return found

    def patterns(self, text: str) -> tuple[Counter, int]:
        """(counts of the patterns of matched clauses, clauses) of a whole text."""
        symbol, memory = self.symbol, self.memory
        read = [memory.get(w) or symbol(w) for w in TOKEN.findall(text.lower())]
        found, clauses = Counter(), 1 + read.count(END)
        if INSULT in read or WEAK in read or THREAT in read:
            state, rows = 0, self.rows
            for s in read:
                if s == END:
                    found[self.pattern[state]] += 1
                    state = 0
                elif s:
                    state = rows[state][s]
            found[self.pattern[state]] += 1
            del found[-1]
        return found, clauses


def evidence(found: Counter, clauses: int) -> np.ndarray:
    """A text's evidence, from matched clauses alone: how often each pattern occurs, all of them, their share, and whether there are over one or two."""
    x, n = np.zeros(EVIDENCE), sum(found.values())
    for k, c in found.items():
        x[k] = np.log1p(c)
    x[PATTERNS:] = np.log1p(n), min(1.0, n / clauses), n > 1, n > 2
    return x


def learn_lexicon(sample: DataFrame) -> dict:
    """Words and word beginnings (with a *) that mark toxic texts, after several different words.

    An entry is INSULT if PRECISION of the texts that have it are toxic, WEAK if
    that holds only for the texts that have it twice or more. Equal texts count
    once for each label, and an entry needs CONTEXTS different words before it
    however many texts have it, so neither copies nor the sample's size keep a
    common insult out.
    """

    def units(it):
        for b in it:
            rows: dict = {}
            contexts = set()
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                words = [w for w in TOKEN.findall(text.lower()) if len(w) > 2]
                own = Counter()
                for last, w in zip(["", *words], words):
                    names = [w, *(w[:n] + "*" for n in STEMS if len(w) >= n)]
                    own.update(names)
                    if label:
                        contexts.update((u, last) for u in names)
                for u, n in own.items():
                    row = rows.setdefault(u, [0, 0, 0, 0])
                    row[0 if label else 1] += 1
                    row[2 if label else 3] += n > 1
            last = [(u, c) for u, c in contexts]
            more = [[0] * len(last)] * 4
            cells = [[r[k] for r in rows.values()] + more[k] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*rows, *(u for u, _ in last)], pa.string()), pa.array([None] * len(rows) + [c for _, c in last], pa.string()), *(pa.array(c, pa.int64()) for c in cells)],
                ["unit", "last", "toxic", "clean", "toxic2", "clean2"],
            )

    rows = sample.select("text", "label").distinct().mapInArrow(units, "unit string, last string, toxic bigint, clean bigint, toxic2 bigint, clean2 bigint")
    sums = [F.sum(c).alias(c) for c in ("toxic", "clean", "toxic2", "clean2")]
    by_unit = rows.groupBy("unit", "last").agg(*sums).groupBy("unit").agg(*sums, F.count("last").alias("contexts"))
    sure = lambda t, c: (F.col(t) >= SUPPORT) & (F.col(t) >= PRECISION * (F.col(t) + F.col(c)))
    strength = F.when(sure("toxic", "clean"), INSULT).when(sure("toxic2", "clean2"), WEAK)
    good = by_unit.where(F.col("contexts") >= CONTEXTS).select("unit", strength.alias("strength")).where("strength is not null")
    return {r["unit"]: r["strength"] for r in good.collect()}  # at most what the bounded sample holds


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3) -> np.ndarray:
    """Newton's method for a penalised logistic regression; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict, np.ndarray]:
    """(lexicon, weights) from a bounded sample of labelled rows.

    Without labelled rows of both kinds the built-in words and fixed weights serve.
    """
    rows = labelled_sample(docs, labels, label, sample, id_col, text_col)
    lexicon = dict.fromkeys(INSULTS.split(), INSULT) | learn_lexicon(rows)

    def read(it):
        reader = Reader(lexicon)
        for b in it:
            x = [evidence(*reader.patterns(t)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column("label")], ["x", "label"])

    seen = rows.mapInArrow(lambda it: read(b.select(["text", "label"]) for b in it), "x binary, label int")
    kinds = seen.groupBy("x", "label").count().collect()  # a few hundred bytes for each of the bounded sample's rows at most
    y = np.array([float(r["label"] > 0) for r in kinds for _ in range(r["count"])])
    if len(set(y)) < 2:
        weights = np.zeros(EVIDENCE + 1)
        weights[PATTERNS], weights[-1] = 3.0, -3.0
        return lexicon, weights
    x = np.array([np.frombuffer(bytes(r["x"])) for r in kinds for _ in range(r["count"])])
    order = np.lexsort((y, *x.T))
    return lexicon, logistic(x[order], y[order])


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, clauses, matched_clauses for every whole text: one row per input row.

    Labels are learnt from rows that are not held out only; a score depends on
    the text alone. Null text counts as empty and has the score of a text without
    a matched clause. Repeated rows and null ids (not held out) are scored like
    others. An empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, sample, id_col, text_col))

    def batches(it):
        lexicon, w = sent.value
        reader = Reader(lexicon)
        for b in it:
            scores, clauses, matched = [], [], []
            for text in b.column(1).to_pylist():
                found, n = reader.patterns(text)
                scores.append(float(1 / (1 + np.exp(-np.clip(evidence(found, n) @ w[:-1] + w[-1], -30, 30)))))
                clauses.append(n)
                matched.append(sum(found.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(clauses, pa.int64()), pa.array(matched, pa.int64())], ["doc_id", "score", "clauses", "matched_clauses"])

    slim = id_and_text(docs, id_col, text_col)
    scored = slim.mapInArrow(batches, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double, clauses bigint, matched_clauses bigint")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses", "matched_clauses")


def op2(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
