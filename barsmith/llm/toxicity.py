"""Toxicity by a weighted finite-state grammar over clauses.

A text is read clause by clause (up to a sentence mark, a comma, or the end of a line). The lexicon turns each
word into a symbol and a weight: INSULT, MODAL (will, going to), VERB (of harm), TARGET or CLITIC (the person
spoken to), OTHER (a third person), SELF (the speaker), NEGATION, ONLY, REPORT (speech), or none. Small transducers read the same
symbols: insults; an intention (a modal word that asks, "will the fire ...", is none); a verb of harm beside the one it
is aimed at (within two words, so that a recipe is no threat); a target anywhere; negation ("not only" is none) and the reported
speech of others ("I said" and "you said" report nothing) before what they govern. Arcs carry weights,
:func:`compose` adds them up, and a clause's weight is that of its path times the factor of the pattern in
which it ends: a plain insult, several, an aimed one, a negated or reported one, a threat, an aimed threat.

Function words are fixed lists for four languages. Insults are learned: word stems (3 to 8 letters) and whole words
in far more toxic than other labelled texts; the weight is the log ratio of the shares of texts, and a word takes
the longest stem that is known. The score is a logistic model of the matched clauses alone (their weights, the
heaviest one, their share of all clauses, how many of each pattern), whose coefficients are not below zero: a clause
that is negated, or dropped, never raises a score. Only the number of clauses, which puts them in proportion, may
lower it. It is learned from at most ``max_rows`` labelled rows, chosen by a hash of the row if there are more, which
bounds the lexicon too; rows of one id and text count once. Scoring reads every whole text, however long, and nothing but the
text; a score of exactly one half predicts 1.

Nulls: a null text is the empty text, which matches nothing and has the lowest score of its length; a null id is
never learned from nor held out; null labels are not learned from. If an id has several labels their mean counts.
Rows that repeat are scored alike. Without labels of both kinds every score is 0 or 1. An empty table gives an empty
result. Extra columns are kept beside the score by :func:`score_rows`, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import crc32_mod, partitions, table, written
from barsmith.llm.quality import labelled
from barsmith.llm.rows import with_vector

NONE, INSULT, MODAL, VERB, TARGET, CLITIC, OTHER, NEGATION, REPORT, SELF, ONLY = range(11)
SYMBOLS = 11
#: Function words, and verbs of harm, in English, German, French and Spanish.
WORDS = {
    MODAL: "will would shall gonna going must should i'll we'll werde werden wird sollte vais va allons vas doit voy vamos va debe",
    VERB: "kill hurt destroy crush stab shoot burn beat smash strangle töten umbringen schlagen vernichten zerstören erschießen tuer frapper détruire écraser brûler matar golpear destruir quemar aplastar",
    TARGET: "you your yours yourself ya u du dein deine ihr tu ton ta tes votre vos tú tuyo vosotros usted ustedes",
    CLITIC: "dich dir euch te toi vous ti",
    OTHER: "him her them they it's ihn sie ihm ihnen le les lui leur lo los las",
    NEGATION: "not no never neither nor isn't aren't don't won't nicht kein keine keiner niemals nie ne pas jamais aucun aucune nunca jamás ningún ninguna tampoco",
    REPORT: "said says say told called calls wrote reported quoted claimed sagte sagt nannte schrieb behauptete dit disait déclaré appelé écrit affirmé dijo dice llamó escribió afirmó",
}
WORDS[SELF] = "i we ich wir je nous yo nosotros"
WORDS[ONLY] = "only just merely nur bloß seulement solo sólo solamente"
FIXED = {w: s for s, ws in WORDS.items() for w in ws.split()}
#: Modal words that ask where they begin a clause.
ASKING = frozenset("will would shall must should werden wird sollte va vas doit debe".split())
#: Characters of a word that is not remembered.
LONG = 64
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.,;:!?\n]")
BREAK = frozenset(".,;:!?\n")
STEMS = range(3, 9)


@dataclass(frozen=True)
class Transducer:
    """arcs[state, symbol] = (next state, weight); a symbol without an arc keeps the state at no weight. ``out[state]`` at the end of a clause."""

    arcs: dict[tuple[int, int], tuple[int, float]]
    out: tuple

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 0.0))


#: none, one, several
INSULTS = Transducer({(0, INSULT): (1, 0.0), (1, INSULT): (2, 0.5)}, (0, 1, 2))
MODALS = Transducer({(0, MODAL): (1, 0.0)}, (False, True))
TARGETS = Transducer({(0, TARGET): (1, 0.5), (0, CLITIC): (1, 0.5)}, (False, True))
#: negation and report count if they stand before the first insult or verb of harm
NEGATIONS = Transducer({(0, NEGATION): (1, 0.0), (1, ONLY): (0, 0.0), (0, INSULT): (2, 0.0), (0, VERB): (2, 0.0), (1, INSULT): (3, 0.0), (1, VERB): (3, 0.0)}, (False, True, False, True))
REPORTS = Transducer({(0, REPORT): (1, 0.0), (0, SELF): (2, 0.0), (0, INSULT): (3, 0.0), (0, VERB): (3, 0.0), (0, TARGET): (2, 0.0), **{(2, x): (0, 0.0) for x in range(SYMBOLS)}, (2, INSULT): (3, 0.0), (2, VERB): (3, 0.0), (2, SELF): (2, 0.0), (2, TARGET): (2, 0.0)}, (False, True, False, False))


def _aimed(after: tuple[int, ...], before: tuple[int, ...], weight: float) -> Transducer:
    """A verb with its object: one of ``after`` up to two words after it, or one of ``before`` up to two words before it."""
    arcs = {}
    for state in (0, 1, 2, 3, 4):  # nothing near, object one or two words ago, verb one or two words ago
        for symbol in range(SYMBOLS):
            if symbol == VERB:
                arcs[state, symbol] = (5, weight) if state in (1, 2) else (3, 0.0)
            elif symbol in after and state in (3, 4):
                arcs[state, symbol] = (5, weight)
            elif symbol in before:
                arcs[state, symbol] = (1, 0.0)
            elif symbol != MODAL:
                arcs[state, symbol] = ({0: 0, 1: 2, 2: 0, 3: 4, 4: 0}[state], 0.0)
    return Transducer(arcs, (False,) * 5 + (True,))


#: what a threat weighs, as much as an insult that is e**3 times as frequent in toxic texts
HARM_YOU = _aimed((TARGET, CLITIC), (CLITIC,), 3.0)
HARM_OTHERS = _aimed((OTHER,), (), 2.0)


def compose(parts: list[Transducer], final: Callable) -> Transducer:
    """The transducer that runs all ``parts`` on the same symbols and adds their weights; ``final`` makes its output of theirs.

    State 0 is the start; only states that some clause can reach are made.
    """
    states = [(0,) * len(parts)]
    number, arcs = {states[0]: 0}, {}
    for s in states:  # grows as states are found
        for x in range(SYMBOLS):
            steps = [p.step(q, x) for p, q in zip(parts, s)]
            to = tuple(q for q, _ in steps)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            arcs[number[s], x] = (number[to], sum(w for _, w in steps))
    return Transducer(arcs, tuple(final(*(p.out[q] for p, q in zip(parts, s))) for s in states))


#: Each pattern, and the factor of its clauses' weight.
FACTORS = {"plain": 1.0, "several": 1.2, "aimed": 1.5, "negated": 0.02, "reported": 0.05, "threat": 1.0, "aimed threat": 1.5}
#: Clauses added to those of a text where matches are put in proportion, so that one clause is not everything.
MORE = 8
PATTERNS = tuple(FACTORS)


def _pattern(insults: int, modal: bool, you: bool, others: bool, target: bool, negated: bool, reported: bool) -> int:
    """The index of the clause's pattern, or -1. A threat needs an intention and a verb with its object."""
    threat = modal and (you or others)
    if not insults and not threat:
        return -1
    if reported:
        return 4
    if negated:
        return 3
    if insults:
        return 2 if target else 1 if insults > 1 else 0
    return 6 if you else 5


GRAMMAR = compose([INSULTS, MODALS, HARM_YOU, HARM_OTHERS, TARGETS, NEGATIONS, REPORTS], _pattern)
NEXT = [[GRAMMAR.arcs[s, x][0] for x in range(SYMBOLS)] for s in range(len(GRAMMAR.out))]
ADDS = [[GRAMMAR.arcs[s, x][1] for x in range(SYMBOLS)] for s in range(len(GRAMMAR.out))]
FACTOR_OF = list(FACTORS.values())
FEATURES = ("clauses", "weight", "heaviest clause", "share of clauses", "weight a clause", *PATTERNS)
#: Features whose coefficient may have any sign, and those that have none.
FREE, UNUSED = ("clauses",), ("negated", "reported")


@dataclass
class Reader:
    """Reads words as symbols with weights; remembers up to ``limit`` words, none of them a long one."""

    stems: dict[str, float]
    limit: int = 150_000
    memo: dict[str, tuple[int, float]] = field(default_factory=dict)

    def symbol(self, word: str) -> tuple[int, float]:
        if word in FIXED:
            return FIXED[word], 0.0
        if (w := self.stems.get("=" + word)) is not None:
            return (INSULT, w) if w > 0 else (NONE, 0.0)
        for n in range(min(len(word), STEMS[-1]), STEMS[0] - 1, -1):
            if (w := self.stems.get(word[:n])) is not None:
                return (INSULT, w) if w > 0 else (NONE, 0.0)
        return NONE, 0.0

    def read(self, text: str) -> list[float]:
        """The values of FEATURES."""
        tokens = TOKEN.findall(text.lower())
        if len(self.memo) > self.limit:
            self.memo.clear()
        memo, out = self.memo, GRAMMAR.out
        new = set(tokens).difference(memo)
        for w in new:
            memo[w] = (-1, 0.0) if w in BREAK else self.symbol(w)
        patterns = [0] * len(PATTERNS)
        matched = clauses = words = 0
        weight = heaviest = clause = 0.0
        state = 0
        tokens.append(".")
        memo["."] = (-1, 0.0)
        for token in tokens:
            symbol, w = memo[token]
            if symbol < 0:
                if words:
                    clauses += 1
                    if state and (p := out[state]) >= 0:
                        clause *= FACTOR_OF[p]
                        patterns[p] += 1
                        matched, weight, heaviest = matched + 1, weight + clause, max(heaviest, clause)
                state, clause, words = 0, 0.0, 0
                continue
            words += 1
            if symbol == MODAL and words == 1 and token in ASKING:
                symbol = NONE
            if symbol or state:
                clause += ADDS[state][symbol] + w
                state = NEXT[state][symbol]
        for w in new:
            if len(w) > LONG:
                del memo[w]
        log, n = math.log1p, clauses + MORE
        return [log(clauses), log(weight), log(heaviest), matched / n, math.sqrt(weight / n), *map(log, patterns)]


def stems_of(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in STEMS if n <= len(word))]


def learn_stems(train: DataFrame, text: str = "text", *, least_docs: int = 4, least_share: float = 0.02, least_g2: float = 30.0) -> dict[str, float]:
    """Stems that mark toxic texts, with the log ratio of the shares of texts that hold them.

    Whether a stem is a mark is tested on numbers of different texts (likelihood ratio). What comes to the driver is the
    grammar's lexicon: stems of at least ``least_docs`` and a share of ``least_share`` of the toxic texts of a training
    table of bounded size. The share keeps out words that only a few texts and their copies have.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = (Counter(), Counter())
            for t, y in zip(b["t"], b["y"]):
                texts[y >= 0.5].update({s for w in set(TOKEN.findall((t or "").lower())) - BREAK for s in stems_of(w)})
            stems = list(texts[0].keys() | texts[1].keys())
            yield pd.DataFrame({"stem": stems} | {c: [k[s] for s in stems] for c, k in zip("ca", texts)})

    train = train.groupBy(text).agg(F.avg("y").alias("y"))
    n = train.agg(F.coalesce(F.sum((F.col("y") >= 0.5).cast("bigint")), F.lit(0)), F.coalesce(F.sum((F.col("y") < 0.5).cast("bigint")), F.lit(0))).first()
    if not n[0] or not n[1]:
        return {}
    each = train.select(F.col(text).alias("t"), "y").mapInPandas(count, "stem string, c bigint, a bigint")
    nt, nc = float(n[0]), float(n[1])
    counts = each.groupBy("stem").agg(*(F.sum(k).alias(k) for k in "ca")).where(F.col("a") >= max(least_docs, least_share * nt))
    rate = (F.col("a") + F.col("c")) / (nt + nc)
    part = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    g2 = 2 * (part(a, nt * rate) + part(c, nc * rate) + part(nt - a, nt * (1 - rate)) + part(nc - c, nc * (1 - rate)))
    ratio = F.log((a + 0.5) / (nt + 1)) - F.log((c + 0.5) / (nc + 1))
    found = counts.withColumn("g2", g2).withColumn("w", ratio).where((F.col("g2") >= least_g2) & (F.col("w") > 0.7))
    kept = {r["stem"]: (r["a"], r["c"], float(r["w"])) for r in found.collect()}
    # a shorter stem that no further text has says nothing more than the longer one, and could only match other words
    extended = {s[:-1] for s in kept if s[:-1] in kept and kept[s[:-1]][:2] == kept[s][:2]}
    return {s: w for s, (_, _, w) in kept.items() if s not in extended}


@dataclass
class Model:
    """Bounded: the lexicon and a weight for each feature."""

    stems: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def reader(self) -> Callable[[list[str]], list[list[float]]]:
        reader = Reader(self.stems)

        def scores(texts: list[str]) -> list[list[float]]:
            x = np.array([reader.read(t) for t in texts])
            return [[s] for s in self.probability(x).tolist()]

        return scores

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    w = np.zeros(x.shape[1])
    w[-1] = math.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9))
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, free: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic weights (the last is the constant's) that are not below zero but where ``free``: the lowest one is left out until none is below."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[used] = _newton(x[:, used], y, ridge, rounds)
        low = np.where(free, 0.0, w)
        if low.min() >= 0:
            return w
        used[int(low.argmin())] = False


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 5, held: int = 0, max_rows: int = 20_000) -> Model:
    k = len(FEATURES)
    train = labelled(docs.select(id_col, text), labels, label, modulus, held, max_rows, id_col).select(text, "y")
    train = written(train.repartition(partitions(docs.sparkSession)), "toxicity-train")
    stems = learn_stems(train, text)
    model = Model(stems, np.zeros(k), np.ones(k), np.zeros(k + 1))

    def features() -> Callable[[list[str]], list[list[float]]]:
        reader = Reader(stems)
        return lambda texts: [reader.read(t) for t in texts]

    rows = with_vector(train, text, features).select("vector", F.col("row.y").alias("y")).toPandas()  # at most max_rows of a few numbers
    y = (rows["y"].to_numpy(np.float64) >= 0.5).astype(float) if len(rows) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        model.weights[-1] = 30.0 if y.sum() else -30.0
        return model
    x = np.stack(rows["vector"].to_numpy())
    x[:, [FEATURES.index(n) for n in UNUSED]] = 0.0
    model.mean, model.scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    free = np.array([n in FREE for n in FEATURES] + [True])
    model.weights = logistic(np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))]), y, free)
    for n in UNUSED:
        model.weights[FEATURES.index(n)] = 0.0
    return model


def score_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(row, score): every column of ``docs`` in a struct beside the score of its whole text."""
    model = fit(docs, labels, id_col=id_col, text=text, **options)
    return with_vector(docs, text, model.reader).select("row", F.col("vector")[0].alias("score"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", modulus: int = 5, held: int = 0, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``."""
    scored = score_rows(docs.select(id_col, text), labels, id_col=id_col, text=text, modulus=modulus, held=held, **options)
    key = F.col(f"row.{id_col}")
    return scored.select(key.alias("doc_id"), F.coalesce(crc32_mod(key, modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir):
    """All ``documents``, learned from ``labels.toxic`` outside the fold crc32 mod 5 = 0."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
