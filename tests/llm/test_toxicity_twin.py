"""The composed transducers against a plain reading of each clause, and what the score makes of patterns."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import toxicity
from barsmith.llm.toxicity import CLITIC, FACTORS, INSULT, MODAL, NEGATION, ONLY, OTHER, PATTERNS, REPORT, SELF, TARGET, VERB

STEMS = {"idiot": 5.0, "=fool": 2.5, "scum": 7.0}


def kind(word):
    if word in toxicity.FIXED:
        return toxicity.FIXED[word], 0.0
    if "=" + word in STEMS:
        return INSULT, STEMS["=" + word]
    for n in range(8, 2, -1):
        if word[:n] in STEMS:
            return INSULT, STEMS[word[:n]]
    return 0, 0.0


def harm(kinds, after, before):
    """Whether a verb of harm has its object near it, read from left to right; a modal word takes up no room."""
    near = None  # ("object" or "verb", words ago)
    for k in kinds:
        if k == MODAL:
            continue
        if k == VERB:
            if near and near[0] == "object":
                return True
            near = ("verb", 0)
        elif k in after and near and near[0] == "verb":
            return True
        elif k in before:
            near = ("object", 0)
        else:
            near = (near[0], 1) if near and near[1] == 0 else None
    return False


def clause(words):
    """(pattern or None, weight)."""
    pairs = [kind(w) for w in words]
    if words[0] in toxicity.ASKING:
        pairs[0] = (0, 0.0)
    kinds = [k for k, _ in pairs]
    insults = kinds.count(INSULT)
    you, others = harm(kinds, (TARGET, CLITIC), (CLITIC,)), harm(kinds, (OTHER,), ())
    target = TARGET in kinds or CLITIC in kinds
    governed = [i for i, k in enumerate(kinds) if k in (INSULT, VERB)]
    before = kinds[: governed[0]] if governed else kinds
    reported = any(k == REPORT and (i == 0 or before[i - 1] not in (SELF, TARGET)) for i, k in enumerate(before))
    denied = False
    for k in before:
        denied = k == NEGATION or denied and k != ONLY
    weight = sum(w for _, w in pairs) + (0.5 if insults > 1 else 0) + (0.5 if target else 0) + 3.0 * you + 2.0 * others
    if not insults and not (MODAL in kinds and (you or others)):
        return None, 0.0
    if reported:
        name = "reported"
    elif denied:
        name = "negated"
    elif insults:
        name = "aimed" if target else "several" if insults > 1 else "plain"
    else:
        name = "aimed threat" if you else "threat"
    return name, weight * FACTORS[name]


def plain(text):
    clauses = [c.split() for c in re.split(r"[.,;:!?\n]", text.lower())]
    clauses = [c for c in clauses if c]
    found = [x for x in map(clause, clauses) if x[0]]
    weights = [w for _, w in found]
    n = len(clauses) + toxicity.MORE
    log = math.log1p
    return [log(len(clauses)), log(sum(weights)), log(max(weights, default=0)), len(found) / n, math.sqrt(sum(weights) / n), *(log(sum(p == name for p, _ in found)) for name in PATTERNS)]


def test_reading_by_brute_force():
    rng = np.random.default_rng(6)
    vocabulary = ["idiot", "idiots", "fool", "foolish", "scum", "will", "werde", "kill", "töten", "you", "dich", "te", "them", "him", "not", "nie", "said", "sagt", "I", "yo", "only", "tree", "green", "walks", "eggs"]
    marks = [" ", " ", " ", " ", ", ", ". ", "\n", "! "]
    reader = toxicity.Reader(STEMS, limit=5)
    for _ in range(3000):
        text = "".join(str(rng.choice(vocabulary)) + str(rng.choice(marks)) for _ in range(int(rng.integers(0, 30))))
        assert reader.read(text) == pytest.approx(plain(text)), text


def test_recipe_matches_nothing_and_threats_do():
    reader = toxicity.Reader({})
    names = list(toxicity.FEATURES)
    of = lambda t: {p for p in PATTERNS if dict(zip(names, reader.read(t)))[p] > 0}
    assert of("Beat the eggs and burn the sugar for you") == set() and of("I will beat the eggs for you") == set() and of("you will hurt") == set()
    assert of("will the fire burn you") == of("should they kill you") == set() and of("the fire will burn you") == {"aimed threat"}
    assert of("ich werde dich töten") == of("je vais te tuer") == of("te voy a matar") == of("I will kill you") == {"aimed threat"}


def test_the_speaker_reports_nothing_and_not_only_denies_nothing():
    reader = toxicity.Reader({"idiot": 5.0})
    names = list(toxicity.FEATURES)
    of = lambda t: {p for p in PATTERNS if dict(zip(names, reader.read(t)))[p] > 0}
    assert of("I said you idiot") == of("ich sagte du idiot") == of("you said idiot to you") == {"aimed"}
    assert of("he said you idiot") == of("dijo idiot") == {"reported"}
    assert of("not only are you an idiot") == of("nicht nur ein idiot bist du") == {"aimed"} and of("you are not an idiot") == {"negated"}


def test_long_words_are_not_remembered():
    reader = toxicity.Reader({"idiot": 5.0})
    one = reader.read("idiot" + "x" * 1000 + " you")
    assert one == reader.read("idiot you") and max(map(len, reader.memo)) <= toxicity.LONG


def test_stems_by_plain_counts(spark):
    """Numbers of different texts, copies counted once, against plain Python."""
    rng = np.random.default_rng(3)
    words = ["idiot", "idiots", "idiotic", "scum", "tree", "green", "treetop", "walk", "a", "of", "sometimes"]
    texts = []
    for k in range(600):
        toxic = k % 4 == 0
        t = " ".join(str(rng.choice(words[:4] if toxic and rng.random() < 0.5 else words[4:])) for _ in range(8))
        texts += [(t, float(toxic))] * (1 + (k % 5 == 0))
    texts += [("copied purvy text " + str(k % 3), 1.0) for k in range(90)]
    got = toxicity.learn_stems(spark.createDataFrame(texts, "text string, y double"))
    by = {}
    for t, y in texts:
        by.setdefault(t, []).append(y)
    label = {t: sum(v) / len(v) >= 0.5 for t, v in by.items()}
    nt, nc = sum(label.values()), len(label) - sum(label.values())
    found = {}
    for stem in {s for t in by for w in re.findall("[a-z]+", t) for s in toxicity.stems_of(w)}:
        a, c = (sum(label[t] == side and any(stem in toxicity.stems_of(w) for w in re.findall("[a-z]+", t)) for t in by) for side in (True, False))
        rate = (a + c) / (nt + nc)
        g2 = 2 * sum(k * math.log(k / m) for k, m in ((a, nt * rate), (c, nc * rate), (nt - a, nt * (1 - rate)), (nc - c, nc * (1 - rate))) if k > 0)
        w = math.log((a + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))
        if a >= max(4, 0.02 * nt) and g2 >= 30 and w > 0.7:
            found[stem] = (a, c, w)
    extended = {s[:-1] for s in found if s[:-1] in found and found[s[:-1]][:2] == found[s][:2]}
    want = {s: v[2] for s, v in found.items() if s not in extended}
    assert got == pytest.approx(want) and "=scum" in got and not any("purvy".startswith(s) for s in got)


def test_logistic_weights_are_the_best_that_do_not_fall_below_zero():
    rng = np.random.default_rng(5)
    x = np.hstack([rng.normal(size=(800, 5)), np.ones((800, 1))])
    y = (rng.random(800) < 1 / (1 + np.exp(-(x @ np.array([1.5, -1.0, 0.3, 0.0, -0.7, -0.5]))))).astype(float)
    free = np.array([False, False, False, False, True, True])
    w = toxicity.logistic(x, y, free)
    penalty = np.array([1.0] * 5 + [1e-6])
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - penalty * w  # of the log likelihood
    used = (w != 0) | free
    assert np.abs(slope[used]).max() < 1e-4 and (slope[~used] <= 1e-6).all() and (w[~free] >= 0).all()
    assert w[0] > 1 and w[1] == 0 and w[4] < 0


@pytest.fixture(scope="module")
def model(spark):
    base = "/root/testdata/sf0.01"
    return toxicity.fit(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet"))


def test_negation_and_report_score_below_the_plain_clause(model):
    word = max((s[1:] for s in model.stems if s.startswith("=")), key=lambda w: model.stems["=" + w])
    score = lambda t: model.reader()([t])[0][0]
    plain_, aimed, negated, reported, clean = map(score, (f"he is {word} now", f"you are {word}", f"he is not {word}", f"they said {word}", "he is here now"))
    assert aimed >= plain_ > 0.5 > reported > clean and plain_ > 2 * negated and plain_ > 2 * reported and negated > clean
    coefficients = dict(zip(toxicity.FEATURES, model.weights))
    assert all(w >= 0 for n, w in coefficients.items() if n not in toxicity.FREE) and all(coefficients[n] == 0 for n in toxicity.UNUSED)


def test_rows_keep_their_columns(spark, model):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (None, None), (2, "word " * 100_000)], "doc_id bigint, text string").withColumns({"row": F.lit(1), "vector": F.lit("v"), "score": F.lit(2), "y": F.lit(3), "_id": F.lit(4)})
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score_rows(docs, labels)
    assert got.select("row.*").columns == docs.columns and got.count() == 4 and got.where("score between 0 and 1").count() == 4
