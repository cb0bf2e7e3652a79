"""Spelling variants against all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from barsmith.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=5):
    """{word: (form, root, n, n_near, form_n)}"""
    form = {}
    out = {}
    for w, n in words.items():
        found = sorted((-m, v) for v, m in words.items() if near(w, v))
        ok = found and -found[0][0] >= times * n
        form[w] = found[0][1] if ok else None
        out[w] = (n, len(found), -found[0][0] if ok else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def made(seed, n, letters="abé", sizes=(6, 9)):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(*sizes))): int(5 * 10 ** r.uniform(0, 4)) for _ in range(n)}


def test_numbers_of_words():
    words = sorted(made(1, 2000))
    automaton = variants.Automaton(words)
    for k, w in enumerate(words):
        state, number = automaton.follow(automaton.root, 0, w)
        assert number == k and automaton.final[state]
    assert automaton.follow(automaton.root, 0, "c") is None
    assert len(automaton.edges) < sum(map(len, words)) / 4  # shared beginnings and ends
    assert variants.Automaton([]).one_error("abc", 1) == set()


def test_one_error_after_an_exact_half():
    words = sorted(made(2, 1500, sizes=(3, 6)))
    automaton = variants.Automaton(words)
    for w in words[:300]:
        half = len(w) // 2
        assert {words[i] for i in automaton.one_error(w, half)} == {v for v in words if len(v) >= len(w) and near(w, v) and v[:half] == w[:half]}


@pytest.mark.parametrize("chunk", [20_000, 40])
def test_against_all_pairs(spark, monkeypatch, chunk):
    """Halves that very many words share are cut into chunks."""
    monkeypatch.setattr(variants, "CHUNK", chunk)
    words = made(3, 700) | made(4, 200, letters="xyzÿ×")
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.grouped(df).collect()}
    assert got == brute(words)
    assert any(v[1] != v[0] and v[0] for v in got.values())  # chains of two forms and more
    assert variants.grouped(df.limit(0)).count() == 0


def test_short_words_and_ties(spark):
    words = {"a": 5, "b": 30, "ab": 30, "": 7, "c": 150}
    df = spark.createDataFrame([(w, n) for w, n in words.items() if w], "word string, n bigint")
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in variants.grouped(df).collect()}
    assert got == {"a": ("c", "c", 3), "b": ("c", "c", 3), "ab": (None, "ab", 2), "c": (None, "c", 2)}
    tied = spark.createDataFrame([("colour", 5), ("colous", 30), ("colouz", 30)], "word string, n bigint")
    assert {r["word"]: r["form"] for r in variants.grouped(tied).collect()} == {"colour": "colous", "colous": None, "colouz": None}


def test_words_of_documents(spark):
    r = random.Random(5)
    letters = "abcABC×÷éÉß 1-"
    rows = [(i, "".join(r.choice(letters) for _ in range(3000))) for i in range(30)] + [(3, "ABCabc " * 20), (3, "ABCabc " * 20), (None, "ÉCOLES écoles " * 9), (4, None), (5, "")]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 3 and n >= 2}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit(1), "n": F.lit("x")})
    got = {r["word"]: r["n"] for r in variants.vocabulary(docs, typo=7, least_length=3, least_count=2).collect()}
    assert got == want
    assert variants.vocabulary(docs.limit(0)).count() == 0
