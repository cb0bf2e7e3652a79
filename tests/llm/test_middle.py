"""Cuts for fill in the middle, against a regular expression and lists of tokens."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from barsmith.llm import middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(id_, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digits = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    pre, mid, suf = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < spm else (n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def test_ranks_and_places():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        for share in (0.0, 0.02, 0.5, 1.0):
            flags = rng.random(n) < share
            bits = middle.Bits(flags)
            assert bits.rank(np.arange(n + 1)).tolist() == np.concatenate(([0], np.cumsum(flags))).tolist()
            ones = np.nonzero(flags)[0]
            assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()


def odd_rows():
    r = random.Random(3)
    letters = ["a", "é", "汉", "🙂", " ", "  ", "\t", "\n", "\x0b", " ", "<", ">", "<S", "S>", "P>"]
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 40)))) for i in range(400)]
    rows += [(None, "no id at all"), (None, None), (7, None), (8, ""), (9, "   "), (9, "   "), (10, "word"), (11, " lead"), (12, "trail "), (-5, "a b c"), (13, "x <P> y"), (14, "é " * 40_000)]
    return rows


def test_against_lists_of_tokens(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int").withColumns({"form": F.lit(1), "output": F.lit(2), "prefix_chars": F.lit("x")})
    got = middle.transformed(docs, rate=90).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *plain(i, t, rate=90), t or "") for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert middle.transformed(docs.limit(0)).count() == 0


def test_other_rates_and_seeds(spark):
    rows = odd_rows()[:100]
    docs = spark.createDataFrame(rows, "key bigint, body string")
    for rate, spm, seed in ((0, 80, 1), (100, 0, 2), (100, 100, 3)):
        got = middle.transformed(docs, id_col="key", text="body", rate=rate, spm_rate=spm, seed=seed).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *plain(i, t, seed, rate, spm)) for i, t in rows), key=str)
