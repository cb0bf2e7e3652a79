"""Whole licence texts in other guises, tables of one's own, and texts that only mention a licence."""

import os

import pytest
from pyspark.sql import functions as F

from barsmith.llm import licenses


def scanned(spark, texts, listed=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumns({"digest": F.lit("x"), "license": F.lit(1), "t": F.lit(2), "n": F.lit(3), "_h": F.lit(4)})
    return {r["doc_id"]: r for r in licenses.scan(df, listed).collect()}


def test_guises_are_found_and_mentions_are_not(spark):
    guises = licenses.planted()
    texts = [*guises, *(f"{t} and more" for _, t in licenses.WHOLE), "MIT", "a\n" + licenses.MIT, "x " * 200_000, None, ""]
    got = scanned(spark, texts)
    assert [got[i]["license"] for i in range(len(guises))] == [name for name, _ in licenses.WHOLE for _ in range(3)]
    assert all(got[i]["license"] is None for i in range(len(guises), len(texts))) and len(got) == len(texts)


def test_spellings_are_whole_words(spark):
    r = spark.createDataFrame([("Conversion of a licence, licence and LICENCES; version 2\nversion",)], "t string").select(licenses.canonical(F.col("t")).alias("c"), licenses.canonical_lines(F.col("t")).alias("l")).first()
    assert r["c"] == "conversion of a license license and licenses v 2 v" and r["l"] == ["conversion of a license license and licenses v 2", "v"]
    assert licenses.canonical_text("Conversion of a licence, licence and LICENCES; version 2\nversion") == r["c"]


def test_lines_that_begin_with_copyright_stay_in_wrapped_texts(spark):
    wrapped = licenses.BSD3.replace("above copyright notice", "above\ncopyright notice").replace("OF THE COPYRIGHT", "OF THE\nCOPYRIGHT")
    assert scanned(spark, ["Copyright (c) 2020, A\nAll rights reserved.\n\n" + wrapped])[0]["license"] == "BSD-3-Clause"


def test_table_of_ones_own(spark):
    mine = licenses.digests(spark.createDataFrame([("Mine-1.0", "Do what\nyou like, © 2020"), ("Mine-1.0", None), ("House", "House rules apply.")], "license string, text string"))
    got = scanned(spark, ["DO WHAT you like", "say:\nhouse rules apply\nhouse rules apply", licenses.MIT], mine)
    assert [(got[i]["license"], got[i]["line_licenses"], got[i]["n_license_lines"]) for i in range(3)] == [(None, "", 0), (None, "House", 2), (None, "", 0)]
    whole = licenses.digests(spark.createDataFrame([("Mine-1.0", "Do what\nyou like")], "license string, text string"))
    assert scanned(spark, ["DO WHAT you like"], whole)[0]["license"] == "Mine-1.0"


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the standard texts are not on this machine")
def test_standard_texts_have_the_fixed_digests(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [open(f"{folder}/{f}", encoding="utf-8").read() for f in names]
    got = scanned(spark, texts)
    assert [got[i]["license"] for i in range(len(names))] == list(names.values())
