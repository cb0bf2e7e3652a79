"""Paths with capitals, very many paths under one host, long URLs, clashing columns, against a plain reading of the list."""

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from barsmith.llm import urls


def test_judging_by_brute_force(spark):
    rng = np.random.default_rng(9)
    hosts, parts = ["a.com", "www.a.com", "b.org", "x.b.org"], ["/A", "/a", "/Ab/c", "/ab", "", "/q/1"]
    day = lambda: date(2024, 1, 1) + timedelta(days=int(rng.integers(0, 60)))
    entries = [(str(rng.choice(hosts)) + str(rng.choice(parts)), str(rng.choice(["x", "y"])), day(), str(rng.choice(["add", "remove"]))) for _ in range(60)]
    entries = list({(p, d, a): (p, "x" if len(p) % 2 else "y", d, a) for p, _, d, a in entries}.values())
    captures = [(i, f"http://{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', '/more', 'Z'])}", day()) for i in range(300)]
    captures += captures[:20] + [(900, None, day()), (901, "http://a.com/A", None), (None, "http://A.com/A", day()), (902, "http://a.com/" + "p" * 50_000, day())]

    def judged(url, at):
        if url is None or at is None:
            return "", 0
        host, _, path = url.split("://", 1)[1].partition("/")
        host, path = host.lower(), "/" + path if "/" in url.split("://", 1)[1] else ""
        hits = set()
        for pattern in {p for p, *_ in entries}:
            on, _, start = pattern.partition("/")
            start = "/" + start if "/" in pattern else ""
            past = [(d, a == "add", c) for p, c, d, a in entries if p == pattern and d <= at]
            if past and max(past)[1] and (host == on or host.endswith("." + on)) and path.startswith(start):
                hits.add((pattern, max(past)[2]))
        return ",".join(sorted({c for _, c in hits})), len(hits)

    listed = spark.createDataFrame(entries, "pattern string, category string, day date, action string")
    df = spark.createDataFrame(captures, "page_id bigint, url string, fetched date").withColumns({c: F.lit(1) for c in ("host", "path", "on", "start", "n", "salt", "_k", "category")})
    got = sorted(((r["page_id"], r["categories"], r["n_entries"], r["blocked"]) for r in urls.judge(df, listed).collect()), key=str)
    assert got == sorted(((i, *judged(u, d), judged(u, d)[1] > 0) for i, u, d in captures), key=str)


def test_many_paths_under_one_host(spark):
    listed = spark.range(5000).select(F.concat(F.lit("big.com/P"), "id").alias("pattern"), F.lit("c").alias("category"), F.lit("2024-01-01").cast("date").alias("day"), F.lit("add").alias("action"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://big.com/P"), F.col("id") * 7).alias("url"), F.lit("2024-02-01").cast("date").alias("fetched"))
    got = {r["page_id"]: r["n_entries"] for r in urls.judge(pages, listed).collect()}
    assert got == {i: sum(str(7 * i)[: k + 1] == str(int(str(7 * i)[: k + 1])) and int(str(7 * i)[: k + 1]) < 5000 for k in range(len(str(7 * i)))) for i in range(2000)}
