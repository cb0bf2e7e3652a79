"""The document after each one, where an id or the lack of one holds most rows."""

from collections import Counter

import xxhash
from pyspark.sql import functions as F

from barsmith.llm import fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_next_text_with_hot_ids(spark):
    rows = [(7, f"seven {k}") for k in range(150)] + [(None, f"none {k}") for k in range(120)] + [(k, f"text {k}") for k in range(60)] + [(7, "seven 3")] * 5 + [(-(1 << 63), "low"), ((1 << 63) - 1, "high"), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"th": F.lit(1), "bucket": F.lit("x")}).repartition(3)
    got = fingerprints.with_next(df).collect()
    order = sorted(((i, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))
    want = Counter((r[0], r[2], order[(k + 1) % len(order)][2]) for k, r in enumerate(order))
    assert Counter((r["id"], r["text"], r["next_text"]) for r in got) == want
    sizes = Counter(r["bucket"] for r in got)
    assert max(sizes.values()) < 130 and sum(r["last"] for r in got) == len(sizes)
    assert fingerprints.with_next(df.limit(0)).count() == 0 and fingerprints.with_next(df.limit(1)).first()["next_text"] is not None
