"""All three limits on instruction data, and a memo that blobs do not fill."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from barsmith.llm import packing, tokens


def test_limits_bind_on_conversations(spark):
    """Prompts bear no loss; answers do. Sequences are closed by tokens, by segments, and by loss-bearing tokens."""
    rows = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    # short conversations have prompts that are all of it; in long ones the loss begins after the first word
    start = F.when(F.size("t") <= 2, F.lit(1_000_000)).when(F.col("conv_id") % 3 == 0, 1).otherwise(F.lit(40))
    docs = rows.select(F.col("conv_id").alias("doc_id"), F.when(F.col("conv_id") % 4 == 0, F.substring(text, 1, 30)).otherwise(text).alias("text"), start.cast("bigint").alias("prompt")).coalesce(2)
    got = packing.pack(docs, loss_from="prompt", segments=6, loss=1500).collect()
    prompts = {r["doc_id"]: r["prompt"] for r in docs.collect()}
    by = defaultdict(list)
    for r in got:
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], prompts[r["doc_id"]]))
        by[r["sequence_id"]].append(r)
    tokens_, segments, loss = ([f(s) for s in by.values()] for f in (lambda s: sum(r["length"] for r in s), len, lambda s: sum(r["loss_tokens"] for r in s)))
    assert max(tokens_) <= 4096 and max(segments) <= 6 and max(loss) <= 1500
    assert 4096 in tokens_ and any(n == 6 and t < 4096 and x < 1500 for n, t, x in zip(segments, tokens_, loss)) and any(x == 1500 and n < 6 and t < 4096 for n, t, x in zip(segments, tokens_, loss))
    seen = defaultdict(int)
    for r in got:
        seen[r["doc_id"]] += r["length"]
    assert all(seen[r["doc_id"]] == r["doc_tokens"] for r in got)


def test_blobs_do_not_stay_in_the_memo():
    w = tokens.Words(tokens.default_path())
    rng = np.random.default_rng(1)
    blobs = ["".join(rng.choice(list("abcdefgh0123+/"), 5000)) for _ in range(20)] + ["q" * 300 + "!!", "ordinary"]
    texts = [" ".join(blobs), "", "ordinary " + blobs[0]]
    assert w.encode(texts) == [np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert "ordinary" in w.memo and max(map(len, w.memo)) <= tokens.LONGEST
