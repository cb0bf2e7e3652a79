"""Repeated strings against a table of all windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import repeats


def brute(rows, depth):
    """[(doc_id, spans, kept)] in the order of the rows; a null id comes last."""
    key = lambda i: repeats.LAST if i is None else i
    first = {}
    for i, t in rows:
        for p in range(len(t) - depth + 1):
            w = t[p : p + depth]
            first[w] = min(first.get(w, repeats.LAST), key(i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - depth + 1):
            if first[t[p : p + depth]] < key(i):
                gone[p : p + depth] = True
        edges = np.nonzero(np.diff(gone, prepend=False))[0].tolist()
        out.append((i, list(zip(edges[::2], edges[1::2])), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def by_blocks(rows, depth, size, buckets=3):
    """What the passes do, without Spark: blocks of ``size`` documents."""
    blocks = []
    for k in range(0, len(rows), size):
        part = sorted(rows[k : k + size], key=lambda r: (r[0] is None, r[0] or 0))
        blocks.append(repeats.Block([i for i, _ in part], [t for _, t in part], depth, buckets))

    def asked(questions, judge):
        dealt = [b._dealt(q[0]) for b, q in zip(blocks, questions)]
        said = [np.zeros(len(q[0]), np.uint8) for q in questions]
        for bucket in range(buckets):
            at = [(k, rows) for k, d in enumerate(dealt) for n, rows in d if n == bucket]
            if at:
                answer = judge(*(np.concatenate([questions[k][c][rows] for k, rows in at]) for c in range(3)))
                for (k, rows), part in zip(at, np.split(answer, np.cumsum([len(r) for _, r in at])[:-1])):
                    said[k][rows] = part
        return said

    for b, s in zip(blocks, asked([b.asked() for b in blocks], repeats.states)):
        b.answer(s)
    for b, s in zip(blocks, asked([b.halves() for b in blocks], repeats.shared)):
        b.answer_halves(s)
    out = []
    for b, s in zip(blocks, asked([b.windows() for b in blocks], repeats.earlier)):
        for k, spans in b.spans(s.astype(bool)):
            t = b.data[b.offsets[k] : b.offsets[k + 1]].tobytes()
            gone = np.zeros(len(t), bool)
            for i, j in spans:
                gone[i:j] = True
            out.append((None if b.ids[k] == repeats.LAST else int(b.ids[k]), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def made(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(80)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k)).encode()
    passages = [text(30) for _ in range(4)] + [b" " * 120, b"ab" * 60, b"x" * 49, b"y" * 50, "é汉".encode() * 30]
    rows = []
    for i in range(n):
        t = b"".join(r.choice([text(r.randint(0, 40)), r.choice(passages), b"%d" % i]) for _ in range(r.randint(0, 6)))
        rows.append((i * 3 % 50, t))
    rows += [(100 + k, rows[5][1]) for k in range(15)] + [(2, rows[7][1])] * 2 + [(None, rows[8][1]), (None, passages[0] + b"tail"), (3, b""), (1, b"z" * 3000), (200, b"z" * 3000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, depth, size, piece, many", [(1, 50, 7, 1 << 20, 8), (2, 50, 100, 64, 8), (3, 32, 3, 100, 0), (4, 77, 10, 1 << 20, 1), (5, 50, 1, 51, 2)])
def test_passes_against_all_windows(monkeypatch, seed, depth, size, piece, many):
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "MANY", many)
    rows = made(seed)
    assert sorted(by_blocks(rows, depth, size), key=str) == sorted(brute(rows, depth), key=str)


def test_in_spark(spark):
    rows = [(i, t.decode("utf-8", "ignore")) for i, t in made(6)] + [(300, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit(1), "block": F.lit("x"), "data": F.lit(2)}).repartition(5)
    got = [(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in repeats.without_repeats(docs).collect()]
    plain = [(i, (t or "").encode()) for i, t in rows]
    want = [(i, len(t), s, k) for (i, t), (_, s, k) in zip(plain, brute(plain, 50))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(len(s) > 1 for _, _, s, _ in got)
    assert repeats.without_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(docs, depth=20)


def test_a_long_text(spark):
    body = "".join(random.Random(1).choice("abcdefghij ") for _ in range(400_000))
    docs = spark.createDataFrame([(1, body), (2, "new " + body[100_000:300_000] + " end"), (3, body[:49])], "doc_id int, text string")
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}
    assert got[1]["spans"] == [] and got[3]["spans"] == [] and [tuple(s) for s in got[2]["spans"]] == [(4, 200_004)] and bytes(got[2]["kept"]) == b"new  end"
