"""The chat operator against Viterbi over each whole conversation in plain Python."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barsmith.llm import chat

SCHEMA = "conv_id bigint, turn bigint, text string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def conversations(rows):
    """Conversations as lists of (turn, text) in reading order."""
    found = {}
    for k, (conv, turn, text) in enumerate(rows):
        text = text or ""
        found.setdefault((conv, None) if conv is not None and turn is not None else (conv, k), []).append((turn, signed(xxhash.xxh64_intdigest(text.encode(), 42)), text))
    return [(conv, [(t, x) for t, _, x in (sorted(v) if k is None else v)]) for (conv, k), v in found.items()]


def twin(rows, rounds):
    model, convs = chat.DEFAULT, conversations(rows)
    for k in range(rounds + 1):
        paths = []
        starts, arcs, seen = np.zeros(6), np.zeros((6, 6)), np.zeros((6, chat.SYMBOLS))
        for _, block in convs:
            syms = b"".join(chat.symbols(x) for _, x in block)
            path, _ = chat.viterbi(model.emit[np.frombuffer(syms, np.uint8)], model.start, model.step)
            paths.append(path)
            starts[path[0]] += 1
            for a, b in zip(path, path[1:]):
                arcs[a, b] += 1
            for s, x in zip(path, syms):
                seen[s, x] += 1
        if k < rounds:
            model = chat.tables(starts, arcs, seen)
    out = Counter()
    for (conv, block), path in zip(convs, paths):
        lines = [(turn, n, line) for turn, text in block for n, line in enumerate(text.split("\n"))]
        turn_of, part, role, body = None, 0, None, []
        for k, ((turn, n, line), state) in enumerate(zip(lines, path)):
            to, begins = chat.STATES[state]
            if begins:
                if body:
                    out[conv, turn_of, part, role, chat.render(role, "\n".join(body).strip("\n"))] += 1
                part = sum(chat.STATES[path[j]][1] for j in range(k - n, k))
                turn_of, role, body = turn, chat.ROLES[to], []
                marked, at = chat.marker(line)
                line = line[at:] if marked == to else line
            body.append(line)
        out[conv, turn_of, part, role, chat.render(role, "\n".join(body).strip("\n"))] += 1
    return out


def transcripts(seed):
    """Turns of 1 to 2,000 rows, rows that repeat, turns that share a number, texts of many lines, nulls."""
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(12):
        turn, role = 0, 1
        for _ in range(int(rng.integers(1, 12))):
            name = ["System", "User", "Assistant"][role]
            mark = ["", f"{name}: ", f"[{name.lower()}] "][int(rng.integers(0, 3))]
            rows.append((conv, turn, f"{mark}start {turn}" + "?" * int(rng.integers(0, 2))))
            for k in range(int(rng.choice([0, 0, 1, 5, 300, 1999]))):
                turn += 1
                rows.append((conv, turn, f"row {k} of {turn}" if k % 7 else f"row {k}\nand more\nand more"))
            turn, role = turn + int(rng.integers(0, 2)), 3 - role if rng.random() < 0.9 else role
    rows += [(20, 5, f"line {k % 700}") for k in range(3000)] + [(20, 6, "Assistant: the same")] * 600 + [(20, None, f"n{k}") for k in range(50)]
    rows += [(21, 0, "\n".join(f"line {k}" if k % 900 else f"User: {k}" for k in range(10_000))), (22, 0, None), (22, 1, ""), (22, 2, "\n\n"), (None, 3, "User: x"), (None, 3, "User: x"), (None, None, "y")]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


@pytest.mark.parametrize(("rounds", "block"), [(0, 256), (2, 256), (2, 7)])
def test_turns_are_those_of_whole_conversations(spark, rounds, block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = transcripts(rounds)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rows": F.lit(1), "prior": F.lit("x"), "hb": F.lit(0)})
    got = Counter((r["conv_id"], r["turn"], r["part"], r["role"], r["rendered"]) for r in chat.format_turns(df, rounds=rounds).collect())
    assert got == twin(rows, rounds)


def test_long_answer_of_short_lines_stays_with_its_speaker(spark):
    rows = [(1, 0, "User: how?"), (1, 1, "Assistant: here it is\n" + "\n".join(f"step {k}" for k in range(3000))), (1, 2, "User: thanks")]
    got = sorted((r["turn"], r["role"]) for r in chat.format_turns(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "user"), (1, "assistant"), (2, "user")]


def test_marker_of_another_role_is_kept_in_the_text():
    rows = [(0, "User: a"), (1, "Assistant: b")]
    found = list(chat.pieces(rows, np.array([2, 4])))
    assert found == [(False, 0, 0, "user", False, "a"), (False, 1, 0, "assistant", True, "b")]
    assert list(chat.pieces(rows[:1], np.array([4])))[0][-1] == "User: a"
