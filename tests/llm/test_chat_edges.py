"""Turns longer than the context at the edge of a block, and blocks of very many rows."""

from barsmith.llm import chat

SCHEMA = "conv_id bigint, turn bigint, text string"


def test_long_turn_at_an_edge_and_many_rows_in_a_block(spark):
    long = [(1, t, "User: start" if t in (0, 600) else "Assistant: mid" if t == 250 else f"row {t} goes on " + "x" * 401) for t in range(610)]
    many = [(2, None, f"line {k} of it") for k in range(5000)]
    got = chat.format_turns(spark.createDataFrame(long + many, SCHEMA)).collect()
    text = {c: "\n".join(r["rendered"] for r in got if r["conv_id"] == c).split("\n") for c in (1, 2)}
    for c, rows in ((1, long), (2, many)):
        lines = sorted(x for x in text[c] if not x.startswith("<|"))
        assert lines == sorted(t.split(": ")[-1] for _, _, t in rows)
    mid = next(r for r in got if r["conv_id"] == 1 and "mid" in r["rendered"])
    assert mid["turn"] == 250 and "row 289 goes on" in mid["rendered"]
