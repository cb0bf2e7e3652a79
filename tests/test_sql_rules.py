"""The SQL of single queries against them, on rows that the given tables hold seldom."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from barsmith.operators import metrics
from barsmith.plans import oracle
from tests.test_queries import plain


def test_change_that_rounds_to_zero_has_no_sign(spark, tmp_path):
    prices = [(50.0, 49.99), (50.0, 50.01), (50.0, 50.0), (50.0, 49.975), (50.0, 49.95), (40.0, 40.58)]
    ticks = [(2 * h + k, datetime(2024, 1, 2) + timedelta(hours=h, minutes=k), 1, "click", p, "") for h, pair in enumerate(prices) for k, p in enumerate(pair)]
    spark.createDataFrame(ticks, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{os.path.join(tmp_path, 'events.parquet')}/*.parquet'")
    sql = con.execute(f"select time, change from ({entry.oracle_sql()['display_texts']}) order by time").fetchall()
    got = [(r["time"], r["change"]) for r in entry.queries()["display_texts"](spark, str(tmp_path)).orderBy("time").collect()]
    assert sql == got
    assert [c for _, c in got][:3] == ["0.00%", "0.00%", "0.00%"] and got[4][1] == "-0.10%"


@pytest.mark.parametrize("net", [[-10.0, -5.0, -20.0], [], [5.0, 7.0], [0.0, 0.0], [0.0, -4.0], [10.0, -5.0, 0.0]])
def test_summary_without_gains_losses_or_trades(spark, net):
    shape = "symbol string, end_index bigint, entry_time bigint, exit_time bigint, gross_return double, net_return double, exit_reason string, holding_bars bigint, same_bar_ambiguity boolean, skip_reason string"
    rows = [("click", k, k, k + 1, x + 1, x, "timeout", 3, False, None) for k, x in enumerate(net)]
    rows.append(("click", len(net), 0, None, None, None, None, None, None, "overlap"))
    types = shape.replace("string", "varchar").split(", ")
    each = ", ".join(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in types)
    values = ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in r) + ")" for r in rows)
    want = duckdb.sql(oracle.summary(f"with tf as (select {each} from (values {values}) t({', '.join(c.split()[0] for c in types)}))"))
    done = spark.createDataFrame(rows[:-1], shape).selectExpr("*", "end_index + 1 as trade_number")
    got = metrics.summary(done)
    assert want.columns == got.columns
    assert [plain(v) for v in want.fetchall()[0]] == [plain(v) for v in got.first()]
    assert got.first()["profit_factor"] == (None if not [x for x in net if x < 0] else {3: 0.0, 2: 0.0}[len(net)] if max(net) <= 0 else 2.0)
