"""Sources, the stream, and the three analyses."""

import pytest
from pyspark.sql import functions as F

from barsmith.functions import intervals, time
from barsmith.operators import simulate
from barsmith.plans import queries, service
from barsmith.sources import catalog, demo, files
from barsmith.streaming.bars import stream_bars

H = 3_600_000


def pages(symbol, interval, start, end):
    """What a vendor would answer: a bar an hour, half-open."""
    return [(t, 1.0, 2.0, 0.5, 1.5, 3.0) for t in range(start, end, H)]


def test_paged_source(spark):
    spark.dataSource.register(files.PagedSource)
    raw = spark.read.format("paged_bars").option("symbol", "NQ").option("interval", "1h").option("start", 0).option("end", 10 * H).option("page", 4 * H).option("fetch", "tests.test_sources.pages").load()
    assert raw.count() == 10 and raw.select("ingest_seq").distinct().count() == 10


def test_demo_bars(spark, tmp_path):
    start = time.parse_time_param("2024-03-04T00:00:00Z")
    df = demo.demo_bars(spark, {"ES": (5000.0, 1.0, 0.25, 2), "NQ": (17000.0, 1.2, 0.25, 2)}, start, start + 7 * intervals.DAY)
    assert df.where("low > open or low > close or high < open or high < close or low <= 0").count() == 0
    assert df.where(~time.in_session(F.col("time"))).count() == 0 and df.groupBy("symbol", "time").count().where("count > 1").count() == 0
    assert sorted(map(tuple, df.limit(50).collect())) == sorted(map(tuple, df.limit(50).collect()))
    files.write_column_list(df.where("symbol = 'ES'"), str(tmp_path / "demo"))
    back = files.read_column_list(spark, str(tmp_path / "demo" / "symbol=ES"), "ES")
    assert back.count() == df.where("symbol = 'ES'").count()


def test_intervals():
    assert intervals.fetch_interval("4h", {"5m"}) == "5m" and intervals.storage_interval("6h") == "1h" and intervals.interval("60") == "1h"
    assert intervals.build_range(10 * H + 5, "1h", 1) == (11 * H - 24 * H, 11 * H) and intervals.cacheable_end(10 * H, 10 * H, "1h") == 8 * H
    with pytest.raises(KeyError):
        intervals.interval("7m")
    with pytest.raises(KeyError):
        catalog.instrument("XX")
    assert catalog.instrument(" nq ")[0] == "NQ" and time.parse_time_param("2024-01-01T00:00:00Z") == time.parse_time_param("1704067200") == 1_704_067_200_000


def test_stream_equals_batch(spark, data, tmp_path):
    ticks = queries.ticks(spark, data).withColumn("ts", F.timestamp_millis("time")).select("symbol", "ts", "seq", "price")
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    q = stream_bars(stream).writeStream.outputMode("complete").format("memory").queryName("formed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = queries.hourly(spark, data)
    assert spark.table("formed").exceptAll(want).count() == 0 and spark.table("formed").count() == want.count()


def test_backtest(spark):
    series = queries.hourly(spark, "/root/testdata/sf0.01")
    times = [r["time"] for r in series.where("symbol = 'click'").orderBy("time").limit(120).collect()]
    request = service.Request("click", ("view", "click"), (times[100], times[111]), (times[0], times[0] + 40 * intervals.DAY), threshold=0.3, matches=5, rules=simulate.Rules(stop="percentage", stop_value=20.0, hold=8))
    out = service.backtest(series, request)
    matches = out["matches"].collect()
    assert 0 < len(matches) <= 5 and all(r["similarity"] >= 0.3 and not (r["symbol"] == "click" and r["start_time"] <= times[111] and r["end_time"] >= times[100]) for r in matches)
    s = out["summary"].first()
    assert s["trades_executed"] == out["trades"].count() == out["equity"].count() and s["wins"] + s["losses"] + s["breakeven"] == s["trades_executed"]
    with pytest.raises(ValueError):
        service.Request("a", (), (2, 1), (0, 1))
