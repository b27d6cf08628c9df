"""Sketches within their error bounds, and late rows in a running stream."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from panelkit.config import PanelConfig
from panelkit.operators import clean, features, sketches
from panelkit.session import work_path
from panelkit.streaming import late, streams

CFG = PanelConfig()


def test_window_from_day_states(spark, dense):
    rows = dense.withColumn("x", F.sin(F.col("b") * F.col("s")) * F.col("capacity"))
    days = sketches.day_sketches(rows, ["status"], "x", "station_id", k=200)
    path = work_path(spark, "day-states")
    days.write.parquet(path)
    first, last, probs = date(2024, 3, 30), date(2024, 3, 31), [0.05, 0.25, 0.5, 0.95]
    got = sketches.window_figures(spark.read.parquet(path), ["status"], first, last, probs).collect()
    assert len(got) == 1
    exact = sorted(r.x for r in rows.filter(F.to_date("tbin_utc").between(F.lit(first), F.lit(last))).select("x").collect())
    assert got[0].n == len(exact)
    for p, q in zip(probs, got[0].q):
        lo, hi = bisect_left(exact, q) / len(exact), bisect_right(exact, q) / len(exact)
        assert lo - sketches.rank_error(200) <= p <= hi + sketches.rank_error(200)
    assert abs(got[0].distinct / 40 - 1) <= 3 * sketches.distinct_error()


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([("a", datetime(2024, 1, 1), None, None)], "g string, tbin_utc timestamp, x double, s string")
    got = sketches.window_figures(sketches.day_sketches(none, ["g"], "x", "s"), ["g"], date(2024, 1, 1), date(2024, 1, 1), [0.5]).collect()
    assert (got[0].n, got[0].q, got[0].distinct) == (0, None, 0)


def test_late_rows_rewrite_their_day(spark, dense):
    rows = dense.select("station_id", "tbin_utc", "ts_utc", "bikes")
    newer = rows.filter("bikes % 7 = 0").withColumns({"ts_utc": F.col("ts_utc") + F.expr("interval 60 seconds"), "bikes": F.lit(99)})
    at = work_path(spark, "late")
    want = {(r.station_id, r.tbin_utc): (r.ts_utc, r.bikes) for r in clean.dedup_latest(rows.unionByName(newer)).collect()}
    # The last day lands first, the corrections in between, the first day last.
    for batch in (rows.filter("tbin_utc >= '2024-04-01'"), newer, rows.filter("tbin_utc < '2024-04-01'")):
        batch.coalesce(1).write.mode("append").parquet(f"{at}/in")
        late.start_daily(streams.file_stream(spark, f"{at}/in", rows.schema), f"{at}/out", f"{at}/checkpoint", CFG)
    read = lambda: {(r.station_id, r.tbin_utc): (r.ts_utc, r.bikes) for r in late.read_days(spark, f"{at}/out", rows.schema).collect()}
    assert read() == want
    # A batch that is repeated from its checkpoint changes nothing.
    import glob
    import os

    for f in [*glob.glob(f"{at}/checkpoint/commits/2"), *glob.glob(f"{at}/checkpoint/commits/.2.crc")]:
        os.remove(f)
    late.start_daily(streams.file_stream(spark, f"{at}/in", rows.schema), f"{at}/out", f"{at}/checkpoint", CFG)
    assert read() == want


def test_recent_history_on_any_grid(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=i), i) for i in range(200)] + [("b", start, 1), ("b", start, 2)]
    df = spark.createDataFrame(rows, "station_id string, tbin_utc timestamp, bikes int")
    got = features.recent_history(df, 60).groupBy("station_id").count().collect()
    assert {r.station_id: r["count"] for r in got} == {"a": 61, "b": 2}
