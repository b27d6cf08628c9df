import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from panelkit.session import session

    s = session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def dense(spark):
    """40 stations, three days of 5-minute bins over a DST change, with planted cases."""
    from pyspark.sql import functions as F

    start = 1711756800  # 2024-03-30 00:00 UTC
    grid = spark.range(40 * 864).select(
        (F.col("id") / 864).cast("int").alias("s"), (F.col("id") % 864).cast("int").alias("b")
    )
    cap = (20 + F.col("s") % 11).cast("int")
    wave = cap / 2 + cap / 3 * F.sin(2 * F.pi() * (F.col("b") % 288) / 288 + F.col("s"))
    ts = F.timestamp_seconds(F.lit(start) + F.col("b") * 300)
    df = grid.select(
        F.concat(F.lit("s"), F.lpad(F.col("s").cast("string"), 2, "0")).alias("station_id"),
        ts.alias("tbin_utc"), (ts + F.expr("interval 30 seconds")).alias("ts_utc"),
        F.rint(F.least(F.greatest(wave, F.lit(0.0)), cap)).cast("int").alias("bikes"), cap.alias("capacity"),
        F.lit("OK").alias("status"), (48.8 + F.col("s") * 0.003).alias("lat"), (2.3 + (F.col("s") * 7 % 40) * 0.002).alias("lon"),
        F.concat(F.lit("Stop "), F.col("s").cast("string")).alias("name"), "s", "b",
    )
    # s00 misses bins 10-15; s01 is empty for 12 bins across midnight and for 11 later; s02 stands still for six readings
    df = df.filter(~((F.col("s") == 0) & F.col("b").between(10, 15)))
    df = df.withColumn(
        "bikes",
        F.when((F.col("s") == 1) & F.col("b").between(282, 293), 0)
        .when((F.col("s") == 1) & F.col("b").between(400, 410), 0)
        .when(F.col("s") == 1, 10)
        .when((F.col("s") == 2) & F.col("b").between(100, 106), 7)
        .when(F.col("s") == 2, F.col("b") % 2 + 10)
        .otherwise(F.col("bikes")).cast("int"),
    )
    return df.cache()
