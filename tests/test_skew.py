"""A sensor holding a third of all rows: results stay exact and the hot
series is spread over several tasks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorframe.operators import dedup, resample, smooth
from sensorframe.sources import driver_tables as dt
from sensorframe.sources.metadata import normalize_metadata
from tests.conftest import SF0001


def _hot(spark):
    f = dt.facts(spark, SF0001)
    # every third reading is attributed to sensor 7 (a hot key)
    return f.withColumn("ID", F.when(F.abs(F.hash("timestamp", "type")) % 3 == 0, F.lit(7).cast("long"))
                        .otherwise(F.col("ID")))


def test_hot_sensor_rolling_blocks(spark):
    f = _hot(spark)
    longest = f.groupBy("ID", "type").count().agg(F.max("count")).first()[0]
    block = 16
    assert longest > 4 * block
    plain = f.withColumn("value", F.avg("value").over(
        Window.partitionBy("ID", "type").orderBy("timestamp", "value").rowsBetween(-4, 0)))
    got = smooth.rolling_mean(f, 5, block_rows=block)
    a = got.withColumn("value", F.round("value", 9))
    b = plain.withColumn("value", F.round("value", 9))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # the plan partitions the window by (series, block), not by series alone
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_blk" in plan


def test_hot_sensor_resample_and_dedup(spark):
    f = _hot(spark)
    m = normalize_metadata(dt.metadata_raw(spark, SF0001))
    res = resample.resample_series(f, m, "H", "sum")
    assert abs(res.agg(F.sum("value")).first()[0] - f.agg(F.sum("value")).first()[0]) < 1e-6
    d = dedup.dedup_keep_first(f)
    assert d.count() == f.select("timestamp", "ID", "type").distinct().count()
