"""Ordered tables with a page index: order, numbers, deep pages and the files they open."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.sinks import ordered

T0 = datetime(2024, 1, 1)


def test_pages_numbers_and_files(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=(i * 37) % 101), float(i % 3), i % 5, "a") for i in range(230)]
    rows += [(None, 1.0, 1, None)] * 3  # rows that repeat, without a time: first
    df = spark.createDataFrame(rows, model.FACT_SCHEMA).repartition(4)
    order = ["timestamp", "ID", "type", "value"]
    path = str(tmp_path / "t")
    ordered.write_ordered(df, path, order, rows_per_file=20)
    key = lambda r: tuple((x is not None, x) for x in (r[0], r[2], r[3], r[1]))
    want = sorted(rows, key=key)
    got = ordered.read_ordered(spark, path).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(1, 234))
    assert [tuple(r)[:4] for r in got] == want
    assert ordered.row_total(spark, path) == 233
    page = ordered.read_page(spark, path, 9, 20)
    assert [tuple(r)[:4] for r in page.collect()] == want[180:200]
    opened = page.inputFiles()
    assert 1 <= len(opened) - 1 <= 3, opened  # the index and the files that hold rows 181 to 200
    assert "Exchange rangepartitioning" in page._jdf.queryExecution().toString()  # only the page's rows are sorted
    assert ordered.read_page(spark, path, 11, 20).count() == 13
    assert ordered.read_page(spark, path, 12, 20).count() == 0


def test_empty_ordered_table(spark, tmp_path):
    path = str(tmp_path / "e")
    ordered.write_ordered(spark.createDataFrame([], model.FACT_SCHEMA), path, ["timestamp"])
    assert ordered.read_ordered(spark, path).count() == 0
    assert ordered.row_total(spark, path) == 0
    assert ordered.read_page(spark, path, 0, 10).filter(F.col("row_no") > 0).count() == 0
