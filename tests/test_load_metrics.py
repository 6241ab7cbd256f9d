"""Load metrics per batch: ids, rows, bytes of the written files, rate."""

import datetime as dt

from pyspark.sql import functions as F

from sensorframe.functions.expressions import per_second
from sensorframe.operators.batches import load_batches
from sensorframe.session import list_files
from sensorframe.sinks import csv as csv_sink

T0 = dt.datetime(2024, 1, 1)


def _facts(spark, ids):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), "t", float(m)) for i, n in ids for m in range(n)],
                                 "ID long, timestamp timestamp_ntz, type string, value double")


def test_load_batches(spark, tmp_path):
    path = str(tmp_path / "load")
    facts = _facts(spark, [(1, 3), (2, 5), (3, 2000), (9, 4)])
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (2,), (None,)], "ID long")
    got = {r.batch_no: r for r in load_batches(facts, ids, path, 2).collect()}
    assert {k: (r.n_ids, r.rows) for k, r in got.items()} == {1: (2, 8), 2: (2, 2000), 3: (1, 0)}
    for k in (1, 2):
        folder = tmp_path / "load" / f"batch_no={k}"
        assert got[k].bytes == sum(f.stat().st_size for f in folder.glob("*.parquet"))
        assert got[k].seconds > 0 and got[k].rows_per_s == got[k].rows / got[k].seconds
    assert got[3].bytes == 0 and got[3].rows_per_s == 0.0
    assert list_files(spark, path).get("_SUCCESS") is not None
    kept = spark.read.parquet(path)
    assert kept.count() == 2008 and set(facts.columns) < set(kept.columns)


def test_load_of_nothing(spark, tmp_path):
    ids = spark.createDataFrame([(1,)], "ID long")
    row, = load_batches(_facts(spark, [(9, 1)]), ids, str(tmp_path / "none"), 2).collect()
    assert (row.rows, row.bytes, row.rows_per_s) == (0, 0, 0.0)


def test_rate_without_time(spark):
    rates = spark.createDataFrame([(10, 2.0), (10, 0.0)], "n long, s double").select(per_second("n", "s").alias("r"))
    assert [r.r for r in rates.collect()] == [5.0, 0.0]


def test_export_reads_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = _facts(spark, [(1, 20)]).mapInArrow(count, "ID long, timestamp timestamp_ntz, type string, value double")
    assert csv_sink.write_export_csv(df, str(tmp_path / "out")) == 20
    assert seen.value == 20
    assert csv_sink.read_export_csv(spark, str(tmp_path / "out"), df.schema).agg(F.sum("value")).first()[0] == 190.0
